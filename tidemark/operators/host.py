"""Host state: disks and their use, partitions, packages, journals, services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Uses of a disk, the first that holds wins.
USES = ("mounted", "lvm", "zfs", "partitions", "filesystem")


def disk_usage(disks: DataFrame, flags: dict[str, DataFrame]) -> DataFrame:
    """Adds usage: the first of USES whose table (column disk) has the disk, else unused. The tables are joined by equality, one by one."""
    out, value = disks, F.lit("unused")
    for use in reversed(USES):
        mark = f"_{use}"
        out = out.join(flags[use].select("disk").distinct().withColumn(mark, F.lit(True)), "disk", "left")
        value = F.when(F.col(mark), use).otherwise(value)
    return out.withColumn("usage", value).drop(*[f"_{u}" for u in USES])


def partition_use(partitions: DataFrame, types: DataFrame) -> DataFrame:
    """Adds use: that of the partition's type id if it is known, else filesystem if it has one, else unused."""
    return partitions.join(types, "type_id", "left").withColumn("use", F.coalesce("known", F.when(F.col("fs").isNotNull(), "filesystem"), F.lit("unused"))).drop("known")


def packages(installed: DataFrame, candidates: DataFrame, dependencies: DataFrame, wanted: Column) -> DataFrame:
    """Installed packages that wanted takes with their candidate versions, and the dependencies that aren't installed (no version)."""
    have = installed.where(wanted).select("package", "version")
    missing = dependencies.join(have.select("package"), "package", "left_semi").select(F.col("needs").alias("package")).distinct().join(installed.select("package"), "package", "left_anti").withColumn("version", F.lit(None).cast("string"))
    return have.unionByName(missing).join(candidates.select("package", "candidate"), "package", "left")


def journal_after(lines: DataFrame, order: list[str], cursor: tuple, limit: int) -> DataFrame:
    """Entries after a cursor in their order, limit of them: a keyset, no offset."""
    after = F.lit(False)
    for c, v in reversed(list(zip(order, cursor, strict=True))):
        after = (F.col(c) > v) | ((F.col(c) == v) & after)
    return lines.where(after).orderBy(*order).limit(limit)


def journal_last(lines: DataFrame, order: list[str], last: int) -> DataFrame:
    """The newest entries, oldest of them first."""
    return lines.orderBy(*[F.desc(c) for c in order]).limit(last).orderBy(*order)


def by_locality(chunks: DataFrame, position: str, tie: str) -> DataFrame:
    """Place of each chunk by its physical position within its prefix, unknown positions last."""
    w = Window.partitionBy(F.substring(tie, 1, 2)).orderBy(F.col(position).asc_nulls_last(), tie)
    return chunks.withColumn("place", F.row_number().over(w))


def resolve_links(links: DataFrame, start: DataFrame, hops: int = 10) -> DataFrame:
    """(path, target): each start path followed through links (path, to), hops times at most; null where it is still a link then."""
    now = start.select("path", F.col("path").alias("target"))
    step = links.select(F.col("path").alias("target"), F.col("to"))
    for _ in range(hops):
        now = now.join(step, "target", "left").select("path", F.coalesce("to", "target").alias("target"))
    return now.join(step.withColumnRenamed("to", "_more"), "target", "left").select("path", F.when(F.col("_more").isNull(), F.col("target")).alias("target"))
