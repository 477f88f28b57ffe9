"""Sync planning: what a pull fetches, what has vanished, which snapshots are transferred, and upserts of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group's rows are dealt over.
SALTS = 64


def fetch_set(needed: DataFrame, present: DataFrame, key: str = "digest") -> DataFrame:
    """Distinct needed keys that aren't present."""
    return needed.select(key).distinct().join(present.select(key), key, "left_anti")


def vanished(local: DataFrame, remote: DataFrame, keys: list[str], protected: str | None = None) -> DataFrame:
    """Local rows that the source doesn't have; protected ones stay out."""
    out = local.join(remote.select(*keys), keys, "left_anti")
    return out.where(~F.coalesce(F.col(protected), F.lit(False))) if protected else out


def transfer_plan(remote: DataFrame, last_synced: DataFrame, group: list[str], time: str, transfer_last: int | None) -> DataFrame:
    """Adds action to the source's snapshots: skip-synced, skip-last or transfer.

    last_synced has the newest local time of each group. Rows up to it are skipped, but the newest of them is looked at again; with
    transfer_last only the newest so many are transferred, except that the first row after skipped ones always is. Rows of equal times in a
    group are treated alike. No task holds a group: it gives sums and, by salt, its newest rows.
    """
    out = remote.join(last_synced.withColumnRenamed(time, "_last"), group, "left")
    old = F.coalesce(F.col(time) < F.col("_last"), F.lit(False))
    action = F.when(old, "skip-synced")
    if transfer_last is not None:
        bounds = out.groupBy(*group).agg(F.count_if(old).alias("_olds"), F.min(F.when(~old, F.col(time))).alias("_next"))
        newest = remote.select(*group, time).withColumn("_salt", F.pmod(F.xxhash64(time), F.lit(SALTS)))
        back = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(F.desc(time)))
        newest = newest.withColumn("_back", back).where(F.col("_back") <= transfer_last).drop("_back", "_salt")
        # the oldest of the newest so many
        newest = newest.withColumn("_back", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(time)))).where(F.col("_back") <= transfer_last)
        out = out.join(bounds.join(newest.groupBy(*group).agg(F.min(time).alias("_least")), group, "left"), group, "left")
        after = (F.col("_olds") > 0) & (F.col(time) == F.col("_next"))
        action = action.when(F.coalesce(F.col(time) < F.col("_least"), F.lit(transfer_last < 1)) & ~after, "skip-last")
    return out.select(*remote.columns, action.otherwise("transfer").alias("action"))


def skipped(planned: DataFrame, group: list[str], time: str) -> DataFrame:
    """Runs of rows skipped for the same reason: count, first and last time."""
    w = Window.partitionBy(*group).orderBy(time)
    start = F.col("action") != F.coalesce(F.lag("action").over(w), F.lit(""))
    runs = planned.withColumn("run", F.sum(start.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("action <> 'transfer'").groupBy(*group, "run", "action").agg(F.count("*").alias("skipped"), F.min(time).alias("first"), F.max(time).alias("last"))


def upsert(existing: DataFrame, retrieved: DataFrame, key: str, fields: list[str], clear: list[str]) -> DataFrame:
    """Full outer upsert: retrieved values win; a field that wasn't retrieved is cleared if listed in clear, else the old one stays.

    action is new, changed, same or vanished; vanished rows keep their values.
    """
    old = existing.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields], F.lit(True).alias("_old"))
    new = retrieved.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_new"))

    def value(f: str) -> Column:
        kept = F.lit(None) if f in clear else F.col(f"_old_{f}")
        return F.when(F.col("_new").isNull(), F.col(f"_old_{f}")).otherwise(F.coalesce(F.col(f"_new_{f}"), kept))

    out = old.join(new, key, "full_outer").withColumns({f: value(f) for f in fields})
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_old_{f}"))
    action = F.when(F.col("_new").isNull(), "vanished").when(F.col("_old").isNull(), "new").when(same, "same").otherwise("changed")
    return out.select(key, *fields, action.alias("action"))


def file_actions(source: DataFrame, target: DataFrame, key: list[str], checksum: str) -> DataFrame:
    """For each file of the source: skip if the target has it with the same checksum, else fetch."""
    have = target.select(*key, F.col(checksum).alias("_have"))
    return source.join(have, key, "left").withColumn("action", F.when(F.col("_have").eqNullSafe(F.col(checksum)), "skip").otherwise("fetch")).drop("_have")
