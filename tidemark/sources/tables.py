"""Readers and writers of index tables, and a Python data source for chunk streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.chunkstore import index_checksum

INDEX = T.StructType([T.StructField("sid", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("end_off", T.LongType()), T.StructField("digest", T.StringType())])


def write_index(entries: DataFrame, path: str, prefixes: int | None = None) -> None:
    """Writes entries as Parquet; Spark's commit makes the files visible all at once. Rows are clustered by digest prefix where prefixes is given."""
    out = entries.select("sid", "pos", "end_off", "digest")
    if prefixes:
        out = out.repartition(prefixes, F.substring("digest", 1, 4)).sortWithinPartitions("digest")
    out.write.mode("overwrite").parquet(path)


def write_dynamic(entries: DataFrame, path: str) -> DataFrame:
    """Writes indexes of entries (sid, pos, end_off, digest) and returns (sid, entries, size, csum), csum over end:digest in order.

    Ends that don't grow, and broken digests, fail the job before anything becomes visible: Spark commits files all at once.
    """
    w = Window.partitionBy("sid").orderBy("pos")
    last = F.coalesce(F.lag("end_off").over(w), F.lit(0))
    good = (F.col("end_off") > last) & F.col("digest").rlike("^[0-9a-f]{64}$")
    checked = entries.withColumn("end_off", F.when(good, F.col("end_off")).otherwise(F.raise_error(F.concat(F.lit("entry out of order or broken in index "), F.col("sid").cast("string"))).cast("long")))
    checked.select("sid", "pos", "end_off", "digest").write.mode("overwrite").parquet(path)
    return index_checksum(read_index(entries.sparkSession, path)).select("sid", "entries", "size", "csum")


def write_fixed(chunks: DataFrame, path: str, chunk_size: int) -> DataFrame:
    """Writes indexes of chunks (sid, total, offset, size, digest), in whatever order they come, and returns the entries (sid, pos, end_off, digest).

    A chunk must begin at a multiple of chunk_size and have that size, but for the last one of total bytes; a position twice or missing is an error, too.
    """
    pos = F.floor(F.col("offset") / chunk_size).cast("long")
    end = F.col("offset") + F.col("size")
    aligned = (F.col("offset") % chunk_size == 0) & ((F.col("size") == chunk_size) | (end == F.col("total"))) & (end <= F.col("total"))
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{what} in index "), F.col("sid").cast("string"))).cast("long")
    rows = chunks.select("sid", F.when(aligned, pos).otherwise(wrong("chunk out of place")).alias("pos"), end.alias("end_off"), "digest", "total")
    sums = rows.groupBy("sid").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.max("total").alias("total"))
    sound = sums.where(F.when((F.col("n") == F.col("d")) & (F.col("n") == F.ceil(F.col("total") / chunk_size)), F.lit(1)).otherwise(wrong("chunks missing or twice")) == 1)
    rows.join(sound.select("sid"), "sid").select("sid", "pos", "end_off", "digest").write.mode("overwrite").parquet(path)
    return read_index(chunks.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an index table, of a fixed schema; rows of a wrong digest or offset are an error."""
    rows = spark.read.schema(INDEX).parquet(path)
    good = F.col("digest").rlike("^[0-9a-f]{64}$") & (F.col("end_off") >= 0) & (F.col("pos") >= 0)
    return rows.withColumn("digest", F.when(good, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("broken index entry "), F.coalesce("digest", F.lit("null"))))))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of existing whose keys new doesn't have: for formats without MERGE, to be written to a new place."""
    return new.unionByName(existing.join(new.select(*keys), keys, "left_anti"))


class ZeroChunks(DataSource):
    """Chunk streams of a synthetic image: option images, option chunks for each, option step. format("zero_chunks") after registration."""

    @classmethod
    def name(cls) -> str:
        return "zero_chunks"

    def schema(self) -> str:
        return "image long, pos long, end_off long"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ZeroReader(int(self.options.get("images", 1)), int(self.options.get("chunks", 4)), int(self.options.get("step", 4096)))


class _ZeroReader(DataSourceReader):
    def __init__(self, images: int, chunks: int, step: int):
        self.images, self.chunks, self.step = images, chunks, step

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.images)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k in range(self.chunks):
            yield partition.value, k, (k + 1) * self.step
