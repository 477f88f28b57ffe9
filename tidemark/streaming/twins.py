"""Streaming forms of batch operators. Each reads a stream, and its result equals the batch one once the stream has ended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import shared_dir

#: Wide enough that nothing of the data here is late.
WATERMARK = "400 days"


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over Parquet at path, of the schema that it has now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def dedup(stream: DataFrame, key: str, time: str | None = None) -> DataFrame:
    """The first row of each key; with a time column, state is dropped once the watermark has passed."""
    return stream.withWatermark(time, WATERMARK).dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])


def roll_up(stream: DataFrame, time: str, name: str, value: str, resolution: str) -> DataFrame:
    """Average and maximum by name and tumbling window."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", WATERMARK)
    out = timed.groupBy(name, F.window("_t", resolution).alias("w")).agg(F.round(F.avg(value), 6).alias("average"), F.round(F.max(value), 6).alias("maximum"), F.count("*").alias("n"))
    return out.select(name, F.col("w.start").alias("start"), "average", "maximum", "n")


def drain(stream: DataFrame, spark: SparkSession, mode: str, shared: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, into Parquet or, for updated aggregates, into the last state; the result as a batch."""
    base = f"{shared or shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows")
        _finish(q)
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def replace(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/{n}")

    q = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    _finish(q)
    last = max((p["batchId"] for p in q.recentProgress if p["batchId"] is not None), default=0)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows/{last}")


def _finish(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


def line_protocol(rows: DataFrame, measurement: str, tags: list[str], fields: list[str], time: str) -> DataFrame:
    """Points as lines of text: measurement,tags fields time."""
    tag = F.concat_ws(",", F.lit(measurement), *[F.concat(F.lit(f"{t}="), F.regexp_replace(F.col(t).cast("string"), "([ ,=])", r"\\$1")) for t in tags])
    value = F.concat_ws(",", *[F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in fields])
    return rows.select(F.concat_ws(" ", tag, value, F.col(time).cast("string")).alias("line"))
