"""Helpers shared by the corpus operators: durable tables, whole groups out of Arrow batches, text columns."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..sources.shipping import ship


#: Rows of an Arrow batch: texts are large, and a worker holds a batch and what it makes of it.
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """Sends this package to the Python workers; where the session has Spark's default of 10000 rows for an Arrow batch, it gets BATCH_ROWS."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    ship(spark)


_made: set[str] = set()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other call uses; it is removed at the latest when this process ends."""
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_made)
    _made.add(path)
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def _remove(path: str) -> None:
    jvm = SparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def _remove_made() -> None:
    """What a result was still read from, or a failed run left."""
    for path in list(_made):
        try:
            _remove(path)
        except Exception:  # the process ends, perhaps without its JVM
            return


def forget(*tables: DataFrame) -> None:
    """Removes what stash() wrote for tables; nothing lazy may read them any more."""
    for df in tables:
        path = getattr(df, "_tidemark_path", None)
        if path in _made:
            _remove(path)
            _made.discard(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or with more underscores where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, by: int) -> Column:
    """crc32 of a column's text, modulo by; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(by)


#: Keys that the rows of one group are dealt over where a value of the group is joined back to them.
SALTS = 64


def group_value(df: DataFrame, keys: list[str], column: str, part: Callable, whole: Callable, name: str) -> DataFrame:
    """Adds name: an aggregate of column over the rows of equal keys, as part() by salt and whole() over the parts.

    A hot group's rows are dealt over SALTS keys in the join too. Keys must not be null. Both joins are merged: each small table
    sent to all executors would take a few MB of the driver, and components() makes dozens of them.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(column)), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(part(column).alias("_part"))
    total = parts.groupBy(*keys).agg(whole("_part").alias(name))
    return salted.join(parts.join(total.hint("merge"), keys).select(*keys, "_salt", name).hint("merge"), [*keys, "_salt"]).drop("_salt")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches sorted by keys. Holds one batch and one run at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        same = held and all(held[-1].column(held[-1].schema.get_field_index(k))[-1] == c[0] for k, c in zip(keys, columns, strict=True))
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            last = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
