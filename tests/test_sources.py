"""Sources, sinks, table functions and streams."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import table
from tidemark.operators import chunking
from tidemark.sources import tables
from tidemark.streaming import twins


def test_index_round_trip(spark, tmp_path):
    rows = [(1, k, (k + 1) * 10, f"{k:064x}") for k in range(50)]
    path = f"file://{tmp_path}/index"
    tables.write_index(spark.createDataFrame(rows, tables.INDEX), path, 3)
    assert sorted(map(tuple, tables.read_index(spark, path).collect())) == rows
    tables.write_index(spark.createDataFrame([(1, 0, 10, "nonsense")], tables.INDEX), path)
    with pytest.raises(PySparkException):
        tables.read_index(spark, path).collect()


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_data_source(spark):
    spark.dataSource.register(tables.ZeroChunks)
    df = spark.read.format("zero_chunks").option("images", 2).option("chunks", 3).option("step", 100).load()
    assert sorted(map(tuple, df.collect())) == [(i, k, 100 * (k + 1)) for i in range(2) for k in range(3)]


def test_chunk_text(spark):
    table.register(spark)
    data = "some text " * 500
    spark.createDataFrame([(data,)], "d string").createOrReplaceTempView("chunk_input")
    got = spark.sql("SELECT c.* FROM chunk_input, LATERAL chunk_text(encode(d, 'UTF-8'), 512) c").collect()
    ends = chunking.cuts(data.encode(), 512)
    assert [r["size"] for r in sorted(got, key=lambda r: r["pos"])] == [b - a for a, b in zip([0, *ends], ends)]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, i % 7, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k long, v double").withColumn("t", F.timestamp_seconds(F.col("i") * 600))
    path = f"file://{tmp_path}/events.parquet"
    df.repartition(5).write.parquet(path)
    distinct = twins.drain(twins.dedup(twins.read(spark, path).select("k"), "k"), spark, "append")
    assert sorted(r["k"] for r in distinct.collect()) == list(range(7))
    rolled = twins.drain(twins.roll_up(twins.read(spark, path), "t", "k", "v", "1 day"), spark, "complete")
    want = df.groupBy("k", F.window("t", "1 day").alias("w")).agg(F.avg("v").alias("a"), F.max("v").alias("m"), F.count("*").alias("n"))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, rolled.select("k", "start", "average", "maximum", "n").collect()), key=key) == sorted(map(tuple, want.select("k", "w.start", F.round("a", 6), F.round("m", 6), "n").collect()), key=key)
    with_time = twins.drain(twins.dedup(twins.read(spark, path).select("k", "t"), "k", "t").select("k"), spark, "append")
    assert sorted(r["k"] for r in with_time.collect()) == list(range(7))


def test_lines(spark):
    out = twins.line_protocol(spark.createDataFrame([("a b", 1, 5)], "host string, v int, t long"), "m", ["host"], ["v"], "t")
    assert out.first()["line"] == "m,host=a\\ b v=1 5"


def test_index_writers_check_what_they_write(spark, tmp_path):
    digest = lambda i: f"{i:064x}"
    good = [(1, 0, 10, digest(1)), (1, 1, 30, digest(2)), (2, 0, 5, digest(3))]
    schema = "sid long, pos long, end_off long, digest string"
    out = {r["sid"]: r for r in tables.write_dynamic(spark.createDataFrame(good, schema), str(tmp_path / "a")).collect()}
    assert (out[1]["entries"], out[1]["size"]) == (2, 30)
    for bad in ((1, 2, 30, digest(4)), (1, 2, 40, "x")):
        with pytest.raises(Exception, match="out of order or broken"):
            tables.write_dynamic(spark.createDataFrame([*good, bad], schema), str(tmp_path / "b"))
    schema = "sid long, total long, offset long, size long, digest string"
    chunks = [(1, 10, 8, 2, digest(3)), (1, 10, 0, 4, digest(1)), (1, 10, 4, 4, digest(2))]
    out = tables.write_fixed(spark.createDataFrame(chunks, schema), str(tmp_path / "c"), 4).orderBy("pos").collect()
    assert [(r["pos"], r["end_off"]) for r in out] == [(0, 4), (1, 8), (2, 10)]
    for bad, why in (([*chunks[:2], (1, 10, 5, 4, digest(2))], "out of place"), (chunks[:2], "missing or twice"), ([*chunks, chunks[1]], "missing or twice"), ([*chunks[:2], (1, 10, 4, 3, digest(2))], "out of place")):
        with pytest.raises(Exception, match=why):
            tables.write_fixed(spark.createDataFrame(bad, schema), str(tmp_path / "d"), 4)
