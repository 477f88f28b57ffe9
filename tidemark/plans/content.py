"""Queries on contents: chunking, deduplication, blobs, varints, reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import views
from ..sources.shipping import ship
from ..sources.views import oracle
from ..streaming import twins


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 4096 bytes of each text."""
    return chunking.fixed_chunks(_texts(spark, sf_dir), "doc_id", "text", 4096)


def chunk_fixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 64 characters of part names repeated, in a form that SQL has too."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.repeat("p_name", 20).alias("d"))
    return chunking.fixed_chunks(p, "p_partkey", "d", 64)


def chunk_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks of about 1 KiB of each text."""
    return chunking.chunk_streams(_texts(spark, sf_dir), "doc_id", "text", 1024)


def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well lines, and whole texts, deduplicate."""
    lines = views.doc_lines(spark, sf_dir).select(F.lit("line").alias("unit"), "digest", "size")
    whole = _texts(spark, sf_dir).select(F.lit("text").alias("unit"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    each = lines.unionByName(whole).groupBy("unit", "digest").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return each.groupBy("unit").agg(F.sum("n").alias("chunks"), F.count("*").alias("distinct"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("stored"))


def dedup_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of content-defined chunks."""
    each = chunk_dynamic(spark, sf_dir).groupBy("digest").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return each.agg(F.sum("n").alias("chunks"), F.count("*").alias("distinct"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("stored"))


def verify_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose stored digest (spoilt for some) is wrong, each distinct content looked at once."""
    d = _texts(spark, sf_dir).withColumn("stored", F.sha2(F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256))
    return d.select("doc_id", (F.sha2("text", 256) == F.col("stored")).alias("ok"), F.octet_length("text").cast("long").alias("size"))


def blob_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.blob_round_trip(_texts(spark, sf_dir), "doc_id", "text")


def blob_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encrypted with authentication and opened again; one byte changed, or another key, opens nothing."""
    key, other = F.lit(b"0123456789abcdef0123456789abcdef"), F.lit(b"fedcba9876543210fedcba9876543210")
    t = views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    blob = F.col("blob")
    spoilt = F.concat(F.substring(blob, F.lit(1), F.length(blob) - 1), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(blob, F.length(blob), F.lit(1))), 16, 10).cast("long").bitwiseXOR(1)), 2, "0")))
    sealed = t.withColumn("blob", chunking.sealed(F.col("text"), key))
    again = F.sha2(chunking.opened(blob, key), 256).alias("digest")
    return sealed.select("doc_id", again, (F.length(blob) - 28).cast("long").alias("size"), chunking.opened(spoilt, key).isNotNull().alias("spoilt_opens"), chunking.opened(blob, other).isNotNull().alias("other_key_opens"))


def stream_chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a fixed size, from a stream of texts."""
    s = twins.read(spark, f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return twins.drain(chunking.fixed_chunks(s, "doc_id", "text", 4096), spark, "append")


def stream_chunk_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks, from a stream of texts: bytes and chunks by text."""
    ship(spark)
    s = twins.read(spark, f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = twins.drain(chunking.chunk_streams(s, "doc_id", "text", 1024), spark, "append")
    return out.groupBy("doc_id").agg(F.sum("size").alias("size"), (F.max("pos") + 1 == F.count("*")).alias("whole"))


def crc32_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


def varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys and their negatives as varints, and the unsigned ones read back."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v"))
    return o.select("v", F.lower(chunking.varint(F.col("v"))).alias("hex"), chunking.varint_value(chunking.varint(F.col("v"))).alias("back"))


def signed_varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 5000).alias("v"))
    return o.select("v", F.lower(chunking.signed_varint(F.col("v"))).alias("hex"))


def zero_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of zero chunks of several sizes."""
    return spark.createDataFrame([(n, chunking.zero_digest(n)) for n in (4096, 65536)], "size long, digest string")


def read_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 100 to 180 of each repeated part name, from its chunks."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.repeat("p_name", 20).alias("d"))
    c = p.select("p_partkey", F.col("d").cast("binary").alias("d"), F.explode(F.sequence(F.lit(0), F.octet_length("d") - 1, F.lit(64))).alias("at")).select("p_partkey", F.col("at").cast("long").alias("start_off"), F.substring(F.col("d"), F.col("at") + 1, F.lit(64)).alias("data"))
    return chunking.read_at(c, "p_partkey", 100, 80).select("p_partkey", F.decode("data", "UTF-8").alias("data"))


def _varint_sql(v: str) -> str:
    byte = lambda i: f"printf('%02x', CAST({v} // {128**i} % 128 + CASE WHEN {v} >= {128 ** (i + 1)} THEN 128 ELSE 0 END AS INTEGER))"
    return byte(0) + "".join(f" || CASE WHEN {v} >= {128**i} THEN {byte(i)} ELSE '' END" for i in range(1, 5))


def _signed_sql(v: str) -> str:
    a = f"abs({v})"
    byte = lambda i: f"printf('%02x', CAST({a} // {128**i} % 128 + 128 AS INTEGER))"
    return f"CASE WHEN {v} >= 0 THEN {_varint_sql(a)} ELSE {byte(0)}" + "".join(f" || CASE WHEN {a} >= {128**i} THEN {byte(i)} ELSE '' END" for i in range(1, 5)) + " || '00' END"


QUERIES = {f.__name__: f for f in (chunk_fixed, chunk_fixed_ids, chunk_dynamic, dedup_stats, dedup_dynamic, verify_digests, blob_round_trip, crc32_texts, blob_sealed, stream_chunk_fixed, stream_chunk_dynamic, varints, signed_varints, zero_digests, read_at)}

_FIXED = """WITH e AS (SELECT doc_id, encode(coalesce(text, '')) AS d, unnest(range(0, strlen(coalesce(text, '')), 4096)) AS off FROM documents)
SELECT doc_id, off // 4096 AS pos, off AS start_off, CAST(octet_length(d[off + 1:off + 4096]) AS BIGINT) AS size, sha256(d[off + 1:off + 4096]) AS digest FROM e"""

ORACLE = {
    "chunk_fixed": _FIXED,
    "stream_chunk_fixed": _FIXED,
    "stream_chunk_dynamic": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, true AS whole FROM documents WHERE text <> ''",
    "blob_sealed": "SELECT doc_id, sha256(coalesce(text, '')) AS digest, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, false AS spoilt_opens, false AS other_key_opens FROM documents",
    "chunk_fixed_ids": """WITH p AS (SELECT p_partkey, repeat(p_name, 20) AS d FROM part), e AS (SELECT p_partkey, d, unnest(range(0, strlen(d), 64)) AS off FROM p)
SELECT p_partkey, e.off // 64 AS pos, e.off AS start_off, CAST(strlen(substr(d, e.off + 1, 64)) AS BIGINT) AS size, sha256(substr(d, e.off + 1, 64)) AS digest FROM e""",
    "dedup_stats": oracle("v_lines") + """, a AS (SELECT 'line' AS unit, digest, size FROM v_lines UNION ALL SELECT 'text', sha256(coalesce(text, '')), strlen(coalesce(text, '')) FROM documents),
b AS (SELECT unit, digest, count(*) AS n, max(size) AS size FROM a GROUP BY unit, digest)
SELECT unit, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS "distinct", CAST(sum(n * size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS stored FROM b GROUP BY unit""",
    "verify_digests": "SELECT doc_id, doc_id % 19 <> 0 AS ok, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents",
    "varints": f"SELECT o_orderkey AS v, {_varint_sql('o_orderkey')} AS hex, o_orderkey AS back FROM orders",
    "signed_varints": f"SELECT o_orderkey - 5000 AS v, {_signed_sql('(o_orderkey - 5000)')} AS hex FROM orders",
    "zero_digests": "SELECT CAST(n AS BIGINT) AS size, sha256(CAST(repeat(chr(0), n) AS BLOB)) AS digest FROM (VALUES (4096), (65536)) v(n)",
    "read_at": "SELECT p_partkey, substr(repeat(p_name, 20), 101, 80) AS data FROM part WHERE length(p_name) * 20 > 100",
}
