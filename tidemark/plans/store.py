"""Queries on the chunk store: marking, sweeping, uploads, verification, checksums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators import chunkstore as cs
from ..operators.rangejoin import point_join
from ..sources import tables, views
from ..sources.shared import shared_dir
from ..sources.shipping import ship
from ..sources.views import NOW, REF_ORDER, oracle

WRITER = NOW - 5 * 86400
LIVE_FROM = "2001-06-01"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the snapshots that still exist: those of the last months."""
    live = views.table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit(LIVE_FROM).cast("timestamp_ntz")).select(F.col("o_orderkey").alias("sid"))
    return views.refs(spark, sf_dir).join(live, "sid", "left_semi")


_LIVE = "live AS (SELECT r.* FROM v_refs r SEMI JOIN (SELECT o_orderkey AS sid FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01') o USING (sid))"


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with position and byte range."""
    return cs.with_offsets(views.refs(spark, sf_dir), "sid", REF_ORDER).select("sid", "pos", "digest", "size", "start_off", "end_off")


def dynamic_index_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes written with their checks, and the checksums of what was written."""
    e = cs.with_offsets(views.refs(spark, sf_dir), "sid", REF_ORDER)
    return tables.write_dynamic(e.select("sid", "pos", "end_off", "digest"), f"{shared_dir(spark)}/dynamic-index-{uuid.uuid4().hex}")


def fixed_index_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of texts in chunks of 4096 bytes, written in the order of digests."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    c = chunking.fixed_chunks(d, "doc_id", "text", 4096).join(d.select("doc_id", F.octet_length("text").cast("long").alias("total")), "doc_id")
    chunks = c.select(F.col("doc_id").alias("sid"), "total", F.col("start_off").alias("offset"), "size", "digest").orderBy("digest")
    return tables.write_fixed(chunks, f"{shared_dir(spark)}/fixed-index-{uuid.uuid4().hex}", 4096)


def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of indexes, their bytes with repeats, and distinct digests."""
    return views.refs(spark, sf_dir).agg(F.count_distinct("sid").alias("files"), F.sum("size").alias("bytes"), F.count_distinct("digest").alias("digests"))


def chunk_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks by the first hex digit of the digest, names checked."""
    return views.chunks(spark, sf_dir).where(F.col("digest").rlike("^[0-9a-f]{64}$")).groupBy(F.substring("digest", 1, 1).alias("prefix")).agg(F.count("*").alias("chunks"), F.sum("disk_size").alias("bytes"))


def gc_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.missing(views.refs(spark, sf_dir), views.chunks(spark, sf_dir))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.marked(views.chunks(spark, sf_dir), _live(spark, sf_dir), NOW)


def gc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.sweep(_marked(spark, sf_dir), NOW, WRITER)


def gc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.gc_report(_marked(spark, sf_dir), _live(spark, sf_dir), NOW, WRITER)


def chunk_top_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.most_used(views.refs(spark, sf_dir), 20)


def chunk_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes that hold one digest."""
    return views.refs(spark, sf_dir).where(F.col("digest") == F.sha2(F.lit("7"), 256)).select("sid").distinct()


def chunk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store contents after the lines' chunks arrive in a store that has parts."""
    stored = views.chunks(spark, sf_dir).select("digest", F.col("disk_size").alias("size"), (F.col("part") % 9 == 0).alias("encrypted"))
    new = views.refs(spark, sf_dir).select("digest", "size", (F.col("part") % 4 == 0).alias("encrypted"), (F.col("sid") * 10 + F.col("l_linenumber")).alias("seq"))
    return cs.insert(stored, new)


def known_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of each document an upload would send, those of one source being known."""
    lines = views.doc_lines(spark, sf_dir)
    return cs.known_runs(lines, lines.where("source = 'src0'"), "sid", "pos").select("sid", F.col("pos").cast("long").alias("pos"), "known", "run", F.col("batch").cast("long").alias("batch"))


def upload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.doc_lines(spark, sf_dir)
    return cs.upload_report(cs.known_runs(lines, lines.where("source = 'src0'"), "sid", "pos"))


def archive_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive of each entry, for archives of 64 KiB."""
    ship(spark)
    entries = cs.with_offsets(views.refs(spark, sf_dir), "sid", REF_ORDER)
    return cs.archives(entries, "sid", "pos", 65536)


def index_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.index_checksum(cs.with_offsets(views.refs(spark, sf_dir), "sid", REF_ORDER))


def verify_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.verified(views.refs(spark, sf_dir), views.chunks(spark, sf_dir))


def verify_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots due for verification after 30 days, without benchmark groups."""
    s = views.snapshots(spark, sf_dir)
    return s.where(cs.reverify(F.col("verify_state"), F.col("verified"), NOW, 30) & ~((F.col("type") == "host") & (F.col("id") == "7"))).select("type", "id", "sid")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that holds byte 40000 of each index."""
    entries = cs.with_offsets(views.refs(spark, sf_dir), "sid", REF_ORDER).select("sid", "pos", "start_off", "end_off")
    points = entries.select("sid").distinct().withColumn("at", F.lit(40000).cast("long"))
    return point_join(points, entries, ["sid"], "at", ("start_off", "end_off"), 1 << 16).select("sid", "at", "pos", (F.col("at") - F.col("start_off")).alias("inner_off"))


def fixed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk number and place within it of an offset, for chunks of 64 KiB; whether the offset is aligned; the size's validity."""
    at = F.col("size") * 3
    valid = F.col("size").isin(*[1 << i for i in range(16, 23)])
    return views.refs(spark, sf_dir).select("size").distinct().select("size", F.shiftright(at, 16).alias("chunk"), at.bitwiseAND(65535).alias("inner_off"), (at.bitwiseAND(65535) == 0).alias("aligned"), valid.alias("valid_size"))


def index_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made from the previous one, where entries under 16 KiB are new."""
    e = cs.with_offsets(views.refs(spark, sf_dir), "sid", REF_ORDER).select("sid", "pos", "digest", "size")
    new = e.where("size < 16384").select("sid", "pos", F.sha2(F.concat("digest", F.lit("+")), 256).alias("fresh"))
    return e.join(new, ["sid", "pos"], "full_outer").select("sid", "pos", F.coalesce("fresh", "digest").alias("digest"))


def recover_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each index that can be recovered, and those that zeros stand for (missing or bad chunks)."""
    e, c = views.refs(spark, sf_dir), views.chunks(spark, sf_dir).where("not bad").select("digest", F.lit(True).alias("have"))
    return e.join(c, "digest", "left").groupBy("sid").agg(F.coalesce(F.sum(F.when(F.col("have"), F.col("size"))), F.lit(0)).alias("recovered"), F.coalesce(F.sum(F.when(F.col("have").isNull(), F.col("size"))), F.lit(0)).alias("zeros"))


def tape_new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct digests of live snapshots that no tape has (tapes have those over 30000 bytes)."""
    on_tape = views.chunks(spark, sf_dir).where("disk_size > 30000").select("digest")
    return _live(spark, sf_dir).select("digest").distinct().join(on_tape, "digest", "left_anti")


def chunk_write_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of written chunks."""
    c = views.chunks(spark, sf_dir)
    return c.agg(F.count("*").alias("chunks"), F.sum("raw_size").alias("raw"), F.sum("disk_size").alias("disk"), F.expr("sum(raw_size) div count(*)").alias("average"), F.round(F.sum("disk_size") * 100 / F.sum("raw_size"), 4).alias("compression_percent"))


_KNOWN = """k AS (SELECT DISTINCT digest FROM v_lines WHERE source = 'src0'),
a AS (SELECT l.*, k.digest IS NOT NULL OR row_number() OVER (PARTITION BY sid, l.digest ORDER BY pos) > 1 AS known FROM v_lines l LEFT JOIN k ON l.digest = k.digest),
b AS (SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY pos) AS run FROM a)"""
_SWEEP = f"""{_LIVE}, m AS (SELECT c.* EXCLUDE (atime), CASE WHEN u.digest IS NULL THEN atime ELSE {NOW} END AS atime FROM v_chunks c LEFT JOIN (SELECT DISTINCT digest FROM live) u USING (digest)),
s AS (SELECT *, CASE WHEN atime < {min(NOW - 86400, WRITER) - 300} THEN 'removed' WHEN atime < {WRITER} THEN 'pending' ELSE 'kept' END AS state FROM m)"""

QUERIES = {f.__name__: f for f in (index_entries, dynamic_index_written, fixed_index_written, index_totals, chunk_prefixes, gc_missing, gc_classify, gc_report, chunk_top_used, chunk_references, chunk_insert, known_chunks, upload_report, archive_numbers, index_checksums, verify_snapshots, verify_due, point_lookup, fixed_offsets, index_clone, recover_index, tape_new_chunks, chunk_write_stats)}

ORACLE = {
    "index_entries": oracle("v_index") + "SELECT sid, pos, digest, size, CAST(start_off AS BIGINT) AS start_off, CAST(end_off AS BIGINT) AS end_off FROM v_index",
    "index_totals": oracle("v_refs") + "SELECT count(DISTINCT sid) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT digest) AS digests FROM v_refs",
    "chunk_prefixes": oracle("v_chunks") + "SELECT digest[1] AS prefix, count(*) AS chunks, CAST(sum(disk_size) AS BIGINT) AS bytes FROM v_chunks GROUP BY 1",
    "gc_missing": oracle("v_refs", "v_chunks") + "SELECT digest, count(*) AS uses FROM v_refs WHERE digest NOT IN (SELECT digest FROM v_chunks) GROUP BY digest",
    "gc_classify": oracle("v_refs", "v_chunks", ctes=_SWEEP) + "SELECT state, count(*) FILTER (NOT bad OR state = 'removed') AS chunks, CAST(sum(disk_size) AS BIGINT) AS bytes, count(*) FILTER (bad) AS bad FROM s GROUP BY state",
    "gc_report": oracle("v_refs", "v_chunks", ctes=_SWEEP) + """, i AS (SELECT count(DISTINCT sid) AS index_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS index_bytes FROM live),
d AS (SELECT CAST(coalesce(sum(disk_size) FILTER (state <> 'removed'), 0) AS BIGINT) AS disk_bytes, count(*) FILTER (state <> 'removed' AND NOT bad) AS disk_chunks,
  CAST(coalesce(sum(disk_size) FILTER (state = 'removed'), 0) AS BIGINT) AS removed_bytes, count(*) FILTER (state = 'removed') AS removed_chunks, count(*) FILTER (state = 'pending') AS pending_chunks FROM s)
SELECT *, round(CASE WHEN disk_bytes > 0 THEN index_bytes / disk_bytes ELSE 1.0 END, 6) AS factor, round(CASE WHEN index_bytes > 0 THEN disk_bytes * 100 / index_bytes ELSE 0.0 END, 6) AS on_disk_percent,
  CASE WHEN disk_chunks > 0 THEN disk_bytes // disk_chunks ELSE 0 END AS average_chunk FROM i, d""",
    "chunk_top_used": oracle("v_refs") + "SELECT digest, count(*) AS uses FROM v_refs GROUP BY digest HAVING count(*) > 1 ORDER BY uses DESC, digest LIMIT 20",
    "chunk_references": oracle("v_refs") + "SELECT DISTINCT sid FROM v_refs WHERE digest = sha256('7')",
    "chunk_insert": oracle("v_refs", "v_chunks", ctes="""b AS (SELECT digest, disk_size AS size, part % 9 = 0 AS enc, -1 AS seq FROM v_chunks UNION ALL SELECT digest, size, part % 4 = 0, sid * 10 + l_linenumber FROM v_refs),
f AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY size > 0 DESC, seq, size, enc) AS rn FROM b)""") + """SELECT digest, CAST(CASE WHEN NOT bool_or(size > 0) THEN 0 WHEN bool_or(rn = 1 AND enc) THEN max(size) FILTER (rn = 1) ELSE min(size) FILTER (size > 0 AND NOT enc) END AS BIGINT) AS size,
  count(*) > 1 AS duplicate, max(seq) >= 0 AS touched FROM f GROUP BY digest""",
    "known_chunks": oracle("v_lines", ctes=_KNOWN) + "SELECT sid, pos, known, CASE WHEN known THEN CAST(run AS BIGINT) END AS run, CASE WHEN known THEN (row_number() OVER (PARTITION BY sid, known, run ORDER BY pos) - 1) // 64 END AS batch FROM b",
    "upload_report": oracle("v_lines", ctes=_KNOWN) + """, u AS (SELECT sid, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (known) AS duplicates, CAST(coalesce(sum(size) FILTER (NOT known), 0) AS BIGINT) AS uploaded FROM a GROUP BY sid)
SELECT *, CASE WHEN bytes > 0 THEN (bytes - uploaded) * 100 // bytes ELSE 0 END AS reused_percent FROM u""",
    "archive_numbers": oracle("v_index", ctes="""w AS (SELECT sid, pos, size AS held, CAST(0 AS BIGINT) AS archive FROM v_index WHERE pos = 0
UNION ALL SELECT i.sid, i.pos, CASE WHEN held > 65536 THEN i.size ELSE held + i.size END, CASE WHEN held > 65536 THEN archive + 1 ELSE archive END FROM w JOIN v_index i ON i.sid = w.sid AND i.pos = w.pos + 1)""", recursive=True) + "SELECT sid, pos, archive FROM w",
    "dynamic_index_written": oracle("v_index") + "SELECT sid, sha256(string_agg(CAST(end_off AS BIGINT) || ':' || digest, ',' ORDER BY pos)) AS csum, CAST(max(end_off) AS BIGINT) AS size, count(*) AS entries FROM v_index GROUP BY sid",
    "fixed_index_written": """WITH e AS (SELECT doc_id, encode(coalesce(text, '')) AS d, unnest(range(0, strlen(coalesce(text, '')), 4096)) AS off FROM documents)
SELECT doc_id AS sid, off // 4096 AS pos, least(off + 4096, octet_length(d)) AS end_off, sha256(d[off + 1:off + 4096]) AS digest FROM e""",
    "index_checksums": oracle("v_index") + "SELECT sid, sha256(string_agg(CAST(end_off AS BIGINT) || ':' || digest, ',' ORDER BY pos)) AS csum, CAST(max(end_off) AS BIGINT) AS size, count(*) AS entries FROM v_index GROUP BY sid",
    "verify_snapshots": oracle("v_refs", "v_chunks") + "SELECT sid, count(*) AS refs, count(*) FILTER (c.digest IS NULL) AS missing, count(*) FILTER (bad) AS bad, bool_and(c.digest IS NOT NULL AND NOT bad) AS ok FROM v_refs r LEFT JOIN v_chunks c ON r.digest = c.digest GROUP BY sid",
    "verify_due": oracle("v_snapshots") + f"SELECT type, id, sid FROM v_snapshots WHERE (verify_state IS NULL OR floor(({NOW} - verified) / 86400) > 30) AND NOT (type = 'host' AND id = '7')",
    "point_lookup": oracle("v_index") + "SELECT sid, CAST(40000 AS BIGINT) AS at, pos, CAST(40000 - start_off AS BIGINT) AS inner_off FROM v_index WHERE start_off <= 40000 AND 40000 < end_off",
    "fixed_offsets": oracle("v_refs") + "SELECT DISTINCT size, size * 3 // 65536 AS chunk, size * 3 % 65536 AS inner_off, size * 3 % 65536 = 0 AS aligned, size IN (65536, 131072, 262144, 524288, 1048576, 2097152, 4194304) AS valid_size FROM v_refs",
    "index_clone": oracle("v_index") + "SELECT sid, pos, CASE WHEN size < 16384 THEN sha256(digest || '+') ELSE digest END AS digest FROM v_index",
    "recover_index": oracle("v_refs", "v_chunks") + "SELECT sid, CAST(coalesce(sum(size) FILTER (c.digest IS NOT NULL), 0) AS BIGINT) AS recovered, CAST(coalesce(sum(size) FILTER (c.digest IS NULL), 0) AS BIGINT) AS zeros FROM v_refs r LEFT JOIN (SELECT digest FROM v_chunks WHERE NOT bad) c ON r.digest = c.digest GROUP BY sid",
    "tape_new_chunks": oracle("v_refs", "v_chunks", ctes=_LIVE) + "SELECT DISTINCT digest FROM live WHERE digest NOT IN (SELECT digest FROM v_chunks WHERE disk_size > 30000)",
    "chunk_write_stats": oracle("v_chunks") + "SELECT count(*) AS chunks, CAST(sum(raw_size) AS BIGINT) AS raw, CAST(sum(disk_size) AS BIGINT) AS disk, CAST(sum(raw_size) // count(*) AS BIGINT) AS average, round(sum(disk_size) * 100 / sum(raw_size), 4) AS compression_percent FROM v_chunks",
}
