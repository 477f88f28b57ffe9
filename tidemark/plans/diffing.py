"""Queries that compare snapshots and plan syncs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunkstore as cs
from ..operators import diffing, syncing
from ..operators.rangejoin import overlap_join
from ..sources import views
from ..sources.views import REF_ORDER, oracle


def digest_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests on one side only, of the smaller and the larger half of all entries."""
    r = views.refs(spark, sf_dir)
    return diffing.symmetric_difference(r.where("size <= 25600"), r.where("size > 25600"))


def _files(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Entries of one side of a comparison: path, size, mtime, mode, content."""
    p = views.table(spark, sf_dir, "part").where(f"p_size <> {side}")
    edit = F.lit(side) * (F.col("p_partkey") % 3 == 0).cast("int")
    return p.select(F.concat(F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") + edit).cast("long").alias("size"), (F.col("p_partkey") * 60 + F.lit(side) * (F.col("p_partkey") % 2)).alias("mtime"), F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("mode"), F.sha2(F.concat_ws("-", "p_name", edit.cast("string")), 256).alias("content"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, deleted and modified files by properties alone: a change of size isn't reported."""
    out = diffing.compare(_files(spark, sf_dir, 1), _files(spark, sf_dir, 2), ["path"], ["mtime", "mode"])
    return out.where("state <> 'same'").select("path", "state")


def snapshot_diff_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with contents: files of which only the time differs are the same."""
    out = diffing.compare(_files(spark, sf_dir, 1), _files(spark, sf_dir, 2), ["path"], ["mtime", "mode"], content="content", mtime="mtime")
    return out.where("state <> 'same'").select("path", "state")


def range_overlap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (ranges of 50000 bytes of an archive) that touch a changed chunk."""
    e = cs.with_offsets(views.refs(spark, sf_dir), "sid", REF_ORDER).select("sid", "pos", "start_off", "end_off", "size")
    total = e.groupBy("sid").agg(F.max("end_off").alias("total"))
    files = total.select("sid", F.explode(F.expr("sequence(0L, total div 50000)")).alias("file"), "total").select("sid", "file", (F.col("file") * 50000).alias("fs"), F.least((F.col("file") + 1) * 50000, F.col("total")).alias("fe")).where("fs < fe")
    chunks = e.where("size > 40960").select("sid", "pos", F.col("start_off").alias("c_start"), F.col("end_off").alias("c_end"))
    return overlap_join(files, chunks, ["sid"], ("fs", "fe"), ("c_start", "c_end"), 1 << 16, touching=True).select("sid", "file").distinct()


def sync_missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pull fetches: digests that aren't there and weren't fetched before."""
    there = views.chunks(spark, sf_dir).where("disk_size > 25000")
    return syncing.fetch_set(views.refs(spark, sf_dir), there)


def sync_vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local snapshots that the source lost; protected ones stay."""
    s = views.snapshots(spark, sf_dir)
    return syncing.vanished(s, s.where("size >= 80000"), ["type", "id", "time"], "protected").select("type", "id", "time")


def sync_vanished_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local groups of one owner that the source lost."""
    s = views.snapshots(spark, sf_dir)
    groups = s.where("owner = 'user3@local'").select("type", "id").distinct()
    return syncing.vanished(groups, s.where("crypt_mode = 'encrypt'").select("type", "id").distinct(), ["type", "id"])


def sync_vanished_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local namespaces that the source lost, with the depth that orders their removal (deepest first)."""
    n = views.namespaces(spark, sf_dir).select(F.array_join("ns", "/").alias("path"), F.size("ns").alias("depth"))
    return syncing.vanished(n, n.where(~F.col("path").like("A%")), ["path"]).select("path", "depth")


def _transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.snapshots(spark, sf_dir).where("finished").select("type", "id", "time", "protected")
    synced = s.where("protected").groupBy("type", "id").agg(F.min("time").alias("time"))
    return syncing.transfer_plan(s, synced, ["type", "id"], "time", 2)


def transfer_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transfer(spark, sf_dir).select("type", "id", "time", "action")


def skip_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncing.skipped(_transfer(spark, sf_dir), ["type", "id"], "time")


def user_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users of a realm, updated from a directory that lacks some and misses some fields."""
    c = views.table(spark, sf_dir, "customer")
    old = c.where("c_mktsegment <> 'BUILDING'").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("comment"))
    new = c.where("c_acctbal >= 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.lit("x")).alias("comment"))
    return syncing.upsert(old, new, "c_custkey", ["name", "comment"], ["comment"])


def file_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each snapshot to fetch, those with the same checksum being there."""
    p = views.table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("file"), F.md5("p_name").alias("csum"))
    b = p.where("p_type <> 'SMALL'").select(F.col("p_partkey").alias("file"), F.md5(F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("csum"))
    return syncing.file_actions(a, b, ["file"], "csum")


def unreferenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk that no manifest lists."""
    p = views.table(spark, sf_dir, "part")
    disk = p.select(F.concat("p_brand", F.lit("."), (F.col("p_size") % 9).cast("string")).alias("filename"))
    listed = disk.where(F.col("filename").rlike("[0-5]$"))
    return disk.select("filename").distinct().join(listed.distinct(), "filename", "left_anti")


def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store-wide figures of a pull: snapshots by action."""
    return _transfer(spark, sf_dir).groupBy("action").agg(F.count("*").alias("snapshots"), F.count_distinct("type", "id").alias("groups"))


QUERIES = {f.__name__: f for f in (digest_symdiff, snapshot_diff, snapshot_diff_content, range_overlap_files, sync_missing_chunks, sync_vanished, sync_vanished_groups, sync_vanished_namespaces, transfer_last, skip_runs, user_upsert, file_sync, unreferenced_files, sync_summary)}


def _side(n: int) -> str:
    e = f"{n} * CAST(p_partkey % 3 = 0 AS INTEGER)"
    return f"""(SELECT '/' || p_brand || '/' || p_partkey AS path, p_partkey * 60 + {n} * (p_partkey % 2) AS mtime, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS mode,
  sha256(p_name || '-' || CAST({e} AS VARCHAR)) AS content FROM part WHERE p_size <> {n})"""


_TRANSFER = """f AS (SELECT type, id, time, protected FROM v_snapshots WHERE finished), l AS (SELECT type, id, min(time) AS last FROM f WHERE protected GROUP BY type, id),
o AS (SELECT f.*, coalesce(time < last, false) AS old, row_number() OVER (PARTITION BY f.type, f.id ORDER BY time DESC) - 1 AS back FROM f LEFT JOIN l USING (type, id)),
a AS (SELECT *, coalesce(lag(old) OVER (PARTITION BY type, id ORDER BY time), false) AND NOT old AS after FROM o),
t AS (SELECT type, id, time, CASE WHEN old THEN 'skip-synced' WHEN back >= 2 AND NOT after THEN 'skip-last' ELSE 'transfer' END AS action FROM a)"""

ORACLE = {
    "digest_symdiff": oracle("v_refs") + """, a AS (SELECT digest FROM v_refs WHERE size <= 25600), b AS (SELECT digest FROM v_refs WHERE size > 25600)
(SELECT digest, 'a' AS side FROM (SELECT digest FROM a EXCEPT SELECT digest FROM b)) UNION ALL (SELECT digest, 'b' AS side FROM (SELECT digest FROM b EXCEPT SELECT digest FROM a))""",
    "snapshot_diff": f"""SELECT path, CASE WHEN a.mtime IS NULL THEN 'added' WHEN b.mtime IS NULL THEN 'deleted' ELSE 'modified' END AS state
FROM {_side(1)} a FULL JOIN {_side(2)} b USING (path) WHERE a.mtime IS NULL OR b.mtime IS NULL OR a.mtime IS DISTINCT FROM b.mtime OR a.mode IS DISTINCT FROM b.mode""",
    "snapshot_diff_content": f"""SELECT path, CASE WHEN a.mtime IS NULL THEN 'added' WHEN b.mtime IS NULL THEN 'deleted' ELSE 'modified' END AS state
FROM {_side(1)} a FULL JOIN {_side(2)} b USING (path) WHERE a.mtime IS NULL OR b.mtime IS NULL OR a.mode IS DISTINCT FROM b.mode OR a.content <> b.content""",
    "range_overlap_files": oracle("v_index") + """, t AS (SELECT sid, CAST(max(end_off) AS BIGINT) AS total FROM v_index GROUP BY sid),
f AS (SELECT sid, file, file * 50000 AS fs, least((file + 1) * 50000, total) AS fe FROM (SELECT sid, total, unnest(range(0, total // 50000 + 1)) AS file FROM t))
SELECT DISTINCT f.sid, f.file FROM f JOIN v_index c ON f.sid = c.sid AND fs < end_off AND fe >= start_off WHERE fs < fe AND size > 40960""",
    "sync_missing_chunks": oracle("v_refs", "v_chunks") + "SELECT DISTINCT digest FROM v_refs WHERE digest NOT IN (SELECT digest FROM v_chunks WHERE disk_size > 25000)",
    "sync_vanished": oracle("v_snapshots") + "SELECT type, id, time FROM v_snapshots a WHERE NOT protected AND NOT EXISTS (SELECT 1 FROM v_snapshots b WHERE b.size >= 80000 AND a.type = b.type AND a.id = b.id AND a.time = b.time)",
    "sync_vanished_groups": oracle("v_snapshots") + "SELECT type, id FROM v_snapshots WHERE owner = 'user3@local' EXCEPT SELECT type, id FROM v_snapshots WHERE crypt_mode = 'encrypt'",
    "sync_vanished_namespaces": oracle("v_namespaces") + "SELECT array_to_string(ns, '/') AS path, CAST(len(ns) AS INTEGER) AS depth FROM v_namespaces WHERE array_to_string(ns, '/') LIKE 'A%'",
    "transfer_last": oracle("v_snapshots", ctes=_TRANSFER) + "SELECT * FROM t",
    "skip_runs": oracle("v_snapshots", ctes=_TRANSFER) + """, g AS (SELECT *, CASE WHEN action IS DISTINCT FROM lag(action) OVER (PARTITION BY type, id ORDER BY time) THEN 1 ELSE 0 END AS start FROM t),
r AS (SELECT *, CAST(sum(start) OVER (PARTITION BY type, id ORDER BY time) AS BIGINT) AS run FROM g)
SELECT type, id, run, action, count(*) AS skipped, min(time) AS first, max(time) AS last FROM r WHERE action <> 'transfer' GROUP BY type, id, run, action""",
    "user_upsert": """WITH o AS (SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS comment FROM customer WHERE c_mktsegment <> 'BUILDING'),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'x' END AS comment, true AS there FROM customer WHERE c_acctbal >= 0),
j AS (SELECT c_custkey, n.there, o.c_custkey AS had, o.name AS on_, o.comment AS oc, CASE WHEN n.there THEN coalesce(n.name, o.name) ELSE o.name END AS name, CASE WHEN n.there THEN n.comment ELSE o.comment END AS comment FROM o FULL JOIN n USING (c_custkey))
SELECT c_custkey, name, comment, CASE WHEN there IS NULL THEN 'vanished' WHEN had IS NULL THEN 'new' WHEN name IS NOT DISTINCT FROM on_ AND comment IS NOT DISTINCT FROM oc THEN 'same' ELSE 'changed' END AS action FROM j""",
    "file_sync": "SELECT p_partkey AS file, md5(p_name) AS csum, CASE WHEN p_type <> 'SMALL' AND (p_partkey % 5 <> 0 OR upper(p_name) = p_name) THEN 'skip' ELSE 'fetch' END AS action FROM part",
    "unreferenced_files": "SELECT p_brand || '.' || (p_size % 9) AS filename FROM part EXCEPT SELECT p_brand || '.' || (p_size % 9) FROM part WHERE regexp_matches(p_brand || '.' || (p_size % 9), '[0-5]$')",
    "sync_summary": oracle("v_snapshots", ctes=_TRANSFER) + "SELECT action, count(*) AS snapshots, count(DISTINCT type || '/' || id) AS groups FROM t GROUP BY action",
}
