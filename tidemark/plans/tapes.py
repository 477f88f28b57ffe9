"""Tape queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tapes
from ..sources import views
from ..sources.views import NOW, oracle


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tapes have which snapshots, and where."""
    r = views.refs(spark, sf_dir)
    return r.select(F.col("sid").alias("snapshot"), F.md5((F.col("part") % 50).cast("string")).alias("uuid"), (F.col("part") % 13).cast("long").alias("file_nr"))


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.media(spark, sf_dir)
    last = m.where("set_uuid IS NOT NULL").groupBy("set_uuid").agg(F.max("seq_nr").alias("top"))
    current = tapes.latest_sets(tapes.media_sets(m)).select(F.col("set_uuid"), F.lit(True).alias("current"))
    joined = m.join(last, "set_uuid", "left").join(current, "set_uuid", "left")
    return joined.withColumn("state", tapes.state(F.col("status"), F.col("set_uuid"), F.coalesce("current", F.lit(False)) & (F.col("seq_nr") == F.col("top"))))


def media_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.media_sets(views.media(spark, sf_dir))


def set_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.usable(tapes.media_sets(views.media(spark, sf_dir))).select("set_uuid", "usable")


def set_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.set_pools(views.media(spark, sf_dir))


def latest_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.latest_sets(tapes.media_sets(views.media(spark, sf_dir)))


def set_next_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.next_starts(tapes.media_sets(views.media(spark, sf_dir))).select("set_uuid", "start", "next_start")


def set_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tapes.media_sets(views.media(spark, sf_dir))
    return s.select("set_uuid", tapes.set_name("%Y-%m-%d %H:%M %id%", F.col("set_uuid"), F.col("start")).alias("name"))


def media_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir).select("uuid", "state")


def media_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiry of each set under a window of ten days and a retention of 60 days, and whether it has passed."""
    s = tapes.next_starts(tapes.media_sets(views.media(spark, sf_dir))).where("start IS NOT NULL")
    out = s.withColumn("expires", tapes.expiry(F.lit(str(10 * 86400)), F.lit(str(60 * 86400)), F.col("start"), F.col("next_start")))
    always = tapes.expiry(F.lit("always"), F.lit(str(86400)), F.col("start"), F.col("next_start"))
    return out.select("set_uuid", "expires", (F.col("expires") <= NOW).alias("expired"), always.alias("expires_always"))


def next_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next medium of each pool, of those that are in reach."""
    m = _stated(spark, sf_dir).where(tapes.available(F.col("location"), ["changer0"], True))
    old = (F.col("state") == "full") & (F.col("set_ctime") < NOW - 250 * 86400)
    return tapes.next_writable(m.withColumn("state", F.when(old, "expired").otherwise(F.col("state"))))


def media_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tapes of pools, without a pool, and of pools that aren't configured, with each branch's defaults."""
    m = views.media(spark, sf_dir)
    known = F.col("pool").isin("Brand#1", "Brand#2", "Brand#3")
    a = m.where("pool IS NOT NULL").where(known).select("uuid", "pool", "set_uuid", F.lit(True).alias("catalog"), "status")
    b = m.where("pool IS NULL").select("uuid", F.lit(None).cast("string").alias("pool"), F.lit(None).cast("string").alias("set_uuid"), F.lit(False).alias("catalog"), "status")
    c = m.where("pool IS NOT NULL").where(~known).select("uuid", "pool", "set_uuid", F.lit(False).alias("catalog"), F.lit("unknown").alias("status"))
    return a.unionByName(b).unionByName(c)


def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets over all pools, once each, with the newest time."""
    return views.media(spark, sf_dir).where("set_uuid IS NOT NULL").groupBy("set_uuid").agg(F.max("set_ctime").alias("set_ctime"))


def tape_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tapes by pool and set, the highest number, and whether some are missing."""
    m = views.media(spark, sf_dir).where("set_uuid IS NOT NULL")
    return m.groupBy("pool", "set_uuid").agg(F.count("*").alias("tapes"), F.max("seq_nr").alias("top")).withColumn("incomplete", F.col("top") + 1 != F.col("tapes"))


def online_tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.media(spark, sf_dir)
    labels = m.where("location = 'changer0'").select("label", F.lit("changer0").alias("changer"), (F.col("status") == "damaged").alias("import_export"))
    return tapes.online(labels, m)


def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = views.snapshots(spark, sf_dir).where("protected AND type = 'vm'").select(F.col("sid").alias("snapshot"))
    return tapes.restore_plan(wanted, _catalog(spark, sf_dir))


def restore_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted snapshots that no tape has."""
    wanted = views.snapshots(spark, sf_dir).select(F.col("sid").alias("snapshot"))
    return wanted.join(_catalog(spark, sf_dir).where("file_nr < 4").select("snapshot"), "snapshot", "left_anti")


def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.catalog_lookup(_catalog(spark, sf_dir))


def tape_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tapes by six optional equalities, three of them given."""
    m = views.media(spark, sf_dir)
    return m.where((F.col("pool") == "Brand#2") & (F.col("status") == "full") & (F.col("location") != "vault")).select("uuid", "label", "set_uuid", "seq_nr")


def tape_backup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished snapshots of filtered groups that no tape has yet."""
    s = views.snapshots(spark, sf_dir).where("finished AND type <> 'ct'").select("type", "id", F.col("sid").alias("snapshot"))
    return s.join(_catalog(spark, sf_dir).where("file_nr < 4").select("snapshot"), "snapshot", "left_anti")


def restorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of tapes that a target lacks, by type: the target has those that aren't encrypted."""
    src = _catalog(spark, sf_dir).select("snapshot").distinct().join(views.snapshots(spark, sf_dir).withColumnRenamed("sid", "snapshot"), "snapshot")
    there = views.snapshots(spark, sf_dir).where("crypt_mode = 'none'").select("type", "id", "time")
    return src.join(there, ["type", "id", "time"], "left_anti").groupBy("type").agg(F.count("*").alias("snapshots"))


QUERIES = {f.__name__: f for f in (media_sets, set_usable, set_pools, latest_set, set_next_start, set_names, media_state, media_expiry, next_media, media_union, distinct_sets, tape_overview, online_tapes, restore_plan, restore_missing, catalog_lookup, tape_content, tape_backup_plan, restorable)}

_SETS = """n AS (SELECT set_uuid, seq_nr, min(label) AS label, count(*) AS n, min(pool) AS pool, max(set_ctime) AS ctime FROM v_media WHERE set_uuid IS NOT NULL GROUP BY set_uuid, seq_nr),
t AS (SELECT set_uuid, min(pool) AS pool, max(ctime) FILTER (seq_nr = 0) AS start, max(seq_nr) AS top, CAST(sum(n) AS BIGINT) AS tapes, max(n) > 1 AS repeated, count(*) AS numbers FROM n GROUP BY set_uuid),
g AS (SELECT set_uuid, unnest(range(0, top + 1)) AS i FROM t),
s AS (SELECT t.*, (SELECT string_agg(coalesce(n.label, ''), ',' ORDER BY i) FROM g LEFT JOIN n ON n.set_uuid = g.set_uuid AND n.seq_nr = g.i WHERE g.set_uuid = t.set_uuid) AS labels, numbers < top + 1 AS incomplete FROM t),
w AS (SELECT pool, max(start) AS start FROM s WHERE start IS NOT NULL GROUP BY pool),
c AS (SELECT pool, min(set_uuid) AS set_uuid, start FROM s JOIN w USING (pool, start) GROUP BY pool, start HAVING count(*) = 1)"""
_STATE = _SETS + """, st AS (SELECT m.*, CASE WHEN status IN ('damaged', 'retired') THEN status WHEN m.set_uuid IS NULL THEN 'free' WHEN c.set_uuid IS NOT NULL AND m.seq_nr = t.top AND status = 'writable' THEN 'writable' ELSE 'full' END AS state
FROM v_media m LEFT JOIN t ON m.set_uuid = t.set_uuid LEFT JOIN c ON m.set_uuid = c.set_uuid)"""
_NEXT = "(SELECT min(start) FROM s b WHERE b.pool = s.pool AND b.start > s.start)"
_CAT = "k AS (SELECT sid AS snapshot, md5(CAST(part % 50 AS VARCHAR)) AS uuid, part % 13 AS file_nr FROM v_refs)"

ORACLE = {
    "media_sets": oracle("v_media", ctes=_SETS) + "SELECT set_uuid, pool, start, labels, tapes, incomplete, repeated FROM s",
    "set_usable": oracle("v_media", ctes=_SETS) + "SELECT set_uuid, NOT incomplete AND NOT repeated AND start IS NOT NULL AS usable FROM s",
    "set_pools": oracle("v_media") + "SELECT set_uuid, min(pool) AS pool FROM v_media WHERE set_uuid IS NOT NULL GROUP BY set_uuid HAVING count(DISTINCT pool) = 1",
    "latest_set": oracle("v_media", ctes=_SETS) + "SELECT * FROM c",
    "set_next_start": oracle("v_media", ctes=_SETS) + f"SELECT set_uuid, start, {_NEXT} AS next_start FROM s",
    "set_names": oracle("v_media", ctes=_SETS) + "SELECT set_uuid, CASE WHEN start IS NULL THEN set_uuid ELSE strftime(to_timestamp(start) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M ') || set_uuid END AS name FROM s",
    "media_state": oracle("v_media", ctes=_STATE) + "SELECT uuid, state FROM st",
    "media_expiry": oracle("v_media", ctes=_SETS) + f""", x AS (SELECT *, {_NEXT} AS nx FROM s WHERE start IS NOT NULL)
SELECT set_uuid, least(start + 864000, coalesce(nx, {tapes.NEVER})) + 5184000 AS expires, least(start + 864000, coalesce(nx, {tapes.NEVER})) + 5184000 <= {NOW} AS expired, CASE WHEN nx IS NULL THEN {tapes.NEVER} ELSE nx + 86400 END AS expires_always FROM x""",
    "next_media": oracle("v_media", ctes=_STATE) + f""", y AS (SELECT *, CASE WHEN state = 'full' AND set_ctime < {NOW - 250 * 86400} THEN 'expired' ELSE state END AS now FROM st WHERE location <> 'vault'),
z AS (SELECT *, CASE WHEN now = 'writable' THEN 0 WHEN now = 'free' AND pool IS NOT NULL THEN 1 WHEN now = 'expired' THEN 2 WHEN now = 'free' THEN 3 END AS prio FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY prio, CASE WHEN prio = 2 THEN set_ctime ELSE ctime END, label) AS rn FROM z WHERE prio IS NOT NULL),
p AS (SELECT DISTINCT pool FROM y WHERE pool IS NOT NULL), sp AS (SELECT label, prio FROM o WHERE pool IS NULL AND rn = 1)
SELECT p.pool, coalesce(o.label, sp.label) AS label, CAST(coalesce(o.prio, sp.prio) AS INTEGER) AS prio FROM p LEFT JOIN o ON o.pool = p.pool AND o.rn = 1, sp""",
    "media_union": oracle("v_media") + "SELECT uuid, pool, CASE WHEN pool IS NOT NULL THEN set_uuid END AS set_uuid, coalesce(pool IN ('Brand#1', 'Brand#2', 'Brand#3'), false) AS catalog, CASE WHEN pool IS NULL OR pool IN ('Brand#1', 'Brand#2', 'Brand#3') THEN status ELSE 'unknown' END AS status FROM v_media",
    "distinct_sets": oracle("v_media") + "SELECT set_uuid, max(set_ctime) AS set_ctime FROM v_media WHERE set_uuid IS NOT NULL GROUP BY set_uuid",
    "tape_overview": oracle("v_media") + "SELECT pool, set_uuid, count(*) AS tapes, max(seq_nr) AS top, max(seq_nr) + 1 <> count(*) AS incomplete FROM v_media WHERE set_uuid IS NOT NULL GROUP BY pool, set_uuid",
    "online_tapes": oracle("v_media") + "SELECT label, 'changer0' AS changer, uuid FROM v_media WHERE location = 'changer0' AND status <> 'damaged'",
    "restore_plan": oracle("v_refs", "v_snapshots", ctes=_CAT) + "SELECT uuid, string_agg(CAST(file_nr AS VARCHAR), ',' ORDER BY file_nr) AS files, max(n) AS snapshots FROM (SELECT DISTINCT uuid, file_nr FROM k WHERE snapshot IN (SELECT sid FROM v_snapshots WHERE protected AND type = 'vm')) JOIN (SELECT uuid, count(DISTINCT snapshot) AS n FROM k WHERE snapshot IN (SELECT sid FROM v_snapshots WHERE protected AND type = 'vm') GROUP BY uuid) USING (uuid) GROUP BY uuid",
    "restore_missing": oracle("v_refs", "v_snapshots", ctes=_CAT) + "SELECT sid AS snapshot FROM v_snapshots WHERE sid NOT IN (SELECT snapshot FROM k WHERE file_nr < 4)",
    "catalog_lookup": oracle("v_refs", ctes=_CAT) + "SELECT snapshot, min(uuid) AS uuid, max(file_nr) FILTER (uuid = least_uuid) AS file_nr FROM (SELECT *, min(uuid) OVER (PARTITION BY snapshot) AS least_uuid FROM k) GROUP BY snapshot",
    "tape_content": oracle("v_media") + "SELECT uuid, label, set_uuid, seq_nr FROM v_media WHERE pool = 'Brand#2' AND status = 'full' AND location <> 'vault'",
    "tape_backup_plan": oracle("v_refs", "v_snapshots", ctes=_CAT) + "SELECT type, id, sid AS snapshot FROM v_snapshots WHERE finished AND type <> 'ct' AND sid NOT IN (SELECT snapshot FROM k WHERE file_nr < 4)",
    "restorable": oracle("v_refs", "v_snapshots") + "SELECT type, count(*) AS snapshots FROM v_snapshots WHERE sid IN (SELECT sid FROM v_refs) AND crypt_mode <> 'none' GROUP BY type",
}
