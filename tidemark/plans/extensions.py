"""Operators that snapshot stores have no counterpart of; the engine has them as Spark has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rangejoin import asof_join
from ..operators.timeseries import sessions
from ..sources import views
from ..sources.views import oracle


def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.snapshots(spark, sf_dir)
    return s.rollup("type", "owner").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.snapshots(spark, sf_dir)
    return s.cube("type", "crypt_mode").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("gid"))


def ext_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.refs(spark, sf_dir)
    return r.where("size <= 25600").select("digest").intersect(r.where("size > 25600").select("digest"))


def ext_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users' events; six hours without any end one."""
    return sessions(views.table(spark, sf_dir, "events").select("user_id", views.epoch("ts").alias("t")), "user_id", "t", 21600)


def ext_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each signup the value of the user's last click before it."""
    m = views.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", views.epoch("ts").alias("at"), "value")
    left = m.where("event_type = 'signup'").select("user_id", "event_id", "at")
    right = m.where("event_type = 'click'").groupBy("user_id", "at").agg(F.max("value").alias("value"))
    return asof_join(left, right, ["user_id"], "at", "at", "value").select("event_id", "value")


def ext_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.metrics(spark, sf_dir).groupBy("name").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


def ext_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct digests, exactly and by a sketch."""
    return views.refs(spark, sf_dir).agg(F.count_distinct("digest").alias("exact"), F.approx_count_distinct("digest", 0.02).alias("sketch"))


def ext_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("type").orderBy("size", "sid")
    return views.snapshots(spark, sf_dir).select("sid", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("share"), F.sum("size").over(Window.partitionBy("type").orderBy("time").rangeBetween(-86400, 0)).alias("day_bytes"))


QUERIES = {f.__name__: f for f in (ext_rollup, ext_cube, ext_intersect, ext_session_window, ext_asof, ext_percentiles, ext_approx_distinct, ext_ranks)}

ORACLE = {
    "ext_rollup": oracle("v_snapshots") + "SELECT type, owner, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM v_snapshots GROUP BY ROLLUP (type, owner)",
    "ext_cube": oracle("v_snapshots") + "SELECT type, crypt_mode, count(*) AS n, CAST(grouping(type, crypt_mode) AS BIGINT) AS gid FROM v_snapshots GROUP BY CUBE (type, crypt_mode)",
    "ext_intersect": oracle("v_refs") + "SELECT digest FROM v_refs WHERE size <= 25600 INTERSECT SELECT digest FROM v_refs WHERE size > 25600",
    "ext_session_window": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 21600 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "ext_asof": """WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, value FROM events),
c AS (SELECT user_id, t, max(value) AS value FROM e WHERE event_type = 'click' GROUP BY user_id, t)
SELECT event_id, c.value FROM (SELECT * FROM e WHERE event_type = 'signup') s ASOF LEFT JOIN c ON s.user_id = c.user_id AND s.t >= c.t""",
    "ext_percentiles": oracle("v_metrics") + "SELECT name, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM v_metrics GROUP BY name",
    "ext_ranks": oracle("v_snapshots") + """SELECT sid, CAST(ntile(4) OVER (PARTITION BY type ORDER BY size, sid) AS INTEGER) AS quarter, round(percent_rank() OVER (PARTITION BY type ORDER BY size, sid), 9) AS share,
CAST(sum(size) OVER (PARTITION BY type ORDER BY time RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS day_bytes FROM v_snapshots""",
}
