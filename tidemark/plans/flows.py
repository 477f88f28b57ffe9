"""Network rules, notifications, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ipv4, once
from ..operators import network
from ..sources import views
from ..sources.views import oracle
from ..streaming import twins

TRAFFIC = [
    {"name": "office", "networks": ["10.0.0.0/24"], "timeframes": ["mon..fri 8-12", "mon..fri 13-17:30"]},
    {"name": "host", "networks": ["10.0.0.35/32", "127.0.0.0/8"], "timeframes": ["20-23:59"]},
    {"name": "wide", "networks": ["10.0.0.0/8"]},
    {"name": "all", "networks": ["0.0.0.0/0"]},
    {"name": "six", "networks": ["2001:db8::/32", "2001:DB8:0:0::1/128"], "timeframes": ["mon..sun 0-11:59"]},
    {"name": "else", "networks": ["::/0"]},
]
MATCHERS = [
    {"targets": ["mail"], "severity": ["error", "warning"]},
    {"targets": ["chat", "mail"], "exact": {"worker_type": ["prunejob", "syncjob"]}, "regex": {"user": "^user1"}, "mode": "any", "invert": True},
    {"targets": ["pager"], "severity": ["error"], "calendar": ["0-8"]},
    {"targets": ["never"], "disable": True},
]


def _peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, user = views.tasks(spark, sf_dir), F.regexp_extract("user", r"(\d+)", 1).cast("int")
    ip = once(user, lambda u: F.when(u % 7 == 0, F.concat(F.lit("127.0.0."), (u % 250).cast("string"))).when(u % 7 == 1, F.concat(F.lit("::ffff:10.0.0."), (u % 40).cast("string"))).when(u % 7 == 2, "2001:db8::1").when(u % 7 == 3, F.concat(F.lit("10.0."), (u % 3).cast("string"), F.lit(".35"))).otherwise(F.concat(F.lit("192.168.1."), (u % 250).cast("string"))))
    return t.select("task", ip.alias("ip"), F.col("start").alias("now"))


def rule_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.longest_prefix(_peers(spark, sf_dir), TRAFFIC).select("task", "rule", "match_len")


def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without hours, networks being a table."""
    rows = [(r["name"], c) for r in TRAFFIC for c in r["networks"]]
    return network.longest_prefix_join(_peers(spark, sf_dir).select("ip").distinct(), spark.createDataFrame(rows, "rule string, network string"))


def current_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with the rates of the tasks that they hold for; some have none."""
    rules = spark.createDataFrame([(r["name"],) for r in TRAFFIC] + [("idle",)], "rule string")
    hit = network.longest_prefix(_peers(spark, sf_dir), TRAFFIC)
    named = hit.select(F.coalesce("rule", F.lit("")).alias("rule"), "task")  # never null, or the join would push a filter down that works rules out a second time
    rates = named.groupBy("rule").agg(F.sum("task").alias("rate_in"), F.count("task").alias("rate_out"))
    return network.rule_rates(rules, rates)


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as numbers, null for those that aren't IPv4."""
    return _peers(spark, sf_dir).select("ip", ipv4(F.col("ip")).alias("number")).distinct()


def notification_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.tasks(spark, sf_dir).select("task", F.coalesce("state", F.lit("info")).alias("severity"), "worker_type", "user", F.col("start").alias("time"))
    return network.route(n, MATCHERS, "task")


def notification_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.oldest_first(views.tasks(spark, sf_dir), "start", "task").select("task", F.col("turn").cast("long").alias("turn"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and types of a stream of events."""
    s = twins.read(spark, f"{sf_dir}/events.parquet").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"))
    return twins.drain(twins.dedup(s, "key"), spark, "append")


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average and maximum by six hours, from a stream."""
    s = twins.read(spark, f"{sf_dir}/events.parquet")
    out = twins.drain(twins.roll_up(s, "ts", "event_type", "value", "6 hours"), spark, "complete")
    return out.select("event_type", F.unix_timestamp("start").alias("start"), "average", "maximum", "n")


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a metric export."""
    m = views.metrics(spark, sf_dir).select("name", F.col("n").alias("id"), "ts")
    return twins.line_protocol(m, "events", ["name"], ["id"], "ts")


QUERIES = {f.__name__: f for f in (rule_longest_prefix, prefix_join, current_traffic, addresses, notification_routes, notification_queue, stream_dedup, stream_rollup, metric_lines)}

_U = """CAST(regexp_extract("user", '(\\d+)', 1) AS INTEGER)"""
_PEERS = f"""p0 AS (SELECT task, start AS now, {_U} AS u FROM v_tasks),
p AS (SELECT *, CASE u % 7 WHEN 0 THEN '127.0.0.' || (u % 250) WHEN 1 THEN '::ffff:10.0.0.' || (u % 40) WHEN 2 THEN '2001:db8::1' WHEN 3 THEN '10.0.' || (u % 3) || '.35' ELSE '192.168.1.' || (u % 250) END AS ip,
  now // 60 % 1440 AS minute, isodow(DATE '1970-01-01' + CAST(now // 86400 AS INTEGER)) <= 5 AS week FROM p0),
a AS (SELECT *, string_split(replace(ip, '::ffff:', ''), '.') AS q FROM p),
n AS (SELECT *, CASE WHEN len(q) = 4 THEN CAST(q[1] AS BIGINT) * 16777216 + CAST(q[2] AS BIGINT) * 65536 + CAST(q[3] AS BIGINT) * 256 + CAST(q[4] AS BIGINT) END AS num FROM a),
h AS (SELECT *, CASE WHEN num IS NULL THEN CASE WHEN minute <= 718 THEN 'six/128' ELSE 'else/0' END WHEN (num = 167772195) AND minute BETWEEN 1200 AND 1438 THEN 'host/32' WHEN num BETWEEN 167772160 AND 167772415 AND week AND (minute BETWEEN 480 AND 719 OR minute BETWEEN 780 AND 1049) THEN 'office/24'
  WHEN num // 16777216 = 127 AND minute BETWEEN 1200 AND 1438 THEN 'host/8' WHEN num // 16777216 = 10 THEN 'wide/8' ELSE 'all/0' END AS hit FROM n)"""

ORACLE = {
    "rule_longest_prefix": oracle("v_tasks", ctes=_PEERS) + "SELECT task, split_part(hit, '/', 1) AS rule, CAST(split_part(hit, '/', 2) AS INTEGER) AS match_len FROM h",
    "prefix_join": oracle("v_tasks", ctes=_PEERS) + "SELECT DISTINCT ip, CASE WHEN num = 167772195 THEN 'host' WHEN num BETWEEN 167772160 AND 167772415 THEN 'office' WHEN num // 16777216 = 127 THEN 'host' WHEN num // 16777216 = 10 THEN 'wide' WHEN num IS NOT NULL THEN 'all' ELSE 'six' END AS rule, CASE WHEN num = 167772195 THEN 32 WHEN num BETWEEN 167772160 AND 167772415 THEN 24 WHEN num // 16777216 IN (10, 127) THEN 8 WHEN num IS NOT NULL THEN 0 ELSE 128 END AS match_len FROM n",
    "current_traffic": oracle("v_tasks", ctes=_PEERS) + ", r AS (SELECT unnest(['office', 'host', 'wide', 'all', 'six', 'else', 'idle']) AS rule) SELECT r.rule, CAST(coalesce(sum(task), 0) AS BIGINT) AS rate_in, count(task) AS rate_out FROM r LEFT JOIN h ON split_part(hit, '/', 1) = r.rule GROUP BY r.rule",
    "addresses": oracle("v_tasks", ctes=_PEERS) + "SELECT DISTINCT ip, num AS number FROM n",
    "notification_routes": oracle("v_tasks") + """, x AS (SELECT task, coalesce(state, 'info') AS s, worker_type AS w, "user" AS u, start // 60 % 1440 AS m FROM v_tasks)
SELECT DISTINCT task, target FROM (SELECT task, 'mail' AS target FROM x WHERE s IN ('error', 'warning') UNION ALL SELECT task, unnest(['chat', 'mail']) FROM x WHERE NOT (w IN ('prunejob', 'syncjob') OR starts_with(u, 'user1')) UNION ALL SELECT task, 'pager' FROM x WHERE s = 'error' AND m < 480)""",
    "notification_queue": oracle("v_tasks") + "SELECT task, row_number() OVER (PARTITION BY start // 86400 ORDER BY start, task) AS turn FROM v_tasks",
    "stream_dedup": "SELECT DISTINCT user_id || '/' || event_type AS key FROM events",
    "stream_rollup": "SELECT event_type, CAST(epoch(time_bucket(INTERVAL '6 hours', ts)) AS BIGINT) AS start, round(avg(value), 6) AS average, round(max(value), 6) AS maximum, count(*) AS n FROM events GROUP BY 1, 2",
    "metric_lines": oracle("v_metrics") + "SELECT 'events,name=' || name || ' id=' || n || ' ' || ts AS line FROM v_metrics",
}
