"""Retention queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retention
from ..operators.retention import Keep
from ..sources import views

POLICIES = {
    "prune_last": Keep(last=2),
    "prune_hourly": Keep(hourly=3),
    "prune_daily": Keep(daily=3),
    "prune_weekly": Keep(weekly=3),
    "prune_monthly": Keep(monthly=2),
    "prune_yearly": Keep(yearly=2),
    "prune_mixed": Keep(last=1, hourly=1, daily=1, weekly=1, monthly=1, yearly=1),
    "prune_protected": Keep(last=1, monthly=1),
    "prune_keep_all": Keep(),
}

#: The periods of a rule in SQL.
_PERIOD = {
    "last": "time",
    "hourly": "time // 3600",
    "daily": "time // 86400",
    "weekly": "isoyear(to_timestamp(time) AT TIME ZONE 'UTC') * 100 + week(to_timestamp(time) AT TIME ZONE 'UTC')",
    "monthly": "strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%Y-%m')",
    "yearly": "strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%Y')",
}


def _query(keep: Keep):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return retention.plan(views.snapshots(spark, sf_dir), keep).select("type", "id", "sid", "time", "mark")

    return run


def _sql(keep: Keep, out: str = "SELECT type, id, sid, time, mark FROM done") -> str:
    if not keep.keeps_something():
        return views.oracle("v_snapshots", ctes="done AS (SELECT *, CASE WHEN protected THEN 'protected' ELSE 'keep' END AS mark FROM v_snapshots)") + out
    steps = ["""r0 AS (SELECT *, CASE WHEN NOT finished THEN CASE WHEN row_number() OVER (PARTITION BY type, id ORDER BY time DESC) = 1 THEN 'keep-partial' ELSE 'remove' END END AS mark FROM v_snapshots)"""]
    for i, (rule, n) in enumerate(keep.rules()):
        steps.append(f"""p{i} AS (SELECT *, {_PERIOD[rule]} AS pid FROM r{i}),
o{i} AS (SELECT *, mark IS NULL AND NOT protected AND NOT coalesce(bool_or(mark = 'keep') OVER (PARTITION BY type, id, pid), false) AS open FROM p{i}),
f{i} AS (SELECT *, open AND row_number() OVER (PARTITION BY type, id, pid, open ORDER BY time DESC) = 1 AS newest FROM o{i}),
k{i} AS (SELECT *, sum(CAST(newest AS INTEGER)) OVER (PARTITION BY type, id ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS k FROM f{i}),
r{i + 1} AS (SELECT * EXCLUDE (pid, open, newest, k, mark), CASE WHEN open AND k <= {n} THEN CASE WHEN newest THEN 'keep' ELSE 'remove' END ELSE mark END AS mark FROM k{i})""")
    last = len(keep.rules())
    steps.append(f"done AS (SELECT * EXCLUDE (mark), CASE WHEN protected THEN 'protected' ELSE coalesce(mark, 'remove') END AS mark FROM r{last})")
    return views.oracle("v_snapshots", ctes=",\n".join(steps)) + out


def prune_datastore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by group of a store-wide prune."""
    return retention.summary(retention.plan(views.snapshots(spark, sf_dir), Keep(last=1, monthly=2, yearly=1)))


def prune_simulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule with its running counter, as a simulator shows it."""
    return retention.marks_with_counter(views.snapshots(spark, sf_dir), "monthly", 2).select("type", "id", "sid", "time", "mark", "kept")


def first_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot of each of a group's two newest months."""
    return retention.first_per_period(views.snapshots(spark, sf_dir), ("type", "id"), "time", "monthly", 2).select("type", "id", "sid", "time")


def period_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period numbers of each snapshot's time."""
    s = views.snapshots(spark, sf_dir)
    names = ("hourly", "daily", "monthly", "yearly")
    return s.select("sid", *[retention.period(r, F.col("time")).alias(r) for r in names])


QUERIES = {name: _query(keep) for name, keep in POLICIES.items()} | {"prune_datastore": prune_datastore, "prune_simulator": prune_simulator, "first_monthly": first_monthly, "period_ids": period_ids}

ORACLE = {name: _sql(keep) for name, keep in POLICIES.items()} | {
    "prune_datastore": _sql(Keep(last=1, monthly=2, yearly=1), "SELECT type, id, count(*) AS snapshots, count(*) FILTER (mark = 'remove') AS removed, count(*) FILTER (mark = 'protected') AS protected, count(*) FILTER (mark IN ('keep', 'keep-partial')) AS kept FROM done GROUP BY type, id"),
    "prune_simulator": views.oracle("v_snapshots", ctes=f"""p AS (SELECT *, {_PERIOD['monthly']} AS pid FROM v_snapshots),
f AS (SELECT *, row_number() OVER (PARTITION BY type, id, pid ORDER BY time DESC) = 1 AS newest FROM p),
k AS (SELECT *, sum(CAST(newest AS INTEGER)) OVER (PARTITION BY type, id ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS k FROM f)""")
    + "SELECT type, id, sid, time, CASE WHEN k <= 2 AND newest THEN 'keep' ELSE 'remove' END AS mark, CAST(least(k, 2) AS BIGINT) AS kept FROM k",
    "first_monthly": views.oracle("v_snapshots", ctes=f"""f AS (SELECT *, row_number() OVER (PARTITION BY type, id, {_PERIOD['monthly']} ORDER BY time DESC) AS rn FROM v_snapshots),
g AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY time DESC) AS k FROM f WHERE rn = 1)""")
    + "SELECT type, id, sid, time FROM g WHERE k <= 2",
    "period_ids": views.oracle("v_snapshots") + """SELECT sid, time // 3600 AS hourly, time // 86400 AS daily,
year(to_timestamp(time) AT TIME ZONE 'UTC') * 12 + month(to_timestamp(time) AT TIME ZONE 'UTC') AS monthly, year(to_timestamp(time) AT TIME ZONE 'UTC') AS yearly FROM v_snapshots""",
}
