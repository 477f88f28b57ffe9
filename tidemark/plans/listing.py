"""Lists, filters and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import listing as ls
from ..sources import views
from ..sources.views import NOW, oracle

FILTERS = ["include:regex:/1", "include:type:ct", "exclude:regex:9$", "exclude:group:ct/12"]


def scan_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with their text path and RFC 3339 time, first line of notes and verification state."""
    s = views.snapshots(spark, sf_dir)
    moment = F.date_format(F.expr("timestampadd(SECOND, time, TIMESTAMP_NTZ'1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return s.select("sid", F.concat_ws("/", "type", "id", moment).alias("path"), F.element_at(F.split("notes", "\n"), 1).alias("comment"), "verify_state", F.coalesce("size", F.lit(0)).alias("size"))


def scan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.snapshots(spark, sf_dir).where("type = 'vm'").select("type", "id").distinct()


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by snapshot as one text: archives of its index entries, first ones first."""
    r = views.refs(spark, sf_dir).select("sid", F.concat(F.lit("f"), (F.col("part") % 10).cast("string"), F.lit(".didx")).alias("file")).distinct()
    return r.groupBy("sid").agg(F.array_join(F.sort_array(F.collect_list("file")), ",").alias("files"), F.count("*").alias("n"))


def group_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.group_list(views.snapshots(spark, sf_dir))


def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups in the list's order, some ids being no numbers."""
    g = views.snapshots(spark, sf_dir).select("type", F.when(F.col("sid") % 3 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id")).alias("id")).distinct()
    return g.orderBy(*ls.group_order())


def group_filter_inc_exc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.snapshots(spark, sf_dir).select("type", "id").distinct().where(ls.apply_filters(FILTERS))


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.type_counts(views.snapshots(spark, sf_dir))


def owner_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of an owner, asked for with a token of that user."""
    return views.snapshots(spark, sf_dir).where(ls.owned_by("owner", "user2@local!backup")).groupBy("type").agg(F.count_distinct("id").alias("groups"))


def last_successful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest finished and newest snapshot by group."""
    return views.snapshots(spark, sf_dir).groupBy("type", "id").agg(F.max(F.when(F.col("finished"), F.col("time"))).alias("last_finished"), F.max("time").alias("last_any"))


def latest_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest finished snapshot of each group, as a tape job takes."""
    w = Window.partitionBy("type", "id").orderBy(F.desc("time"))
    return views.snapshots(spark, sf_dir).where("finished").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("type", "id", "sid", "time")


def group_verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.verify_counts(views.snapshots(spark, sf_dir), NOW)


def crypt_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.snapshots(spark, sf_dir).groupBy("type", "id").agg(ls.crypt_summary("crypt_mode").alias("crypt"))


def group_delete_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What deleting a type's groups would remove and what protection keeps."""
    return views.snapshots(spark, sf_dir).groupBy("type").agg(F.count_if(~F.col("protected")).alias("removed"), F.count_if("protected").alias("protected"))


def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = NOW - 20 * 86400
    return ls.task_filter(views.tasks(spark, sf_dir), since=since, until=NOW - 5 * 86400, user="user1", kind="job", errors=True).select("task", "worker_type", "user", "state")


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.task_filter(views.tasks(spark, sf_dir), store="store3", states=["warning", "error"]).select("task", "worker_id", "state")


def task_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.task_filter(views.tasks(spark, sf_dir), running=True).select("task", "worker_type", "start")


def task_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 50 tasks, newest first."""
    return ls.page(views.tasks(spark, sf_dir), [F.desc("start"), F.col("task")], 50, 50).select("task", "start", "worker_type", "state")


def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 7 of each document, as a task log."""
    d = views.doc_lines(spark, sf_dir)
    return ls.log_page(d, "sid", "pos", 3, 5).select("sid", F.col("line").cast("long").alias("line"), "digest")


def task_summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.task_summary(views.tasks(spark, sf_dir))


def longest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.page(views.tasks(spark, sf_dir).where("stop IS NOT NULL"), [F.desc("duration"), F.col("task")], 0, 10).select("task", "duration", "worker_type")


def history_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a series with gaps carried forward."""
    m = views.metrics(spark, sf_dir).withColumn("gappy", F.when(F.col("n") % 4 != 0, F.round("value", 6)))
    return ls.forward_fill(m.withColumn("place", F.struct("ts", "n")), "name", "place", "gappy").select("name", "n", "filled")


def maintenance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores by maintenance mode that take a read and a write."""
    n = views.table(spark, sf_dir, "nation").withColumn("mode", F.when(F.col("n_nationkey") % 3 == 0, "offline").when(F.col("n_nationkey") % 3 == 1, "read-only"))
    return n.select("n_name", ls.maintenance_allows(F.col("mode"), "read").alias("read"), ls.maintenance_allows(F.col("mode"), "write").alias("write"))


def active_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit(False)).when(F.col("c_custkey") % 3 == 1, F.lit(True)).alias("enable"), F.when(F.col("c_custkey") % 5 == 0, 0).when(F.col("c_custkey") % 5 < 3, NOW + (F.col("c_custkey") % 7 - 3) * 1000).alias("expire"))
    return c.where(ls.active("enable", "expire", NOW)).select("c_custkey")


def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against a schema: pattern, least and greatest length, and a range of numbers."""
    p = views.table(spark, sf_dir, "part")
    ok = F.col("p_name").rlike("^[A-Za-z0-9_ #][A-Za-z0-9._ #\\-]*$") & F.length("p_name").between(3, 64) & F.col("p_size").between(2, 40)
    return p.select("p_partkey", F.coalesce(ok, F.lit(False)).alias("valid"))


def tokens_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their tokens in one list, empty for those without."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    t = views.table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("user"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("token"))
    folded = t.groupBy("user").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return c.join(folded, "user", "left").select("user", F.array_join(F.coalesce("tokens", F.array().cast("array<string>")), ",").alias("tokens"))


def active_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes in progress by store, of processes that are alive."""
    t = views.tasks(spark, sf_dir).where("stop IS NULL").select(ls.store_of("worker_type", "worker_id").alias("store"), F.col("task"), (F.col("worker_type") == "backup").alias("writes"))
    alive = views.tasks(spark, sf_dir).where("duration >= 10").select("task")
    return t.join(alive, "task", "left_semi").groupBy("store").agg(F.count_if(~F.col("writes")).alias("reading"), F.count_if("writes").alias("writing"))


QUERIES = {f.__name__: f for f in (scan_snapshots, scan_groups, scan_files, group_list, group_order, group_filter_inc_exc, type_counts, owner_check, last_successful, latest_finished, group_verify_counts, crypt_mode, group_delete_stats, task_filter, task_states, task_running, task_page, log_page, task_summary_pivot, longest_tasks, history_ffill, maintenance_gate, active_entities, valid_names, tokens_by_user, active_operations)}

_CRYPT = "CASE WHEN count(*) FILTER (crypt_mode = 'encrypt') = count(*) THEN 'encrypt' WHEN count(*) FILTER (crypt_mode = 'sign-only') = count(*) THEN 'sign-only' WHEN count(*) FILTER (crypt_mode <> 'none') = 0 THEN 'none' ELSE 'mixed' END"
_STORE = "split_part(worker_id, ':', 1)"

ORACLE = {
    "scan_snapshots": oracle("v_snapshots") + "SELECT sid, type || '/' || id || '/' || strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS path, split_part(notes, chr(10), 1) AS comment, verify_state, size FROM v_snapshots",
    "scan_groups": oracle("v_snapshots") + "SELECT DISTINCT type, id FROM v_snapshots WHERE type = 'vm'",
    "scan_files": oracle("v_refs") + "SELECT sid, string_agg(file, ',' ORDER BY file) AS files, count(*) AS n FROM (SELECT DISTINCT sid, 'f' || (part % 10) || '.didx' AS file FROM v_refs) GROUP BY sid",
    "group_list": oracle("v_snapshots") + "SELECT type, id, count(*) AS backup_count, max(time) AS last_backup, max_by(owner, time) AS owner, max(time) FILTER (finished) AS last_successful, max_by(size, time) AS last_size FROM v_snapshots GROUP BY type, id",
    "group_order": oracle("v_snapshots") + "SELECT DISTINCT type, CASE WHEN sid % 3 = 0 THEN 'n' || id ELSE id END AS id, CASE type WHEN 'vm' THEN 0 WHEN 'ct' THEN 1 ELSE 2 END AS r FROM v_snapshots",
    "group_filter_inc_exc": oracle("v_snapshots") + "SELECT DISTINCT type, id FROM v_snapshots WHERE (regexp_matches(type || '/' || id, '/1') OR type = 'ct') AND NOT (regexp_matches(type || '/' || id, '9$') OR type || '/' || id = 'ct/12')",
    "type_counts": oracle("v_snapshots") + "SELECT type, count(DISTINCT id) AS groups, count(*) AS snapshots FROM v_snapshots GROUP BY type",
    "owner_check": oracle("v_snapshots") + "SELECT type, count(DISTINCT id) AS groups FROM v_snapshots WHERE owner = 'user2@local' GROUP BY type",
    "last_successful": oracle("v_snapshots") + "SELECT type, id, max(time) FILTER (finished) AS last_finished, max(time) AS last_any FROM v_snapshots GROUP BY type, id",
    "latest_finished": oracle("v_snapshots") + "SELECT type, id, max_by(sid, time) AS sid, max(time) AS time FROM v_snapshots WHERE finished GROUP BY type, id",
    "group_verify_counts": oracle("v_snapshots") + f"""SELECT type, id, count(*) FILTER (verify_state = 'ok') AS ok, count(*) FILTER (verify_state = 'failed') AS failed, count(*) FILTER (verify_state IS NULL) AS none,
count(*) FILTER (verify_state IS NOT NULL AND {NOW} - verified > 2592000) AS outdated, max_by(size, time) FILTER (finished) AS last_size, {_CRYPT} AS crypt FROM v_snapshots GROUP BY type, id""",
    "crypt_mode": oracle("v_snapshots") + f"SELECT type, id, {_CRYPT} AS crypt FROM v_snapshots GROUP BY type, id",
    "group_delete_stats": oracle("v_snapshots") + "SELECT type, count(*) FILTER (NOT protected) AS removed, count(*) FILTER (protected) AS protected FROM v_snapshots GROUP BY type",
    "task_filter": oracle("v_tasks") + f"""SELECT task, worker_type, "user", state FROM v_tasks WHERE (stop IS NULL OR stop >= {NOW - 20 * 86400}) AND start <= {NOW - 5 * 86400} AND contains("user", 'user1') AND contains(worker_type, 'job') AND state <> 'ok'""",
    "task_states": oracle("v_tasks") + f"SELECT task, worker_id, state FROM v_tasks WHERE CASE worker_type WHEN 'syncjob' THEN split_part(worker_id, ':', 2) ELSE {_STORE} END = 'store3' AND state IN ('warning', 'error')",
    "task_running": oracle("v_tasks") + "SELECT task, worker_type, start FROM v_tasks WHERE stop IS NULL",
    "task_page": oracle("v_tasks") + "SELECT task, start, worker_type, state FROM v_tasks ORDER BY start DESC, task LIMIT 50 OFFSET 50",
    "log_page": oracle("v_lines") + "SELECT sid, pos + 1 AS line, digest FROM v_lines WHERE pos BETWEEN 2 AND 6",
    "task_summary_pivot": oracle("v_tasks") + "SELECT worker_type, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'warning') AS warning, count(*) FILTER (state = 'error') AS error, count(*) FILTER (state IS NULL) AS running FROM v_tasks GROUP BY worker_type",
    "longest_tasks": oracle("v_tasks") + "SELECT task, duration, worker_type FROM v_tasks WHERE stop IS NOT NULL ORDER BY duration DESC, task LIMIT 10",
    "history_ffill": oracle("v_metrics") + "SELECT name, n, last_value(CASE WHEN n % 4 <> 0 THEN round(value, 6) END IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts, n ROWS UNBOUNDED PRECEDING) AS filled FROM v_metrics",
    "maintenance_gate": "SELECT n_name, n_nationkey % 3 <> 0 AS read, n_nationkey % 3 = 2 AS write FROM nation",
    "active_entities": f"SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 5 >= 3 OR c_custkey % 7 > 3)",
    "valid_names": "SELECT p_partkey, coalesce(regexp_full_match(p_name, '[A-Za-z0-9_ #][A-Za-z0-9._ #-]*') AND length(p_name) BETWEEN 3 AND 64 AND p_size BETWEEN 2 AND 40, false) AS valid FROM part",
    "tokens_by_user": "SELECT c_custkey AS \"user\", coalesce(string_agg('t' || o_orderkey, ',' ORDER BY 't' || o_orderkey), '') AS tokens FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '5-LOW') ON c_custkey = o_custkey GROUP BY c_custkey",
    "active_operations": oracle("v_tasks") + f"SELECT CASE worker_type WHEN 'syncjob' THEN split_part(worker_id, ':', 2) ELSE {_STORE} END AS store, count(*) FILTER (worker_type <> 'backup') AS reading, count(*) FILTER (worker_type = 'backup') AS writing FROM v_tasks WHERE stop IS NULL AND duration >= 10 GROUP BY 1",
}
ORACLE["group_order"] = ORACLE["group_order"].replace("SELECT DISTINCT type", "SELECT type, id FROM (SELECT DISTINCT type") + ") ORDER BY r, try_cast(id AS BIGINT) NULLS LAST, id"
