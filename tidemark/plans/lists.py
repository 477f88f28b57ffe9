"""Plain lists: keys, rules, realms, second factors, services, the node, and jobs and devices with their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, parsers
from ..operators import access, tapes
from ..sources import views
from ..sources.views import NOW, oracle


def _suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return views.table(spark, sf_dir, "supplier"), F.col("s_suppkey")


def list_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tape encryption keys: fingerprint, hint and kind of key derivation, never the key; by fingerprint."""
    s, key = _suppliers(spark, sf_dir)
    return s.select(F.sha2("s_name", 256).alias("fingerprint"), F.when(key % 3 != 0, F.concat(F.lit("hint "), key.cast("string"))).alias("hint"), F.when(key % 2 == 0, "scrypt").otherwise("pbkdf2").alias("kdf")).orderBy("fingerprint")


def list_traffic_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with their networks, rates, and bursts, which are the rates where none is set."""
    s, key = _suppliers(spark, sf_dir)
    rate = F.when(key % 4 != 0, (key % 50 + 1) * 1_000_000)
    return s.select(F.col("s_name").alias("name"), F.concat(F.lit("10."), (key % 256).cast("string"), F.lit(".0.0/16")).alias("network"), rate.alias("rate_in"), F.coalesce(F.when(key % 3 == 0, key * 1000), rate).alias("burst_in")).orderBy("name")


#: Kinds of configured realms.
REALMS = ("ldap", "ad", "openid")


def _realms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = views.table(spark, sf_dir, "customer"), F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in REALMS]), (key % 3 + 1).cast("int"))
    return c.select(F.concat(F.lit("realm"), key.cast("string")).alias("realm"), kind.alias("type"), F.when(key % 5 != 0, F.col("c_name")).alias("comment"), (key == 7).alias("default"), F.md5("c_name").alias("bind_password"))


def list_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two built-in realms and all configured ones; a built-in one is the default where no configured one is."""
    own = _realms(spark, sf_dir).select("realm", "type", "comment", "default")
    some = own.agg(F.coalesce(F.max("default"), F.lit(False)).alias("some"))  # one row
    fixed = spark.createDataFrame([("pam", "pam", "Linux PAM standard authentication", True), ("pbs", "pbs", "built-in authentication server", False)], own.schema)
    return fixed.join(F.broadcast(some)).select("realm", "type", "comment", (F.col("default") & ~F.col("some")).alias("default")).unionByName(own)


def list_realms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured realms by kind, without their passwords."""
    return _realms(spark, sf_dir).where(F.col("type").isin(*REALMS)).drop("bind_password").orderBy("type", "realm")


def list_tfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their second factors: an auditor sees all, others themselves; locks until a time that has not passed."""
    c, key = views.table(spark, sf_dir, "customer"), F.col("c_custkey")
    kinds = F.concat(F.when(key % 2 == 0, F.array(F.lit("totp"))).otherwise(F.array().cast("array<string>")), F.when(key % 3 == 0, F.array(F.lit("webauthn"))).otherwise(F.array().cast("array<string>")), F.when(key % 5 == 0, F.array(F.lit("recovery"))).otherwise(F.array().cast("array<string>")))
    until = F.when(key % 7 == 0, F.lit(NOW - 86400) + key * 600)
    own = c.select(F.concat(F.lit("user"), key.cast("string"), F.lit("@local")).alias("user"), F.array_join(kinds, ",").alias("factors"), (F.coalesce(until, F.lit(0)) > NOW).alias("locked"), (key % 4 != 0).alias("seen"))
    return own.where((F.col("seen") | (F.col("user") == "user4@local")) & (F.col("factors") != "")).drop("seen")


def list_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services with the state of their unit's last entry, unknown where that has none or there is no unit."""
    names = spark.createDataFrame([("backup", "backup-api"), ("proxy", "backup-proxy"), ("sshd", "ssh"), ("syslog", "rsyslog"), ("cron", "cron")], "service string, unit string")
    units = views.tasks(spark, sf_dir).groupBy((F.col("task") % 4).alias("k")).agg(F.max_by("state", F.struct("start", "task")).alias("state"), F.max("start").alias("since"))
    unit = F.element_at(F.array(*[F.lit(x) for x in ("backup-api", "backup-proxy", "ssh", "cron")]), (F.col("k") + 1).cast("int"))
    return names.join(units.select(unit.alias("unit"), "state", "since"), "unit", "left").select("service", "unit", F.coalesce("state", F.lit("unknown")).alias("state"), "since")


def node_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for the node: use of processor, memory, root file system and swap, load, and uptime."""
    m = views.metrics(spark, sf_dir)
    last = lambda name: F.max_by(F.when(F.col("name") == name, F.col("value")), F.when(F.col("name") == name, F.struct("ts", "n")))
    size = F.sum(F.when(F.col("name") == "purchase", F.col("n"))).alias("root_total")
    used = F.sum(F.when((F.col("name") == "purchase") & (F.col("n") % 3 == 0), F.col("n"))).alias("root_used")
    out = m.agg(F.round(last("click"), 6).alias("cpu"), F.round(last("view"), 6).alias("load"), size, used, (F.lit(NOW) - F.min("ts")).alias("uptime"))
    return out.select("*", (F.col("root_total") - F.col("root_used")).alias("root_available"))


def gc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store's last collection: state, duration from start to end, and the next event after that end (or now, if there was none)."""
    t = views.tasks(spark, sf_dir).withColumn("store", F.split("worker_id", ":")[0])
    stores = t.select("store").distinct()
    last = t.where("worker_type = 'garbage_collection'").groupBy("store").agg(F.max_by(F.struct("start", "stop", "state"), F.struct("start", "task")).alias("l"))
    end = F.coalesce("l.stop", F.lit(NOW))
    state = F.when(F.col("l").isNull(), None).when(F.col("l.stop").isNull(), "running").otherwise(F.col("l.state"))
    return stores.join(last, "store", "left").select("store", state.alias("state"), F.col("l.start").alias("started"), (F.col("l.stop") - F.col("l.start")).alias("duration"), F.when(F.col("store") != "store3", calendar.next_event(end, "daily")).alias("next_run"))


def list_sync_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync jobs for which the caller may read both ends: the remote (a local source has none) and the store."""
    s, key = _suppliers(spark, sf_dir)
    jobs = s.select(F.col("s_name").alias("job"), F.when(key % 4 != 0, F.concat(F.lit("remote"), (key % 6).cast("string"))).alias("remote"), F.concat(F.lit("store"), (key % 5).cast("string")).alias("store"))
    grants = [(f"remote{i}", access.bits("Remote.Audit") if i % 2 else access.bits("Sys.Audit")) for i in range(6)] + [(f"store{i}", access.bits("Datastore.Audit") if i != 3 else access.bits("Datastore.Backup")) for i in range(5)]
    rights = spark.createDataFrame(grants, "resource string, privs long")
    far, near = rights.select(F.col("resource").alias("remote"), F.col("privs").alias("far")), rights.select(F.col("resource").alias("store"), F.col("privs").alias("near"))
    both = jobs.join(near, "store").join(far, "remote", "left")
    may = access.has_privileges(F.col("near"), access.bits("Datastore.Audit")) & (F.col("remote").isNull() | access.has_privileges(F.coalesce("far", F.lit(0)), access.bits("Remote.Audit")))
    return both.where(may).select("job", "remote", "store")


def list_tape_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tape jobs with their store's last backup, and the medium that the pool would write next."""
    s, key = _suppliers(spark, sf_dir)
    jobs = s.select(F.col("s_name").alias("job"), F.concat(F.lit("Brand#"), (key % 7 + 1).cast("string")).alias("pool"), F.concat(F.lit("store"), (key % 5).cast("string")).alias("store"))
    last = views.tasks(spark, sf_dir).where("worker_type = 'backup'").groupBy(F.split("worker_id", ":")[0].alias("store")).agg(F.max("start").alias("last"))
    m = views.media(spark, sf_dir)
    state = F.when(F.col("set_uuid").isNull(), "free").when(F.col("status") == "writable", "writable")
    guess = tapes.next_writable(m.select("pool", "label", "ctime", "set_ctime", state.alias("state"))).select("pool", F.col("label").alias("next_medium"))
    return jobs.join(last, "store", "left").join(guess, "pool", "left").select("job", "pool", "store", "last", "next_medium")


def list_changers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured changers with the vendor and model that a device scan found under their path, null for one that is gone."""
    s, key = _suppliers(spark, sf_dir)
    path = F.concat(F.lit("/dev/sg"), key.cast("string"))
    changers = s.where("s_acctbal > 2000").select(F.col("s_name").alias("changer"), path.alias("path"))
    scan = s.where("s_acctbal > 4000").select(path.alias("path"), F.concat(F.lit("vendor"), (key % 3).cast("string")).alias("vendor"), F.upper("s_name").alias("model"))
    return changers.join(scan, "path", "left").select("changer", "path", "vendor", "model")


def drive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a changer reports with the known medium's id, null for an unknown label; cleaning tapes are skipped."""
    p, key = views.table(spark, sf_dir, "part"), F.col("p_partkey")
    label = F.when(key % 10 == 0, F.concat(F.lit("CLN"), key.cast("string"))).when(key % 10 == 1, F.concat(F.lit("X"), key.cast("string"))).otherwise(F.format_string("T%07d", key))
    seen = p.where("p_partkey % 4 > 1").select(label.alias("label")).where(~F.startswith("label", F.lit("CLN")))
    return seen.join(views.media(spark, sf_dir).select("label", "uuid"), "label", "left")


def list_metric_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric servers with their kind; the server is the host, or else the URL."""
    s, key = _suppliers(spark, sf_dir)
    host = F.when(key % 3 == 0, F.concat(F.lit("metrics"), key.cast("string"), F.lit(":8089")))
    url = F.when(key % 2 == 0, F.concat(F.lit("https://metrics"), key.cast("string"), F.lit(":8086")))
    own = s.where((key % 2 == 0) | (key % 3 == 0)).select(F.col("s_name").alias("name"), host.alias("host"), url.alias("url"), (key % 5 != 0).alias("enable"), F.when(key % 4 != 0, F.concat(F.lit("comment "), key.cast("string"))).alias("comment"))
    return own.select("name", F.when(F.col("host").isNull(), "influxdb-http").otherwise("influxdb-udp").alias("type"), F.coalesce("host", "url").alias("server"), "enable", "comment")


#: Where stores are mounted.
MOUNTS = "/mnt/datastore/"


def list_datastore_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mount units of stores, taken from their files' text: device, path, file system, options, and the path below MOUNTS as the name."""
    s, key = _suppliers(spark, sf_dir)
    k = key.cast("string")
    where = F.concat(F.when(key % 7 == 0, "/srv/").otherwise(MOUNTS), F.lit("disk"), k)
    text = F.concat(F.lit("[Unit]\nDescription=Mount\nWhat=other\n\n[Mount]\nWhat=/dev/disk/by-uuid/"), F.md5("s_name"), F.lit("\nWhere="), where, F.lit("\nType="), F.when(key % 2 == 0, "xfs").otherwise("ext4"), F.when(key % 3 == 0, "\n").otherwise("\nOptions=defaults\n"), F.lit("\n[Install]\nOptions=none\n"))
    files = s.select(F.concat(F.when(key % 5 == 0, "srv-").otherwise("mnt-datastore-"), F.lit("disk"), k, F.when(key % 11 == 0, ".service").otherwise(".mount")).alias("unit"), text.alias("text"))
    value = lambda key: parsers.unit_value(F.col("text"), "Mount", key)
    mounts = files.where(F.col("unit").rlike(r"^mnt-datastore-(.+)\.mount$")).select(F.concat(F.lit("/etc/systemd/system/"), "unit").alias("unitfile"), value("What").alias("device"), value("Where").alias("path"), value("Type").alias("filesystem"), value("Options").alias("options"))
    return mounts.withColumn("name", F.regexp_replace("path", f"^{MOUNTS}", ""))


QUERIES = {f.__name__: f for f in (list_keys, list_traffic_controls, list_domains, list_realms, list_tfa, list_services, node_status, gc_status, list_sync_jobs, list_tape_jobs, list_changers, drive_inventory, list_metric_servers, list_datastore_mounts)}

_REALMS = "r AS (SELECT 'realm' || c_custkey AS realm, ['ldap', 'ad', 'openid'][c_custkey % 3 + 1] AS type, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS comment, c_custkey = 7 AS \"default\" FROM customer)"

ORACLE = {
    "list_keys": "SELECT sha256(s_name) AS fingerprint, CASE WHEN s_suppkey % 3 <> 0 THEN 'hint ' || s_suppkey END AS hint, CASE WHEN s_suppkey % 2 = 0 THEN 'scrypt' ELSE 'pbkdf2' END AS kdf FROM supplier",
    "list_traffic_controls": "SELECT s_name AS name, '10.' || (s_suppkey % 256) || '.0.0/16' AS network, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 50 + 1) * 1000000 END AS rate_in, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 1000 WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 50 + 1) * 1000000 END AS burst_in FROM supplier",
    "list_domains": f"WITH {_REALMS} SELECT * FROM r UNION ALL SELECT 'pam', 'pam', 'Linux PAM standard authentication', NOT (SELECT bool_or(\"default\") FROM r) UNION ALL SELECT 'pbs', 'pbs', 'built-in authentication server', false",
    "list_realms": f"WITH {_REALMS} SELECT * FROM r",
    "list_tfa": f"""WITH c AS (SELECT c_custkey AS k, 'user' || c_custkey || '@local' AS "user", array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'totp' END, CASE WHEN c_custkey % 3 = 0 THEN 'webauthn' END, CASE WHEN c_custkey % 5 = 0 THEN 'recovery' END], lambda x: x IS NOT NULL), ',') AS factors FROM customer)
SELECT "user", factors, k % 7 = 0 AND k * 600 > 86400 AS locked FROM c WHERE factors <> '' AND (k % 4 <> 0 OR k = 4)""",
    "list_services": oracle("v_tasks") + """, u AS (SELECT ['backup-api', 'backup-proxy', 'ssh', 'cron'][task % 4 + 1] AS unit, start AS since, state, row_number() OVER (PARTITION BY task % 4 ORDER BY start DESC, task DESC) AS rn FROM v_tasks),
w AS (SELECT ['backup-api', 'backup-proxy', 'ssh', 'cron'][task % 4 + 1] AS unit, max(start) AS since FROM v_tasks GROUP BY 1),
s AS (SELECT * FROM (VALUES ('backup', 'backup-api'), ('proxy', 'backup-proxy'), ('sshd', 'ssh'), ('syslog', 'rsyslog'), ('cron', 'cron')) v(service, unit))
SELECT service, unit, coalesce(state, 'unknown') AS state, w.since FROM s LEFT JOIN (SELECT * FROM u WHERE rn = 1) u USING (unit) LEFT JOIN w USING (unit)""",
    "node_status": oracle("v_metrics") + f""", a AS (SELECT CAST(sum(n) FILTER (name = 'purchase') AS BIGINT) AS root_total, CAST(sum(n) FILTER (name = 'purchase' AND n % 3 = 0) AS BIGINT) AS root_used, {NOW} - min(ts) AS uptime FROM v_metrics)
SELECT (SELECT round(value, 6) FROM v_metrics WHERE name = 'click' ORDER BY ts DESC, n DESC LIMIT 1) AS cpu, (SELECT round(value, 6) FROM v_metrics WHERE name = 'view' ORDER BY ts DESC, n DESC LIMIT 1) AS load, root_total, root_used, uptime, root_total - root_used AS root_available FROM a""",
    "gc_status": oracle("v_tasks") + f""", s AS (SELECT DISTINCT split_part(worker_id, ':', 1) AS store FROM v_tasks),
l AS (SELECT split_part(worker_id, ':', 1) AS store, *, row_number() OVER (PARTITION BY split_part(worker_id, ':', 1) ORDER BY start DESC, task DESC) AS rn FROM v_tasks WHERE worker_type = 'garbage_collection')
SELECT store, CASE WHEN start IS NOT NULL THEN CASE WHEN stop IS NULL THEN 'running' ELSE state END END AS state, start AS started, stop - start AS duration, CASE WHEN store <> 'store3' THEN (coalesce(stop, {NOW}) // 86400 + 1) * 86400 END AS next_run FROM s LEFT JOIN (SELECT * FROM l WHERE rn = 1) l USING (store)""",
    "list_sync_jobs": "SELECT s_name AS job, CASE WHEN s_suppkey % 4 <> 0 THEN 'remote' || (s_suppkey % 6) END AS remote, 'store' || (s_suppkey % 5) AS store FROM supplier WHERE s_suppkey % 5 <> 3 AND (s_suppkey % 4 = 0 OR s_suppkey % 6 % 2 = 1)",
    "list_tape_jobs": oracle("v_tasks", "v_media") + """, t AS (SELECT split_part(worker_id, ':', 1) AS store, max(start) AS last FROM v_tasks WHERE worker_type = 'backup' GROUP BY 1),
m AS (SELECT *, CASE WHEN set_uuid IS NULL THEN 'free' WHEN status = 'writable' THEN 'writable' END AS state FROM v_media),
n AS (SELECT pool, label, row_number() OVER (PARTITION BY pool ORDER BY CASE state WHEN 'writable' THEN 0 ELSE 1 END, ctime, label) AS rn FROM m WHERE state IS NOT NULL),
p AS (SELECT DISTINCT pool FROM m WHERE pool IS NOT NULL),
g AS (SELECT p.pool, coalesce(n.label, (SELECT label FROM n WHERE pool IS NULL AND rn = 1)) AS next_medium FROM p LEFT JOIN (SELECT * FROM n WHERE rn = 1) n ON n.pool = p.pool)
SELECT s_name AS job, 'Brand#' || (s_suppkey % 7 + 1) AS pool, 'store' || (s_suppkey % 5) AS store, last, next_medium FROM supplier LEFT JOIN t ON t.store = 'store' || (s_suppkey % 5) LEFT JOIN g ON g.pool = 'Brand#' || (s_suppkey % 7 + 1)""",
    "list_changers": "SELECT s_name AS changer, '/dev/sg' || s_suppkey AS path, CASE WHEN s_acctbal > 4000 THEN 'vendor' || (s_suppkey % 3) END AS vendor, CASE WHEN s_acctbal > 4000 THEN upper(s_name) END AS model FROM supplier WHERE s_acctbal > 2000",
    "drive_inventory": oracle("v_media") + "SELECT l.label, uuid FROM (SELECT CASE p_partkey % 10 WHEN 1 THEN 'X' || p_partkey ELSE 'T' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS label FROM part WHERE p_partkey % 4 > 1 AND p_partkey % 10 <> 0) l LEFT JOIN v_media m ON m.label = l.label",
    "list_metric_servers": "SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'influxdb-udp' ELSE 'influxdb-http' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN 'metrics' || s_suppkey || ':8089' ELSE 'https://metrics' || s_suppkey || ':8086' END AS server, s_suppkey % 5 <> 0 AS enable, CASE WHEN s_suppkey % 4 <> 0 THEN 'comment ' || s_suppkey END AS comment FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0",
    "list_datastore_mounts": """SELECT '/etc/systemd/system/mnt-datastore-disk' || s_suppkey || '.mount' AS unitfile, '/dev/disk/by-uuid/' || md5(s_name) AS device, CASE WHEN s_suppkey % 7 = 0 THEN '/srv/' ELSE '/mnt/datastore/' END || 'disk' || s_suppkey AS path,
CASE WHEN s_suppkey % 2 = 0 THEN 'xfs' ELSE 'ext4' END AS filesystem, CASE WHEN s_suppkey % 3 <> 0 THEN 'defaults' END AS options, CASE WHEN s_suppkey % 7 = 0 THEN '/srv/' ELSE '' END || 'disk' || s_suppkey AS name FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 11 <> 0""",
}
