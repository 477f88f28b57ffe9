"""Plain lists with a privilege filter, host lists, journals, and what else is looked up by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, chunkstore, chunking, hierarchy, host
from ..sources import views
from ..sources.views import NOW, REF_ORDER, oracle


def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured entities: kind, name, comment, secret, disabled, the bits that the caller has on each."""
    s, key = views.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (key % len(KINDS) + 1).cast("int"))
    mask = F.when(key % 3 == 0, access.bits("Datastore.Audit", "Sys.Audit")).when(key % 3 == 1, access.bits("Remote.Audit", "Tape.Audit")).otherwise(access.bits("Datastore.Backup"))
    return s.select(kind.alias("kind"), F.col("s_name").alias("name"), F.when(key % 4 != 0, F.concat(F.lit("comment "), key.cast("string"))).alias("comment"), F.md5("s_name").alias("secret"), (key % 5 == 0).alias("disabled"), mask.cast("long").alias("privs"), key.alias("key"))


KINDS = ("datastore", "remote", "sync", "prune", "verify", "tape-job", "pool", "metric", "gotify", "smtp")
#: What a list asks for by kind.
NEEDS = {"datastore": "Datastore.Audit", "remote": "Remote.Audit", "sync": "Remote.Audit", "prune": "Datastore.Audit", "verify": "Datastore.Audit", "tape-job": "Tape.Audit", "pool": "Tape.Audit", "metric": "Sys.Audit", "gotify": "Sys.Audit", "smtp": "Sys.Audit"}


def list_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all kinds that the caller may see, without secrets."""
    need = F.element_at(F.create_map(*[F.lit(x) for k, p in NEEDS.items() for x in (k, access.bits(p))]), F.col("kind"))
    return _config(spark, sf_dir).where(F.col("privs").bitwiseAND(need.cast("long")) != 0).drop("secret", "privs", "key")


def list_datastores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores in full where the caller may audit them, by name only where there is any other right."""
    c = _config(spark, sf_dir).where("kind = 'datastore'")
    full = access.has_privileges(F.col("privs"), access.bits("Datastore.Audit"))
    some = access.has_privileges(F.col("privs"), access.bits("Datastore.Audit", "Datastore.Backup"), True)
    return c.where(some).select("name", F.when(full, F.col("comment")).alias("comment"), full.alias("full"))


def list_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their last run; disabled ones have no next run."""
    c = _config(spark, sf_dir).where(F.col("kind").isin("sync", "prune", "verify")).withColumn("store", F.concat(F.lit("store"), (F.col("key") % 5).cast("string")))
    kind = F.when(F.col("kind") == "sync", "syncjob").when(F.col("kind") == "prune", "prunejob").otherwise("verificationjob")
    t = views.tasks(spark, sf_dir).groupBy(F.split("worker_id", ":")[0].alias("store"), "worker_type").agg(F.max("start").alias("last"))
    j = c.withColumn("worker_type", kind).join(t, ["store", "worker_type"], "left")
    return j.select("name", "kind", "store", "last", F.when(~F.col("disabled"), (F.floor(F.coalesce("last", F.lit(0)) / 86400) + 1) * 86400).alias("next_run"))


def list_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured drives with what a device scan and the changers' state know of them."""
    s, key = views.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    drives = s.where("s_acctbal > 5000").select(F.col("s_name").alias("drive"), key.alias("serial"))
    scan = s.where("s_acctbal > 7000").select(key.alias("serial"), F.concat(F.lit("vendor"), (key % 3).cast("string")).alias("vendor"))
    state = s.where("s_acctbal > 9000").select(key.alias("serial"), F.lit("busy").alias("state"))
    return drives.join(scan, "serial", "left").join(state, "serial", "left").select("drive", "serial", "vendor", "state")


def notification_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that matchers may name: of entities, jobs, the host and fixed types."""
    c = _config(spark, sf_dir)
    out = c.where("kind = 'datastore'").select(F.lit("datastore").alias("field"), F.col("name").alias("value"))
    out = out.unionByName(c.where("kind IN ('sync', 'prune', 'verify', 'tape-job')").select(F.lit("job-id").alias("field"), F.col("name").alias("value")))
    out = out.unionByName(c.where("kind = 'pool'").select(F.lit("media-pool").alias("field"), F.col("name").alias("value")))
    fixed = [("hostname", "localhost"), ("type", "gc"), ("type", "prune"), ("type", "sync"), ("type", "verify")]
    return out.unionByName(spark.createDataFrame(fixed, "field string, value string")).orderBy("field", "value")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package versions, a fixed list first, each once."""
    p = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_size").cast("string").alias("version")).groupBy("package").agg(F.max("version").alias("version"))
    first = spark.createDataFrame([("Brand#1", 0), ("Brand#2", 1), ("kernel", 2)], "package string, place int")
    return p.join(first, "package", "full_outer").select("package", F.coalesce("version", F.lit("unknown")).alias("version"), F.coalesce("place", F.lit(1000)).alias("place")).orderBy("place", "package")


def _disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("disk"), F.col("p_size").cast("long").alias("size"), "p_type", "p_brand")


def disk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disks by their use; a mounted one counts as mounted whatever else it is."""
    d = _disks(spark, sf_dir)
    flags = {"mounted": d.where("p_type = 'SMALL'"), "lvm": d.where("p_brand = 'Brand#1'"), "zfs": d.where("p_type = 'LARGE'"), "partitions": d.where("size < 20"), "filesystem": d.where("size > 40")}
    return host.disk_usage(d.select("disk", "size"), flags)


def partition_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _disks(spark, sf_dir).select("disk", (F.col("size") % 6).alias("type_id"), F.when(F.col("disk") % 4 == 0, "ext4").alias("fs"))
    types = spark.createDataFrame([(1, "bios"), (2, "efi"), (3, "zfs reserved")], "type_id long, known string")
    return host.partition_use(p, types).select("disk", "type_id", "use")


def package_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of a section with the missing ones that they need."""
    p = views.table(spark, sf_dir, "part")
    name = lambda k: F.concat(F.lit("pkg"), k.cast("string"))
    installed = p.where("p_type <> 'PROMO'").select(name(F.col("p_partkey")).alias("package"), F.col("p_size").cast("string").alias("version"), F.col("p_brand").alias("section"))
    candidates = p.select(name(F.col("p_partkey")).alias("package"), (F.col("p_size") + 1).cast("string").alias("candidate"))
    needs = p.select(name(F.col("p_partkey")).alias("package"), name(F.col("p_partkey") + 2).alias("needs"))
    return host.packages(installed, candidates, needs, F.col("section") == "Brand#3")


def journal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a service between two times, the first 40 of them."""
    t = views.tasks(spark, sf_dir).where((F.col("worker_type") == "backup") & F.col("start").between(NOW - 20 * 86400, NOW - 10 * 86400))
    return t.orderBy("start", "task").limit(40).select("task", "start")


def journal_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host.journal_after(views.tasks(spark, sf_dir), ["start", "task"], (NOW - 15 * 86400, 0), 25).select("task", "start")


def journal_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host.journal_last(views.tasks(spark, sf_dir), ["start", "task"], 30).select("task", "start")


def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in the order of their position on disk, by prefix."""
    c = views.chunks(spark, sf_dir).withColumn("inode", F.when(F.col("part") % 10 != 0, F.col("part") * 7919 % 100003))
    return host.by_locality(c, "inode", "digest").select("digest", F.col("place").cast("long").alias("place"))


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where links lead: every part links to the half of its number until that is odd; a few lead in circles."""
    p = views.table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("path"))
    links = p.where("path % 2 = 0 OR path IN (3, 5)").select("path", F.when(F.col("path") == 3, 5).when(F.col("path") == 5, 3).otherwise(F.floor(F.col("path") / 2)).cast("long").alias("to"))
    return host.resolve_links(links, p, 24)


def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group's snapshots: both keys are given, so only its files would be read in a partitioned store."""
    return views.snapshots(spark, sf_dir).where("type = 'vm' AND id = '37'").select("sid", "time")


def previous_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of each snapshot's finished predecessor in its group."""
    from pyspark.sql import Window

    w = Window.partitionBy("type", "id").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    return views.snapshots(spark, sf_dir).select("sid", F.last(F.when(F.col("finished"), F.col("time")), ignorenulls=True).over(w).alias("previous"))


def ns_target_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces mapped by several prefixes, one level below them at most; one may have several targets."""
    ns = views.namespaces(spark, sf_dir)
    maps = spark.createDataFrame([(["EUROPE"], ["eu"], 1), (["ASIA"], ["a"], 0), ([], ["all"], 1)], "source array<string>, target array<string>, most int")
    # prefixes of a path are few, so the prefix match is an equality
    prefixes = ns.select("ns", F.explode(F.transform(F.sequence(F.lit(0), F.size("ns")), lambda i: F.struct(F.array_join(F.slice("ns", F.lit(1), i), "/").alias("p"), (F.size("ns") - i).alias("below")))).alias("x"))
    hit = prefixes.join(maps.withColumn("p", F.array_join("source", "/")), F.col("x.p") == F.col("p")).where("x.below <= most")
    return hit.select(F.array_join("ns", "/").alias("ns"), F.array_join(hierarchy.map_prefix(F.col("ns"), F.col("source"), F.col("target")), "/").alias("target"))


def ns_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.namespaces(spark, sf_dir)
    return n.agg(F.max(F.size("ns")).alias("deepest"), F.count("*").alias("namespaces"), F.max(F.size("ns") < hierarchy.MAX_DEPTH).alias("fits"))


def privilege_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a caller's bits allow on each entity: all, own ones only, or nothing."""
    p = F.col("privs")
    gate = F.when(access.has_privileges(p, access.bits("Datastore.Audit")), "all").when(access.has_privileges(p, access.bits("Datastore.Backup")), "own").otherwise("denied")
    return _config(spark, sf_dir).select("name", gate.alias("access"))


def acl_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the rules and of the entities, and the fixed ones, once each."""
    fixed = spark.createDataFrame([("/",), ("/access",), ("/datastore",), ("/remote",), ("/system",), ("/tape",)], "path string")
    entities = _config(spark, sf_dir).where("kind IN ('datastore', 'remote')").select(F.concat(F.lit("/"), "kind", F.lit("/"), "name").alias("path"))
    return fixed.union(entities).distinct()


def pull_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of several pulls added up, what vanished only where it was counted."""
    t = views.tasks(spark, sf_dir).where("worker_type = 'syncjob'")
    return t.groupBy(F.split("worker_id", ":")[0].alias("store")).agg(F.count("*").alias("pulls"), F.sum("duration").alias("elapsed"), F.sum(F.when(F.col("task") % 3 == 0, F.col("task") % 10)).alias("vanished"))


def fixed_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of indexes over their digests alone."""
    e = chunkstore.with_offsets(views.refs(spark, sf_dir), "sid", REF_ORDER)
    return e.groupBy("sid").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]), ","), 256).alias("csum"))


def manifest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests with a verification state put into their free part, other keys kept."""
    s = views.snapshots(spark, sf_dir)
    before = s.select("sid", F.to_json(F.struct(F.col("notes"), F.lit("old").alias("verify"))).alias("j"), "verify_state")
    merged = F.map_concat(F.map_filter(F.from_json("j", "map<string,string>"), lambda k, v: k != "verify"), F.create_map(F.lit("verify"), F.coalesce("verify_state", F.lit("none"))))
    return before.select("sid", F.try_element_at(merged, F.lit("notes")).alias("notes"), F.try_element_at(merged, F.lit("verify")).alias("verify"))


def manifest_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of all snapshots' manifests; the free part (notes) doesn't count."""
    s = views.snapshots(spark, sf_dir)
    manifest = F.to_json(F.struct("type", "id", F.struct("notes").alias("unprotected")))
    own = F.from_json(manifest, "type string, id string")
    return s.select("sid", chunking.hmac_sha256(b"key", F.to_json(F.struct(own["id"].alias("id"), own["type"].alias("type")))).alias("signature"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged states of jobs: created, started or finished, as structs taken apart."""
    t = views.tasks(spark, sf_dir)
    tag = F.when(F.col("task") % 13 == 0, "created").when(F.col("stop").isNull(), "started").otherwise("finished")
    state = F.struct(tag.alias("tag"), F.when(tag == "created", None).otherwise(F.col("start")).alias("time"), F.when(tag == "finished", F.col("state")).alias("state"))
    return t.withColumn("s", state).groupBy("s.tag", "s.state").agg(F.count("*").alias("jobs"), F.max("s.time").alias("last"))


def top_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's list: sorted, with sizes rendered, each row also as JSON."""
    from ..functions.scalar import human_bytes

    s = views.snapshots(spark, sf_dir).orderBy(F.desc("size"), "sid").limit(20)
    return s.select("sid", human_bytes(F.col("size")).alias("size"), F.to_json(F.struct("type", "id")).alias("json"))


QUERIES = {f.__name__: f for f in (list_config, list_datastores, list_jobs, list_drives, notification_values, versions, disk_usage, partition_use, package_list, journal_range, journal_after, journal_last, chunk_order, link_targets, snapshot_lookup, previous_backup, ns_target_join, ns_depths, privilege_gate, acl_paths, pull_stats, fixed_checksums, manifest_update, manifest_signatures, job_states, top_outputs)}

_BITS = {p: access.bits(p) for p in access.PRIVILEGES}
_CONFIG = f"""c AS (SELECT ['{"', '".join(KINDS)}'][s_suppkey % {len(KINDS)} + 1] AS kind, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 'comment ' || s_suppkey END AS comment, s_suppkey % 5 = 0 AS disabled,
CAST(CASE s_suppkey % 3 WHEN 0 THEN {access.bits("Datastore.Audit", "Sys.Audit")} WHEN 1 THEN {access.bits("Remote.Audit", "Tape.Audit")} ELSE {_BITS["Datastore.Backup"]} END AS BIGINT) AS privs, s_suppkey AS key FROM supplier)"""
_NEED = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_BITS[p]}" for k, p in NEEDS.items()) + " END"

ORACLE = {
    "list_config": f"WITH {_CONFIG} SELECT kind, name, comment, disabled FROM c WHERE privs & {_NEED} <> 0",
    "list_datastores": f"WITH {_CONFIG} SELECT name, CASE WHEN privs & {_BITS['Datastore.Audit']} <> 0 THEN comment END AS comment, privs & {_BITS['Datastore.Audit']} <> 0 AS \"full\" FROM c WHERE kind = 'datastore' AND privs & {access.bits('Datastore.Audit', 'Datastore.Backup')} <> 0",
    "list_jobs": oracle("v_tasks", ctes=_CONFIG) + """, t AS (SELECT split_part(worker_id, ':', 1) AS store, worker_type, max(start) AS last FROM v_tasks GROUP BY 1, 2),
j AS (SELECT *, 'store' || (key % 5) AS store, CASE kind WHEN 'sync' THEN 'syncjob' WHEN 'prune' THEN 'prunejob' ELSE 'verificationjob' END AS worker_type FROM c WHERE kind IN ('sync', 'prune', 'verify'))
SELECT name, kind, store, last, CASE WHEN NOT disabled THEN (coalesce(last, 0) // 86400 + 1) * 86400 END AS next_run FROM j LEFT JOIN t USING (store, worker_type)""",
    "list_drives": "SELECT s_name AS drive, s_suppkey AS serial, CASE WHEN s_acctbal > 7000 THEN 'vendor' || (s_suppkey % 3) END AS vendor, CASE WHEN s_acctbal > 9000 THEN 'busy' END AS state FROM supplier WHERE s_acctbal > 5000",
    "notification_values": f"WITH {_CONFIG} SELECT CASE kind WHEN 'datastore' THEN 'datastore' WHEN 'pool' THEN 'media-pool' ELSE 'job-id' END AS field, name AS value FROM c WHERE kind IN ('datastore', 'sync', 'prune', 'verify', 'tape-job', 'pool') UNION ALL SELECT * FROM (VALUES ('hostname', 'localhost'), ('type', 'gc'), ('type', 'prune'), ('type', 'sync'), ('type', 'verify')) v(f, v)",
    "versions": "WITH p AS (SELECT p_brand AS package, max(CAST(p_size AS VARCHAR)) AS version FROM part GROUP BY 1), f AS (SELECT * FROM (VALUES ('Brand#1', 0), ('Brand#2', 1), ('kernel', 2)) v(package, place)) SELECT package, coalesce(version, 'unknown') AS version, coalesce(place, 1000) AS place FROM p FULL JOIN f USING (package)",
    "disk_usage": "SELECT p_partkey AS disk, CAST(p_size AS BIGINT) AS size, CASE WHEN p_type = 'SMALL' THEN 'mounted' WHEN p_brand = 'Brand#1' THEN 'lvm' WHEN p_type = 'LARGE' THEN 'zfs' WHEN p_size < 20 THEN 'partitions' WHEN p_size > 40 THEN 'filesystem' ELSE 'unused' END AS usage FROM part",
    "partition_use": "SELECT p_partkey AS disk, CAST(p_size % 6 AS BIGINT) AS type_id, CASE p_size % 6 WHEN 1 THEN 'bios' WHEN 2 THEN 'efi' WHEN 3 THEN 'zfs reserved' ELSE CASE WHEN p_partkey % 4 = 0 THEN 'filesystem' ELSE 'unused' END END AS use FROM part",
    "package_list": """WITH i AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS version FROM part WHERE p_type <> 'PROMO' AND p_brand = 'Brand#3'),
m AS (SELECT DISTINCT k + 2 AS k FROM i WHERE k + 2 NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')), u AS (SELECT k, version FROM i UNION ALL SELECT k, NULL FROM m)
SELECT 'pkg' || k AS package, version, CAST(p_size + 1 AS VARCHAR) AS candidate FROM u LEFT JOIN part ON k = p_partkey""",
    "journal_range": oracle("v_tasks") + f"SELECT task, start FROM v_tasks WHERE worker_type = 'backup' AND start BETWEEN {NOW - 20 * 86400} AND {NOW - 10 * 86400} ORDER BY start, task LIMIT 40",
    "journal_after": oracle("v_tasks") + f"SELECT task, start FROM v_tasks WHERE (start, task) > ({NOW - 15 * 86400}, 0) ORDER BY start, task LIMIT 25",
    "journal_last": oracle("v_tasks") + "SELECT task, start FROM v_tasks ORDER BY start DESC, task DESC LIMIT 30",
    "chunk_order": oracle("v_chunks") + "SELECT digest, row_number() OVER (PARTITION BY digest[1:2] ORDER BY CASE WHEN part % 10 <> 0 THEN part * 7919 % 100003 END NULLS LAST, digest) AS place FROM v_chunks",
    "link_targets": "WITH RECURSIVE t AS (SELECT p_partkey AS path, p_partkey AS k FROM part WHERE p_partkey > 0 UNION ALL SELECT path, k // 2 FROM t WHERE k % 2 = 0) SELECT path, min(CASE WHEN k NOT IN (3, 5) THEN k END) AS target FROM t WHERE k % 2 = 1 GROUP BY path",
    "snapshot_lookup": oracle("v_snapshots") + "SELECT sid, time FROM v_snapshots WHERE type = 'vm' AND id = '37'",
    "previous_backup": oracle("v_snapshots") + "SELECT sid, max(CASE WHEN finished THEN time END) OVER (PARTITION BY type, id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM v_snapshots",
    "ns_target_join": oracle("v_namespaces") + "SELECT array_to_string(ns, '/') AS ns, array_to_string(['eu'] || ns[2:], '/') AS target FROM v_namespaces WHERE ns[1] = 'EUROPE' AND len(ns) <= 2 UNION ALL SELECT 'ASIA', 'a' UNION ALL SELECT array_to_string(ns, '/'), array_to_string(['all'] || ns, '/') FROM v_namespaces WHERE len(ns) <= 1",
    "ns_depths": oracle("v_namespaces") + "SELECT CAST(max(len(ns)) AS INTEGER) AS deepest, count(*) AS namespaces, true AS fits FROM v_namespaces",
    "privilege_gate": f"WITH {_CONFIG} SELECT name, CASE WHEN privs & {_BITS['Datastore.Audit']} <> 0 THEN 'all' WHEN privs & {_BITS['Datastore.Backup']} <> 0 THEN 'own' ELSE 'denied' END AS access FROM c",
    "acl_paths": f"WITH {_CONFIG} SELECT '/' || kind || '/' || name AS path FROM c WHERE kind IN ('datastore', 'remote') UNION SELECT unnest(['/', '/access', '/datastore', '/remote', '/system', '/tape'])",
    "pull_stats": oracle("v_tasks") + "SELECT split_part(worker_id, ':', 1) AS store, count(*) AS pulls, CAST(sum(duration) AS BIGINT) AS elapsed, CAST(sum(CASE WHEN task % 3 = 0 THEN task % 10 END) AS BIGINT) AS vanished FROM v_tasks WHERE worker_type = 'syncjob' GROUP BY 1",
    "fixed_checksums": oracle("v_index") + "SELECT sid, sha256(string_agg(digest, ',' ORDER BY pos)) AS csum FROM v_index GROUP BY sid",
    "manifest_update": oracle("v_snapshots") + "SELECT sid, notes, coalesce(verify_state, 'none') AS verify FROM v_snapshots",
    "manifest_signatures": oracle("v_snapshots") + f"SELECT sid, sha256(unhex('{chunking.pad(b'key', 0x5C)}') || unhex(sha256(unhex('{chunking.pad(b'key', 0x36)}') || encode('{{\"id\":\"' || id || '\",\"type\":\"' || type || '\"}}')))) AS signature FROM v_snapshots",
    "job_states": oracle("v_tasks") + """, s AS (SELECT CASE WHEN task % 13 = 0 THEN 'created' WHEN stop IS NULL THEN 'started' ELSE 'finished' END AS tag, start, state FROM v_tasks)
SELECT tag, CASE WHEN tag = 'finished' THEN state END AS state, count(*) AS jobs, max(CASE WHEN tag <> 'created' THEN start END) AS last FROM s GROUP BY 1, 2""",
    "top_outputs": oracle("v_snapshots") + "SELECT sid, printf('%.2f KiB', size / 1024) AS size, '{\"type\":\"' || type || '\",\"id\":\"' || id || '\"}' AS json FROM v_snapshots ORDER BY v_snapshots.size DESC, sid LIMIT 20",
}
