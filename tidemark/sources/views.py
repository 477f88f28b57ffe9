"""Domain views over the driver's tables: one function for each, and the same definition as SQL for the checks.

Times are epoch seconds in UTC, whatever the session's time zone is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that "now" means in checked queries: 2024-02-01 00:00:00 UTC.
NOW = 1_706_745_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    t = F.col(column).cast("timestamp_ntz")
    return F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each snapshot: sid, type, id, time, finished, protected, owner, size, verify_state, verified, crypt_mode, notes."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    time = epoch("o_orderdate") + key % 86400
    return o.select(
        key.alias("sid"),
        F.when(F.col("o_orderstatus") == "F", "ct").when(F.col("o_orderstatus") == "O", "host").otherwise("vm").alias("type"),
        F.col("o_custkey").cast("string").alias("id"),
        time.alias("time"),
        (F.col("o_totalprice") >= 50000).alias("finished"),
        (F.col("o_orderpriority") == "1-URGENT").alias("protected"),
        F.concat(F.lit("user"), (F.col("o_custkey") % 7).cast("string"), F.lit("@local")).alias("owner"),
        F.floor("o_totalprice").cast("long").alias("size"),
        F.when(key % 5 == 0, None).when(key % 5 == 1, "failed").otherwise("ok").alias("verify_state"),
        F.when(key % 5 == 0, None).otherwise(time + 86400 * (key % 60)).alias("verified"),
        F.when(key % 4 == 0, "encrypt").when(key % 4 == 1, "sign-only").otherwise("none").alias("crypt_mode"),
        F.concat_ws("\n", "o_orderpriority", F.concat(F.lit("order "), key.cast("string"))).alias("notes"),
    )


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths ns as arrays: the root, regions and nations."""
    regions = table(spark, sf_dir, "region")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))
    root = spark.range(1).select(F.array().cast("array<string>").alias("ns"))
    return root.union(regions.select(F.array("r_name"))).union(nations.select(F.array("r_name", "n_name")))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each index entry: sid, part (the chunk's number), digest, size, and the columns that order them."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("sid"), F.col("l_partkey").alias("part"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"), (F.col("l_quantity") * 1024).cast("long").alias("size"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


#: The total order of the entries of one index.
REF_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each stored chunk: part, digest, disk_size, atime, bad, raw_size. Parts of two sizes are missing."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.where(~F.col("p_size").isin(17, 34)).select(key.alias("part"), F.sha2(key.cast("string"), 256).alias("digest"), (F.col("p_size") * 1000).cast("long").alias("disk_size"), (F.lit(NOW - 10 * 86400) + key % 480 * 3600).alias("atime"), (key % 97 == 0).alias("bad"), (F.col("p_size") * 1500).cast("long").alias("raw_size"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each worker: task, start, stop, worker_type, worker_id, user, duration, state."""
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    start, took = epoch("ts"), F.floor(F.abs("value")).cast("long")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in TASK_TYPES for x in pair]), F.col("event_type"))
    state = F.when(key % 11 == 0, None).when(key % 7 == 0, "error").when(key % 5 == 0, "warning").otherwise("ok")
    return e.select(key.alias("task"), start.alias("start"), F.when(key % 11 == 0, None).otherwise(start + took).alias("stop"), kind.alias("worker_type"), F.concat(F.lit("store"), (F.col("user_id") % 5).cast("string"), F.lit(":"), F.when(key % 3 == 0, "vm/100").otherwise("ct/200")).alias("worker_id"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@local")).alias("user"), took.alias("duration"), state.alias("state"))


#: Event types as worker types.
TASK_TYPES = (("click", "backup"), ("purchase", "prunejob"), ("error", "verificationjob"), ("signup", "syncjob"), ("view", "garbage_collection"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time series in long form: name, ts, value."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), epoch("ts").alias("ts"), "value", F.col("event_id").alias("n"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks of a stream: sid, source, pos, digest, size."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("sid"), "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n"))).select("sid", "source", "pos", F.sha2("col", 256).alias("digest"), F.octet_length("col").cast("long").alias("size"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges of the tree that the pages' URLs make: parent, name, path, depth, leaf."""
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    parts = p.select(F.filter(F.split(bare, "/"), lambda x: x != "").alias("parts"))
    step = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("i"))
    path = F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("i")), "/"))
    parent = F.when(F.col("i") == 1, "/").otherwise(F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("i") - 1), "/")))
    rows = step.select(parent.alias("parent"), F.element_at("parts", F.col("i")).alias("name"), path.alias("path"), F.col("i").alias("depth"), (F.col("i") == F.size("parts")).alias("leaf"))
    return rows.groupBy("parent", "name", "path", "depth").agg(F.every("leaf").alias("leaf"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tapes: uuid, label, ctime, pool, set_uuid, seq_nr, set_ctime, status, location."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    used = key % 13 != 0
    set_uuid = F.concat("p_brand", F.lit("/"), (key % 5).cast("string"))
    ctime = F.lit(NOW - 400 * 86400) + key * 60
    return p.select(
        F.md5(key.cast("string")).alias("uuid"),
        F.format_string("T%07d", key).alias("label"),
        ctime.alias("ctime"),
        F.when(key % 29 == 0, None).otherwise(F.col("p_brand")).alias("pool"),
        F.when(used & (key % 29 != 0), set_uuid).alias("set_uuid"),
        F.when(used & (key % 29 != 0), F.col("p_size") % 7).cast("int").alias("seq_nr"),
        F.when(used & (key % 29 != 0), F.lit(NOW - 300 * 86400) + (key % 5) * 30 * 86400).alias("set_ctime"),
        F.when(key % 31 == 0, "damaged").when(key % 37 == 0, "retired").when(key % 2 == 0, "full").otherwise("writable").alias("status"),
        F.when(key % 4 == 0, "vault").when(key % 4 == 1, "offline").otherwise("changer0").alias("location"),
    )


#: The same views for DuckDB, by name.
SQL = {
    "v_snapshots": """SELECT o_orderkey AS sid, CASE o_orderstatus WHEN 'F' THEN 'ct' WHEN 'O' THEN 'host' ELSE 'vm' END AS type,
  CAST(o_custkey AS VARCHAR) AS id, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS time, o_totalprice >= 50000 AS finished,
  o_orderpriority = '1-URGENT' AS protected, 'user' || (o_custkey % 7) || '@local' AS owner, CAST(floor(o_totalprice) AS BIGINT) AS size,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'failed' ELSE 'ok' END AS verify_state,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 + 86400 * (o_orderkey % 60) END AS verified,
  CASE o_orderkey % 4 WHEN 0 THEN 'encrypt' WHEN 1 THEN 'sign-only' ELSE 'none' END AS crypt_mode,
  o_orderpriority || chr(10) || 'order ' || o_orderkey AS notes FROM orders""",
    "v_namespaces": """SELECT CAST([] AS VARCHAR[]) AS ns UNION ALL SELECT [r_name] FROM region
  UNION ALL SELECT [r_name, n_name] FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_refs": """SELECT l_orderkey AS sid, l_partkey AS part, sha256(CAST(l_partkey AS VARCHAR)) AS digest, CAST(l_quantity * 1024 AS BIGINT) AS size,
  l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem""",
    "v_index": """SELECT sid, part, digest, size, pos, sum(size) OVER (PARTITION BY sid ORDER BY pos) - size AS start_off, sum(size) OVER (PARTITION BY sid ORDER BY pos) AS end_off
  FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos FROM v_refs)""",
    "v_chunks": f"""SELECT p_partkey AS part, sha256(CAST(p_partkey AS VARCHAR)) AS digest, CAST(p_size * 1000 AS BIGINT) AS disk_size,
  {NOW - 10 * 86400} + p_partkey % 480 * 3600 AS atime, p_partkey % 97 = 0 AS bad, CAST(p_size * 1500 AS BIGINT) AS raw_size FROM part WHERE p_size NOT IN (17, 34)""",
    "v_tasks": """SELECT event_id AS task, CAST(floor(epoch(ts)) AS BIGINT) AS start,
  CASE WHEN event_id % 11 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(abs(value)) AS BIGINT) END AS stop,
  CASE event_type WHEN 'click' THEN 'backup' WHEN 'purchase' THEN 'prunejob' WHEN 'error' THEN 'verificationjob' WHEN 'signup' THEN 'syncjob' ELSE 'garbage_collection' END AS worker_type,
  'store' || (user_id % 5) || ':' || CASE WHEN event_id % 3 = 0 THEN 'vm/100' ELSE 'ct/200' END AS worker_id, 'user' || user_id || '@local' AS "user",
  CAST(floor(abs(value)) AS BIGINT) AS duration,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'warning' ELSE 'ok' END AS state FROM events""",
    "v_metrics": "SELECT event_type AS name, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_id AS n FROM events",
    "v_lines": """SELECT sid, source, pos - 1 AS pos, sha256(line) AS digest, CAST(strlen(line) AS BIGINT) AS size
  FROM (SELECT doc_id AS sid, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)""",
    "v_entries": """SELECT parent, name, path, depth, bool_and(leaf) AS leaf FROM (
  SELECT CASE WHEN i = 1 THEN '/' ELSE '/' || array_to_string(parts[1:i - 1], '/') END AS parent, parts[i] AS name, '/' || array_to_string(parts[1:i], '/') AS path, CAST(i AS INTEGER) AS depth, i = len(parts) AS leaf
  FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/'), lambda x: x <> '') AS parts FROM pages))) GROUP BY ALL""",
    "v_media": f"""SELECT md5(CAST(p_partkey AS VARCHAR)) AS uuid, 'T' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS label, {NOW - 400 * 86400} + p_partkey * 60 AS ctime,
  CASE WHEN p_partkey % 29 <> 0 THEN p_brand END AS pool, CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 29 <> 0 THEN p_brand || '/' || (p_partkey % 5) END AS set_uuid,
  CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 29 <> 0 THEN CAST(p_size % 7 AS INTEGER) END AS seq_nr,
  CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 29 <> 0 THEN {NOW - 300 * 86400} + (p_partkey % 5) * 30 * 86400 END AS set_ctime,
  CASE WHEN p_partkey % 31 = 0 THEN 'damaged' WHEN p_partkey % 37 = 0 THEN 'retired' WHEN p_partkey % 2 = 0 THEN 'full' ELSE 'writable' END AS status,
  CASE p_partkey % 4 WHEN 0 THEN 'vault' WHEN 1 THEN 'offline' ELSE 'changer0' END AS location FROM part""",
}
#: Views that others build on.
_NEEDS = {"v_index": ("v_refs",)}


def oracle(*views: str, ctes: str = "", recursive: bool = False) -> str:
    """WITH clause of the named views, and of more common table expressions if given."""
    names = list(dict.fromkeys(n for v in views for n in (*_NEEDS.get(v, ()), v)))
    parts = [f"{n} AS ({SQL[n]})" for n in names] + ([ctes] if ctes else [])
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} "
