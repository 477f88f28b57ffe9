"""Queries that parse texts: names, paths, status outputs, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers, scalar
from ..sources import views
from ..sources.views import oracle

POOLS = ("tank\t1000\t400\t600\t-\t-\t12\t40\t1.25x\tONLINE", "rpool\t2000\t-\t-\t-\t-\t-\t0\t1.00x\tDEGRADED", "broken line")
STATUS = ("\tNAME        STATE     READ WRITE CKSUM", "\ttank        ONLINE       0     0     0", "\t  mirror-0  ONLINE       0     0     0", "\t    sda     ONLINE       1     2     3", "\t    sdb     FAULTED      0     7     0  too many errors", "\tlogs", "\t  sdc       ONLINE       0     0     0")
CHANGER = ("  Storage Changer dev:2 Drives, 4 Slots ( 1 Import/Export )", "Data Transfer Element 0:Full (Storage Element 1 Loaded):VolumeTag = T0000001", "Data Transfer Element 1:Empty", "      Storage Element 1:Empty", "      Storage Element 2:Full :VolumeTag=T0000002", "      Storage Element 3 IMPORT/EXPORT:Full :VolumeTag=T0000003")
DISKS = ("   14 0 300 2 50 0 900 3 0 77 5 2 0 40 0", "1 2 3 4 5 6 7 8 9 10 11")
SMART = (
    {"model_name": "a", "smart_status": {"passed": True}, "ata_smart_attributes": {"table": [{"id": 5, "name": "Reallocated_Sector_Ct", "value": 100, "raw": {"string": "0"}}, {"id": 177, "name": "Wear_Leveling_Count", "value": 93, "raw": {"string": "41"}}]}},
    {"model_name": "b", "smart_status": {"passed": False}, "nvme_smart_health_information_log": {"percentage_used": 7, "temperature": 40}},
    {"model_name": "c"},
)
REPOSITORIES = ("store1", "backup.example.com:store2", "admin@local@10.0.0.1:8008:store3", "admin@local!tok@host:s", "[::1]:8007:s4", "bad store")
UNITS = ("/mnt/datastore/my store", "/", "a-b/c.d", "/.hidden")
SIZES = ("10", "1.5 MiB", "20MB", "3k", "2 GiB", "x1", "1 TB")


def _lines(spark: SparkSession, lines) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n long, line string")


def snapshot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of snapshots and groups, with namespaces before some, taken apart again."""
    s = views.snapshots(spark, sf_dir)
    moment = F.date_format(F.expr("timestampadd(SECOND, time, TIMESTAMP_NTZ'1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ns = F.when(F.col("sid") % 2 == 0, F.concat(scalar.namespace_path(F.array(F.lit("a"), F.lit("b"))), F.lit("/"))).otherwise("")
    path = F.concat(ns, F.concat_ws("/", "type", "id", F.when(F.col("sid") % 5 != 0, moment)))
    return s.select("sid", *[c.alias(n) for n, c in scalar.snapshot_parts(path).items()])


def archive_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".didx", ".fidx", ".blob", ".txt")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select(F.concat("p_name", suffix).alias("name")).distinct().select("name", scalar.archive_type(F.col("name")).alias("type"))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.snapshots(spark, sf_dir).select((F.col("size") * F.col("sid")).alias("size")).distinct()
    return s.select("size", scalar.human_bytes(F.col("size")).alias("text"))


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names and base64 of full paths of entries."""
    return views.entries(spark, sf_dir).select("path", scalar.basename(F.col("path")).alias("text"), F.base64(F.col("path").cast("binary")).alias("filepath"), "leaf")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lines(spark, REPOSITORIES)
    return r.select("line", *[c.alias(n) for n, c in scalar.repository_parts(F.col("line")).items()])


def unit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, UNITS).select("line", scalar.escape_unit(F.col("line")).alias("unit"))


def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, SIZES).select("line", scalar.parse_bytes(F.col("line")).alias("bytes"))


def vlan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _lines(spark, ("vmbr0.100", "vlan7", "eth0", "enp3s0.4094", "lo"))
    tag, raw = scalar.vlan(F.col("line"))
    return n.select("line", tag.alias("vlan"), raw.alias("raw"), scalar.physical_nic(F.col("line")).alias("physical"))


def pool_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.pool_list(_lines(spark, POOLS))


def pool_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.pool_status(_lines(spark, STATUS))


def changer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.changer_status(_lines(spark, CHANGER))


def disk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, DISKS).select("n", *[c.alias(k) for k, c in parsers.disk_stat(F.col("line")).items()])


def smart_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.smart_attributes(_lines(spark, map(json.dumps, SMART)), "n", "line")


def smart_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.smart_summary(_lines(spark, map(json.dumps, SMART)), "n", "line")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column with a default."""
    return views.table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("-")).alias("none"))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of manifests written as JSON and parsed again, with those on disk only (no size)."""
    r = views.refs(spark, sf_dir).select("sid", F.concat(F.lit("f"), (F.col("part") % 10).cast("string"), F.lit(".didx")).alias("filename"), "size")
    each = r.groupBy("sid", "filename").agg(F.sum("size").alias("size"))
    manifest = each.where("size < 40000").groupBy("sid").agg(F.to_json(F.struct(F.collect_list(F.struct("filename", "size")).alias("files"))).alias("manifest"))
    listed = manifest.select("sid", F.explode(F.from_json("manifest", "files array<struct<filename:string,size:bigint>>")["files"]).alias("f")).select("sid", "f.filename", "f.size")
    on_disk = each.select("sid", "filename")
    return on_disk.join(listed, ["sid", "filename"], "left")


def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of manifests' files as arrays, null as 0."""
    files = manifest_files(spark, sf_dir).groupBy("sid").agg(F.collect_list(F.struct("filename", "size")).alias("files"))
    return files.select("sid", F.size("files").alias("n"), F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f["size"], F.lit(0))).alias("total"))


QUERIES = {f.__name__: f for f in (snapshot_paths, archive_types, human_sizes, path_names, repositories, unit_names, byte_sizes, vlan_names, pool_list, pool_status, changer_status, disk_stats, smart_attributes, smart_summary, json_fields, manifest_files, manifest_totals)}

_FILES = """e AS (SELECT sid, 'f' || (part % 10) || '.didx' AS filename, CAST(sum(size) AS BIGINT) AS size FROM v_refs GROUP BY 1, 2),
m AS (SELECT sid, filename, CASE WHEN size < 40000 THEN size END AS size FROM e)"""
_B = "CAST(NULL AS BIGINT)"

ORACLE = {
    "snapshot_paths": oracle("v_snapshots") + """SELECT sid, CASE WHEN sid % 2 = 0 THEN 'a/b' ELSE '' END AS ns, type, id, CASE WHEN sid % 5 <> 0 THEN strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS time FROM v_snapshots""",
    "archive_types": "SELECT DISTINCT p_name || CASE p_partkey % 4 WHEN 0 THEN '.didx' WHEN 1 THEN '.fidx' WHEN 2 THEN '.blob' ELSE '.txt' END AS name, CASE p_partkey % 4 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'fixed' WHEN 2 THEN 'blob' END AS type FROM part",
    "human_sizes": oracle("v_snapshots") + ", s AS (SELECT DISTINCT size * sid AS size FROM v_snapshots) SELECT size, CASE WHEN size >= 1099511627776 THEN printf('%.2f TiB', size / 1099511627776) WHEN size >= 1073741824 THEN printf('%.2f GiB', size / 1073741824) WHEN size >= 1048576 THEN printf('%.2f MiB', size / 1048576) WHEN size >= 1024 THEN printf('%.2f KiB', size / 1024) ELSE size || ' B' END AS text FROM s",
    "path_names": oracle("v_entries") + "SELECT path, name AS text, base64(encode(path)) AS filepath, leaf FROM v_entries",
    "repositories": "SELECT * FROM (VALUES ('store1', NULL, 'localhost', 8007, 'store1'), ('backup.example.com:store2', NULL, 'backup.example.com', 8007, 'store2'), ('admin@local@10.0.0.1:8008:store3', 'admin@local', '10.0.0.1', 8008, 'store3'), ('admin@local!tok@host:s', 'admin@local!tok', 'host', 8007, 's'), ('[::1]:8007:s4', NULL, '[::1]', 8007, 's4'), ('bad store', NULL, NULL, NULL, NULL)) v(line, \"user\", host, port, store)",
    "unit_names": "SELECT * FROM (VALUES ('/mnt/datastore/my store', 'mnt-datastore-my\\x20store'), ('/', '-'), ('a-b/c.d', 'a\\x2db-c.d'), ('/.hidden', '\\x2ehidden')) v(line, unit)",
    "byte_sizes": "SELECT line, CAST(bytes AS BIGINT) AS bytes FROM (VALUES ('10', 10), ('1.5 MiB', 1572864), ('20MB', 20000000), ('3k', 3000), ('2 GiB', 2147483648), ('x1', NULL), ('1 TB', 1000000000000)) v(line, bytes)",
    "vlan_names": "SELECT * FROM (VALUES ('vmbr0.100', 100, 'vmbr0', false), ('vlan7', 7, NULL, false), ('eth0', NULL, NULL, true), ('enp3s0.4094', 4094, 'enp3s0', false), ('lo', NULL, NULL, false)) v(line, vlan, raw, physical)",
    "pool_list": f"SELECT 'tank' AS name, CAST(1000 AS BIGINT) AS size, CAST(400 AS BIGINT) AS alloc, CAST(600 AS BIGINT) AS free, CAST(12 AS BIGINT) AS frag, CAST(1.25 AS DOUBLE) AS dedup, 'ONLINE' AS health UNION ALL SELECT 'rpool', 2000, {_B}, {_B}, {_B}, 1.0, 'DEGRADED'",
    "pool_status": f"""SELECT CAST(n AS BIGINT) AS n, CAST(level AS BIGINT) AS level, name, state, CAST(read AS BIGINT) AS read, CAST(write AS BIGINT) AS write, CAST(cksum AS BIGINT) AS cksum, msg FROM (VALUES (1, 0, 'tank', 'ONLINE', 0, 0, 0, NULL), (2, 1, 'mirror-0', 'ONLINE', 0, 0, 0, NULL),
(3, 2, 'sda', 'ONLINE', 1, 2, 3, NULL), (4, 2, 'sdb', 'FAULTED', 0, 7, 0, 'too many errors'), (5, 0, 'logs', NULL, NULL, NULL, NULL, NULL), (6, 1, 'sdc', 'ONLINE', 0, 0, 0, NULL)) v(n, level, name, state, read, write, cksum, msg)""",
    "changer_status": "SELECT * FROM (VALUES ('drive', 0, false, true, 'T0000001', 1), ('drive', 1, false, false, NULL, NULL), ('slot', 1, false, false, NULL, NULL), ('slot', 2, false, true, 'T0000002', NULL), ('slot', 3, true, true, 'T0000003', NULL)) v(kind, number, import_export, \"full\", label, loaded_from)",
    "disk_stats": "SELECT CAST(n AS BIGINT) AS n, CAST(a AS BIGINT) AS read_ios, CAST(b AS BIGINT) AS read_sectors, CAST(c AS BIGINT) AS write_ios, CAST(d AS BIGINT) AS write_sectors, CAST(e AS BIGINT) AS io_ticks FROM (VALUES (0, 14, 300, 52, 940, 77), (1, 1, 3, 5, 7, 10)) v(n, a, b, c, d, e)",
    "smart_attributes": "SELECT CAST(n AS BIGINT) AS n, name, raw, normalized FROM (VALUES (0, 'Reallocated_Sector_Ct', '0', 100), (0, 'Wear_Leveling_Count', '41', 93), (1, 'percentage_used', '7', NULL), (1, 'temperature', '40', NULL)) v(n, name, raw, normalized)",
    "smart_summary": "SELECT CAST(n AS BIGINT) AS n, status, CAST(life AS DOUBLE) AS life_left FROM (VALUES (0, 'passed', 93), (1, 'failed', 93), (2, 'unknown', NULL)) v(n, status, life)",
    "json_fields": "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, '-' AS none FROM events",
    "manifest_files": oracle("v_refs", ctes=_FILES) + "SELECT * FROM m",
    "manifest_totals": oracle("v_refs", ctes=_FILES) + "SELECT sid, CAST(count(*) AS INTEGER) AS n, CAST(sum(coalesce(size, 0)) AS BIGINT) AS total FROM m GROUP BY sid",
}
