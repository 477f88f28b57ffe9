"""Namespaces, entry trees, and access control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, hierarchy
from ..sources import views
from ..sources.views import oracle

#: Regions are stores' namespaces here; r0 and r1 stand for the names of the first two.
RULES = (
    "acl:1:/:admin@local:Admin",
    "acl:1:/datastore:audit@local,power@local:DatastoreAudit",
    "acl:0:/datastore/main/ASIA:reader@local:DatastoreReader",
    "acl:1:/datastore/main/EUROPE:reader@local,backup@local:DatastoreReader,DatastoreBackup",
    "acl:1:/datastore/main/EUROPE/NATION_3:reader@local:NoAccess",
    "acl:1:/datastore/main/AMERICA:@ops,power@local:DatastoreAdmin",
    "acl:0:/datastore/main/AMERICA/NATION_1:power@local:NoAccess,DatastoreBackup",
    "acl:1:/datastore/main/AMERICA:power@local!job:DatastorePowerUser",
    "acl:1:/datastore/main/AFRICA:backup@local:DatastoreBackup,TapeReader",
    "not a rule",
)
USERS = ("admin@local", "audit@local", "reader@local", "backup@local", "power@local", "power@local!job", "ops")


def _rules(spark: SparkSession) -> DataFrame:
    return access.text_rules(RULES, spark)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = views.namespaces(spark, sf_dir).select(hierarchy.acl_path(F.col("ns"), "main").alias("path"))
    return paths.select(F.explode(F.array(*[F.lit(u) for u in USERS])).alias("user"), "path")


def _text(path: str):
    return F.concat(F.lit("/"), F.array_join(path, "/")).alias("path")


def ns_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces from EUROPE down."""
    return hierarchy.walk(views.namespaces(spark, sf_dir), ["EUROPE"], 3).select(F.array_join("ns", "/").alias("ns"), "below")


def ns_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, parent, path for access control, and the prefix AMERICA replaced."""
    ns = F.col("ns")
    source, target = F.array(F.lit("AMERICA")), F.array(F.lit("copies"), F.lit("us"))
    return views.namespaces(spark, sf_dir).select(F.array_join("ns", "/").alias("ns"), F.size("ns").alias("depth"), F.array_join(hierarchy.parent(ns), "/").alias("parent"), F.array_join(hierarchy.acl_path(ns, "main"), "/").alias("acl_path"), F.array_join(hierarchy.map_prefix(ns, source, target), "/").alias("mapped"))


def catalog_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.dump(views.entries(spark, sf_dir)).select("path", "leaf")


def catalog_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with a 2, but nothing below /m. hosts or fr directories."""
    return hierarchy.find(views.entries(spark, sf_dir), "2", "^/m[.]|/fr$")


def catalog_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories by their number of entries and leaves."""
    return views.entries(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("entries"), F.count_if("leaf").alias("leaves"))


def path_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of a typed prefix in the root directory."""
    return views.entries(spark, sf_dir).where((F.col("parent") == "/") & F.startswith("name", F.lit("th"))).select("name")


def glob_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a list of patterns takes; the last match decides."""
    e = views.entries(spark, sf_dir)
    return hierarchy.select_patterns(e, "path", ["!**/en/*", "**/en/1*", "!/m.*"]).select("path", "included")


def acl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark).select(_text("path"), "ugid", "is_group", "role", "propagate")


def acl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as text, users of equal roles together."""
    return access.serialize(_rules(spark))


def acl_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.roles(_rules(spark), _targets(spark, sf_dir)).select("user", _text("path"), "role", "propagate")


def acl_privs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.privileges(_rules(spark), _targets(spark, sf_dir)).select("user", _text("path"), "privs", "propagated")


def permission_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.permission_map(access.privileges(_rules(spark), _targets(spark, sf_dir))).select("user", _text("path"), "privilege", "propagate")


def acl_any_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who may back up anywhere below the store."""
    return access.any_below(access.privileges(_rules(spark), _targets(spark, sf_dir)), ["datastore", "main"], access.bits("Datastore.Backup"))


def acl_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.child_paths(_rules(spark), "power@local", ["datastore"]).select(_text("path"))


def role_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles with the names of their privileges."""
    r = spark.createDataFrame(list(access.ROLES.items()), "role string, privs long")
    return r.select("role", F.array_join(access.privilege_names(F.col("privs")), ",").alias("names"))


def accessible_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of namespaces that backup@local may see: its own ones where it may only back up, all where it may audit."""
    o = views.snapshots(spark, sf_dir).select("type", "id", "owner", "sid").join(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), "o_custkey"), "sid")
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = views.table(spark, sf_dir, "nation").join(views.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ns = n.select(F.col("n_nationkey").alias("c_nationkey"), F.array(F.lit("datastore"), F.lit("main"), "r_name", "n_name").alias("path"))
    groups = o.join(c, "o_custkey").select("c_nationkey", "type", "id", "owner").distinct().join(ns, "c_nationkey")
    p = access.privileges(_rules(spark), ns.select(F.lit("backup@local").alias("user"), "path"))
    audit, backup = access.bits("Datastore.Audit"), access.bits("Datastore.Backup")
    sees = access.has_privileges(F.col("privs"), audit) | (access.has_privileges(F.col("privs"), backup) & (F.col("owner") == "user3@local"))
    return groups.join(p, "path").where(sees).groupBy(_text("path")).agg(F.count("*").alias("groups"))


def equal_member_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose parts come in the same sizes, with those sizes."""
    p = views.table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), (F.col("p_partkey") % 6).cast("string").alias("k"))
    return access.group_equal_lists(p, "k", "size")


def group_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their snapshots nested, read back as the newest child's time and the number of children."""
    t = hierarchy.nested(views.snapshots(spark, sf_dir))
    return t.select("type", "id", F.size("children").alias("n"), F.col("children")[0]["time"].alias("newest"))


def indented_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of lines by their indentation; the levels come from part sizes, made to skip none but in a few lists."""
    p = views.table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("list"), F.col("p_partkey").alias("line"), (F.floor(F.col("p_partkey") / 50) % 4).cast("long").alias("level"))
    return hierarchy.indented_parents(p, "list", "line", "level").select("list", "line", "level", "parent", "ok")


QUERIES = {f.__name__: f for f in (ns_walk, ns_properties, catalog_dump, catalog_find, catalog_ls, path_complete, glob_select, acl_parse, acl_lines, acl_roles, acl_privs, permission_map, acl_any_below, acl_children, role_list, accessible_groups, equal_member_lists, group_tree, indented_tree)}


def _rule_rows() -> list[tuple[str, str, bool, str, bool]]:
    out = []
    for line in RULES:
        f = line.split(":")
        if len(f) == 5:
            out += [(f[2].strip("/"), u.lstrip("@"), u.startswith("@"), r, f[1] == "1") for u in f[3].split(",") for r in f[4].split(",")]
    return out


_VALUES = ", ".join(f"('{p}', '{u}', {g}, '{r}', {q})" for p, u, g, r, q in _rule_rows())
_ACL = f"""r AS (SELECT CASE WHEN p = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(p, '/') END AS path, ugid, is_group, role, propagate FROM (VALUES {_VALUES}) v(p, ugid, is_group, role, propagate)),
roles(role, bits) AS (VALUES {', '.join(f"('{r}', CAST({b} AS BIGINT))" for r, b in access.ROLES.items())}),
privs(name, bit) AS (VALUES {', '.join(f"('{n}', CAST({1 << i} AS BIGINT))" for i, n in enumerate(access.PRIVILEGES))}),
t AS (SELECT u AS "user", ['datastore', 'main'] || ns AS path FROM v_namespaces, (SELECT unnest([{', '.join(f"'{u}'" for u in USERS)}]) AS u)),
h AS (SELECT t."user", t.path, len(r.path) AS n, role, propagate FROM t JOIN r ON NOT is_group AND ugid = "user" AND t.path[1:len(r.path)] = r.path AND (propagate OR len(r.path) = len(t.path))),
d AS (SELECT h.* FROM h JOIN (SELECT "user", path, max(n) AS n FROM h GROUP BY "user", path) m USING ("user", path, n)),
e AS (SELECT *, bool_or(role = 'NoAccess') OVER (PARTITION BY "user", path) AS none FROM d),
f AS (SELECT "user", path, role, bool_or(propagate) AS propagate FROM e WHERE NOT none OR role = 'NoAccess' GROUP BY "user", path, role),
s AS (SELECT "user", path, bit_or(bits) AS p, bit_or(CASE WHEN propagate THEN bits ELSE 0 END) AS q FROM f JOIN roles USING (role) GROUP BY "user", path),
w AS (SELECT t."user", t.path, coalesce(s.p, 0) AS p, coalesce(s.q, 0) AS q FROM t LEFT JOIN s USING ("user", path)),
x AS (SELECT w."user", w.path, CASE WHEN w."user" LIKE '%!%' THEN w.p & coalesce(o.p, 0) ELSE w.p END AS privs, CASE WHEN w."user" LIKE '%!%' THEN w.q & coalesce(o.q, 0) ELSE w.q END AS propagated FROM w LEFT JOIN s o ON o."user" = split_part(w."user", '!', 1) AND o.path = w.path)"""
_P = "'/' || array_to_string(path, '/') AS path"
_WALK = """t AS (SELECT CASE WHEN parent = '/' THEN '' ELSE parent END || '/' || name AS path, leaf FROM v_entries WHERE parent = '/'{0}
UNION ALL SELECT t.path || '/' || e.name, e.leaf FROM t JOIN v_entries e ON e.parent = t.path{1})"""

ORACLE = {
    "ns_walk": oracle("v_namespaces") + "SELECT array_to_string(ns, '/') AS ns, CAST(len(ns) - 1 AS INTEGER) AS below FROM v_namespaces WHERE ns[1] = 'EUROPE'",
    "ns_properties": oracle("v_namespaces") + """SELECT array_to_string(ns, '/') AS ns, CAST(len(ns) AS INTEGER) AS depth, CASE WHEN len(ns) > 0 THEN array_to_string(ns[1:len(ns) - 1], '/') END AS parent,
array_to_string(['datastore', 'main'] || ns, '/') AS acl_path, CASE WHEN ns[1] = 'AMERICA' THEN array_to_string(['copies', 'us'] || ns[2:], '/') END AS mapped FROM v_namespaces""",
    "catalog_dump": oracle("v_entries", ctes=_WALK.format("", ""), recursive=True) + "SELECT path, leaf FROM t",
    "catalog_find": oracle("v_entries", ctes=_WALK.format(" AND NOT regexp_matches('/' || name, '^/m[.]|/fr$')", " WHERE NOT regexp_matches(t.path || '/' || e.name, '^/m[.]|/fr$')"), recursive=True) + "SELECT path, leaf FROM t WHERE contains(path, '2')",
    "catalog_ls": oracle("v_entries") + "SELECT parent, count(*) AS entries, count(*) FILTER (leaf) AS leaves FROM v_entries GROUP BY parent",
    "path_complete": oracle("v_entries") + "SELECT name FROM v_entries WHERE parent = '/' AND starts_with(name, 'th')",
    "glob_select": oracle("v_entries") + "SELECT path, CASE WHEN regexp_matches(path, '^/m[.][^/]*$') THEN false WHEN regexp_matches(path, '(^|/)en/1[^/]*$') THEN true WHEN regexp_matches(path, '(^|/)en/[^/]*$') THEN false ELSE true END AS included FROM v_entries",
    "acl_parse": oracle("v_namespaces", ctes=_ACL) + f"SELECT {_P}, ugid, is_group, role, propagate FROM r",
    "acl_lines": oracle("v_namespaces", ctes=_ACL) + f""", a AS (SELECT path, propagate, CASE WHEN is_group THEN '@' ELSE '' END || ugid AS who, string_agg(role, ',' ORDER BY role) AS roles FROM r GROUP BY ALL)
SELECT 'acl:' || CAST(propagate AS INTEGER) || ':/' || array_to_string(path, '/') || ':' || string_agg(who, ',' ORDER BY who) || ':' || roles AS line FROM a GROUP BY path, propagate, roles""",
    "acl_roles": oracle("v_namespaces", ctes=_ACL) + f'SELECT "user", {_P}, role, propagate FROM f',
    "acl_privs": oracle("v_namespaces", ctes=_ACL) + f'SELECT "user", {_P}, privs, propagated FROM x',
    "permission_map": oracle("v_namespaces", ctes=_ACL) + f'SELECT "user", {_P}, name AS privilege, propagated & bit <> 0 AS propagate FROM x, privs WHERE privs & bit <> 0'.replace("x, privs WHERE privs &", "x, privs WHERE x.privs &"),
    "acl_any_below": oracle("v_namespaces", ctes=_ACL) + f'SELECT "user", bool_or(privs & {access.bits("Datastore.Backup")} <> 0) AS "any" FROM x GROUP BY "user"',
    "acl_children": oracle("v_namespaces", ctes=_ACL) + f"SELECT DISTINCT {_P} FROM r WHERE ugid = 'power@local' AND NOT is_group AND len(path) > 1 AND path[1] = 'datastore'",
    "role_list": oracle("v_namespaces", ctes=_ACL) + "SELECT role, coalesce(string_agg(name, ',' ORDER BY bit), '') AS names FROM roles LEFT JOIN privs ON bits & bit <> 0 GROUP BY role",
    "accessible_groups": oracle("v_namespaces", "v_snapshots", ctes=_ACL) + f""", g AS (SELECT DISTINCT r_name, n_name, type, id, owner FROM v_snapshots JOIN orders ON sid = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT '/datastore/main/' || r_name || '/' || n_name AS path, count(*) AS groups FROM g JOIN x ON x.path = ['datastore', 'main', r_name, n_name] AND "user" = 'backup@local'
WHERE privs & {access.bits("Datastore.Audit")} <> 0 OR (privs & {access.bits("Datastore.Backup")} <> 0 AND owner = 'user3@local') GROUP BY 1""",
    "equal_member_lists": """WITH l AS (SELECT p_partkey % 6 AS k, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS members FROM part GROUP BY 1)
SELECT members, string_agg(CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS keys FROM l GROUP BY members""",
    "group_tree": oracle("v_snapshots") + "SELECT type, id, CAST(count(*) AS INTEGER) AS n, max(time) AS newest FROM v_snapshots GROUP BY type, id",
    "indented_tree": """WITH p AS (SELECT p_partkey % 50 AS list, p_partkey AS line, p_partkey // 50 % 4 AS level FROM part),
q AS (SELECT *, lag(level) OVER (PARTITION BY list ORDER BY line) AS before FROM p)
SELECT list, line, level, (SELECT max(b.line) FROM p b WHERE b.list = q.list AND b.line < q.line AND b.level = q.level - 1) AS parent, CASE WHEN before IS NULL THEN level = 0 ELSE level <= before + 1 END AS ok FROM q""",
}
