"""Access control: roles along paths, privileges as bits, permission maps, and the text form of the list.

A rule row is (path as an array, ugid, is_group, role, propagate).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Privileges by bit, fixed values.
PRIVILEGES = (
    "Sys.Audit", "Sys.Modify", "Sys.PowerManagement", "Datastore.Audit", "Datastore.Allocate", "Datastore.Modify", "Datastore.Read", "Datastore.Verify", "Datastore.Backup", "Datastore.Prune",
    "Permissions.Modify", "Remote.Audit", "Remote.Modify", "Remote.Read", "Sys.Console", "Tape.Audit", "Tape.Modify", "Tape.Write", "Tape.Read", "Realm.Allocate",
)
_BIT = {name: 1 << i for i, name in enumerate(PRIVILEGES)}


def bits(*names: str) -> int:
    return sum(_BIT[n] for n in names)


NO_ACCESS = "NoAccess"
#: Roles and their privileges; the administrator has all bits.
ROLES = {
    "Admin": -1,
    "Audit": bits("Sys.Audit", "Datastore.Audit"),
    NO_ACCESS: 0,
    "DatastoreAdmin": bits("Datastore.Audit", "Datastore.Modify", "Datastore.Read", "Datastore.Verify", "Datastore.Backup", "Datastore.Prune"),
    "DatastoreReader": bits("Datastore.Audit", "Datastore.Verify", "Datastore.Read"),
    "DatastoreBackup": bits("Datastore.Backup"),
    "DatastorePowerUser": bits("Datastore.Prune", "Datastore.Backup"),
    "DatastoreAudit": bits("Datastore.Audit"),
    "RemoteAudit": bits("Remote.Audit"),
    "TapeReader": bits("Tape.Audit", "Tape.Read"),
}


def privileges_of(role: Column) -> Column:
    """The bits of a role, 0 for an unknown one."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r, p in ROLES.items() for x in (r, p)]).cast("map<string,bigint>"), role), F.lit(0).cast("long"))


def privilege_names(mask: Column) -> Column:
    """Names of the bits of a mask, in the order of the bits."""
    return F.filter(F.array(*[F.when(mask.bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(n)) for n, b in _BIT.items()]), lambda x: x.isNotNull())


def has_privileges(mask: Column, wanted: int, partial: bool = False) -> Column:
    """All wanted bits, or any of them."""
    got = mask.bitwiseAND(F.lit(wanted).cast("long"))
    return got != 0 if partial else got == F.lit(wanted).cast("long")


def parse_rules(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rules of lines acl:propagate:path:users:roles: one for each user (groups start with @) and role; other lines give none."""
    f = [F.get(F.split(line, ":"), F.lit(i)) for i in range(6)]
    good = lines.where((f[0] == "acl") & f[1].isin("0", "1") & f[4].isNotNull() & f[5].isNull())
    rows = good.select(F.filter(F.split(f[2], "/"), lambda x: x != "").alias("path"), (f[1] == "1").alias("propagate"), F.explode(F.split(f[3], ",")).alias("u"), f[4].alias("roles"))
    return rows.select("path", F.ltrim("u", F.lit("@")).alias("ugid"), F.startswith("u", F.lit("@")).alias("is_group"), F.explode(F.split("roles", ",")).alias("role"), "propagate").distinct()


def node_rules(rules: DataFrame, order: str | None = None) -> DataFrame:
    """Rules after the order of insertion: NoAccess takes away the other roles of a user at a path, any other role takes away NoAccess."""
    if order is None:
        return rules
    last = rules.groupBy("path", "ugid", "is_group").agg(F.max_by("role", order).alias("_last"), F.max(F.when(F.col("role") == NO_ACCESS, F.col(order))).alias("_none"))
    kept = (F.col("_last") == NO_ACCESS) & (F.col("role") == NO_ACCESS) | (F.col("_last") != NO_ACCESS) & (F.col("role") != NO_ACCESS) & (F.col("_none").isNull() | (F.col(order) > F.col("_none")))
    return rules.join(last, ["path", "ugid", "is_group"]).where(kept).drop("_last", "_none")


def roles(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """(user, path, role, propagate) that hold at the targets (user, path): those of the deepest path with any, above it only what propagates.

    Groups have no members, so group rules never apply. NoAccess at that path takes away the others. The rules are few and
    joined by user and by path prefix, each target having as many candidate prefixes as its path is deep.
    """
    prefixes = targets.select("user", "path", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("_n"))
    at = prefixes.withColumn("_at", F.array_join(F.when(F.col("_n") > 0, F.slice("path", F.lit(1), F.greatest(F.col("_n"), F.lit(1)))).otherwise(F.array().cast("array<string>")), "/"))
    own = rules.where("NOT is_group").select(F.col("ugid").alias("user"), F.array_join("path", "/").alias("_at"), "role", "propagate")
    held = at.join(own, ["user", "_at"]).where(F.col("propagate") | (F.col("_n") == F.size("path")))
    deepest = held.groupBy("user", "path").agg(F.max("_n").alias("_n"))
    there = held.join(deepest, ["user", "path", "_n"])
    none = there.where(F.col("role") == NO_ACCESS).select("user", "path").distinct().withColumn("_none", F.lit(True))
    out = there.join(none, ["user", "path"], "left").where(F.col("_none").isNull() | (F.col("role") == NO_ACCESS))
    return out.groupBy("user", "path", "role").agg(F.bool_or("propagate").alias("propagate"))


def privileges(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """(user, path, privs, propagated): bits of all roles there, and of those that propagate; 0 without any. A token (user!name) has at most its user's bits."""
    asked = targets.select("user", "path", F.split("user", "!")[0].alias("_owner"))
    both = asked.select("user", "path").union(asked.select(F.col("_owner"), "path")).distinct()
    held = roles(rules, both).withColumn("p", privileges_of(F.col("role")))
    sums = held.groupBy("user", "path").agg(F.bit_or("p").alias("p"), F.bit_or(F.when(F.col("propagate"), F.col("p")).otherwise(F.lit(0))).alias("q"))
    zero = F.lit(0).cast("long")
    mine = asked.join(sums, ["user", "path"], "left").select("user", "path", "_owner", F.coalesce("p", zero).alias("p"), F.coalesce("q", zero).alias("q"))
    of = sums.select(F.col("user").alias("_owner"), "path", F.col("p").alias("op"), F.col("q").alias("oq"))
    joined = mine.join(of, ["_owner", "path"], "left")
    token = F.contains("user", F.lit("!"))
    return joined.select("user", "path", F.when(token, F.col("p").bitwiseAND(F.coalesce("op", zero))).otherwise(F.col("p")).alias("privs"), F.when(token, F.col("q").bitwiseAND(F.coalesce("oq", zero))).otherwise(F.col("q")).alias("propagated"))


def permission_map(privs: DataFrame) -> DataFrame:
    """A row for each privilege that a user has at a path, and whether it propagates."""
    names = F.explode(privilege_names(F.col("privs"))).alias("privilege")
    return privs.select("user", "path", names, "propagated").select("user", "path", "privilege", F.array_contains(privilege_names(F.col("propagated")), F.col("privilege")).alias("propagate"))


def any_below(privs: DataFrame, root: list[str], wanted: int) -> DataFrame:
    """Users with any of the wanted bits at or below a path."""
    top = F.array(*[F.lit(x) for x in root]).cast("array<string>")
    below = F.slice("path", F.lit(1), F.lit(len(root))) == top if root else F.lit(True)
    return privs.where(below).groupBy("user").agg(F.bool_or(has_privileges(F.col("privs"), wanted, True)).alias("any"))


def serialize(rules: DataFrame) -> DataFrame:
    """Lines of rules: users of the same roles at a path and propagation share one line."""
    who = F.concat(F.when(F.col("is_group"), "@").otherwise(""), F.col("ugid"))
    each = rules.groupBy("path", "propagate", who.alias("who")).agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))
    lines = each.groupBy("path", "propagate", "roles").agg(F.array_join(F.sort_array(F.collect_set("who")), ",").alias("users"))
    return lines.select(F.concat_ws(":", F.lit("acl"), F.col("propagate").cast("int").cast("string"), F.concat(F.lit("/"), F.array_join("path", "/")), "users", "roles").alias("line"))


def child_paths(rules: DataFrame, user: str, root: list[str]) -> DataFrame:
    """Distinct paths strictly below root at which the user has a role."""
    top = F.array(*[F.lit(x) for x in root]).cast("array<string>")
    below = (F.size("path") > len(root)) & ((F.slice("path", F.lit(1), F.lit(len(root))) == top) if root else F.lit(True))
    return rules.where((F.col("ugid") == user) & ~F.col("is_group") & below).select("path").distinct()


def group_equal_lists(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Keys of equal member lists together, both comma-joined."""
    lists = rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(member)), ",").alias("members"))
    return lists.groupBy("members").agg(F.array_join(F.sort_array(F.collect_set(F.col(key).cast("string"))), ",").alias("keys"))


def text_rules(lines: Iterable[str], spark) -> DataFrame:
    """Rules of a literal list."""
    return parse_rules(spark.createDataFrame([(x,) for x in lines], "line string"))
