"""Trees: namespaces as array paths, entries as edges, walks with pruning inside the recursion, indented lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 7


def contains(outer: Column, inner: Column) -> Column:
    """Depth of inner below outer, null where outer doesn't hold inner."""
    return F.when(F.slice(inner, F.lit(1), F.size(outer)) == outer, F.size(inner) - F.size(outer))


def parent(ns: Column) -> Column:
    """The namespace above, null for the root."""
    return F.when(F.size(ns) > 0, F.slice(ns, F.lit(1), F.size(ns) - 1))


def map_prefix(ns: Column, source: Column, target: Column) -> Column:
    """ns with the prefix source replaced by target, null where it isn't a prefix."""
    return F.when(contains(source, ns).isNotNull(), F.concat(target, F.slice(ns, F.size(source) + 1, F.greatest(F.size(ns) - F.size(source), F.lit(0)))))


def acl_path(ns: Column, store: str) -> Column:
    return F.concat(F.array(F.lit("datastore"), F.lit(store)), ns)


def walk(namespaces: DataFrame, anchor: list[str], depth: int) -> DataFrame:
    """Namespaces from the anchor down, the anchor first, at most depth levels below it and MAX_DEPTH in all; depth is the column below."""
    top = F.array(*[F.lit(x) for x in anchor]).cast("array<string>")
    below = contains(top, F.col("ns"))
    most = min(depth, MAX_DEPTH - len(anchor))
    return namespaces.withColumn("below", below).where((F.col("below") >= 0) & (F.col("below") <= most)).orderBy(F.array_join("ns", "/"))


def _below(entries: DataFrame, start: str) -> DataFrame:
    """Entries (parent, name, ...) below start with path, and parts, the path's components."""
    path = F.concat(F.when(F.col("parent") == "/", "").otherwise(F.col("parent")), F.lit("/"), F.col("name"))
    base = start.rstrip("/")
    inside = (F.col("parent") == start) | F.startswith("parent", F.lit(base + "/"))
    return entries.where(inside).withColumn("path", path).withColumn("parts", F.slice(F.split("path", "/"), base.count("/") + 2, F.size(F.split("path", "/"))))


def dump(entries: DataFrame, start: str = "/") -> DataFrame:
    """All entries (parent, name, leaf) below start with their full paths and levels below it; every directory below start is an entry itself.

    A parent is a whole path, so no walk is needed: one scan, of any depth.
    """
    return _below(entries, start).select("path", "leaf", F.size("parts").alias("level"))


def find(entries: DataFrame, include: str, exclude: str, start: str = "/") -> DataFrame:
    """Paths that include (a regular expression) matches, without what is below a path that exclude matches: an entry is tested with all directories above it up to start."""
    ahead = F.lit(start.rstrip("/"))
    steps = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.concat(ahead, F.lit("/"), F.array_join(F.slice("parts", F.lit(1), i), "/")))
    return _below(entries, start).where(F.col("path").rlike(include) & ~F.exists(steps, lambda p: p.rlike(exclude))).select("path", "leaf")


def glob_to_regex(pattern: str) -> str:
    """A path glob as a regular expression: * and ? within a component, ** across, a leading / anchors, [..] as it is."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out, i = out + f"[{'^' + body[1:] if body.startswith('!') else body}]", end + 1
            continue
        out += {"*": ".*" if pattern.startswith("**", i) else "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "/_-" else "\\" + c)
        i += 2 if pattern.startswith("**", i) else 1
    anchored = out.startswith("/")
    return f"^{out}$" if anchored else f"(?:^|/){out}$"


def select_patterns(paths: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """Adds included: the last pattern that matches decides; one that starts with ! excludes; none matching includes."""
    decision = F.lit(None).cast("boolean")
    for p in reversed(patterns):
        hit = F.col(path).rlike(glob_to_regex(p.removeprefix("!")))
        decision = F.coalesce(decision, F.when(hit, F.lit(not p.startswith("!"))))
    return paths.withColumn("included", F.coalesce(decision, F.lit(True)))


def indented_parents(lines: DataFrame, group: str, order: str, level: str) -> DataFrame:
    """Adds parent: the order number of the nearest line before of a level less, null at level 0; ok is false where levels skip.

    Each line stands twice, as a parent under its own level and as a child under the one above, so levels may be any.
    """
    last = F.last(level).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ok = F.when(last.isNull(), F.col(level) == 0).otherwise(F.col(level) <= last + 1) & (F.col(level) >= 0)
    rows = lines.withColumn("ok", ok)
    twice = rows.withColumn("_as", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_key", F.col(level) - F.col("_as"))
    near = F.last(F.when(F.col("_as") == 0, F.col(order)), ignorenulls=True).over(Window.partitionBy(group, "_key").orderBy(order, "_as"))
    return twice.withColumn("parent", near).where("_as = 1").select(*lines.columns, F.when(F.col(level) > 0, F.col("parent")).alias("parent"), "ok")


def nested(snapshots: DataFrame) -> DataFrame:
    """A row for each group with its snapshots as an array of structs, newest first; a group's list is one row."""
    return snapshots.groupBy("type", "id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("time", "size")))).alias("children"))
