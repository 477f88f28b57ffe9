"""Lists and filters over groups, snapshots and tasks, and the dashboards' summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of group types: that of their declaration.
TYPE_ORDER = ("vm", "ct", "host")


def group_filter(text: str, type_col: str = "type", id_col: str = "id") -> tuple[bool, Column]:
    """(include?, predicate) of include:|exclude: and type:, group: or regex: filters; a regex is searched in type/id."""
    include = True
    for word, value in (("include:", True), ("exclude:", False)):
        if text.startswith(word):
            include, text = value, text.removeprefix(word)
    kind, _, rest = text.partition(":")
    path = F.concat_ws("/", type_col, id_col)
    match kind:
        case "type":
            return include, F.col(type_col) == rest
        case "group":
            return include, path == rest
        case "regex":
            return include, path.rlike(rest)
    raise ValueError(f"no such group filter: {kind}")


def apply_filters(filters: list[str]) -> Column:
    """Rows that any include filter matches (all if there is none) and no exclude filter does; their order doesn't matter."""
    parsed = [group_filter(f) for f in filters]
    includes, excludes = ([c for inc, c in parsed if inc is want] for want in (True, False))
    wanted = reduce(Column.__or__, includes) if includes else F.lit(True)
    return wanted & ~reduce(Column.__or__, excludes) if excludes else wanted


def owned_by(owner: str, auth: str) -> Column:
    """Whether an owner column names auth: a token's owner user counts as the user, but not the other way round."""
    return (F.col(owner) == auth) | (F.lit(auth.split("!")[0]) == F.col(owner))


def group_order(type_col: str = "type", id_col: str = "id") -> list[Column]:
    """Types in order, numeric ids by number before textual ones."""
    rank = reduce(lambda acc, x: acc.when(F.col(type_col) == x[1], x[0]), enumerate(TYPE_ORDER), F.when(F.lit(False), 0))
    return [rank, F.col(id_col).try_cast("bigint").asc_nulls_last(), F.col(id_col)]


def group_list(snapshots: DataFrame) -> DataFrame:
    """For each group: number of snapshots, newest one and its owner, and the newest finished one's time."""
    return snapshots.groupBy("type", "id").agg(F.count("*").alias("backup_count"), F.max("time").alias("last_backup"), F.max_by("owner", "time").alias("owner"), F.max(F.when(F.col("finished"), F.col("time"))).alias("last_successful"), F.max_by("size", "time").alias("last_size"))


def type_counts(snapshots: DataFrame) -> DataFrame:
    """Groups and snapshots by type: one aggregation by group, one by type."""
    return snapshots.groupBy("type", "id").agg(F.count("*").alias("n")).groupBy("type").agg(F.count("*").alias("groups"), F.sum("n").alias("snapshots"))


def crypt_summary(mode: str) -> Column:
    """An aggregate: mixed, encrypt, sign-only or none of a set of modes."""
    n, e, s = F.count(mode), F.count_if(F.col(mode) == "encrypt"), F.count_if(F.col(mode) == "sign-only")
    return F.when(n == 0, None).when(e == n, "encrypt").when(s == n, "sign-only").when((e + s) == 0, "none").otherwise("mixed")


def verify_counts(snapshots: DataFrame, now: int, outdated: int = 30 * 86400) -> DataFrame:
    """By group: snapshots verified, failed, never verified, and verified too long ago; and the newest finished one's size."""
    state = F.col("verify_state")
    return snapshots.groupBy("type", "id").agg(F.count_if(state == "ok").alias("ok"), F.count_if(state == "failed").alias("failed"), F.count_if(state.isNull()).alias("none"), F.count_if(state.isNotNull() & (now - F.col("verified") > outdated)).alias("outdated"), F.max_by(F.when(F.col("finished"), F.col("size")), F.when(F.col("finished"), F.col("time"))).alias("last_size"), crypt_summary("crypt_mode").alias("crypt"))


def store_of(worker_type: str, worker_id: str) -> Column:
    """The store in a worker id; the place of it depends on the worker's type."""
    kind, wid = F.col(worker_type), F.col(worker_id)
    first = F.regexp_extract(wid, "^([^:]+)", 1)
    return F.when(kind.isin("backup", "verificationjob", "prunejob"), first).when(kind == "syncjob", F.regexp_extract(wid, "^(?:[^:]*:){0,1}([^:]+)", 1)).when(kind == "garbage_collection", first).otherwise(wid)


def task_filter(tasks: DataFrame, since: int | None = None, until: int | None = None, user: str | None = None, kind: str | None = None, store: str | None = None, running: bool = False, errors: bool = False, states: list[str] | None = None) -> DataFrame:
    """Tasks by any of these; errors and states drop running tasks, which have no state yet."""
    out = tasks
    if since is not None:
        out = out.where(F.col("stop").isNull() | (F.col("stop") >= since))
    if until is not None:
        out = out.where(F.col("start") <= until)
    if user is not None:
        out = out.where(F.contains("user", F.lit(user)))
    if kind is not None:
        out = out.where(F.contains("worker_type", F.lit(kind)))
    if store is not None:
        out = out.where(store_of("worker_type", "worker_id") == store)
    if running:
        out = out.where("stop IS NULL")
    if errors:
        out = out.where("state <> 'ok'")
    if states is not None:
        out = out.where(F.col("state").isin(*states))
    return out


def page(rows: DataFrame, order: list[Column], start: int, limit: int) -> DataFrame:
    """Rows from start on, limit of them; 0 means all."""
    out = rows.orderBy(*order).offset(start)
    return out.limit(limit) if limit else out


def log_page(rows: DataFrame, group: str, order: str, start: int, limit: int, zero_is_all: bool = True) -> DataFrame:
    """Lines numbered from 1 within each log, from start on (0 and 1 are alike), limit of them."""
    numbered = rows.withColumn("line", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    first = max(start, 1)
    if not limit:
        return numbered.where(F.col("line") >= first) if zero_is_all else numbered.where(F.lit(False))
    return numbered.where(F.col("line").between(first, first + limit - 1))


def task_summary(tasks: DataFrame, states: tuple[str, ...] = ("ok", "warning", "error")) -> DataFrame:
    """Counts by worker type, a column for each state; running ones apart."""
    return tasks.groupBy("worker_type").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states], F.count_if(F.col("state").isNull()).alias("running"))


def forward_fill(rows: DataFrame, group: str, time: str, value: str) -> DataFrame:
    """Adds filled: the value, or the last one before it that isn't null."""
    w = Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(w))


def maintenance_allows(mode: Column, operation: str) -> Column:
    """Whether a store in a maintenance mode takes an operation: offline takes none, read-only takes reads."""
    return F.when(mode == "offline", operation == "lookup").when(mode == "read-only", operation in ("read", "lookup")).otherwise(True)


def active(enabled: str, expires: str, now: int) -> Column:
    """Whether an entity is enabled (null: yes) and hasn't expired (null or 0: never)."""
    e = F.col(expires)
    return F.coalesce(F.col(enabled), F.lit(True)) & (e.isNull() | (e <= 0) | (e > now))
