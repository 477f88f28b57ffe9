"""Tapes: media sets, states and expiry, the choice of the next writable medium, and restore plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEVER = (1 << 63) - 1


def media_sets(media: DataFrame) -> DataFrame:
    """A row for each set: pool, start time, tapes by sequence number (comma-joined, empty for gaps), completeness, and repeated numbers."""
    by_number = media.where("set_uuid IS NOT NULL").groupBy("set_uuid", "seq_nr").agg(F.min("label").alias("label"), F.count("*").alias("n"), F.min("pool").alias("pool"), F.max("set_ctime").alias("ctime"))
    sets = by_number.groupBy("set_uuid").agg(F.min("pool").alias("pool"), F.max(F.when(F.col("seq_nr") == 0, F.col("ctime"))).alias("start"), F.map_from_entries(F.collect_list(F.struct("seq_nr", "label"))).alias("m"), F.max("seq_nr").alias("top"), F.sum("n").alias("tapes"), F.max("n").alias("most"))
    listed = F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    return sets.select("set_uuid", "pool", "start", F.array_join(listed, ",").alias("labels"), "tapes", (F.exists(listed, lambda x: x == "")).alias("incomplete"), (F.col("most") > 1).alias("repeated"))


def set_pools(media: DataFrame) -> DataFrame:
    """Sets whose tapes agree on a pool, with it."""
    return media.where("set_uuid IS NOT NULL").groupBy("set_uuid").agg(F.min("pool").alias("pool"), F.count_distinct("pool").alias("n")).where("n = 1").select("set_uuid", "pool")


def latest_sets(sets: DataFrame) -> DataFrame:
    """The newest set of each pool, none where two began at the same time."""
    newest = sets.where("start IS NOT NULL").groupBy("pool").agg(F.max("start").alias("start"))
    return sets.join(newest, ["pool", "start"]).groupBy("pool", "start").agg(F.min("set_uuid").alias("set_uuid"), F.count("*").alias("n")).where("n = 1").select("pool", "set_uuid", "start")


def next_starts(sets: DataFrame) -> DataFrame:
    """Adds next_start: when the pool's next set began, strictly later; null for its newest."""
    times = sets.where("start IS NOT NULL").select("pool", "start").distinct().withColumn("next_start", F.lead("start").over(Window.partitionBy("pool").orderBy("start")))
    return sets.join(times, ["pool", "start"], "left")


def expiry(policy: Column, retention: Column, set_start: Column, next_start: Column) -> Column:
    """When a full tape's data expires. policy: always, continue, or seconds of a set's creation window; retention: overwrite, keep, or seconds."""
    created = F.when(policy == "always", F.coalesce(next_start, F.lit(NEVER))).when(policy == "continue", F.lit(NEVER)).otherwise(set_start + F.coalesce(policy.try_cast("bigint"), F.lit(0)))
    base = F.least(created, F.coalesce(next_start, F.lit(NEVER)))
    return F.when(retention == "keep", F.lit(NEVER)).when(retention == "overwrite", set_start).otherwise(F.when(base == NEVER, F.lit(NEVER)).otherwise(base + F.coalesce(retention.try_cast("bigint"), F.lit(0))))


def state(status: Column, set_uuid: Column, is_last_of_current: Column) -> Column:
    """full unless the tape is the last one of the current set; explicit states win; a tape of no set is free."""
    return F.when(status.isin("damaged", "retired"), status).when(set_uuid.isNull(), "free").when(is_last_of_current & (status == "writable"), "writable").otherwise("full")


def available(location: Column, changers: list[str], allow_offline: bool) -> Column:
    return F.when(location == "offline", F.lit(allow_offline)).when(location == "vault", False).otherwise(location.isin(*changers))


def next_writable(media: DataFrame) -> DataFrame:
    """By pool, the medium to write next: of the current set, then free ones of the pool, expired ones, and unassigned ones; the oldest first.

    Rows: pool (null: unassigned), label, ctime, set_ctime, state (writable, free, expired, ...).
    """
    order = F.when(F.col("state") == "writable", 0).when((F.col("state") == "free") & F.col("pool").isNotNull(), 1).when(F.col("state") == "expired", 2).when((F.col("state") == "free") & F.col("pool").isNull(), 3)
    ranked = media.withColumn("prio", order).where("prio IS NOT NULL").withColumn("age", F.when(F.col("prio") == 2, F.col("set_ctime")).otherwise(F.col("ctime")))
    best = F.min_by(F.struct("label", "prio"), F.struct("prio", "age", "label"))
    of_pool = ranked.where("pool IS NOT NULL").groupBy("pool").agg(best.alias("b"))
    spare = ranked.where("pool IS NULL").agg(best.alias("spare"))
    pools = media.where("pool IS NOT NULL").select("pool").distinct()
    chosen = pools.join(of_pool, "pool", "left").join(F.broadcast(spare))  # one row
    return chosen.select("pool", F.coalesce("b.label", "spare.label").alias("label"), F.coalesce("b.prio", "spare.prio").alias("prio"))


def usable(sets: DataFrame) -> DataFrame:
    """Whether each set can go on: complete, no number twice, a start, one pool."""
    return sets.withColumn("usable", ~F.col("incomplete") & ~F.col("repeated") & F.col("start").isNotNull())


def online(labels: DataFrame, media: DataFrame) -> DataFrame:
    """Tapes that a changer holds in drives or slots (not import/export), by label."""
    return labels.where("NOT import_export").select("label", "changer").join(media.select("label", "uuid"), "label")


def restore_plan(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files to read by medium, in order: wanted snapshots with their media and file numbers, one row for each medium."""
    hit = wanted.join(catalog, "snapshot")
    return hit.groupBy("uuid").agg(F.array_join(F.transform(F.array_sort(F.collect_set("file_nr")), lambda x: x.cast("string")), ",").alias("files"), F.count_distinct("snapshot").alias("snapshots"))


def catalog_lookup(catalog: DataFrame) -> DataFrame:
    """For each snapshot the medium that has it: the one with the smallest uuid, with its last file number."""
    last = catalog.groupBy("snapshot", "uuid").agg(F.max("file_nr").alias("file_nr"))
    return last.groupBy("snapshot").agg(F.min("uuid").alias("uuid"), F.min_by("file_nr", "uuid").alias("file_nr"))


def set_name(template: str, set_uuid: Column, start: Column) -> Column:
    """A set's name: its start time by the template's %Y %m %d %H %M, %id% as the uuid; the uuid alone without a start."""
    day = F.date_from_unix_date(F.floor(start / 86400).cast("int"))
    parts = {"%Y": F.date_format(day, "yyyy"), "%m": F.date_format(day, "MM"), "%d": F.date_format(day, "dd"), "%H": F.lpad((F.floor(start / 3600) % 24).cast("string"), 2, "0"), "%M": F.lpad((F.floor(start / 60) % 60).cast("string"), 2, "0")}
    out = F.lit(template)
    for mark, value in (*parts.items(), ("%id%", set_uuid)):
        out = F.replace(out, F.lit(mark), value)
    return F.when(start.isNull(), set_uuid).otherwise(out)
