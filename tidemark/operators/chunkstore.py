"""The chunk store: index offsets, mark and sweep, insertion, deduplication figures, verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400
SAFETY = 300  # seconds taken off the sweep's threshold
STRETCH = 4096  # places of a stream that a task looks at together


def with_offsets(entries: DataFrame, index: str, order: tuple[str, ...], size: str = "size", stretch: Column | None = None) -> DataFrame:
    """Adds pos, start_off and end_off to the entries of each index.

    stretch: a number that never falls in the order, by default its first column. An index is added up by stretches first, so that one of any size is
    dealt out; a task holds a stretch of it.
    """
    own = entries.withColumn("_stretch", F.col(order[0]) if stretch is None else stretch)
    before = Window.partitionBy(index).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy(index, "_stretch").agg(F.count("*").alias("_n"), F.sum(size).alias("_s"))
    parts = parts.select(index, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    w = Window.partitionBy(index, "_stretch").orderBy(*order)
    end = F.col("_s") + F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = own.join(parts, [index, "_stretch"]).withColumn("pos", (F.col("_n") + F.row_number().over(w) - 1).cast("long")).withColumn("end_off", end)
    return out.withColumn("start_off", F.col("end_off") - F.col(size)).select(*entries.columns, "pos", "end_off", "start_off")


def missing(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Digests that are referenced but not stored, with the number of references."""
    return refs.groupBy("digest").agg(F.count("*").alias("uses")).join(chunks.select("digest"), "digest", "left_anti")


def marked(chunks: DataFrame, refs: DataFrame, now: int) -> DataFrame:
    """Chunks with the access time that marking leaves: now for referenced ones."""
    used = refs.select("digest").distinct().withColumn("used", F.lit(True))
    return chunks.join(used, "digest", "left").withColumn("used", F.coalesce("used", F.lit(False))).withColumn("atime", F.when(F.col("used"), F.lit(now)).otherwise(F.col("atime")))


def sweep_state(start: int, oldest_writer: int, atime: Column) -> Column:
    """removed, pending or kept, by access time: what was touched a day before the start, or since the oldest writer, isn't removed."""
    least = min(start - DAY, oldest_writer) - SAFETY
    return F.when(atime < least, "removed").when(atime < oldest_writer, "pending").otherwise("kept")


def sweep(chunks: DataFrame, start: int, oldest_writer: int) -> DataFrame:
    """Sums by sweep state; a bad chunk that stays adds its bytes, not a chunk, and bad chunks are counted apart."""
    state = chunks.withColumn("state", sweep_state(start, oldest_writer, F.col("atime")))
    good = ~F.col("bad")
    return state.groupBy("state").agg(F.count_if(good | (F.col("state") == "removed")).alias("chunks"), F.sum("disk_size").alias("bytes"), F.count_if("bad").alias("bad"))


def gc_report(chunks: DataFrame, refs: DataFrame, start: int, oldest_writer: int) -> DataFrame:
    """One row: index bytes (with repeats), disk bytes and chunks after the sweep, deduplication factor, on-disk percent and average chunk."""
    index = refs.agg(F.count_distinct("sid").alias("index_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("index_bytes"))
    state = chunks.withColumn("state", sweep_state(start, oldest_writer, F.col("atime")))
    stays = F.col("state") != "removed"
    disk = state.agg(
        F.coalesce(F.sum(F.when(stays, F.col("disk_size"))), F.lit(0)).alias("disk_bytes"), F.count_if(stays & ~F.col("bad")).alias("disk_chunks"),
        F.coalesce(F.sum(F.when(~stays, F.col("disk_size"))), F.lit(0)).alias("removed_bytes"), F.count_if(~stays).alias("removed_chunks"), F.count_if(F.col("state") == "pending").alias("pending_chunks"))
    out = index.join(F.broadcast(disk))  # one row each
    factor = F.when(F.col("disk_bytes") > 0, F.col("index_bytes") / F.col("disk_bytes")).otherwise(1.0)
    share = F.when(F.col("index_bytes") > 0, F.col("disk_bytes") * 100 / F.col("index_bytes")).otherwise(0.0)
    return out.select("*", F.round(factor, 6).alias("factor"), F.round(share, 6).alias("on_disk_percent"), F.when(F.col("disk_chunks") > 0, F.expr("disk_bytes div disk_chunks")).otherwise(0).cast("long").alias("average_chunk"))


def most_used(refs: DataFrame, most: int) -> DataFrame:
    """The most used digests of those used more than once."""
    return refs.groupBy("digest").agg(F.count("*").alias("uses")).where("uses > 1").orderBy(F.desc("uses"), "digest").limit(most)


def insert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after an insertion, and whether each digest was there before or came twice.

    Rows: digest, size (encoded), encrypted, seq (order of arrival; stored ones are before all). A plain newcomer replaces a larger or an empty plain
    chunk; an encrypted newcomer never replaces anything that isn't empty.
    """
    both = stored.select("digest", "size", "encrypted", F.lit(-1).cast("long").alias("seq")).unionByName(new.select("digest", "size", "encrypted", F.col("seq").cast("long")))
    arrival = F.struct("seq", "size", "encrypted")
    first = F.min(F.when(F.col("size") > 0, arrival)).alias("first")
    best = F.min(F.when((F.col("size") > 0) & ~F.col("encrypted"), F.struct("size", "seq"))).alias("plain")
    out = both.groupBy("digest").agg(first, best, F.count("*").alias("times"), F.max("seq").alias("last"))
    size = F.when(F.col("first").isNull(), 0).when(F.col("first.encrypted"), F.col("first.size")).otherwise(F.col("plain.size"))
    return out.select("digest", size.cast("long").alias("size"), (F.col("times") > 1).alias("duplicate"), (F.col("last") >= 0).alias("touched"))


def known_runs(entries: DataFrame, known: DataFrame, stream: str, order: str, batch: int = 64) -> DataFrame:
    """Upload plan: each entry is new or known (stored before, or earlier in its stream), and adjacent known ones share a batch of batch at most.

    order is a whole number, an entry's place in its stream; no stream is null, and null digests are new. A stream is looked at by stretches of STRETCH places first, so that one of any size is dealt
    out; a task holds a stretch of it.
    """
    seen = known.select("digest").distinct().withColumn("_known", F.lit(True))
    own = entries.withColumn("_stretch", F.floor(F.col(order) / STRETCH))
    first = own.groupBy(stream, "digest", "_stretch").agg(F.min(order).alias("_first"))
    first = first.withColumn("_first", F.min("_first").over(Window.partitionBy(stream, "digest")))
    out = own.join(seen, "digest", "left").join(first, [stream, "digest", "_stretch"], "left")
    out = out.withColumn("known", F.coalesce("_known", F.col(order) > F.col("_first"), F.lit(False)))
    w = Window.partitionBy(stream, "_stretch").orderBy(order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    # rank: place among the stretch's entries; last: that of the last new one so far
    out = out.withColumn("_rank", F.row_number().over(w)).withColumn("_new", F.count_if(~F.col("known")).over(up)).withColumn("_last", F.max(F.when(~F.col("known"), F.col("_rank"))).over(up))
    before = Window.partitionBy(stream).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = out.groupBy(stream, "_stretch").agg(F.count("*").alias("_n"), F.max("_new").alias("_news"), F.max("_last").alias("_end"))
    parts = parts.withColumn("_ranks", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_runs", F.coalesce(F.sum("_news").over(before), F.lit(0)))
    parts = parts.select(stream, "_stretch", "_ranks", "_runs", F.coalesce(F.max(F.col("_ranks") + F.col("_end")).over(before), F.lit(0)).alias("_ended"))
    out = out.join(parts, [stream, "_stretch"])
    place = F.col("_ranks") + F.col("_rank") - F.coalesce(F.col("_ranks") + F.col("_last"), F.col("_ended")) - 1
    run, part = F.col("_runs") + F.col("_new"), F.floor(place / batch)
    return out.select(*entries.columns, "known", F.when(F.col("known"), run).alias("run"), F.when(F.col("known"), part).alias("batch"))


def upload_report(entries: DataFrame, stream: str = "sid") -> DataFrame:
    """Counts, bytes and integer percents of a planned upload by stream."""
    dup, size = F.col("known"), F.col("size")
    out = entries.groupBy(stream).agg(F.count("*").alias("chunks"), F.sum(size).alias("bytes"), F.count_if(dup).alias("duplicates"), F.coalesce(F.sum(F.when(~dup, size)), F.lit(0)).alias("uploaded"))
    return out.withColumn("reused_percent", F.when(F.col("bytes") > 0, F.expr("(bytes - uploaded) * 100 div bytes")).otherwise(0).cast("long"))


def archives(entries: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """(group, order, archive) for chunks written in order: an archive is closed after the write that takes it over limit.

    The sum starts anew with each archive, which no window expresses, so sorted rows are read as a stream that carries one sum.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held = None, 0, 0
        for b in batches:
            out = []
            for key, size in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != now:
                    now, number, held = key, 0, 0
                elif held > limit:
                    number, held = number + 1, 0
                out.append(number)
                held += size
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, type=pa.int64())], names=[group, order, "archive"])

    rows = entries.select(F.col(group).cast("long"), F.col(order).cast("long"), F.col("size").cast("long"))
    return rows.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, f"`{group}` long, `{order}` long, archive long")


def index_checksum(entries: DataFrame, index: str = "sid") -> DataFrame:
    """SHA-256 over end:digest pairs in order, for each index. An index is one file, so its entries fit in a task."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "end_off", "digest")))
    text = F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["end_off"].cast("string"), x["digest"])), ",")
    return entries.groupBy(index).agg(F.sha2(text, 256).alias("csum"), F.max("end_off").alias("size"), F.count("*").alias("entries"))


def verified(snapshot_refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """By snapshot: references, missing and bad ones, and whether it is sound. Each digest is looked at once."""
    state = snapshot_refs.select("digest").distinct().join(chunks.select("digest", "bad"), "digest", "left").select("digest", F.when(F.col("bad").isNull(), "missing").when(F.col("bad"), "bad").otherwise("ok").alias("state"))
    return snapshot_refs.join(state, "digest").groupBy("sid").agg(F.count("*").alias("refs"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "bad").alias("bad"), F.every(F.col("state") == "ok").alias("ok"))


def reverify(state: Column, verified_at: Column, now: int, outdated_days: int | None) -> Column:
    """Whether a snapshot is due for verification: never verified, or verified more whole days ago than allowed."""
    never = state.isNull()
    return never if outdated_days is None else never | (F.floor((F.lit(now) - verified_at) / DAY) > outdated_days)
