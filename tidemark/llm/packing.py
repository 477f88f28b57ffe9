"""Best-fit packing with certified bounds.

Documents are dealt into groups of bounded size, and each group is packed by best-fit decreasing. Dual feasible functions bound
the sequences of each group from below: a group that meets its bound is certified. The documents of the unfilled sequences of the other
groups are exchanged: they go into a pool, which is dealt into fewer, larger groups and packed again, until a round saves nothing.
A certificate holds for a group's own documents; as long as all sequences together miss the bound of all lengths, certified groups'
unfilled sequences are exchanged, too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, whole_groups
from .tokens import encoder

#: Pieces that one group holds about in the first round; in each later one GROWTH times as many.
GROUP = 8192
GROWTH = 4
MOST_GROUP = 1 << 19


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins. Items must be sorted, longest first; none may be over capacity."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: some bin has room for r
    for i, n in enumerate(lengths.tolist()):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at, count = capacity, count, count + 1
        bins[i], offsets[i] = at, capacity - room
        by_room[room - n].append(at)
        rooms |= 1 << (room - n)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Bins that any packing needs at least: the best of several dual feasible functions of the lengths. counts: how often each length is there."""
    if not len(lengths):
        return 0
    size, n = np.unique(lengths, return_counts=True) if counts is None else (lengths, counts)
    size, n = size.astype(np.int64), n.astype(np.int64)
    best = -(-int((size * n).sum()) // capacity)
    for least in size[size * 2 <= capacity].tolist():  # items over capacity - least count as whole, items under least as nothing
        value = np.where(size > capacity - least, capacity, np.where(size < least, 0, size))
        best = max(best, -(-int((value * n).sum()) // capacity))
    for k in range(1, 13):  # rounds each length down to k-ths of the capacity, unless it is a whole number of (k + 1)-ths
        whole = size * (k + 1) % capacity == 0
        value = np.where(whole, size * k, size * (k + 1) // capacity * capacity)  # in k-ths
        best = max(best, -(-int((value * n).sum()) // (capacity * k)))
    return best


def pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids with end_id after them, cut only where longer than capacity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(vocabulary), int(end_id).to_bytes(4, "little"), 4 * capacity
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = (enc.ids(text) if text else b"") + end
                rows += [(doc, k, at // 4, len(part) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), step)) for part in [ids[at : at + step]]]
            names, kinds = ("id", "piece", "start", "length", "ids_crc32"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=names)
        enc.forget()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


_ROW = "row long, length long, g long, bin long, offset long, fill long, bins long, bound long, gap long"


def _packed(rows: DataFrame, groups: int, capacity: int, salt: int) -> DataFrame:
    """Deals (row, length) into groups and packs each; bins and bound are on the first row of a group, else zero; gap is their difference."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["g"]):
            g, row, length = (t[c].to_numpy() for c in ("g", "row", "length"))
            order = np.lexsort((row, -length, g))
            g, row, length = g[order], row[order], length[order]
            cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = length[a:b]
                bins, offset, count = best_fit_decreasing(own, capacity)
                fill = np.bincount(bins, weights=own, minlength=count).astype(np.int64)[bins]
                first = (np.arange(b - a) == 0).astype(np.int64)
                bound = lower_bound(own, capacity)
                found = (row[a:b], own, g[a:b], bins, offset, fill, first * count, first * bound, np.full(b - a, count - bound))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in found], names=_ROW.replace(" long", "").split(", "))

    dealt = rows.select("row", "length", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(groups)).alias("g"))
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, _ROW)


class Packed(NamedTuple):
    """rows: (row, sequence_id, offset); used: the sequences; bound: what any packing needs at least."""

    rows: DataFrame
    used: int
    bound: int


def pack(items: DataFrame, capacity: int) -> Packed:
    """Sequences for items (row, length): row is a distinct long, length from 1 to capacity. Equal lengths go by row.

    The rounds end when all sequences together meet the bound of all lengths, or when a round of all that is unfilled saves none.
    """
    lengths = items.groupBy("length").count().toPandas()  # capacity rows at most
    left, needed = int(lengths["count"].sum()), lower_bound(lengths["length"].to_numpy(), capacity, lengths["count"].to_numpy())
    placed = ("row", "length", "sequence_id", "offset")
    done: list[DataFrame] = []
    parked: list[tuple[DataFrame, int]] = []  # certified groups' unfilled sequences, and how many
    pool, full, turn, before = items, 0, 0, None
    while True:
        groups = max(1, -(-left // min(GROUP * GROWTH**turn, MOST_GROUP)))
        now = stash(_packed(pool, groups, capacity, turn), "packed")
        now = now.withColumn("sequence_id", F.lit(turn).cast("long") * (1 << 56) + F.shiftleft("g", 28) + F.col("bin"))
        used = int(now.agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0])
        stalled = before is not None and used >= before[1]  # nothing saved: what was there stays
        if stalled:
            open_rows, certified = before[0], None
        else:
            done.append(now.where(F.col("fill") == capacity).select(*placed))
            open_rows, certified = now.where((F.col("fill") < capacity) & (F.col("gap") > 0)).select(*placed), now.where((F.col("fill") < capacity) & (F.col("gap") == 0)).select(*placed)
            closed, sure = (x.agg(F.count_distinct("sequence_id")).first()[0] for x in (done[-1], certified))
            full += closed
            if sure:
                parked.append((certified, sure))
            before = (open_rows, used - closed - sure)
        if full + before[1] + sum(n for _, n in parked) <= needed:
            break
        if stalled or not before[1] or groups == 1:
            if not parked:
                break
            for rows, n in parked:  # no gap is left to close by itself; only the bound of all lengths says that there is room
                before = (before[0].unionByName(rows), before[1] + n)
            parked = []
        pool, turn = before[0].select("row", "length"), turn + 1
        left = pool.count()
    out = before[0]
    for more in [*done, *(rows for rows, _ in parked)]:
        out = out.unionByName(more)
    return Packed(out.select("row", "sequence_id", "offset"), full + before[1] + sum(n for _, n in parked), needed)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """A row for each piece of each row of docs: id_col, piece, start, length, ids_crc32, sequence_id, offset, sequences, least_sequences.

    A document is its ids and then end_id; only a longer one than capacity is cut, into pieces of capacity and a last one that may be
    shorter; a very long text gives many pieces. A null or empty text is end_id alone. A null id is kept; rows of equal ids are packed
    each on its own; pieces of equal lengths go in the order of rows; an empty table gives no rows. sequences and least_sequences
    are alike in all rows: how many there are, and how many any packing needs at least. Other columns are not read.
    """
    cut = pieces(docs, vocabulary, id_col, text_col, capacity, end_id)
    cut = stash(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut.select("row", "length"), capacity)
    counts = F.lit(placed.used).cast("long").alias("sequences"), F.lit(placed.bound).cast("long").alias("least_sequences")
    return cut.join(placed.rows, "row").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *counts)
