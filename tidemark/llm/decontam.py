"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as words: lower case, runs of other characters as one space. An item of m characters may differ
by a budget of k edits; it is split into k + 1 pieces, of which one at least stands unchanged in any match. An Aho-Corasick automaton
finds all piece hits in a text; each says where the item would lie. Such a window must share as many grams that don't overlap as
k edits leave, and is then verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece at least; so an item may differ in about one of so many characters.
PIECE = 10
#: Length of the grams that a window is tested for before the distance.
GRAM = 4
#: Items of fewer characters are looked for as they are, as whole words.
LEAST_INEXACT = 32
#: Characters of items that are matched in one pass over the documents: a worker's matcher takes about 100 bytes for each.
BLOCK_CHARS = 4 << 20
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(size: int) -> int:
    """Edits that an item of size characters may differ by: one for each PIECE, less one; none under LEAST_INEXACT."""
    return 0 if size < LEAST_INEXACT else size // PIECE - 1


def pieces(item: str) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length, with their places."""
    n = budget(len(item)) + 1
    cuts = [round(i * len(item) / n) for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern(NamedTuple):
    item_id: int
    text: str
    masks: dict[str, int]


def pattern(item_id: int, text: str) -> Pattern:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(text):
        masks[c] |= 1 << i
    return Pattern(item_id, text, dict(masks))


def best_distance(p: Pattern, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of text, end of the first such part)."""
    m = len(p.text)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text, 1):
        eq = p.masks.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(h | up), up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up, down = (minus | ~(v | plus)) & full, plus & v & full
        if score < best:
            best, end = score, i
    return best, end


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.patterns = [pattern(i, t) for i, t in items]
        apart = [{t[i : i + GRAM] for i in range(0, len(t) - GRAM + 1, GRAM)} for _, t in items]
        often = Counter(g for some in apart for g in some)
        self.grams = [sorted(some, key=lambda g: (often[g], g)) for some in apart]  # the rarest first, so that most windows fail soon
        places = defaultdict(list)
        for n, p in enumerate(self.patterns):
            for at, piece in pieces(p.text):
                places[piece].append((n, at, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, budget, end in the normal text) of each item that the text holds."""
        data = normal(text)
        if self.empty or not data:
            return
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for last, where in self.automaton.iter(data):
            for n, at, size in where:
                m = len(self.patterns[n].text)
                k = budget(m)
                start = last + 1 - size - at
                windows[n].append([max(start - k, 0), min(start + m + k, len(data))])
        for n, spans in windows.items():
            p, found = self.patterns[n], None
            k = budget(len(p.text))
            spans.sort()
            joined = [spans[0]]
            for a, b in spans[1:]:
                if a <= joined[-1][1] and b > joined[-1][1]:
                    joined[-1][1] = b
                elif a > joined[-1][1]:
                    joined.append([a, b])
            for a, b in joined:
                if b - a < len(p.text) - k:
                    continue
                part = data[a:b]
                lacking = k  # grams that don't overlap: an edit takes away one at most
                for g in self.grams[n]:
                    if g not in part:
                        lacking -= 1
                        if lacking < 0:
                            break
                if lacking < 0:
                    continue
                if k:
                    distance, end = best_distance(p, part)
                else:  # whole words only
                    at = f" {data[max(a - 1, 0) : b + 1]} ".find(f" {p.text} ")
                    if at < 0:
                        continue
                    distance, end = 0, max(a - 1, 0) + at + len(p.text) - a
                if distance <= k and (found is None or distance < found[1]):
                    found = (p.item_id, distance, k, a + end)
            if found:
                yield found


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, least_item: int) -> Iterator[list[tuple[int, str]]]:
    """The items' (id, normal text) in blocks of about BLOCK_CHARS characters; null and repeated items, and those of fewer than least_item characters, are left out."""
    own = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where(F.length("t") >= least_item)
    total = own.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = -(-int(total) // BLOCK_CHARS)
    for b in range(blocks):
        got = own.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b).collect()  # a block's characters at most, about
        items = sorted({(r["id"], normal(r["t"])) for r in got}, key=lambda x: (x[0] is None, x[0], x[1]))
        yield [x for x in items if len(x[1]) >= max(least_item, 1)]


_matchers: dict[int, Matcher] = {}


def _matcher(items) -> Matcher:
    """This process's matcher for a broadcast block; one is kept."""
    if items.id not in _matchers:
        _matchers.clear()
        _matchers[items.id] = Matcher(items.value)
    return _matchers[items.id]


class _Block:
    """A broadcast block with a name that workers can remember its matcher by."""

    def __init__(self, spark, items: list[tuple[int, str]]):
        self._cast = spark.sparkContext.broadcast(items)
        self.id = hash(tuple(items))

    @property
    def value(self) -> list[tuple[int, str]]:
        return self._cast.value


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least_item: int = 1) -> DataFrame:
    """(id_col, item_id, distance, budget, end_at): a row for each item that a row of docs holds within its budget of edits.

    end_at is the end of its first nearest place, in characters of the normal text; of equally near places it is the first. A null or empty
    text holds nothing; null items, those without a letter or digit and those of fewer than least_item normal characters aren't looked
    for; items under LEAST_INEXACT characters count as whole words without edits; equal texts under several item ids are found under each.
    Very long texts are searched whole. Repeated rows of docs give repeated rows; null ids are kept; empty tables give no rows. Other
    columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"`{id_col}` long, item_id long, distance int, budget int, end_at long"
    names = [id_col, "item_id", "distance", "budget", "end_at"]
    out = docs.sparkSession.createDataFrame([], schema)
    for n, items in enumerate(item_blocks(benchmark, item_id_col, item_text_col, least_item)):
        block = _Block(docs.sparkSession, items)

        def run(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block)
            for b in batches:
                rows = [(doc, *found) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for found in matcher.matches(t)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=names)

        found = own.mapInArrow(run, schema)
        out = out.unionByName(found) if n else found
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least_item: int = 1) -> DataFrame:
    """docs without the rows that hold an item, as contamination() finds them; other rows and all columns stay as they are."""
    for items in item_blocks(benchmark, item_id_col, item_text_col, least_item):
        docs = docs.where(~_holds(_Block(docs.sparkSession, items))(F.col(text_col)))
    return docs


def _holds(block: _Block):
    """A function of a text column: whether the text holds an item of the block."""

    @F.pandas_udf("boolean")
    def holds(text: pd.Series) -> pd.Series:
        matcher = _matcher(block)
        return pd.Series([next(matcher.matches(t), None) is not None for t in text], dtype=bool)

    return holds
