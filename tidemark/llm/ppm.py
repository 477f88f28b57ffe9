"""Language-model scoring by prediction by partial matching, beside a word baseline.

The model is a trie of byte contexts of up to ORDER bytes, counted over all training texts. A symbol is looked for in the longest
context; where it is new there, an escape (method C: as likely as the context has distinct symbols) leads to the next shorter
context, and symbols of the longer one are excluded there. Since a context's symbols are also symbols of its suffixes, the mass that
exclusion takes from the shorter context is a number that each node can carry, so whole arrays of bytes are scored at once.

No count is pruned, and no task holds the whole trie: tasks build it for some contexts' last two bytes at a time, with the counts of the two
shortest orders (65536 at most) beside, and turn the distinct codes of the corpus into probabilities. These and the word counts of the baseline
go to the documents by runs of rows of the input.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, stash, whole_groups

ORDER = 5
#: Codes that a task gathers before it builds a trie of them; the codes of one pair of bytes always come together.
PART = 150_000
#: Rows of a run: its distinct words and codes are in memory together, its texts aren't.
RUN = 8_192
#: Parts for each run.
SPREAD = 4
#: Words, and codes, that a task counts before it passes the counts on.
HELD = 500_000
HELD_CODES = 1_500_000
#: Rows of a batch that goes back to the JVM, which holds a batch as a whole.
SENT = 65_536
END = 0xFF  # no byte of UTF-8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_END_WORD = b"\n"


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def held_out(key: int | None) -> bool:
    """Whether a row of this id isn't learnt from."""
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def words_of(data: bytes) -> list[bytes]:
    """The text's words and the end."""
    return [*_WORD.findall(data), _END_WORD]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of ORDER bytes of context and the symbol, first position of each text); each text ends with END."""
    pad = bytes(ORDER)
    data = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), dtype=np.uint8)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(size + ORDER) - size
    code = np.zeros(max(len(data) - ORDER, 0), dtype=np.int64)
    for i in range(ORDER + 1):
        code = (code << 8) | data[i : len(code) + i]
    keep = np.ones(len(data), dtype=bool)
    for i in range(1, ORDER + 1):
        keep[starts - i] = False
    return code[keep[ORDER:]], np.cumsum(size) - size


class Lookup:
    """Values by code, with open addressing."""

    def __init__(self, own: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(own), 1) * 3))))
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.float32)
        rest, at = np.arange(len(own)), self._slot(own)
        while len(rest):
            free = self.keys[at] == -1
            self.keys[at[free]] = own[rest[free]]  # of several for a slot the last one stays
            won = self.keys[at] == own[rest]
            self.values[at[won]] = values[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value of each code, 0 where it has none; places of those that have none)."""
        out = np.zeros(len(codes))
        rest, at = np.arange(len(codes)), self._slot(codes)
        missing = [rest[:0]]
        while len(rest):
            key = self.keys[at]
            hit = key == codes[rest]
            out[rest[hit]] = self.values[at[hit]]
            gone = key == -1
            missing.append(rest[gone])
            on = ~(hit | gone)
            rest, at = rest[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out, np.concatenate(missing)


def summed(log10: Callable[[np.ndarray], np.ndarray], texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text and its end, from that of codes."""
    out = np.zeros(len(texts))
    for at in range(0, len(texts), 256):
        codes, starts = grams(texts[at : at + 256])
        out[at : at + 256] = np.add.reduceat(log10(codes), starts)
    return out


class Trie:
    """Counts of (context, symbol) by order, turned into log10 probabilities.

    shorter: codes and counts of the shortest orders over all texts, where codes are only those of some contexts' last bytes.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, shorter: Sequence[tuple[np.ndarray, np.ndarray]] = ()):
        self.entry, self.context = [], []
        by_order = list(shorter)
        for order in range(len(by_order), ORDER + 1):
            own, at = np.unique(codes & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            by_order.append((own, np.bincount(at, weights=counts, minlength=len(own))))
        for order, (own, n) in enumerate(by_order):
            ctx, at = np.unique(own >> 8, return_inverse=True)
            total, kinds = np.bincount(at, weights=n, minlength=len(ctx)), np.bincount(at, minlength=len(ctx)).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                if order:  # what an escape from here leaves of the next shorter context
                    shorter, m = by_order[order - 1]
                    taken = np.bincount(at, weights=m[np.searchsorted(shorter, own & ((1 << 8 * order) - 1))], minlength=len(ctx))
                    up = np.searchsorted(self.context[-1][0], ctx & ((1 << 8 * (order - 1)) - 1))
                    new = self.context[-1][5][up] - kinds
                    room = self.context[-1][4][up] - taken + new
                    left, again = np.log10(room), np.where(new > 0, np.log10(new) - np.log10(room), 0.0)
                else:  # the uniform choice among symbols that are new everywhere
                    left, again = np.log10(np.maximum(256 - kinds, 1)), np.zeros(len(ctx))
            self.entry.append((own, np.log10(n).astype(np.float32), (np.log10(n) - np.log10((total + kinds)[at])).astype(np.float32)))
            self.context.append((ctx, np.log10(kinds) - np.log10(total + kinds), left, again, total, kinds))
        self.context = [(c[0], *(x.astype(np.float32) for x in c[1:4])) for c in self.context]
        own, _, top = self.entry[ORDER]
        self.longest = Lookup(own, top)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's symbol after its context."""
        if not len(self.entry[0][0]):
            return np.full(len(codes), -np.log10(256.0))
        out, lost = self.longest.get(codes)
        if len(lost):
            out[lost] = self._escaped(codes[lost])
        return out

    def _escaped(self, codes: np.ndarray) -> np.ndarray:
        """As log10(), from the longest context down."""
        out, done = np.zeros(len(codes)), np.zeros(len(codes), dtype=bool)
        below, node = np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=np.int64)  # whether an escape led here, and from which context
        for order in range(ORDER, -1, -1):
            own, logs, top = self.entry[order]
            ctx, escape, _, _ = self.context[order]
            if not len(own):  # no training text has these contexts
                continue
            code = codes & ((1 << 8 * (order + 1)) - 1)
            e = np.minimum(np.searchsorted(own, code), len(own) - 1)
            c = np.minimum(np.searchsorted(ctx, code >> 8), len(ctx) - 1)
            known, seen = ctx[c] == code >> 8, own[e] == code
            first = ~done & ~below & known
            out[first & seen] += top[e[first & seen]]
            out[first & ~seen] += escape[c[first & ~seen]]
            later = ~done & below
            if order < ORDER:
                _, _, left, again = self.context[order + 1]
                out[later & seen] += logs[e[later & seen]] - left[node[later & seen]]
                out[later & ~seen] += again[node[later & ~seen]]
            done |= (first | later) & seen
            below |= first & ~seen
            node = c
        left = self.context[0][2]
        out[~done] -= left[0] if len(left) else np.log10(256)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        return summed(self.log10, texts)


def _counted(rows: DataFrame) -> DataFrame:
    """(kind, run, key, word, n): by run the words (kind 0) and byte codes (kind 1, by key), and how often they are in training texts. A run may have one several times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, codes = None, Counter(), []

        def out(kind: int, of: int | None, keys: np.ndarray | list[bytes], n: np.ndarray | list[int]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), SENT):
                own, many = keys[at : at + SENT], n[at : at + SENT]
                size = len(own)
                ids, bare = (pa.array(own, type=pa.int64()), pa.nulls(size, pa.binary())) if kind else (pa.nulls(size, pa.int64()), pa.array(own, type=pa.binary()))
                runs = pa.nulls(size, pa.int64()) if of is None else pa.array(np.full(size, of, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, dtype=np.int32)), runs, ids, bare, pa.array(many, type=pa.int64())], names=["kind", "run", "key", "word", "n"])

        def words_out() -> Iterator[pa.RecordBatch]:
            return out(0, now, list(words), list(words.values()))

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate([c for c, _ in codes]), np.concatenate([m for _, m in codes])
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order
            return keys[first], np.add.reduceat(n, first) if len(first) else n

        def gather(texts: list[bytes], learnt: bool) -> None:
            keys, n = np.unique(grams(texts)[0], return_counts=True)
            codes.append((keys, n if learnt else np.zeros(len(keys), dtype=np.int64)))

        def many() -> bool:
            """Whether the codes must be passed on: merging them first is only worth while where they are alike."""
            if sum(len(c) for c, _ in codes) > HELD_CODES:
                codes[:] = [merged()]
            return len(codes) == 1 and len(codes[0][0]) > HELD_CODES // 2

        for b in batches:
            texts = b.column(2).to_pylist()
            held, runs = b.column(1).to_pylist(), b.column(0).to_pylist()
            waiting: dict[bool, list[bytes]] = {True: [], False: []}
            for i, t in enumerate(texts):
                if runs[i] != now or len(words) >= HELD:
                    if words:
                        yield from words_out()
                    words = Counter()
                if runs[i] != now:
                    for learnt, some in waiting.items():
                        if some:
                            gather(some, learnt)
                    waiting = {True: [], False: []}
                    if codes:
                        yield from out(1, now, *merged())
                    codes = []
                now = runs[i]
                data = lowered(t)
                own = words_of(data)
                if held[i]:
                    words.update(dict.fromkeys(own, 0))
                else:
                    words.update(own)
                some = waiting[not held[i]]
                some.append(data)
                if len(some) >= 512 or sum(map(len, some[-8:])) > 1 << 23:
                    gather(some, not held[i])
                    some.clear()
                    if many():
                        yield from out(1, now, *codes.pop())
            for learnt, some in waiting.items():
                if some:
                    gather(some, learnt)
            if many():
                yield from out(1, now, *codes.pop())
        if words:
            yield from words_out()
        if codes:
            yield from out(1, now, *merged())

    return rows.select("run", "held", "t").mapInArrow(run, "kind int, run long, key long, word binary, n long")


def _shortest(codes: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of orders 0 and 1: 256 and 65536 at most."""
    got = codes.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    pairs, n = got["key"].to_numpy(), got["n"].to_numpy().astype(np.float64)
    single, at = np.unique(pairs & 0xFF, return_inverse=True)
    return [(single, np.bincount(at, weights=n, minlength=len(single))), (pairs, n)]


def _probabilities(codes: DataFrame) -> DataFrame:
    """(key, p): the log10 probability of each distinct code (key, n); codes whose contexts end in the same two bytes are worked out together."""
    sent = codes.sparkSession.sparkContext.broadcast(_shortest(codes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(held)
            keys, n = t["key"].to_numpy(), t["n"].to_numpy()
            p = Trie(keys[n > 0], n[n > 0].astype(np.float64), sent.value).log10(keys)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p.astype(np.float32))], names=["key", "p"])

        held: list[pa.Table] = []
        for t in whole_groups(batches, ["end"]):
            held.append(t)
            if sum(x.num_rows for x in held) >= PART:
                yield out(held)
                held = []
        if held:
            yield out(held)

    end = F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("end")
    return codes.select(end, "key", "n").repartition("end").sortWithinPartitions("end").mapInArrow(run, "key long, p float")


def ppm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out rows (crc32 of the id as text has remainder 2 by 7) aren't learnt from; a null id is not held out. Tokens are words of the text
    with A-Z in lower case, and an end. base_score adds log10((c + 1) / (N + V + 1)) over them, score is the model's log10 probability of
    the lowered text's bytes and end. A null text is as an empty one: one token. Without any training text every byte has one chance in
    256, and N and V are 0. Very long texts are read whole, and so are very long words. Repeated rows are scored alike; an empty table
    gives no rows; other columns are not read. docs must read files, or is written to the shared folder first.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    if not docs.inputFiles() or "_metadata" in docs.columns or not _has_rows_numbered(docs):
        own = stash(own, "texts")
        docs = own
        numbered = own.select("id", "t", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    else:
        numbered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    rows = numbered.select("id", "t", F.xxhash64("f", F.expr(f"r div {RUN}L")).alias("run"), F.coalesce(crc_mod("id", 7) == 2, F.lit(False)).alias("held"))

    counted = stash(_counted(rows), "counts")
    codes = stash(counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "codes")
    chances = stash(_probabilities(codes), "probabilities")
    words = counted.where("kind = 0")
    totals = stash(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "totals")
    tokens, distinct = (int(x) for x in totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first())
    floor = float(np.log10(tokens + distinct + 1))

    # a key has a row for each run that has the word or code, never one for each document
    def part(df: DataFrame, kind: int, key: Column | None = None, c: Column | None = None, x: Column | None = None) -> DataFrame:
        """Rows of few columns: they are many. key: a code or an id; c: a word's count or a code's log10; x: a word or a text."""
        empty = {"key": F.lit(None).cast("long"), "c": F.lit(None).cast("double"), "x": F.lit(None).cast("binary")}
        return df.select("run", F.lit(kind).alias("kind"), *[(empty[n] if v is None else v).alias(n) for n, v in (("key", key), ("c", c), ("x", x))])

    known = part(words.join(totals, "word"), 0, c=F.col("c").cast("double"), x=F.col("word"))
    chance = part(counted.where("kind = 1").join(chances, "key"), 1, key=F.col("key"), c=F.col("p").cast("double"))
    texts = part(rows, 2, key=F.col("id"), x=F.col("t").cast("binary"))
    # more parts than runs: dealt by hash into as many parts as there are, several runs would often share one, which then spills
    parts = max(1, min(SPREAD * counted.select("run").distinct().count(), 1 << 15))
    dealt = known.unionByName(chance).unionByName(texts).repartition(parts, "run").sortWithinPartitions("run", "kind")
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, now, model, gathered = _Logs(), None, None, []
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                runs, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = np.flatnonzero(np.r_[True, (runs[1:] != runs[:-1]) | (kinds[1:] != kinds[:-1]), True]).tolist()
                for x, y in zip(cuts, cuts[1:], strict=False):
                    if runs[x] != now:
                        now, logs, model, gathered = runs[x], _Logs(), None, []
                    part = b.slice(x, y - x)
                    if kinds[x] == 1:
                        gathered.append((part.column(2).to_numpy(), part.column(3).to_numpy().astype(np.float32)))
                        continue
                    if kinds[x] == 2 and model is None:
                        model, gathered = Lookup(*(np.concatenate(c) for c in zip(*gathered, strict=True))), []
                    if not kinds[x]:
                        logs.update(zip(part.column(4).to_pylist(), np.log10(part.column(3).to_numpy() + 1.0).tolist(), strict=True))
                        continue
                    data = [(t or b"").lower() for t in part.column(4).to_pylist()]
                    found = [list(map(logs.__getitem__, words_of(d))) for d in data]
                    n = [len(f) for f in found]
                    base = [sum(f) - floor * len(f) for f in found]
                    columns = [part.column(2), pa.array([held_out(i) for i in part.column(2).to_pylist()]), pa.array(n, type=pa.int64()), pa.array([sum(map(bool, f)) for f in found], type=pa.int64()), pa.array([tokens] * len(n), type=pa.int64()), pa.array(base), pa.array(summed(lambda c: model.get(c)[0], data))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.mapInArrow(run, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class _Logs(dict):
    """log10(count + 1) by word; 0 for a word that training texts don't have."""

    def __missing__(self, word: bytes) -> float:
        return 0.0


def _has_rows_numbered(docs: DataFrame) -> bool:
    """Whether docs is a plain scan of Parquet files, whose rows have a fixed place."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except Exception as e:  # pyspark raises AnalysisException for an unknown column
        if type(e).__name__ != "AnalysisException":
            raise
        return False
    return True
