"""SimHash near-duplicates, searched with pivot distance tables.

A fingerprint has 64 bits. Two fingerprints within max_bits of each other agree wholly on some of any max_bits + 1
bit groups, so every link lies in a bucket of fingerprints that agree there. Inside a bucket each fingerprint has a row in
a table of Hamming distances to reference fingerprints (pivots). By the triangle inequality a pair within max_bits
differs by max_bits at most in each coordinate: the bucket is sorted by the first coordinate, pairs are looked for in a
sliding window of it, pairs whose largest coordinate difference is over max_bits are discarded, and the rest are verified.
Equal fingerprints are one node from the start, and a bucket gives a forest (each node with its local root), never pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, forget, group_value, stash, whole_groups
from .components import components

BITS = 64
#: Rows of a bucket that one task compares with each other; larger buckets are dealt out as pairs of tiles.
TILE = 1024
PIVOTS = 12
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of the text with A-Z in lower case, repeats included."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, 42)] if words else [], dtype=np.uint64)
    starts = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
    return np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[shingle:], strict=False)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; zero if there are none."""
    if not len(hashes):
        return 0
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a bounded piece of a very long text at a time
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): a row for each row of docs; fp is the fingerprint as a signed long. A null text is as an empty one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t, shingle)) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of small numbers, so the same in every task."""
    return np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(count)], dtype=np.uint64)


def bit_groups(max_bits: int, rows: int) -> list[int]:
    """Masks to bucket by: for m bit groups, each choice of m - max_bits of them. More groups make buckets smaller and rows more; m is the cheapest for so many rows, every m is exact."""

    def cost(m: int) -> float:
        keep = sum(sorted((BITS // m + (i < BITS % m) for i in range(m)))[: m - max_bits])
        return comb(m, max_bits) * (50 + max(rows, 1) / 2**keep)

    m = min(range(max_bits + 1, max_bits + 5), key=cost)
    edges = [round(i * BITS / m) for i in range(m + 1)]
    groups = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(groups, m - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def local_forest(group: np.ndarray, fps: np.ndarray, max_bits: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, fp) for each fingerprint that links to another one of its group; roots are of the same local component.

    group: a number for each row; only rows of equal numbers are compared.
    """
    first = np.bitwise_count(fps ^ refs[0]).astype(np.int16)
    order = np.lexsort((first, group))
    group, fps, first = group[order], fps[order], first[order]
    table = np.stack([np.bitwise_count(fps ^ r) for r in refs[1:]], axis=1).astype(np.int16)
    label = np.arange(len(fps))
    live, shift = np.arange(len(fps)), 1
    while True:
        live = live[live + shift < len(fps)]
        live = live[(group[live] == group[live + shift]) & (first[live + shift] - first[live] <= max_bits)]
        if not len(live):
            break
        a, b = live, live + shift
        near = (np.abs(table[a] - table[b]) <= max_bits).all(axis=1)
        a, b = a[near], b[near]
        hit = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        a, b = a[hit], b[hit]
        while len(a):  # hooks the larger root of each link to the smaller one
            ra, rb = label[a], label[b]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while (nxt := label[label]).tobytes() != label.tobytes():
                label = nxt
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
        shift += 1
    linked = label != np.arange(len(fps))
    return fps[label[linked]], fps[linked]


def fingerprint_links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within max_bits."""
    masks = bit_groups(max_bits, nodes.count())
    refs = pivots()
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = nodes.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    counted = group_value(keyed, ["t", "key"], "fp", F.count, F.sum, "rows").where("rows > 1")  # by salts: no key is hot
    tiled = counted.withColumn("tiles", F.ceil(F.col("rows") / TILE))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    dealt = tiled.select("fp", "t", "key", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("fp", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "t", "key")
    dealt = dealt.repartition("g").sortWithinPartitions("g")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["g"]):
            a, b = local_forest(t["g"].to_numpy(), t["fp"].to_numpy().view(np.uint64), max_bits, refs)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.select("g", "fp").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most max_bits differing bits, its own included; rows of equal
    fingerprints are linked. Null and empty texts have fingerprint zero and are linked like others. A null id takes no part in
    the smallest id (a component of null ids only has a null one); repeated ids give repeated rows; very long texts are read whole, a
    bit set in just half the hashes is 0; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    prints = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    rooted = nodes.join(components(fingerprint_links(nodes, max_bits)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stash(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "fingerprint-components")
    forget(nodes)
    # a fingerprint's rows, such as all empty texts, are dealt over salts where they meet it
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    spread = salted.select("fp", "salt").distinct().join(named, "fp")
    return salted.join(spread, ["fp", "salt"]).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
