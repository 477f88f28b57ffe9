"""Near-duplicate removal on top of SimHash and pivots: one document of each group of similar word shingles stays.

Similarity 0.8 leaves 64-bit fingerprints too far apart for an exact search within a few bits, so pivots serve twice here. For each
reference fingerprint a document is known by its shingle hash nearest to it; two documents share that hash as often as they
share shingles. Two neighbouring pivots' hashes make a bucket. In a bucket the fingerprints' table of distances to the pivots
discards pairs by their maximum coordinate difference, pairs within RADIUS bits become candidates, and candidates are
verified by the exact Jaccard similarity of their shingle sets.

Buckets of over CROWD rows belong to large groups of copies, or to pages of one template. Their pairs aren't listed:

* A first look compares the rows of random tiles of such buckets by their whole sets and joins most of a group of copies.
* Rows of crowded buckets are then keyed by prefixes: of two sets with the similarity, the rarest shingles of each, in one order for all, have
  one in common. A template's shingles come last in that order. Pairs that share a key of CROWD rows at most become candidates.
* Rows that have a prefix key with more rows are alike but for a few words. They are keyed by the shingle hashes nearest to LAST pivots, and
  tiles of such a bucket's largest component meet the tiles of its other rows, by whole sets.

Rows of one component never meet again, so a group that has been joined costs nothing more. Tiles give a forest of verified links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, forget, free_name, group_value, stash, whole_groups
from .components import components
from .simhash import _WORD, fingerprint, pivots, shingle_hashes

TABLES = 10
RADIUS = 20
#: Rows of a bucket whose pairs are all looked at in the first round; larger buckets' rows go to the second, too.
CROWD = 32
#: Rows of a tile, and shingles of its rows, about: what one task compares with each other, or with one other tile.
TILE = 1024
TILE_SHINGLES = 1 << 19
#: Pivots whose nearest shingle hashes key the rows that differ from many others by a few words.
LAST = 5
#: Bits of the filter that keeps most texts without candidates out of the verifying join.
FILTER_BITS = 1 << 24
#: Cells that shingles are counted in for the order of prefixes. The order decides nothing but how large buckets are.
CELL_BITS = 18


def nearest_hashes(hashes: np.ndarray, refs: np.ndarray) -> list[int]:
    """For each reference fingerprint: distance and leading bits of the nearest shingle hash, as one signed long."""
    out = []
    for r in refs:
        d = np.bitwise_count(hashes ^ r).astype(np.uint64)
        out.append(int(((d << np.uint64(56)) | (hashes >> np.uint64(8))).min()))
    return out


def _words_hash(text: str | None) -> tuple[int, int]:
    """128 bits of a text's word sequence, as two signed longs."""
    whole = xxhash.xxh3_128_digest(b" ".join(_WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())))
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, a, b, fp, size, keys): a and b tell word sequences apart; size is the number of distinct shingles; keys has TABLES bucket keys, none for a text without words."""
    refs = pivots(TABLES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, fps, sizes, keys = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                x, y = _words_hash(t)
                a.append(x)
                b.append(y)
                hashes = shingle_hashes(t, shingle)
                fps.append(fingerprint(hashes))
                distinct = np.unique(hashes)
                sizes.append(len(distinct))
                near = nearest_hashes(distinct, refs) if len(hashes) else []
                keys.append([xxhash.xxh64_intdigest(f"{i}:{x}:{near[(i + 1) % TABLES]}", 5) >> 1 for i, x in enumerate(near)])
            columns = [batch.column(0), pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, type=pa.int64()), pa.array(keys, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "a", "b", "fp", "size", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, a long, b long, fp long, size long, keys array<long>")


def near_pairs(nodes: np.ndarray, fps: np.ndarray, table: np.ndarray, sizes: np.ndarray, comp: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(earlier nodes, nodes) of one bucket's pairs of different components within RADIUS bits whose numbers of shingles allow the similarity."""
    before, after = [nodes[:0]], [nodes[:0]]
    for i in range(1, len(nodes)):
        at = np.flatnonzero((np.abs(table[:i] - table[i]).max(axis=1) <= RADIUS) & (comp[:i] != comp[i]))
        at = at[(np.bitwise_count(fps[at] ^ fps[i]) <= RADIUS) & (np.minimum(sizes[at], sizes[i]) >= similarity * np.maximum(sizes[at], sizes[i]))]
        before.append(nodes[at])
        after.append(np.full(len(at), nodes[i]))
    return np.concatenate(before), np.concatenate(after)


def _compared(buckets: DataFrame, similarity: float) -> DataFrame:
    """Distinct candidates (a, b) with a < b of rows (key, node, fp, size, comp) in buckets of CROWD rows at most."""
    refs = pivots()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key"]):
            key, nodes, fps, sizes, comp = (t[c].to_numpy() for c in ("key", "node", "fp", "size", "comp"))
            fps = fps.view(np.uint64)
            table = np.stack([np.bitwise_count(fps ^ r) for r in refs], axis=1).astype(np.int16)
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            before, after = [nodes[:0]], [nodes[:0]]
            for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
                x, y = cuts[k], cuts[k + 1]
                a, b = near_pairs(nodes[x:y], fps[x:y], table[x:y], sizes[x:y], comp[x:y], similarity)
                before.append(a)
                after.append(b)
            a, b = np.concatenate(before), np.concatenate(after)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = buckets.select("key", "node", "fp", "size", "comp").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long").where("a < b").distinct()


def shared_counts(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of shingles that any two of the sets, one after the other in flat, have in common."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    keep = often[at] > 1  # only what two sets have
    owner, (_, at) = owner[keep], np.unique(at[keep], return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out, step = np.zeros((len(sizes), len(sizes)), dtype=np.float32), 4096
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        x, y = np.searchsorted(at, [low, low + step])
        has = np.zeros((len(sizes), step), dtype=np.float32)
        has[owner[x:y], at[x:y] - low] = 1
        out += has @ has.T
    return out


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The label of each row when the rows a and b, pair by pair, are joined: the smallest of their labels. label[i] is a row's number."""
    label = label.copy()
    while len(a):  # hooks the larger root of each link to the smaller one
        ra, rb = label[a], label[b]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (nxt := label[label]).tobytes() != label.tobytes():
            label = nxt
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def tile_forest(nodes: np.ndarray, fps: np.ndarray, comp: np.ndarray, tile: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) edges that join the nodes as all their pairs of at least the similarity do. Rows of one component, or of one tile where there are two, aren't compared."""
    shared = shared_counts(flat, sizes)
    apart = comp[:, None] != comp[None, :]
    if (tile != tile[0]).any():
        apart &= tile[:, None] != tile[None, :]
    for r in pivots():
        far = np.bitwise_count(fps ^ r).astype(np.int16)
        apart &= np.abs(far[:, None] - far[None, :]) <= RADIUS
    total = sizes.astype(np.float32)
    a, b = np.nonzero(np.triu(apart & (shared >= similarity * (total[:, None] + total[None, :] - shared)), 1))
    label = forest(np.arange(len(nodes)), a, b)
    loose = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[loose]], nodes[loose]


def _tiles_linked(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) of rows (g, node, fp, comp, tile), compared by their sets (node, shingles) within each g."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["g"]):
            t = t.combine_chunks()
            g = t["g"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
                part = t.slice(cuts[k], cuts[k + 1] - cuts[k])
                lists = part["shingles"].combine_chunks()
                nodes, fps, comp, tile = (part[c].to_numpy() for c in ("node", "fp", "comp", "tile"))
                a, b = tile_forest(nodes, fps.view(np.uint64), comp, tile, lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = rows.join(sets, "node").select("g", "node", "fp", "comp", "tile", "shingles").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "a long, b long")


def _tiles(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / TILE), F.ceil(shingles / TILE_SHINGLES)).cast("long")


def _bucketed(classes: DataFrame) -> DataFrame:
    """(key, node, fp, size, n, shingles) of keys that several classes (node, fp, size, keys) have; n and shingles are of all the key's rows. Counted by salts, so no key is hot."""
    keyed = classes.select("node", "fp", "size", F.explode("keys").alias("key"))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("key", "_salt").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    total = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("shingles")).where("n > 1")
    return salted.join(parts.select("key", "_salt").join(total, "key"), ["key", "_salt"]).drop("_salt")


def _cells(sets: DataFrame) -> np.ndarray:
    """How many of all shingles of sets fall in each of 2 ** CELL_BITS cells of hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for b in batches:
            total += np.bincount((b.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = sets.select("shingles").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2 ** CELL_BITS rows at most
    out = np.zeros(1 << CELL_BITS, dtype=np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def prefix(hashes: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a set's distinct shingles (signed longs): two sets of at least the similarity have one of them in common."""
    most = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    count = often[(hashes.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    return hashes[np.lexsort((hashes, count))[:most]]


def _prefixed(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (node, fp, size, comp) with prefix keys and the LAST nearest hashes of their sets (node, shingles)."""
    sent = sets.sparkSession.sparkContext.broadcast(_cells(sets))
    refs = pivots(LAST)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b.column(1)[i].values.to_numpy() for i in range(b.num_rows)]
            keys = [prefix(x, sent.value, similarity) for x in own]
            near = [[xxhash.xxh64_intdigest(f"{i}:{h}", 6) >> 1 for i, h in enumerate(nearest_hashes(x.view(np.uint64), refs))] for x in own]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, type=pa.list_(pa.int64())) for x in (keys, near))], names=["node", "keys", "near"])

    return rows.join(sets.select("node", "shingles").mapInArrow(run, "node long, keys array<long>, near array<long>"), "node")


def _by_prefix(rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(candidates, distinct nodes that share a prefix key with more than CROWD rows of several components), for rows of _prefixed()."""
    keyed = rows.select("node", "fp", "size", "comp", F.explode("keys").alias("key"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = keyed.groupBy("key", "salt").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    total = parts.groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    met = stash(keyed.join(parts.select("key", "salt").join(total.select("key", "n"), "key"), ["key", "salt"]), "prefix-buckets")
    pairs = stash(_compared(met.where(F.col("n") <= CROWD), similarity), "candidates")
    dense = stash(met.where(F.col("n") > CROWD).select("node").distinct(), "dense")
    forget(met)
    return pairs, dense


def _tile_pairs(rows: DataFrame) -> DataFrame:
    """(g, node, fp, comp, tile): rows (node, fp, size, comp, near) dealt as pairs of tiles by each of their near keys. A key's rows of its largest component only meet its other rows."""
    keyed = rows.select("node", "fp", "size", "comp", F.explode("near").alias("key"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = keyed.groupBy("key", "comp").agg(F.struct(F.count("*").alias("n"), F.sum("size").alias("s"), F.col("comp").alias("of")).alias("x"))
    total = parts.groupBy("key").agg(F.max("x").alias("main"), F.sum("x.n").alias("n"), F.sum("x.s").alias("s")).where(F.col("n") > F.col("main.n"))
    total = total.select("key", F.col("main.of").alias("main"), _tiles(F.col("main.n"), F.col("main.s")).alias("p"), _tiles(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("q"))
    met = keyed.join(keyed.select("key", "salt").distinct().join(total, "key"), ["key", "salt"])
    inside = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("node", "key"), F.when(inside, F.col("p")).otherwise(F.col("q")))
    # tiles of the largest component are numbered from -1 down, those of the others from 0 up
    others = F.sequence(F.lit(0).cast("long"), F.col("q") - 1)
    every = F.concat(others, F.transform(F.sequence(F.lit(1).cast("long"), F.col("p")), lambda x: -x))
    met = met.select("node", "fp", "comp", "key", F.when(inside, -1 - own).otherwise(own).alias("tile"), F.explode(F.when(inside, others).otherwise(every)).alias("with"))
    return met.select(F.xxhash64("key", F.least("tile", "with"), F.greatest("tile", "with")).alias("g"), "node", "fp", "comp", "tile")


class IdFilter:
    """A bit for each of FILTER_BITS hashes of ids: rows without their bit surely aren't among the ids. Its size doesn't grow with them."""

    def __init__(self, ids: DataFrame):
        spot = self.spot(F.col("id"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(63).cast("int"))
        words = ids.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
        bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
        bits[words["at"].to_numpy()] = words["bits"].to_numpy()
        self._sent = ids.sparkSession.sparkContext.broadcast(bits)

    @staticmethod
    def spot(column: Column) -> Column:
        return F.pmod(F.xxhash64(column, F.lit(1)), F.lit(FILTER_BITS))

    def test(self, spots: np.ndarray) -> np.ndarray:
        return ((self._sent.value[spots >> 6] >> (spots & 63)) & 1).astype(bool)

    def column(self, id_column: Column) -> Column:
        """Whether an id may be among the ids."""

        @F.pandas_udf("boolean")
        def maybe(spots: pd.Series) -> pd.Series:
            return pd.Series(self.test(spots.to_numpy()))

        return maybe(self.spot(id_column))


def _shingle_sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles) of the classes needed (node, id, a, b). Few other texts pass the filter of ids; the join by word sequence is exact."""
    passing = IdFilter(needed.select("id"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.filter(pa.array(passing.test(batch.column(1).to_numpy())))
            texts = b.column(2).to_pylist()
            marks = [_words_hash(t) for t in texts]
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[i] for m in marks], type=pa.int64()) for i in (0, 1)), pa.array(sets, type=pa.list_(pa.int64()))], names=["id", "a", "b", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    found = texts.select("id", IdFilter.spot(F.col("id")).alias("spot"), "t").mapInArrow(run, "id long, a long, b long, shingles array<long>")
    return found.dropDuplicates(["id", "a", "b"]).join(needed, ["id", "a", "b"]).select("node", "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least similarity. A hub's set goes to SALTS keys at most."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("mine")), "a")
    both = salted.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("theirs")), "b").join(left, ["a", "salt"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                keep = []
                for i in range(b.num_rows):
                    x, y = b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy()
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared >= similarity * (len(x) + len(y) - shared))
                yield b.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return both.select("a", "b", "mine", "theirs").mapInArrow(run, "a long, b long")


def near_duplicate_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows (id, node, least), roots (node, root)): each row's class of word sequence with the class's smallest id, and the component of each class that has links.

    Both are written tables. Rows of null ids aren't there.
    """
    signed = stash(signatures(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle), "signatures")
    classes = signed.groupBy("a", "b").agg(F.min(F.struct("id", "fp", "size", "keys")).alias("m"))
    classes = stash(classes.select(F.monotonically_increasing_id().alias("node"), "a", "b", F.col("m.id").alias("id"), F.col("m.fp").alias("fp"), F.col("m.size").alias("size"), F.col("m.keys").alias("keys")), "classes")
    own = F.col("node").alias("comp")
    buckets = stash(_bucketed(classes.select("node", "fp", "size", "keys")), "buckets")
    pairs = stash(_compared(buckets.where(F.col("n") <= CROWD).withColumn("comp", F.col("node")), similarity), "candidates")
    key = F.struct("key", "n", "shingles")
    crowded = stash(buckets.where(F.col("n") > CROWD).groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.min(key).alias("x"), F.max(key).alias("y")), "crowded")
    forget(buckets)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct()
    needed = stash(classes.join(wanted, "node").select("node", "id", "a", "b"), "candidate-classes")
    sets = stash(_shingle_sets(docs, needed, id_col, text_col, shingle), "shingle-sets")
    links = _verified(pairs, sets, similarity)
    some = not crowded.isEmpty()
    if some:
        looks = crowded.select("node", "fp", own, F.lit(0).alias("tile"), F.explode(F.array_distinct(F.array("x", "y"))).alias("k"))
        looks = looks.withColumn("g", F.xxhash64("k.key", F.pmod(F.xxhash64("node", "k.key"), _tiles(F.col("k.n"), F.col("k.shingles")))))
        links = links.unionByName(_tiles_linked(looks.select("g", "node", "fp", "comp", "tile"), sets, similarity))
    links = stash(links, "links")
    roots = stash(components(links), "components")
    if some:
        joined = crowded.select("node", "fp", "size").join(roots, "node", "left").select("node", "fp", "size", F.coalesce("root", "node").alias("comp"))
        joined = stash(_prefixed(joined, sets.join(crowded.select("node"), "node", "left_semi"), similarity), "prefixes")
        rare, dense = _by_prefix(joined, similarity)
        tiled = _tile_pairs(joined.join(dense, "node", "left_semi"))
        found = stash(_verified(rare, sets, similarity).unionByName(_tiles_linked(tiled, sets, similarity)), "links")
        if not found.isEmpty():
            roots = stash(components(links.unionByName(found)), "components")
        forget(joined, rare, dense)
    # a class's rows are dealt over salts where they meet it
    salted = signed.select("id", "a", "b", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    spread = salted.select("a", "b", "salt").distinct().join(classes.select("a", "b", "node", F.col("id").alias("least")), ["a", "b"])
    rows = stash(salted.join(spread, ["a", "b", "salt"]).select("id", "node", "least"), "row-classes")
    forget(signed, classes, pairs, needed, sets, links)
    return rows, roots


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest id; columns are as they were.

    Documents of the same words in the same order (A-Z in lower case) are copies; others are linked if their sets of word shingles have a
    Jaccard similarity of at least similarity, and groups are what links reach. Null, empty and other texts without words are copies of each
    other; a text of fewer words than a shingle is one shingle; very long texts are taken whole. Rows of a null id always stay.
    Rows of one id are one document, whatever their texts: they stay or go together, and go where any of them has a copy of a smaller
    id. An empty table stays empty; other columns, whatever their names, aren't read.
    """
    rows, roots = near_duplicate_links(docs, id_col, text_col, shingle, similarity)
    named = group_value(rows.select("node", "least").distinct().join(roots, "node").select("node", "root", "least"), ["root"], "least", F.min, F.min, "first").select("node", "first")
    linked = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    spread = linked.select("node", "salt").distinct().join(named, "node")
    dead = stash(rows.where("id > least").select("id").union(linked.join(spread, ["node", "salt"]).where("id > first").select("id")).distinct(), "gone")
    forget(rows, roots)
    # only rows that may go are shuffled
    key, gone = F.col(id_col).cast("long"), free_name(docs, "_gone")
    maybe = F.coalesce(IdFilter(dead).column(key), F.lit(False)) & key.isNotNull()
    rest = docs.where(maybe).join(dead.withColumnRenamed("id", gone), key == F.col(gone), "left_anti")
    return docs.where(~maybe).unionByName(rest)
