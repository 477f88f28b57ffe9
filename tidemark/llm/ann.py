"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Equal vectors of a label are one node from the start. The nodes of one label are dealt into shards of bounded size, and each shard
gets a graph. Every node, in blocks, queries every shard of its label: a task loads the graph of one shard and streams blocks past it, so
what is shuffled for a shard is the blocks, and one copy of the shard for each STREAM of them. A search descends the layers, runs a beam over the lowest one and then follows all neighbours over the
threshold, so a large group of copies isn't cut off by the beam's width. Each block audits its recall against brute force over
some of its queries and doubles the beam until the audit passes; a beam as wide as the shard that still fails gives way to a
scan of that shard. Cosines are verified in double precision. A task gives counts and a forest of its links, never pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, group_value, stash, whole_groups
from .components import components

SHARD = 8192
BLOCK = 512
#: Blocks that one task streams past a shard.
STREAM = 64
LINKS = 12
BUILD_BEAM = 48
BEAM = 32
#: The share of brute-force links that an audit asks for.
RECALL = 0.99
AUDIT_EVERY, AUDIT_LEAST = 20, 16


class Graph:
    """A layered neighbour graph over unit vectors (float32 rows)."""

    def __init__(self, vectors: np.ndarray, near: np.ndarray | None = None, upper: list[dict[int, list[int]]] | None = None, entry: int = 0):
        self.v, self.entry = vectors, entry
        self.near = np.full((len(vectors), 2 * LINKS), -1, dtype=np.int32) if near is None else near
        self.upper = upper or []
        self._seen, self._stamp = np.zeros(len(vectors), dtype=np.int32), 0

    def neighbours(self, node: int, layer: int) -> np.ndarray:
        if layer:
            return np.array(self.upper[layer - 1].get(node, ()), dtype=np.int32)
        row = self.near[node]
        return row[row >= 0]

    def beam(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The best (similarity, node) found with a beam, best first."""
        self._stamp += 1
        seen, stamp = self._seen, self._stamp
        for _, n in starts:
            seen[n] = stamp
        todo = [(-s, n) for s, n in starts]
        heapq.heapify(todo)
        best = list(starts)
        heapq.heapify(best)
        while todo:
            s, n = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            new = self.neighbours(n, layer)
            new = new[seen[new] != stamp]
            if not len(new):
                continue
            seen[new] = stamp
            for s, n in zip((self.v[new] @ q).tolist(), new.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, n))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, n))
                else:
                    continue
                heapq.heappush(todo, (-s, n))
        return sorted(best, reverse=True)

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.v[self.entry] @ q), self.entry)]
        for layer in range(len(self.upper), to, -1):
            at = self.beam(q, at, 1, layer)
        return at

    def _chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, best first: those nearer to the new node than to any chosen one; then the best of the rest."""
        nodes = np.array([n for _, n in found])
        among = self.v[nodes] @ self.v[nodes].T
        keep, rest = [], []
        for i, (s, _) in enumerate(found):
            if len(keep) == most:
                break
            (keep if not keep or among[i, keep].max() < s else rest).append(i)
        return [int(nodes[i]) for i in (keep + rest)[:most]]

    def _link(self, node: int, to: int, layer: int) -> None:
        most = LINKS if layer else 2 * LINKS
        have = self.neighbours(node, layer).tolist()
        have.append(to)
        if len(have) > most:
            sims = (self.v[have] @ self.v[node]).tolist()
            have = self._chosen(sorted(zip(sims, have, strict=True), reverse=True), most)
        if layer:
            self.upper[layer - 1][node] = have
        else:
            self.near[node, : len(have)] = have
            self.near[node, len(have) :] = -1

    def build(self) -> Graph:
        for i in range(len(self.v)):
            u = (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 3) + 1) / 2**64
            level = min(int(-math.log(u) / math.log(LINKS)), 12)
            if i:
                at = self.descend(self.v[i], level)
                for layer in range(min(level, len(self.upper)), -1, -1):
                    at = self.beam(self.v[i], at, BUILD_BEAM, layer)
                    mine = self._chosen(at, LINKS)
                    if layer:
                        self.upper[layer - 1][i] = mine
                    else:
                        self.near[i, : len(mine)] = mine
                    for n in mine:
                        self._link(n, i, layer)
            for _ in range(level - len(self.upper)):
                self.upper.append({i: []})
                self.entry = i
        return self

    def within(self, q: np.ndarray, least: float, width: int) -> np.ndarray:
        """Nodes found whose similarity to q is least or more: the beam's, and all that can be reached over such nodes."""
        hits = np.array([n for s, n in self.beam(q, self.descend(q, 0), width, 0) if s >= least], dtype=np.int32)
        if not len(hits):
            return hits
        self._stamp += 1
        self._seen[hits] = self._stamp
        found, edge = [hits], hits
        while len(edge):
            new = np.unique(self.near[edge])
            new = new[new >= 0]
            new = new[self._seen[new] != self._stamp]
            self._seen[new] = self._stamp
            edge = new[self.v[new] @ q >= least]
            found.append(edge)
        return np.concatenate(found)

    def packed(self) -> tuple[bytes, bytes, int]:
        flat = [len(self.upper)]
        for layer in self.upper:
            flat.append(len(layer))
            for n, links in layer.items():
                flat += [n, len(links), *links]
        return self.near.tobytes(), np.array(flat, dtype=np.int32).tobytes(), self.entry

    @classmethod
    def unpacked(cls, vectors: np.ndarray, near: bytes, upper: bytes, entry: int) -> Graph:
        flat, at, layers = np.frombuffer(upper, dtype=np.int32).tolist(), 1, []
        for _ in range(flat[0]):
            layer, n = {}, flat[at]
            at += 1
            for _ in range(n):
                layer[flat[at]] = flat[at + 2 : at + 2 + flat[at + 1]]
                at += 2 + flat[at + 1]
            layers.append(layer)
        return cls(vectors, np.frombuffer(near, dtype=np.int32).reshape(-1, 2 * LINKS), layers, entry)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double precision; no row may be zero."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


#: How much lower than the threshold float32 similarities are followed before the double-precision check.
SLACK = 1e-5


def linked(queries: np.ndarray, ids: np.ndarray, graph: Graph, nodes: np.ndarray, node_ids: np.ndarray, least: float) -> list[np.ndarray]:
    """For each query (unit rows, double): positions of the nodes found with cosine least or more, itself not included."""

    def verified(i: int, found: np.ndarray) -> np.ndarray:
        found = found[node_ids[found] != ids[i]]
        return np.sort(found[nodes[found] @ queries[i] >= least]) if len(found) else found

    def scan(i: int) -> np.ndarray:
        return verified(i, np.flatnonzero(graph.v @ single[i] >= least - SLACK))

    single = queries.astype(np.float32)
    audit = np.flatnonzero(ids % AUDIT_EVERY == 0)
    if len(audit) < AUDIT_LEAST:
        audit = np.arange(min(len(ids), AUDIT_LEAST))
    truth = {int(i): scan(i) for i in audit}
    wanted, width = sum(map(len, truth.values())), BEAM
    while width < 2 * len(nodes):
        got = {i: verified(i, graph.within(single[i], least - SLACK, width)) for i in truth}
        if sum(len(np.intersect1d(got[i], truth[i])) for i in truth) >= RECALL * wanted:
            return [truth[i] if i in truth else verified(i, graph.within(single[i], least - SLACK, width)) for i in range(len(ids))]
        width *= 2
    return [scan(i) for i in range(len(ids))]


def _roots(count: int, pairs: Iterable[tuple[int, np.ndarray]]) -> list[int]:
    up = list(range(count))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, many in pairs:
        for b in many.tolist():
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    return [find(x) for x in range(count)]


def _bytes(type_name: str) -> type:
    """How vectors travel: single precision where the table has it."""
    return np.float32 if type_name == "array<float>" else np.float64


def _packed(df: DataFrame, size: int, graphs: bool, tasks: int, kind: type) -> DataFrame:
    """Packs the rows (g, rid, vector, n: rows of g) into blobs of about size rows, numbered by part within g; with graphs, also builds each one's graph."""
    part = df.withColumn("part", F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / size))).withColumn("k", F.xxhash64("g", "part"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["k", "g"]):
            k, g = t["k"].to_numpy(), np.array(t["g"].to_pylist(), dtype=object)
            cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1]), True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = t.slice(a, b - a)
                order = np.argsort(own["rid"].to_numpy(), kind="stable")
                flat = own["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)[order]
                near, upper, entry = Graph(unit(flat).astype(np.float32)).build().packed() if graphs else (b"", b"", 0)
                blob = np.ascontiguousarray(flat, dtype=kind).tobytes()
                row = (g[a], pa.string()), (own["n"][0].as_py(), pa.int64()), (own["part"][0].as_py(), pa.int64()), (own["rid"].to_numpy()[order].tobytes(), pa.binary()), (own["weight"].to_numpy()[order].tobytes(), pa.binary()), (blob, pa.binary()), (near, pa.binary()), (upper, pa.binary()), (entry, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x], type=kind_) for x, kind_ in row], names=[x.split()[0] for x in _BLOB.split(", ")])

    return part.select("g", "n", "k", "part", "rid", "weight", "vector").repartition(tasks, "k", "g").sortWithinPartitions("k", "g").mapInArrow(run, _BLOB)


_BLOB = "g string, n long, part long, rids binary, weights binary, vectors binary, near binary, upper binary, entry int"


def _meetings(able: DataFrame, kind: type) -> DataFrame:
    """Each block with each shard of its label: rows (k, kind, ...) by k, the shard's own row (kind 0) first, then its blocks (kind 1)."""
    number = able.select("g", "n").distinct().agg(F.coalesce(F.sum(F.ceil(F.col("n") / SHARD)), F.lit(1))).first()[0]
    tasks = max(able.sparkSession.sparkContext.defaultParallelism, min(2 * int(number), 1 << 15))
    shards = stash(_packed(able, SHARD, True, tasks, kind), "graphs")
    blocks = stash(_packed(able, BLOCK, False, tasks, kind), "blocks")
    own = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.ceil(F.col("n") / BLOCK) - 1) / STREAM)))
    to = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / SHARD) - 1))
    served = shards.withColumn("stream", own).select(F.xxhash64("g", "part", "stream").alias("k"), F.lit(0).alias("kind"), "rids", "weights", "vectors", "near", "upper", "entry")
    asked = blocks.withColumn("shard", to).withColumn("stream", F.floor(F.col("part") / STREAM).cast("long"))
    asked = asked.select(F.xxhash64("g", "shard", "stream").alias("k"), F.lit(1).alias("kind"), "rids", "weights", "vectors", "near", "upper", "entry")
    streams = able.select("g", "n").distinct().agg(F.coalesce(F.sum(F.ceil(F.col("n") / SHARD) * (F.floor((F.ceil(F.col("n") / BLOCK) - 1) / STREAM) + 1)), F.lit(1))).first()[0]
    tasks = max(able.sparkSession.sparkContext.defaultParallelism, min(2 * int(streams), 1 << 15))
    return served.unionByName(asked).repartition(tasks, "k").sortWithinPartitions("k", "kind")


def embedding_components(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """A row for each row of vectors: id_col, n_links, component_id, kept.

    Rows of equal labels (not null; all rows where label_col is None) and equal lengths are linked where their cosine is least or more.
    A vector that is null, empty or all zero, or holds a null or a number that isn't finite, has no links. n_links counts the other
    rows linked; component_id is the smallest id reachable, its own included; kept says that it is the row's own id. Repeated
    rows are vectors of their own and linked. A null id takes no part in the smallest id. An empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    kind = _bytes(vectors.schema[vector_col].dataType.simpleString())
    wide = "array<float>" if kind is np.float32 else "array<double>"
    rows = stash(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(wide).alias("vector"), label.alias("label")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    able = rows.where(F.col("label").isNotNull() & sound).select("rid", "vector", F.concat_ws(":", F.size("vector"), "label").alias("g"))
    # copies: those of one hash of 128 bits are one node, that of the smallest number
    marked = able.select("g", "rid", F.xxhash64("vector").alias("m"), F.xxhash64(F.lit("copy"), "vector").alias("mm"))
    copies = stash(group_value(marked, ["g", "m", "mm"], "rid", F.min, F.min, "node"), "copies").select("rid", "node", "g")
    weights = copies.groupBy("node").agg(F.count("*").alias("weight"))
    sizes = copies.where("rid = node").groupBy("g").agg(F.count("*").alias("n"))
    nodes = able.join(weights.withColumnRenamed("node", "rid"), "rid")
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    able = stash(salted.join(salted.select("g", "salt").distinct().join(sizes, "g"), ["g", "salt"]).drop("salt"), "able-vectors")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, graph, nodes, node_ids, node_weights = None, None, None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                ids = np.frombuffer(r["rids"], dtype=np.int64)
                units = unit(np.frombuffer(r["vectors"], dtype=kind).reshape(len(ids), -1))
                weight = np.frombuffer(r["weights"], dtype=np.int64)
                if not r["kind"]:
                    now, nodes, node_ids, node_weights = r["k"], units, ids, weight
                    graph = Graph.unpacked(units.astype(np.float32), r["near"], r["upper"], r["entry"])
                    continue
                if r["k"] != now:  # a shard without any row
                    continue
                found = linked(units, ids, graph, nodes, node_ids, least)
                every, place = np.unique(np.concatenate([ids, node_ids]), return_inverse=True)
                mine, theirs = place[: len(ids)], place[len(ids) :]
                root = every[np.array(_roots(len(every), ((int(mine[i]), theirs[f]) for i, f in enumerate(found))), dtype=np.int64)]
                loose = root != every
                counts = np.array([node_weights[f].sum() for f in found], dtype=np.int64)
                some = counts > 0
                out = [(ids[some], ids[some], counts[some]), (root[loose], every[loose], np.zeros(loose.sum(), dtype=np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "links"])

    found = stash(_meetings(able, kind).mapInArrow(run, "a long, b long, links long"), "links")
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    rooted = components(found.where("links = 0").select("a", "b"))
    known = weights.join(links, "node", "left").join(rooted, "node", "left").select("node", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    # a node's copies are dealt over salts where they meet it
    salted = copies.select("rid", "node", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).alias("salt"))
    each = salted.join(salted.select("node", "salt").distinct().join(known, "node"), ["node", "salt"]).select("rid", "n_links", "root")
    known = stash(rows.select("id", "rid").join(each, "rid", "left").select("id", "rid", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "rid").alias("root")), "rooted")
    named = group_value(known, ["root"], "id", F.min, F.min, "component_id")
    return named.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
