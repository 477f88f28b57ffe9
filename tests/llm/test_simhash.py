"""SimHash links and near-duplicate removal against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import components, neardup, simhash

SCHEMA = "doc_id long, text string, fp string, `id` string"


def reference_fingerprint(text: str | None, k: int) -> int:
    """Bit by bit, from the definition."""
    words, now = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, now = words + [now] if now else words, ""
        else:
            now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                up[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, key in enumerate(ids):
        r = find(i)
        least[r] = key if least.get(r) is None else min(least[r], key) if key is not None else least[r]
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one two three", "A b c d", "É É é x y z " * 40, "a\x0bb\x0cc\td e f", "word " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text, 4)) == reference_fingerprint(text, 4)


def documents(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        base = rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.5 else None
        words = base.split() if base else [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 30, 200]))]
        if base and rng.random() < 0.6 and words:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i if rng.random() > 0.05 else None, " ".join(words), "x", "y"))
    return rows + [(900, None, "x", "y"), (901, "", "x", "y"), (5, "repeated id", "x", "y"), (5, "repeated id", "x", "y")]


@pytest.mark.parametrize("tile", [1024, 3])
def test_components_are_those_of_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = documents()
    out = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [reference_fingerprint(r[1], 4) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_components([r[0] for r in rows], fps, 4)), key=str)
    assert sorted(map(tuple, out), key=str) == want


@pytest.mark.parametrize("rows", [1, 10**6, 10**9, 10**12])
@pytest.mark.parametrize("bits", [1, 4, 7])
def test_bit_groups_lose_no_link(rows, bits):
    masks = simhash.bit_groups(bits, rows)
    rng = random.Random(0)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), bits):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_local_forest_is_a_forest_of_the_right_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.unique(np.array([int(b) ^ int(sum(1 << int(i) for i in rng.choice(64, 3, replace=False))) for b in base for _ in range(80)], dtype=np.uint64))
    group = np.zeros(len(fps), dtype=np.int64)
    a, b = simhash.local_forest(group, fps, 4, simhash.pivots())
    assert len(a) < len(fps)
    up = {int(f): int(f) for f in fps}
    for x, y in zip(a.tolist(), b.tolist()):
        up[y] = x
    want = brute_components(fps.tolist(), fps.tolist(), 4)
    root = lambda x: x if up[x] == x else root(up[x])
    got = [root(f) for f in fps.tolist()]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(empty).count() == 0
    assert neardup.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(2, 1), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 300)], [(5, 9), (9, 7), (3, 4), (None, 4)]])
def test_connected_components(spark, edges):
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up: dict[int, int] = {}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    for a, b in real:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in real:
        for a, b in real:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


def near_copies(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows, at = [], 0
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([40, 150, 600]))]
        for copy in range(rng.choice([1, 2, 5])):
            own = list(words)
            for _ in range(copy * len(words) // 120 + (copy > 0)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((at, " ".join(own), "x", "y"))
            at += 1
    return rows + [(None, "no id here", "x", "y"), (None, "no id here", "x", "y"), (at, rows[0][1].upper(), "x", "y"), (at + 1, None, "x", "y"), (at + 2, " ", "x", "y")]


def similar(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return x == y or (x and y and len(x & y) / len(x | y) >= 0.8)


@pytest.mark.parametrize("tile", [1024, 2])
def test_one_of_each_group_stays(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = near_copies()
    out = neardup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    named = [r for r in rows if r[0] is not None]
    up = {r[0]: r[0] for r in named}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(named):
        for b in named[:i]:
            if similar(a[1], b[1]):
                x, y = find(a[0]), find(b[0])
                up[max(x, y)] = min(x, y)
    got = sorted(r["doc_id"] for r in out if r["doc_id"] is not None)
    want = sorted({find(k) for k in up})
    if tile == 1024:
        assert got == want
    else:  # dealt into tiles of two, some copies need more rounds than there are; nothing else may go
        assert set(want) <= set(got)
    assert sum(r["doc_id"] is None for r in out) == 2 and set(out[0].asDict()) == {"doc_id", "text", "fp", "id"}


def test_rounds_of_components_are_small_plans_without_broadcasts(spark, monkeypatch):
    """Each broadcast table and each copy of a step in a plan costs the driver memory."""
    plans, write = [], components.stash

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(components, "stash", seen)
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(20)]
    edges += [(edges[0][1], edges[0][0]), (5, 5), (None, 7)]
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in up:
        for a, b in edges:
            if a in up and b in up and a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(up.items())
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
    assert max(p.count("FileScan parquet") for p in plans) <= 6
