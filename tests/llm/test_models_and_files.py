"""Decontamination, language-model scores, WARC files and embeddings."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import ann, decontam, ppm, warc
from tidemark.llm.common import fresh_path


def edit_distance_in(p, t):
    """Least edit distance of p to any part of t, by the textbook table."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90))
def test_bit_parallel_distance(p, t):
    assert decontam.best_distance(decontam.pattern(0, p), t)[0] == edit_distance_in(p, t)


def contamination_rows():
    rng = random.Random(2)
    items = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 40))) for _ in range(12)]
    docs = []
    for i in range(60):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60))
        if i % 3 == 0:
            item = list(items[i % 12])
            for _ in range(rng.randrange(0, decontam.budget(len(item)) + 4)):
                item[rng.randrange(len(item))] = rng.choice("abcxyz")
            text = text[:100] + " " + "".join(item).title() + "!! " + text[100:]
        docs.append((i if i != 4 else None, text, "clash"))
    return docs + [(100, None, "clash"), (101, "", "clash"), (102, items[0], "clash"), (102, items[0], "clash"), (103, "it is Too, short!", "clash"), (104, "too shorty", "clash"), (105, "too short", "clash")], [*enumerate(items), (50, items[0]), (51, None), (52, "too short"), (None, items[1])]


def test_contamination_against_brute_force(spark):
    docs, items = contamination_rows()
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for i, t, _ in docs:
        for k, item in items:
            p = decontam.normal(item)
            short = len(p) < decontam.LEAST_INEXACT
            if p and (d := edit_distance_in(p, decontam.normal(t))) <= decontam.budget(len(p)) and (not short or f" {p} " in f" {decontam.normal(t)} "):
                want.append((i, k, d))
    assert len(want) > 15 and any(k == 52 for _, k, _ in want)
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in got), key=str) == sorted(want, key=str)


def test_decontaminate(spark, monkeypatch):
    docs, items = contamination_rows()
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    bad = {r["doc_id"] for r in decontam.contamination(d, b).collect()}
    for size in (decontam.BLOCK_CHARS, 700):  # the items in one block, and in several
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        out = decontam.decontaminate(d, b).collect()
        assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(str(i) for i, _, _ in docs if i not in bad) and set(out[0].asDict()) == {"doc_id", "text", "item_id"}
    kept = {r["doc_id"] for r in decontam.decontaminate(d, b, least_item=32).collect()}
    assert {103, 104, 105} <= kept and 102 not in kept
    assert decontam.contamination(d.limit(0), b).count() == 0 and decontam.contamination(d, b.limit(0)).count() == 0 and decontam.decontaminate(d, b.limit(0)).count() == len(docs)


def slow_ppm(train, text):
    """PPM with exclusion, symbol by symbol."""
    counts: dict[bytes, Counter] = {}
    for t in train:
        data = bytes(ppm.ORDER) + t + bytes([ppm.END])
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    total, data = 0.0, bytes(ppm.ORDER) + text + bytes([ppm.END])
    for i in range(ppm.ORDER, len(data)):
        out: set[int] = set()
        for k in range(ppm.ORDER, -1, -1):
            c = {s: n for s, n in counts.get(data[i - k : i], {}).items() if s not in out}
            if not c:
                continue
            room = sum(c.values()) + len(c)
            if data[i] in c:
                total += math.log10(c[data[i]] / room)
                break
            total += math.log10(len(c) / room)
            out |= c.keys()
        else:
            total -= math.log10(256 - len(out))
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: bytes(x % 5 + 97 for x in b)), max_size=5), st.binary(max_size=25).map(lambda b: bytes(x % 7 + 97 for x in b)))
def test_trie_is_ppm_with_exclusion(train, text):
    codes = ppm.grams(train)[0] if train else np.zeros(0, dtype=np.int64)
    keys, n = np.unique(codes, return_counts=True)
    assert ppm.Trie(keys, n.astype(float)).score([text])[0] == pytest.approx(slow_ppm(train, text), abs=1e-3)


def test_probabilities_sum_to_one():
    train = [b"abracadabra", b"banana", b"cab"]
    keys, n = np.unique(ppm.grams(train)[0], return_counts=True)
    trie = ppm.Trie(keys, n.astype(float))
    for ctx in (b"\0\0\0\0\0", b"\0\0\0ba", b"nanan", b"zzzzz", b"zzzza"):
        code = int.from_bytes(ctx[-ppm.ORDER :], "big") << 8
        assert (10 ** trie.log10(np.arange(256, dtype=np.int64) + code)).sum() == pytest.approx(1, abs=1e-3)


def test_rare_codes_are_never_pruned(spark):
    """Over two million distinct codes, nearly all of them met once."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.choice(list(b"abcdefghijklmnopqrstuvwxyz"), 100000).astype(np.uint8).tobytes() + b" \xce\xbb" * (i == 5)).decode(), 1, "x") for i in range(40)]
    rows.append((1000, rows[0][1][:300] + " \u03bb", 1, "x"))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    keys, n = np.unique(np.concatenate([ppm.grams([ppm.lowered(t)])[0] for (_, t, *_), h in zip(rows, held, strict=True) if not h]), return_counts=True)
    assert len(keys) > 2_000_000
    trie = ppm.Trie(keys, n.astype(float))
    out = {r["doc_id"]: r["score"] for r in scored(spark, rows).collect()}
    for i, t, *_ in rows:
        assert out[i] == pytest.approx(trie.score([ppm.lowered(t)])[0], rel=1e-5)


def scored(spark, rows):
    return ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string, run long, t string"))


@pytest.mark.parametrize("run", [8192, 3])
def test_scores(spark, monkeypatch, run):
    monkeypatch.setattr(ppm, "RUN", run)
    monkeypatch.setattr(ppm, "HELD", 20)
    if run == 3:  # counts passed on early and in many small batches
        monkeypatch.setattr(ppm, "HELD_CODES", 40)
        monkeypatch.setattr(ppm, "SENT", 7)
    rng = random.Random(1)
    rows = [(i if i != 9 else None, " ".join(rng.choice(["The", "cat", "Sat", "été", "on", f"w{i}"]) for _ in range(rng.randrange(0, 30))), 1, "x") for i in range(40)] + [(50, None, 1, "x"), (50, None, 1, "x"), (51, "\x0b tail ", 1, "x")]
    out = {r["doc_id"]: r for r in scored(spark, rows).collect()}
    words = lambda t: ppm.words_of(ppm.lowered(t))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    train = [ppm.lowered(t) for i, t, *_ in rows if not held(i)]
    for i, t, *_ in rows:
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(words(t)), sum(w in c for w in words(t)), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)))
        assert r["score"] == pytest.approx(slow_ppm(train, ppm.lowered(t)), rel=1e-4, abs=1e-3)


def test_scores_without_training(spark):
    assert scored(spark, []).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = scored(spark, [(held, "ab", 1, "x")]).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(-3 * math.log10(256)) and r["base_score"] == 0.0


def pages():
    big = "x" * 100
    return [
        (3, "http://a/ü?q=1\r\nX: y", "<html>é</html>" * 20, "clash"), (1, "http://b/", "<html>é</html>" * 20, "clash"), (7, None, big, "clash"), (5, "http://c/", big, "clash"), (5, "http://c/2", big, "clash"),
        (8, "http://d/", "short", "clash"), (9, "http://e/", "short", "clash"), (10, "http://f/", None, "clash"), (11, "http://g/", "", "clash"), (None, "http://h/", big, "clash"), (12, "http://i/", "WARC/1.1\r\n\r\n\r\n" + big, "clash"),
    ]


def written(spark, rows, **sizes):
    base = fresh_path(spark, "warc-test")
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, shard string"), base, **sizes)
    return base, manifest


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 600, "file_bytes": 300}])
def test_round_trip(spark, sizes):
    rows = pages()
    base, manifest = written(spark, rows, **sizes)
    got = sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in warc.read_warc(manifest, base).collect()), key=str)
    want = []
    for i, url, html, _ in rows:
        data = (html or "").encode()
        same = [(k is None, k, u or "") for k, u, h, _ in rows if (h or "").encode() == data]
        first = min(same, key=lambda x: (x[0], x[1] or 0, x[2]))
        again = len(data) >= 100 and (i is None, i, url or "") != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[1] if again else None, None if again else html or ""))
    assert got == sorted(want, key=str)
    assert manifest.count() == (1 if not sizes else manifest.select("file").distinct().count()) and manifest.agg({"records": "sum"}).first()[0] == len(rows)


def test_files_are_the_same_bytes_again(spark):
    rows = [(i, f"http://x/{i}", f"page {i % 7} " * 40, "c") for i in range(200)]
    digests = []
    for order in (rows, rows[::-1]):
        _, manifest = written(spark, order, shard_bytes=9000, file_bytes=2000)
        digests.append(sorted((r["file"], r["sha256"], r["records"]) for r in manifest.collect()))
    assert digests[0] == digests[1] and len(digests[0]) > 4


def test_far_ids(spark):
    rows = [(k, f"http://x/{k}", "some page", "c") for k in (-(1 << 63), -5, 0, 7, (1 << 63) - 1)]
    base, manifest = written(spark, rows, shard_bytes=1)
    assert sorted(r["id"] for r in warc.read_warc(manifest, base).collect()) == [r[0] for r in rows]


def test_no_pages(spark):
    base, manifest = written(spark, [])
    assert manifest.count() == 0 and warc.read_warc(manifest, base).count() == 0


def shard_of(manifest):
    return [(r["shard"], r["records"]) for r in manifest.orderBy("shard", "part").collect()]


@pytest.mark.parametrize("far", [2**60, -(2**63), 2**63 - 1])
def test_a_far_id_leaves_shards_as_they_are(spark, far):
    body = "".join(random.Random(1).choice("abcdefgh") for _ in range(10000))
    pages = [(i, f"http://a/{i}", f"{i} {body}") for i in range(300)]
    schema = "page_id long, url string, html string"
    many = [len(shard_of(warc.write_warc(spark.createDataFrame(rows, schema), fresh_path(spark, "warc-far"), shard_bytes=300_000))) for rows in (pages, [*pages, (far, "http://far/", "x")])]
    assert many[0] >= 10 and abs(many[1] - many[0]) <= 1


def test_null_and_repeated_ids_are_dealt(spark):
    body = "".join(random.Random(1).choice("abcdefgh") for _ in range(10000))
    rows = [(None, f"http://n/{i}", f"{i} {body}") for i in range(100)] + [(7, f"http://s/{i}", f"s{i} {body}") for i in range(100)] + [(7, "http://s/0", f"s0 {body}"), (8, "http://s/0", f"s0 {body}")]
    base = fresh_path(spark, "warc-null")
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), base, shard_bytes=200_000)
    assert len(shard_of(manifest)) >= 8 and max(n for _, n in shard_of(manifest)) < 60
    got = warc.read_warc(manifest, base).collect()
    assert sorted(((r["id"], r["url"], r["payload_digest"]) for r in got), key=str) == sorted(((i, u, hashlib.sha256(h.encode()).hexdigest()) for i, u, h in rows), key=str)
    assert [(r["id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"] == [(8, 7)]


def test_broken_records_are_found():
    record = warc.make_record(1, "http://a/", b"payload", None)
    assert warc.parse_record(record)[1] == b"payload"
    for bad in (record[:-1], record.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def vectors(seed=0, n=240, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(i if i != 17 else None, (centres[rng.integers(12)] + rng.normal(scale=rng.choice([0.02, 0.3]), size=d)).astype(np.float32).tolist(), int(rng.integers(3)), "x") for i in range(n)]
    odd = [(900, None, 0, "x"), (901, [], 0, "x"), (902, [0.0] * d, 0, "x"), (903, [float("nan")] + [1.0] * (d - 1), 0, "x"), (904, [float("inf")] + [1.0] * (d - 1), 0, "x"), (905, [None] + [1.0] * (d - 1), 0, "x"), (906, rows[0][1], None, "x"), (907, rows[0][1], rows[0][2], "x"), (907, rows[0][1], rows[0][2], "x"), (908, [1.0, 2.0], rows[0][2], "x"), (909, [2.0, 4.0], rows[0][2], "x")]
    return rows + odd


def brute_links(rows, least):
    unit = []
    for _, v, label, _ in rows:
        ok = bool(v) and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        a = np.array(v, dtype=np.float64) if ok else None
        unit.append(a / np.linalg.norm(a) if ok else None)
    link = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))]
    up = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(link):
            for j in js:
                up[i] = up[j] = min(up[i], up[j])
    least_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[up[i]] = min(least_id.get(up[i], r[0]), r[0])
    return sorted(((r[0], len(link[i]), least_id.get(up[i]), r[0] is not None and r[0] == least_id.get(up[i])) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("shard, block", [(8192, 512), (25, 20)])
def test_embeddings_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "STREAM", 64 if block > 100 else 2)
    rows = vectors()
    got = ann.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows, 0.98)


def test_no_embeddings(spark):
    assert ann.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_recall_and_packing():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 32))
    v = ann.unit(np.vstack([centres[i % 30] + rng.normal(scale=0.08, size=32) for i in range(1500)]))
    g = ann.Graph(v.astype(np.float32)).build()
    near, upper, entry = g.packed()
    h = ann.Graph.unpacked(v.astype(np.float32), near, upper, entry)
    hit = all_ = 0
    for i in range(0, 1500, 20):
        want = set(np.flatnonzero(v @ v[i] >= 0.95).tolist())
        got = set(h.within(v[i].astype(np.float32), 0.95, ann.BEAM).tolist())
        assert got == set(g.within(v[i].astype(np.float32), 0.95, ann.BEAM).tolist())
        hit, all_ = hit + len(want & got), all_ + len(want)
    assert hit >= 0.9 * all_
    found = ann.linked(v, np.arange(1500), g, v, np.arange(1500), 0.95)
    truth = [set(np.flatnonzero(v @ v[i] >= 0.95).tolist()) - {i} for i in range(1500)]
    assert sum(len(truth[i] & set(found[i].tolist())) for i in range(1500)) >= 0.99 * sum(map(len, truth))
    assert all(set(f.tolist()) <= truth[i] for i, f in enumerate(found))
