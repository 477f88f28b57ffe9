"""The pipeline stage by stage, and the registered queries of the corpus operators."""

from __future__ import annotations

import random
import re

import corpus_pipeline as cp
import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.llm import decontam, neardup, queries, simhash

SF = "/root/testdata/sf0.001"


def test_ten_operators_and_the_pipeline():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    key = df.columns[0]
    table = {"page_id": "pages", "vec_id": "embeddings"}.get(key, "documents")
    if name == "op4_decontamination":
        assert len(rows) > 0
    elif name != "op3_packing":
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


def test_warc_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rel = con.sql(queries.oracle_sql()["op6_warc"])
    got = queries.op6_warc(spark, SF).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rel.fetchall(), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "123 456", "en", "s", 7), (90003, "Write to a.b@example.com now", "en", "s", 28), (90004, "Write to a.b@example.com now", "en", "s", 28)], docs.schema)
    now, kept = docs.unionByName(extra), {}
    for name, stage in cp.STAGES:
        before = now
        now = stage(spark, now, SF)
        if name != "packing":
            assert now.columns == names and now.schema.simpleString() == docs.schema.simpleString()
        now = spark.createDataFrame(now.toPandas(), now.schema)
        kept[name] = (before, now)
    ids = {k: ({r["doc_id"] for r in a.select("doc_id").collect()}, {r["doc_id"] for r in b.select("doc_id").collect()}) for k, (a, b) in kept.items()}
    assert ids["language_id"][0] - ids["language_id"][1] == {90001, 90002}
    assert 90003 in ids["near_duplicates"][1] and 90004 not in ids["near_duplicates"][1]
    texts = {r["doc_id"]: r["text"] for r in kept["near_duplicates"][1].collect()}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    order = sorted(sets)
    assert not [1 for k, a in enumerate(order) for b in order[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = kept["decontamination"][1].collect()
    assert ids["decontamination"][0] - ids["decontamination"][1] and not [1 for r in clean for i in items if i in decontam.normal(r["text"])]
    masked = kept["personal_data"][1].collect()
    assert ids["personal_data"][0] == ids["personal_data"][1] and not [1 for r in masked if re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", r["text"])]
    assert all(r["n_chars"] == len(r["text"]) for r in masked)
    assert ids["packing"][0] == ids["packing"][1]


def test_whole_run(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


def template_corpus(pairs: int, others: int):
    """Documents that share a long passage, each with words of its own; the last pairs are copies of the first but for a few words."""
    passage = [f"p{k}" for k in range(78)]
    own = lambda i, k: [f"w{i}x{j}" for j in range(k)]
    rows = [(i, " ".join(passage + own(i, 26))) for i in range(pairs + others)]
    return rows + [(100000 + i, " ".join(passage + own(i, 17) + own(100000 + i, 9))) for i in range(pairs)]


def test_crowded_buckets_meet_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    rows = template_corpus(60, 240)
    kept = {r["doc_id"] for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == brute_force(rows)


def test_nearest_of_many_may_all_be_strangers(spark):
    """A bucket's row has more strangers nearer by fingerprint than its true partner."""
    own = lambda i, n: [f"w{i}x{j}" for j in range(n)]
    passage = [f"p{k}" for k in range(80)]
    rows = [(i, " ".join(passage + own(i, 20))) for i in range(300)]
    rows += [(1000 + i, " ".join(passage + own(i, 11) + own(1000 + i, 9))) for i in range(100)]
    kept = {r["doc_id"] for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == brute_force(rows)


def test_twins_among_twenty_thousand_pages_of_one_template(spark):
    """Of pages that share three quarters of their words, and are no copies, each planted twin of similarity 0.8 or more goes."""
    rng = random.Random(5)
    shared = [f"p{k}" for k in range(78)]
    pages = [" ".join(shared + [f"w{rng.randrange(50000)}" for _ in range(26)]) for _ in range(20000)]
    twins = []
    for j in range(300):
        words = pages[j].split()
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**9)}"
        twins.append(" ".join(words))
    close = [j for j, t in enumerate(twins) for x, y in [(set(simhash.shingle_hashes(u, 5).tolist()) for u in (t, pages[j]))] if len(x & y) >= 0.8 * len(x | y)]
    rows = [*enumerate(pages), *((100000 + j, t) for j, t in enumerate(twins))]
    kept = {r["doc_id"] for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id").collect()}
    assert len(close) > 200 and sum(100000 + j not in kept for j in close) >= 0.99 * len(close)
    assert sum(i < 100000 for i in kept) == 20000


def test_a_large_group_whose_copies_are_hardly_similar(spark, monkeypatch):
    """Copies of one text with a few words changed: many pairs are just below the similarity."""
    for name, value in (("CROWD", 8), ("TILE", 64)):
        monkeypatch.setattr(neardup, name, value)
    rng, base, rows = random.Random(6), [f"b{k}" for k in range(120)], []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(120)] = f"z{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    kept = {r["doc_id"] for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == brute_force(rows)


def test_near_duplicates_of_odd_input(spark):
    schema = "doc_id long, text string, _gone string, id string, node long"
    other = "other words stand here for the second text"
    rows = [(1, None, "x", "a", 1), (2, "", "x", "a", 1), (3, other, "x", "a", 1), (3, "quite a different text under the same number", "x", "a", 1), (4, other.upper(), "x", "a", 1), (None, other, "x", "a", 1), (5, "quite a different text under the same number", "x", "a", 1)]
    got = neardup.drop_near_duplicates(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "_gone", "id", "node"]
    assert sorted((r["doc_id"] or 0 for r in got.collect())) == [0, 1, 3, 3]
    assert neardup.drop_near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_shared_counts():
    rng = random.Random(7)
    sets = [sorted({rng.randrange(60) for _ in range(rng.randrange(1, 30))}) for _ in range(40)]
    got = neardup.shared_counts(np.concatenate([np.array(x, dtype=np.int64) for x in sets]), np.array([len(x) for x in sets]))
    assert all(got[i, j] == len(set(a) & set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def brute_force(rows):
    """Ids that stay: the smallest of each component of exact links."""
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for k, b in enumerate(order):
        for a in order[:k]:
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}
