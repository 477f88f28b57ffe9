"""Token counts against the library, and packings."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", " ", "Hello, world's end!", "naïve Straße ÉTÉ ½ ² 100", "<|endoftext|> in <|startoftext|>text", "日本語 текст", "é combining", "İstanbul ΣΑΣ", "a b c", "x" * 5000, "it's don't we'll 'S", "_-_ a_b __", "😀 emoji 👍🏽", "tab\tnew\nline\r\n", "ŉ ſ ÿ Ÿ × ÷"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_library_s(text):
    got = np.frombuffer(tokens.encoder(PATH).ids(text), dtype="<u4").tolist()
    assert got == ids(text) and tokens.encoder(PATH).count(text) == len(got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdefgh ABC'stélß.,!?019²½×÷_\n\t"), st.characters(max_codepoint=0x180, exclude_categories=("Cs",))), max_size=60))
def test_any_plain_text(text):
    assert np.frombuffer(tokens.encoder(PATH).ids(text), dtype="<u4").tolist() == ids(text)


def test_every_plain_character():
    for c in [chr(i) for i in range(9, 0x180)]:
        for text in (c, f"a{c}b", f"A{c} {c}{c}1"):
            assert np.frombuffer(tokens.encoder(PATH).ids(text), dtype="<u4").tolist() == ids(text), repr(text)


def test_whole_tokens_are_proven():
    enc = tokens.encoder(PATH)
    assert len(enc.single) > 10_000
    for w in random.Random(0).sample(sorted(enc.single), 500):
        assert len(ids(w)) == 1


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    enc = tokens.Encoder(PATH)
    words = [f"zq{i}x" for i in range(40)] * 2
    assert np.frombuffer(enc.ids(" ".join(words)), dtype="<u4").tolist() == ids(" ".join(words))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode("A plain text, été.")
    else:
        want = Tokenizer.from_file(path).encode("A plain text, été.", add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder(path).ids("A plain text, été."), dtype="<u4").tolist() == want


def rows(spark, texts):
    return spark.createDataFrame([(i if i != 2 else None, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, piece int")


def test_counts(spark):
    texts = [*TEXTS, None, "word " * 3000, "word " * 3000]
    out = tokens.token_counts(rows(spark, texts), PATH).collect()
    want = sorted(((i if i != 2 else None, len((t or "").encode()), len(ids(t or "")), len(ids(t or "")) > 2048) for i, t in enumerate(texts)), key=str)
    assert sorted(map(tuple, out), key=str) == want
    assert tokens.token_counts(rows(spark, []), PATH).count() == 0


def check_packing(out, texts, capacity):
    by_doc, seen = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        seen.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        key = i if i != 2 else None
        want = [*ids(t or ""), 1]
        own = sorted(by_doc[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == [capacity * k for k in range(len(own))]
        assert all(r["length"] == capacity for r in own[:-1]) and sum(r["length"] for r in own) == len(want)
        for r in own:
            part = want[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for rs in seen.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(seen)


@pytest.mark.parametrize("group", [8192, 7])
def test_packing(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    rng = random.Random(5)
    texts = [*TEXTS, None, "word " * 200] + ["w " * rng.randrange(1, 60) for _ in range(80)]
    out = packing.pack_documents(rows(spark, texts), PATH, capacity=64).collect()
    used = check_packing(out, texts, 64)
    least = packing.lower_bound(np.array([r["length"] for r in out]), 64)
    assert least <= used <= least + (0 if group == 8192 else 3)


def test_packing_nothing(spark):
    assert packing.pack_documents(rows(spark, []), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_bounds(lengths):
    """The bound is never over the best packing, and best-fit decreasing never under it."""
    n = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    bins, offsets, count = packing.best_fit_decreasing(n, 30)
    assert packing.lower_bound(n, 30) <= optimum(n.tolist(), 30) <= count
    for b in range(count):
        own = sorted(zip(offsets[bins == b].tolist(), n[bins == b].tolist()))
        assert [o for o, _ in own] == np.r_[0, np.cumsum([x for _, x in own])][:-1].astype(int).tolist() and sum(x for _, x in own) <= 30


def optimum(items, capacity):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                k = rooms.index(room)
                go(i + 1, rooms[:k] + [room - items[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_a_gap_is_found():
    """Six items of just over half: the sum alone says four bins, the dual feasible functions six."""
    assert packing.lower_bound(np.array([17] * 6), 30) == 6
