"""Licence scans with a positional rare-token index.

The index has the words of every licence template and base phrase with their positions. Document frequencies of those words, over
the whole corpus, say which words of an entry's mandatory key phrase are rarest; the entry is posted under up to POSTED of them, each with
its position. A file's licence words are looked up from the rarest on. Each posting turns a word's places into places where the entry
would stand; these are intersected over the entry's posted words, and what is left counts only where the whole key phrase
stands. An entry has all its posted words wherever its key phrase occurs, so no place is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Words of its key phrase that an entry is posted under, at most.
POSTED = 3

#: Fixed values, own templates: label, a section of the licence or of its usual notice as words, and the mandatory key phrase within the section.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "unless required by applicable law or agreed to in writing software"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission is hereby granted free of charge to any person obtaining"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("gpl-gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license"),
    ("gpl-gnu", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "hope that it will be useful but without any warranty"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit", "creative commons attribution 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution", "eclipse public license"),
)


class Entry(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    key: int  # the key phrase's first position in words
    key_words: tuple[bytes, ...]
    base: bool


def entries() -> list[Entry]:
    out = [Entry(label, tuple(p.encode().split()), 0, tuple(p.encode().split()), True) for p, label in PHRASES]
    for label, text, key in TEMPLATES:
        words, k = tuple(text.encode().split()), tuple(key.encode().split())
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        out.append(Entry(label, words, at, k, False))
    return out


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Index:
    """Entries under the rarest words of their key phrases, with the words' places in the phrase."""

    def __init__(self, frequency: dict[bytes, int], documents: int):
        self.entries = entries()
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1 for e in self.entries for w in e.words}
        self.total = [sum(self.idf[w] for w in e.words) for e in self.entries]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # word: (entry, place in its key phrase)
        self.needs: list[int] = []
        for n, e in enumerate(self.entries):
            rarest = sorted(range(len(e.key_words)), key=lambda i: (-self.idf[e.key_words[i]], i))[:POSTED]
            self.needs.append(len(rarest))
            for i in rarest:
                self.postings[e.key_words[i]].append((n, i))
        self.rare = frozenset(self.postings)

    def places(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(entry, places of its key phrase) for each entry that the words hold."""
        if self.rare.isdisjoint(words):
            return
        where = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.rare:
                where[w].append(i)
        starts: dict[int, set[int]] = {}
        met: dict[int, int] = defaultdict(int)
        for w in sorted(where, key=lambda w: (-self.idf[w], w)):
            for n, i in self.postings[w]:
                here = {p - i for p in where[w] if p >= i}
                starts[n] = starts[n] & here if n in starts else here
                met[n] += 1
        for n, found in starts.items():
            key = self.entries[n].key_words
            if met[n] == self.needs[n] and (sure := [k for k in sorted(found) if tuple(words[k : k + len(key)]) == key]):
                yield n, sure

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """(starts of base phrases, base labels, all labels, best score) of a file's words."""
        starts, base, labels, score = [], set(), set(), 0.0
        for n, places in self.places(words):
            e = self.entries[n]
            labels.add(e.label)
            if e.base:
                starts += places
                base.add(e.label)
                score = 1.0
                continue
            for key in places:
                first = key - e.key
                alike = sum(self.idf[x] for i, x in enumerate(e.words) if 0 <= first + i < len(words) and words[first + i] == x)
                score = max(score, alike / self.total[n])
        return starts, base, labels, min(score, 1.0)


def _frequencies(docs: DataFrame, text_col: str) -> tuple[dict[bytes, int], int]:
    """Documents that have each licence word, over all rows, and the number of rows: as many counts as the templates have words."""
    known = frozenset(w for e in entries() for w in e.words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = Counter(), 0
        for b in batches:
            rows += b.num_rows
            for t in b.column(0).to_pylist():
                n.update(known.intersection(words_of(t)))
        n[b""] = rows
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n]), pa.array(list(n.values()), type=pa.int64())], names=["w", "n"])

    sums = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {r["w"].encode(): r["n"] for r in sums}
    return found, found.pop(b"", 0)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases; first_word and last_word are the smallest and largest of their starts, in words from 0, null
    without any. Labels are distinct, sorted and comma-joined, empty strings without any; an entry's label is there where its key phrase
    stands. score is the best entry's share, by inverse document frequency, of words found in place: 0 without any entry, 1 for a
    whole one. A null text is as an empty one; very long texts are read whole. Null and repeated ids are kept; an empty table gives no rows;
    other columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(*_frequencies(docs, text_col)))  # bounded by the templates
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = index.value.scan
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                starts, base, labels, score = scan(words)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            columns = [b.column(0), *(pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)
