"""Token counts and ids as a public tokenizer file gives them, with the whole-token shortcut.

Which strings of the vocabulary encode alone as exactly one token is proven once for a worker, by encoding each of them.
A text is cut into pre-tokens; those that are proven strings are counted directly, and only the others are merged by the
library, each distinct one once. A text that the cutting rule isn't proven for (other scripts, special strings, another kind of
tokenizer) goes through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Merged pre-tokens that a worker remembers before it forgets them all.
REMEMBERED = 300_000
#: Longer pre-tokens are merged again each time.
LONGEST = 64

#: The tokenizer file's own rules (fixed values of its format) that the shortcut is written for.
RULES = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
#: Characters for which the rules are the same in Python: no combining marks, one lower-case form, known classes.
_PLAIN = re.compile("[\t\n\r -~¡-įı-ſ]*")
_LETTER, _NUMBER = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


class Encoder:
    """Encodes texts with the tokenizer file at path; ids are little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._library = lambda text: model.encode(text, num_threads=1)
            self.single, self.shortcut, self._special = {}, False, None
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._library = lambda text: tok.encode(text, add_special_tokens=False).ids
            spec = json.loads(tok.to_str())
            self.shortcut = self._applies(spec)
            special = [re.escape(t["content"]) for t in spec["added_tokens"]]
            self._special = re.compile("|".join(special)) if special else None
            self.single = self._proven(tok) if self.shortcut else {}
        self._merged: dict[str, bytes] = _Merged(_merger(tok) if self.shortcut else self._pack, self.single)

    @staticmethod
    def _applies(spec: dict) -> bool:
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        return (spec.get("normalizer") or {}).get("normalizers") == RULES["normalizer"] and pre[0].get("pattern", {}).get("Regex") == RULES["split"] and pre[0].get("behavior") == "Removed" and not spec["model"].get("dropout")

    def _pack(self, text: str) -> bytes:
        return np.array(self._library(text), dtype="<u4").tobytes()

    @staticmethod
    def _proven(tok) -> dict[str, bytes]:
        """Pre-tokens that the library encodes alone as one token."""
        plain = {i: tok.id_to_token(i) for i in range(tok.get_vocab_size())}
        words = sorted({m for t in plain.values() if t for m in [t.removesuffix("</w>").lower()] if _PIECE.fullmatch(m)})
        proven = {}
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            proven |= {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(part, tok.encode_batch(part, add_special_tokens=False), strict=True) if len(e.ids) == 1}
        return proven

    def pieces(self, text: str) -> list[str] | None:
        """The text's pre-tokens, or None if only the library may cut it."""
        if not self.shortcut or not _PLAIN.fullmatch(text) or (self._special and self._special.search(text)):
            return None
        return _PIECE.findall(text.lower())

    def forget(self) -> None:
        """Drops the merged pre-tokens, so that an idle worker doesn't hold them."""
        self._merged.reset()

    def ids(self, text: str) -> bytes:
        pieces = self.pieces(text)
        return self._pack(text) if pieces is None else b"".join(map(self._merged.__getitem__, pieces))

    def count(self, text: str) -> int:
        pieces = self.pieces(text)
        return len(self._library(text)) if pieces is None else sum(map(len, map(self._merged.__getitem__, pieces))) // 4


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible bytes stand for themselves, the others for the letters from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _merger(tok):
    """Ids of one plain pre-token, by the library's merges alone: such a pre-token is normal already and isn't cut further."""
    letters, merge = _byte_letters(), tok.model.tokenize

    def ids(piece: str) -> bytes:
        word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in merge(word)]).tobytes()

    return ids


class _Merged(dict):
    """Ids by pre-token: the proven ones, and those merged so far."""

    def __init__(self, merge, proven: dict[str, bytes]):
        super().__init__(proven)
        self._merge, self._proven = merge, proven

    def reset(self) -> None:
        self.clear()
        self.update(self._proven)

    def __missing__(self, piece: str) -> bytes:
        ids = self._merge(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED + len(self._proven):
                self.reset()
            self[piece] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """A row for each row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary is a path that every executor has (a public tokenizer's .json or .model). A null text counts as an empty one: no
    bytes, no tokens. Null and repeated ids are kept as they are; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = pa.array([enc.count(t) if t else 0 for t in b.column(1).to_pylist()], type=pa.int64())
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])
        enc.forget()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
