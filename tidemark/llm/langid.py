"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte n-grams of whole texts in lower case, as square roots of their shares, over their length. Models are
fitted on the driver from a bounded sample of labelled rows: PER_LANGUAGE texts of each label, fewer where labels are so many that this
would be over TRAIN_ROWS in all, and the first TRAIN_CHARS characters of each. Every label is learnt, if only from one text. Prediction
reads every text whole.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, free_name

BUCKETS = 4096
PER_LANGUAGE = 400
TRAIN_ROWS = 16_000
TRAIN_CHARS = 10_000
EPOCHS = 25
UNKNOWN = "und"
#: The pipeline's stage rejects a text of LEAST_LETTERS letters or more whose language has a lower score.
LEAST_SCORE = 0.45
LEAST_LETTERS = 32

#: Families of related languages by ISO 639-1 code. A label that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "celtic": "br cy ga gd",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_OTHER = re.compile(r"[\W\d_]+")


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"={lang}")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def features(text: str) -> np.ndarray:
    """Unit vector of hashed byte 1- to 4-grams of the letters, runs of other characters as one space."""
    data = np.frombuffer(f" {_OTHER.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), 1 << 18):  # a bounded piece of a very long text at a time
        b = data[at : at + (1 << 18) + 3].astype(np.uint32)
        code = b.copy()
        for n in range(1, 5):
            if n > 1:
                code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
            slot = ((code * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519)) >> np.uint32(20)
            total += np.bincount(slot, minlength=BUCKETS)
    x = np.sqrt(total.astype(np.float32))
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def fit_pair(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = EPOCHS) -> np.ndarray:
    """Linear SVM by dual coordinate descent; y is +1 or -1; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, alpha = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(x))
    norm = (x * x).sum(axis=1)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = float(y[i] * (x[i] @ w)) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Votes:
    """One-versus-one machines over classes; none are needed for one class."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        y = np.array(labels)
        self.pairs = [(i, j) for i in range(len(self.classes)) for j in range(i + 1, len(self.classes))]
        w = []
        for i, j in self.pairs:
            own = (y == self.classes[i]) | (y == self.classes[j])
            w.append(fit_pair(x[own], np.where(y[own] == self.classes[i], 1.0, -1.0)))
        self.w = np.array(w, dtype=np.float32).T if w else None

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class number, confidence from 0 to 1) of each row: most votes, then the largest sum of margins, then the first class."""
        if self.w is None:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        margin = x @ self.w[:-1] + self.w[-1]
        votes, worst = np.zeros((len(x), len(self.classes))), np.full((len(x), len(self.classes)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            m = margin[:, k]
            for c, s in ((i, m), (j, -m)):
                votes[:, c] += (s >= 0) + np.tanh(s) / (4 * len(self.classes))
                worst[:, c] = np.minimum(worst[:, c], s)
        best = votes.argmax(axis=1)
        return best, 1 / (1 + np.exp(-3 * worst[np.arange(len(x)), best]))


class Model:
    """Families, and the languages within each."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.families: Votes | None = None
        self.within: dict[str, Votes] = {}
        if not texts:
            return
        x = np.array([features(t) for t in texts])
        of = [family(c) for c in langs]
        self.families = Votes(x, of)
        for name in self.families.classes:
            own = [i for i, f in enumerate(of) if f == name]
            self.within[name] = Votes(x[own], [langs[i] for i in own])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if self.families is None or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        x = np.array([features(t) for t in texts])
        fam, sure = self.families.predict(x)
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for k, name in enumerate(self.families.classes):
            own = np.flatnonzero(fam == k)
            if len(own):
                best, more = self.within[name].predict(x[own])
                for i, b, s in zip(own.tolist(), best.tolist(), more.tolist(), strict=True):
                    langs[i], scores[i] = self.within[name].classes[b], float(min(max(sure[i] * s, 0.0), 1.0))
        return langs, scores


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """At most per_language (text, lang) of each label, chosen by a hash of the id; fewer where all labels would give over TRAIN_ROWS."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).where((crc_mod("id", 4) != 2) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each label
    if not counts:
        return []
    per_language = max(1, min(per_language, TRAIN_ROWS // len(counts)))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 40, math.ceil((1 << 40) * (1.5 * per_language + 20) / n)))])
    near = rows.where(place < rate[F.col("lang")]).select("lang", place.alias("h"), "id", F.left("t", F.lit(TRAIN_CHARS)).alias("t"))
    by = defaultdict(list)
    for r in sorted(near.collect(), key=lambda r: (r["lang"], r["h"], r["id"])):
        if has_letter(r["t"]) and len(by[r["lang"]]) < per_language:
            by[r["lang"]].append(r["t"])
    return [(t, lang) for lang, texts in by.items() for t in texts]


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """A row for each row of docs: id_col, held_out, lang_pred, score.

    held_out rows (crc32 of the id as text has remainder 2 by 4) are never learnt from; a null id isn't held out and isn't learnt from.
    lang_pred is UNKNOWN (score 0) if the text is null or has no letter, or if there is nothing to learn from; with one language learnt it is
    that one. Equal votes go to the larger sum of margins, then to the first label. Very long texts are read whole, a piece at a time.
    Repeated rows are alike; an empty table gives no rows; the label and other columns aren't inputs of a prediction.
    """
    rows = training_rows(docs, id_col, text_col, lang_col, per_language)
    model = docs.sparkSession.sparkContext.broadcast(Model([t for t, _ in rows], [c for _, c in rows]))  # BUCKETS weights for each pair of families, and of labels within one

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(2).to_pylist()
                able = [i for i, t in enumerate(texts) if has_letter(t)]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                for i, lang, s in zip(able, *model.value.predict([texts[i] for i in able]), strict=True):
                    langs[i], scores[i] = lang, s
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs), pa.array(scores)], names=[id_col, "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, least_score: float = LEAST_SCORE, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """docs without the rows whose text has no language that could be learnt; rows without a label get the predicted one.

    Rejected are texts that language_id() calls UNKNOWN (null, or no letter), and those of least_letters letters or more whose score is under
    least_score: a shorter text has too little evidence against it. Labels that rows have, other columns and repeated rows stay as
    they are. Where there is nothing to learn from, every text with a letter stays, its label null as it was.
    """
    rows = training_rows(docs, id_col, text_col, lang_col, per_language)
    model = docs.sparkSession.sparkContext.broadcast(Model([t for t, _ in rows], [c for _, c in rows]))

    @F.pandas_udf("string")
    def found(text: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(text)
        able = [i for i, t in enumerate(text) if has_letter(t)]
        for at in range(0, len(able), 512):
            part = able[at : at + 512]
            texts = [text.iloc[i] for i in part]
            for i, t, lang, score in zip(part, texts, *model.value.predict(texts), strict=True):
                if model.value.families is None or score >= least_score or sum(map(str.isalpha, t)) < least_letters:
                    out[i] = lang
        return pd.Series(out, dtype=object)

    name = free_name(docs, "_lang")
    once = found.asNondeterministic()  # so that the filter and the column share one evaluation
    kept = docs.withColumn(name, once(F.col(text_col))).where(F.col(name).isNotNull())
    kind = docs.schema[lang_col].dataType
    filled = F.coalesce(F.col(lang_col), F.nullif(F.col(name), F.lit(UNKNOWN)).cast(kind))
    return kept.select(*[filled.alias(lang_col) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
