"""Personal data in texts, with DataFrame functions only.

A regular expression proposes spans of each kind, a validator confirms them (digit counts, octets, Luhn, mod-97), and words in
the text before a span adjust its score. Base kinds (email, ip, card, phone) are kept whatever their score; added kinds
(iban, ssn, secret) need LEAST_SCORE. Patterns use possessive quantifiers and start only where a run starts, so that a very long
run of matching characters takes linear time and no recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SCORE = 0.5
#: Code points before a span in which context words count.
WINDOW = 48
CONTEXT_GAIN = 0.25


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1 (letters are 10 to 35)."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _octets(m: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, "\\."), small)


class Kind(NamedTuple):
    name: str
    pattern: str
    #: A cheap test that a text with a match always passes.
    maybe: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    words: str
    mask: str


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.75, "mail|contact|write", "[EMAIL]"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), _octets, 0.6, "ip|host|server|address", "[IP]"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12,}+", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"), lambda m: (F.length(_digits(m)) <= 19) & luhn(_digits(m)), 0.7, "card|visa|credit|debit|master|amex|karte|tarjeta|carte", "[CARD]"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|call|tel|mobile|fax|cell", "[PHONE]"),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), lambda m: F.length(F.replace(m, F.lit(" "))).between(15, 34) & mod97(F.replace(m, F.lit(" "))), 0.7, "iban|account|bank|konto|cuenta|compte", "[IBAN]"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), lambda m: F.lit(True), 0.3, "ssn|social security|taxpayer", "[SSN]"),
    Kind("secret", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=[=:\x22' ])(?<=(?:password|passwd|secret|token|api_key|apikey)[\x22']?[ ]{0,2}[=:][ ]{0,2}[\x22']?)[A-Za-z0-9+/_-]{12,}+", lambda t: t.rlike(r"AKIA|(?:password|passwd|secret|token|api_key|apikey)[\x22']? {0,2}[=:]"), lambda m: F.lit(True), 0.6, "key|secret|password|token|aws", "[SECRET]"),
)

#: Of the columns that redact() adds for a while.
_PREFIX = "_tidemark_spans_"
_FOUND = "array<struct<s:int,e:int,m:string,before:string>>"
#: Spans that are taken together: an array grows by copying, so one of all spans would take quadratic time.
BLOCK = 128


def _blocks(spans: Column) -> Column:
    """An array cut into arrays of BLOCK elements."""
    count = F.ceil(F.size(spans) / BLOCK).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often a function inside needs it."""
    return F.transform(F.array(value), use)[0]


def _proposed(text: Column, kind: Kind) -> Column:
    """Array of (s, e, m, before): the kind's matches by code points, with the WINDOW code points before; the text is only searched if it may have one."""
    gaps, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.from_json(F.lit("[]"), _FOUND)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        before = F.right(F.concat(acc["tail"], x["gap"]), F.lit(WINDOW))
        span = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), before.alias("before"))
        return F.struct(e.alias("at"), F.right(F.concat(before, x["m"]), F.lit(WINDOW)).alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))

    def offsets(blocks: Column) -> Column:
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def tails(blocks: Column) -> Column:
        """What stands before each block; a block is longer than WINDOW, but for the last one."""
        return F.concat(F.array(F.lit("")), F.transform(blocks, lambda b: b["tail"]))

    def placed(blocks: Column) -> Column:
        def one(b: Column, i: Column, at: Column, tail: Column) -> Column:
            shift, ahead = F.get(at, i), F.get(tail, i)
            return F.transform(b["out"], lambda x: F.struct((x["s"] + shift).alias("s"), (x["e"] + shift).alias("e"), x["m"].alias("m"), F.right(F.concat(ahead, x["before"]), F.lit(WINDOW)).alias("before")))

        return _once(offsets(blocks), lambda at: _once(tails(blocks), lambda tail: F.flatten(F.transform(blocks, lambda b, i: one(b, i, at, tail)))))

    def whole(pairs: Column) -> Column:
        return _once(F.transform(_blocks(pairs), lambda b: F.aggregate(b, start, step)), placed)

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("m"))
    return F.when(kind.maybe(text), F.coalesce(_once(pairs, whole), none)).otherwise(none)


def _scored(kind: Kind, name: Column) -> Column:
    """The confirmed spans of column name, each with its score."""

    def score(x: Column) -> Column:
        gain = F.when(F.lower(x["before"]).rlike(rf"\b(?:{kind.words})"), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.least(F.lit(kind.score) + gain, F.lit(1.0)).alias("score"))

    kept = F.transform(F.filter(name, lambda x: kind.valid(x["m"])), score)
    return kept if kind in BASE else F.filter(kept, lambda x: x["score"] >= LEAST_SCORE)


def _with_spans(docs: DataFrame, text: str, kinds: tuple[Kind, ...] = BASE + ADDED, prefix: str = "_") -> DataFrame:
    """Adds a column of scored spans for each kind, named prefix and kind; a null text has none."""
    out = docs
    for k in kinds:
        out = out.withColumn(f"{prefix}{k.name}", _proposed(F.col(text), k))
    for k in kinds:
        out = out.withColumn(f"{prefix}{k.name}", _scored(k, F.col(f"{prefix}{k.name}")))
    return out


def _listed(kinds: tuple[Kind, ...]) -> Column:
    def said(k: Kind) -> Column:
        return F.transform(F.col(f"_{k.name}"), lambda x: F.concat_ws(":", F.lit(k.name), x["s"].cast("string"), x["e"].cast("string")))

    return F.array_join(F.concat(*[said(k) for k in kinds]), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score.

    Spans are kind:start:end by code points, end exclusive, by kind as listed and then by start, comma-joined; base_sha256 is over those
    of the base kinds. max_score is the highest span's, null without spans. A null text is as an empty one. Null and repeated ids are
    kept as they are; an empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = _with_spans(own, "_text")
    scores = F.concat(*[F.transform(F.col(f"_{k.name}"), lambda x: x["score"]) for k in BASE + ADDED])
    counts = [F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE]
    return found.select(F.col("_id").alias(id_col), *counts, F.sha2(_listed(BASE), 256).alias("base_sha256"), _listed(BASE + ADDED).alias("spans"), F.array_max(scores).alias("max_score"))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = BASE + ADDED) -> DataFrame:
    """docs with the spans that personal_data() reports for kinds masked in text_col; every row and column stays, a null text stays null.

    Spans that overlap get one mask, that of the span that starts first (of several, of the kind listed first), over all they cover.
    """
    found = _with_spans(docs, text_col, kinds, _PREFIX)
    text, spans = F.col(text_col), F.col(f"{_PREFIX}all")

    def marked(i: int, k: Kind) -> Column:
        return F.transform(F.col(f"{_PREFIX}{k.name}"), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("kind"), x["e"].alias("e"), F.lit(k.mask).alias("mask")))

    def pieces(whole: Column, b: Column, i: Column, ends: Column) -> Column:
        """The text from the end of the spans before a block to the end of its own, masked. A block's part of the text is cut out once."""
        begin = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        part = F.substr(whole, begin + 1, F.greatest(F.get(ends, i) - begin, F.lit(0)))

        def said(region: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                fresh = F.array(F.substr(region, acc["at"] - begin + 1, x["s"] - acc["at"]), x["mask"])
                return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))

            return F.aggregate(b, F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.array_join(acc["out"], ""))

        return _once(part, said)

    def reach(blocks: Column) -> Column:
        """For each block the largest end of it and those before it."""
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, b: F.struct(F.greatest(acc["at"], F.array_max(F.transform(b, lambda x: x["e"]))).alias("at"), F.concat(acc["out"], F.array(F.greatest(acc["at"], F.array_max(F.transform(b, lambda x: x["e"]))))).alias("out")), lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        return _once(reach(blocks), lambda ends: F.concat(F.array_join(F.transform(blocks, lambda b, i: pieces(text, b, i, ends)), ""), F.substr(text, F.element_at(ends, -1) + 1)))

    found = found.withColumn(f"{_PREFIX}all", F.array_sort(F.concat(*[marked(i, k) for i, k in enumerate(kinds)])))
    masked = _once(_blocks(spans), joined)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).select(*docs.columns)
