"""The registered queries of the corpus operators, each over its whole table, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from .ann import embedding_components
from .common import fresh_path, prepare
from .decontam import contamination
from .langid import language_id
from .licenses import license_scan
from .packing import pack_documents
from .pii import personal_data
from .ppm import ppm_scores
from .simhash import simhash_components
from .tokens import token_counts
from .warc import read_warc, write_warc

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and the components of links of 4 bits or fewer."""
    return simhash_components(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), capacity=4096, end_id=1)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document, within a budget of edits."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of every document, and the word baseline."""
    return ppm_scores(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back from them."""
    base = fresh_path(spark, "warc")
    found = read_warc(write_warc(_table(spark, sf_dir, "pages"), base), base, payloads=False)
    return found.select(found["id"].alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=2048)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal labels linked at cosine 0.98 or more."""
    return embedding_components(_table(spark, sf_dir, "embeddings"), least=0.98)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return personal_data(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {f.__name__: f for f in (op1_simhash, op2_licenses, op3_packing, op4_decontamination, op5_ppm, op6_warc, op7_token_counts, op8_embeddings, op9_language_id, op10_personal_data)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name, for the queries that SQL can express."""
    return {"op6_warc": OP6_SQL}
