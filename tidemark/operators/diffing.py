"""Differences between two snapshots: digest sets, entries, and what a range of bytes touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symmetric_difference(a: DataFrame, b: DataFrame, key: str = "digest") -> DataFrame:
    """Keys on one side only, with the side: one aggregation, no join."""
    sides = a.select(key, F.lit(1).alias("_side")).unionByName(b.select(key, F.lit(2).alias("_side")))
    return sides.groupBy(key).agg(F.bit_or("_side").alias("_sides")).where("_sides < 3").select(key, F.when(F.col("_sides") == 1, "a").otherwise("b").alias("side"))


def changed(properties: list[str], prefix_a: str, prefix_b: str) -> Column:
    """Whether any property differs; null equals null."""
    out = F.lit(False)
    for p in properties:
        out = out | ~F.col(prefix_a + p).eqNullSafe(F.col(prefix_b + p))
    return out


def compare(a: DataFrame, b: DataFrame, keys: list[str], properties: list[str], content: str | None = None, mtime: str | None = None) -> DataFrame:
    """Full outer comparison by keys: state is added, deleted, modified or same.

    Without content only properties count (a size change alone isn't one of them unless listed). With content, rows of equal content of which only
    mtime differs are the same.
    """
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys], F.lit(True).alias("_b"))
    differs = changed([p for p in properties if p != mtime or content is None], "a_", "b_")
    if content:
        differs = differs | ~F.col(f"a_{content}").eqNullSafe(F.col(f"b_{content}"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(differs, "modified").otherwise("same")
    return left.join(right, keys, "full_outer").withColumn("state", state).drop("_a", "_b")
