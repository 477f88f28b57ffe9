"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Edges stay in tables. Hubs are split by a salt, so no task gets all edges of one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, group_value, stash


def _pairs(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Rows (u, v): for each row of df, its two columns of each pair."""
    return df.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in columns])).alias("x")).select("x.u", "x.v")


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds least: the smallest of u and its neighbours v."""
    return group_value(edges, ["u"], "v", F.min, F.min, "least").withColumn("least", F.least("least", "u"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Nodes are longs. Loops and repeated edges are allowed; an edge with a null end is ignored; no edges give no rows.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = _pairs(now, ("u", "v"), ("v", "u"))
        # the steps are written one by one: group_value() reads its input three times, so two in one plan would read it nine times
        large = stash(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct(), "stars")
        new = stash(_pairs(_with_least(large), ("v", "least"), ("u", "least")).where("u <> v").distinct(), "edges")
        forget(large)
        forget(now)
        now = new
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if sign == seen or not sign[0]:
            break
        seen = sign
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
