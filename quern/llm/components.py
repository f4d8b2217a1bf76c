"""Connected components of an edge table, by alternating large and small stars.

Every round joins each vertex with the least vertex among its neighbours, first
for its larger neighbours, then for its smaller ones; the edges end as stars
around the least vertex of each component.  Edges stay as many as there were at
most, and each round is written to the shared folder.  More than ``rounds`` rounds
(their number goes by the logarithm of the vertices) are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) for every vertex u of ``edges`` (u, v) that isn't the least of its component itself."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't found after {rounds} rounds")
    return edges.select("u", F.col("v").alias("root"))
