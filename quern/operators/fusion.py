"""Fusion of ranked lists: reciprocal ranks, weighted scores, or first seen.

A ranked list is a row per (query_id, path_idx, path, kind, id, score, rank).
Lists are merged by a union and one aggregation by (query_id, id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import lexicon as L

_QUERY = "query_id"


def path(ranked: DataFrame, index: int, name: str, kind: str, item: str = "doc") -> DataFrame:
    return ranked.select("query_id", F.lit(index).alias("path_idx"), F.lit(name).alias("path"), F.lit(kind).alias("kind"), F.col(item).alias("id"), "score", "rank")


def union(paths: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, paths)


def min_max(c: Column, over: Window) -> Column:
    """To 0..1 within the window; 1 where all are equal."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(high - low < 1e-9, F.lit(1.0)).otherwise((c - low) / (high - low))


def _details() -> list[Column]:
    entry = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", value))))
    return [entry("score").alias("path_scores"), entry("rank").alias("path_ranks"), F.count_distinct("path").cast("long").alias("n_paths"), F.min(F.struct("path_idx", "rank")).alias("first_seen")]


def _ranked(fused: DataFrame) -> DataFrame:
    """Best first; ties go to what was seen first."""
    order = Window.partitionBy(_QUERY).orderBy(F.desc("fused_score"), "first_seen", "id")
    return fused.withColumn("fused_score", F.round("fused_score", 6)).withColumn("fused_rank", F.row_number().over(order)).drop("first_seen")


def reciprocal_rank(lists: DataFrame, k: int = L.RRF_K) -> DataFrame:
    return _ranked(lists.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fused_score"), *_details()))


def weighted(lists: DataFrame, weights: dict[str, float] = L.KIND_WEIGHTS) -> DataFrame:
    """Scores to 0..1 within each path, the best path of each kind, then the weighted sum over kinds."""
    own = lists.withColumn("value", min_max(F.col("score"), Window.partitionBy("query_id", "path_idx")))
    weight = F.coalesce(reduce(lambda acc, kv: acc.when(F.col("kind") == kv[0], F.lit(kv[1])), weights.items(), F.when(F.lit(False), F.lit(0.0))), F.lit(0.0))
    kinds = own.groupBy("query_id", "id", "kind").agg(F.max("value").alias("value")).groupBy("query_id", "id").agg(F.sum(weight * F.col("value")).alias("fused_score"))
    return _ranked(kinds.join(own.groupBy("query_id", "id").agg(*_details()), ["query_id", "id"]))


def first_seen(lists: DataFrame) -> DataFrame:
    """Every id once, in the order of paths and ranks; its score is 1 / position."""
    once = lists.groupBy("query_id", "id").agg(*_details())
    position = F.row_number().over(Window.partitionBy(_QUERY).orderBy("first_seen", "id"))
    return _ranked(once.withColumn("fused_score", F.lit(1.0) / position))


STRATEGIES = {"rrf": reciprocal_rank, "weighted": weighted, "simple": first_seen}


def materialize(fused: DataFrame, chunks: DataFrame, chunk_id: str = "id") -> DataFrame:
    """Text and metadata of the candidates; unknown ids go."""
    return fused.join(chunks, fused["id"] == chunks[chunk_id]).drop(chunks[chunk_id])
