"""Reranking by relevance, recency and authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import lexicon as L
from quern.operators.fusion import min_max


def venue_authority(docs: DataFrame, venue: str = "journal", doc_id: str = "doc_id", top: list[str] = L.TOP_VENUES) -> DataFrame:
    """(venue, n_docs, authority): 0.4 + 0.6 * ln(1 + n) / ln(1 + largest n), 0.15 more for top venues, 1 at most."""
    own = docs.groupBy(doc_id).agg(F.min(venue).alias("venue")).groupBy("venue").agg(F.count("*").alias("n_docs"))
    largest = own.agg(F.max("n_docs").alias("largest"))
    bonus = F.when(F.lower(F.trim("venue")).isin(top), 0.15).otherwise(0.0)
    weight = F.round(F.least(F.lit(1.0), 0.4 + 0.6 * F.log1p("n_docs") / F.log1p("largest") + bonus), 4)
    return own.crossJoin(F.broadcast(largest)).select("venue", "n_docs", weight.alias("authority"))


def authority(venue: Column, known: Column, top: list[str] = L.TOP_VENUES) -> Column:
    """The known weight; 0.3 for a blank venue, 1 for an unseen top venue, 0.45 for any other."""
    return F.when(F.coalesce(F.trim(venue), F.lit("")) == "", F.lit(0.3)).when(known.isNotNull(), known).when(F.lower(F.trim(venue)).isin(top), F.lit(1.0)).otherwise(F.lit(0.45))


def recency(year: Column, low: int = L.YEAR_MIN, high: int = L.YEAR_MAX) -> Column:
    """0 to 1 over the years, 0.5 where there is none; ``year`` is an integer or null."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - low) / F.lit(float(high - low))))
    return F.when(year.isNull(), F.lit(0.5)).otherwise(share)


def rerank(candidates: DataFrame, top_n: int = 5, weights: dict[str, float] | None = None, normalize: bool = True, cut: int = 20, item: str = "id") -> DataFrame:
    """The best rows by the weighted criteria columns relevance, recency and authority.

    Candidates are cut to ``cut`` by fused_rank first; relevance goes to 0..1 within
    a query unless it has one row; unknown criteria are ignored, weights sum to 1.
    """
    weights = {k: v for k, v in (weights or L.CRITERIA).items() if k in L.CRITERIA}
    total = sum(weights.values()) or 1.0
    own = Window.partitionBy("query_id")
    rows = candidates.where(F.col("fused_rank") <= cut).withColumn("relevance_raw", F.col("relevance"))
    if normalize:
        rows = rows.withColumn("relevance", F.when(F.count("*").over(own) > 1, min_max(F.col("relevance_raw"), own)).otherwise(F.col("relevance_raw")))
    score = sum((F.col(k) * F.lit(v / total) for k, v in weights.items()), F.lit(0.0))
    rows = rows.withColumn("rerank_score", F.round(score, 6))
    return rows.withColumn("rerank_rank", F.row_number().over(own.orderBy(F.desc("rerank_score"), item))).where(F.col("rerank_rank") <= top_n)
