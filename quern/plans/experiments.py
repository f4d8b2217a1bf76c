"""Comparisons of settings: means, differences, wins, and readiness of an environment."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.profile import positions
from quern.sources.shared import stored


def compare(results: DataFrame, setting: str = "setting", query_id: str = "query_id", score: str = "score") -> DataFrame:
    """Per setting the mean score, its difference from the best mean, and the queries that it wins (ties go to the first by name)."""
    best = results.groupBy(query_id).agg(F.min_by(setting, F.struct(-F.col(score), F.col(setting))).alias(setting))
    wins = best.groupBy(setting).agg(F.count("*").alias("wins"))
    means = results.groupBy(setting).agg(F.round(F.avg(score), 6).alias("mean_score"), F.count_distinct(query_id).alias("n_queries"))
    top = means.agg(F.max("mean_score").alias("top"))
    return means.join(wins, setting, "left").crossJoin(F.broadcast(top)).select(setting, "n_queries", "mean_score", F.round(F.col("mean_score") - F.col("top"), 6).alias("delta"), F.coalesce("wins", F.lit(0)).alias("wins"))


def compliance(results: DataFrame, ok, by: str = "query_id") -> DataFrame:
    """The share of each query's rows that satisfy a condition."""
    return results.groupBy(by).agg(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("compliance"))


def systematic_sample(df: DataFrame, key: str, samples: int) -> DataFrame:
    """Every (n // samples)-th row by the order of a key, ``samples`` at most."""
    own = positions(df, key).withColumn("__step", F.greatest(F.lit(1), F.expr(f"total div {samples}")))
    return own.where(f"pos % __step = 0 and pos < __step * {samples}").drop("__step", "pos", "total")


def similar_pairs(rows: DataFrame, by: str, item: str, text: str = "text", threshold: float = 0.0) -> DataFrame:
    """(by, a, b, similarity): all unordered pairs within a group of bounded size, such as a document's chunks or a list of
    candidates, by the Jaccard similarity of their character 4-grams, from ``threshold`` on."""
    own = rows.select(by, F.col(item).alias("item"), F.transform(T.char_shingles(F.col(text)), lambda x: F.xxhash64(x)).alias("set"))
    first, second = (own.select(by, F.col("item").alias(x), F.col("set").alias(f"set_{x}")) for x in ("a", "b"))
    pairs = first.join(second, by).where("a < b")
    return pairs.select(by, "a", "b", F.round(T.jaccard(F.col("set_a"), F.col("set_b")), 6).alias("similarity")).where(F.col("similarity") >= threshold)


def grid(queries: DataFrame, settings: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The results of every setting for all queries, with the column setting; what they start from is made once."""
    queries = stored(queries, "grid")
    parts = [run(queries).withColumn("setting", F.lit(name)) for name, run in settings.items()]
    return reduce(DataFrame.unionByName, parts)


def latencies(function: Callable[[object], object], items: list, clock: Callable[[], float] = time.perf_counter) -> dict[str, float]:
    """Seconds of each call: their number, mean, median, 95th percentile and largest."""
    seconds = []
    for x in items:
        start = clock()
        function(x)
        seconds.append(clock() - start)
    ordered = sorted(seconds)
    at = lambda q: ordered[min(len(ordered) - 1, int(q * len(ordered)))] if ordered else 0.0
    return {"n": len(seconds), "mean": sum(seconds) / max(1, len(seconds)), "p50": at(0.5), "p95": at(0.95), "max": ordered[-1] if ordered else 0.0}


def readiness(checks: dict[str, Callable[[], object]]) -> list[tuple[str, bool, str]]:
    """(name, ok, detail) of each check; a check that raises is not ok, and the others still run."""
    out = []
    for name, check in checks.items():
        try:
            out.append((name, True, str(check())))
        except Exception as e:  # a failing check is a result
            out.append((name, False, f"{type(e).__name__}: {e}"))
    return out


def default_checks(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    """Libraries, a Spark job, a table, and the default models."""
    from quern.operators import models

    def libraries():
        import numpy
        import pandas
        import pyarrow

        return numpy.__version__, pandas.__version__, pyarrow.__version__

    return {
        "libraries": libraries,
        "spark": lambda: spark.range(10).count(),
        "documents": lambda: spark.read.parquet(f"{sf_dir}/documents.parquet").limit(1).count(),
        "embedder": lambda: models.hashing_embedder()(["a"]).shape,
        "generator": lambda: models.echo_generator("x"),
    }
