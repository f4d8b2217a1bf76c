"""Approximate vector search over an inverted file of cells; the exact search of ``vector`` stays the default.

Cells are those of spherical k-means, fitted on a bounded sample.  Every vector is
stored in the folder of its nearest centroid's cell, so a search reads the folders
of the cells that its queries probe, and compares a query with its own cells only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import vector
from quern.operators.bm25 import top_k
from quern.sources.shared import stored

#: Vectors of the sample for each cell, and parts of a cell that are written by tasks of their own.
SAMPLE, SALTS = 256, 16


def spherical_means(rows: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids; first ones are drawn far from each other, a cell that loses all its rows keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.integers(len(rows))][None]
    while len(centroids) < min(cells, len(rows)):
        away = np.clip(1 - (rows @ centroids.T).max(1), 0, None) + 1e-12
        centroids = np.vstack([centroids, rows[rng.choice(len(rows), p=away / away.sum())]])
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, vector._unit(sums), centroids)
    return centroids


@dataclass(frozen=True)
class CellIndex:
    """``vectors``: (vec_id, embedding, cell), partitioned by cell; ``sizes``: rows of each cell."""

    vectors: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int = 64, vector_id: str = "vec_id", embedding: str = "embedding", rounds: int = 12, seed: int = 1) -> CellIndex:
        """Fits the cells on the ``SAMPLE * cells`` vectors with the least hashes, and writes all vectors by cell; null and zero vectors go to cell 0."""
        own = vectors.select(F.col(vector_id).alias("vec_id"), F.col(embedding).alias("embedding"))
        some = own.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * cells).select("embedding").toArrow().column(0)
        width = max((len(x) for x in some), default=1)
        rows = vector._unit(vector._matrix(some, width)) if len(some) else np.zeros((1, width))
        centroids = spherical_means(rows[np.linalg.norm(rows, axis=1) > 0] if rows.any() else np.eye(1, width), cells, rounds, seed)
        sent = own.sparkSession.sparkContext.broadcast(centroids)
        schema = own.schema.simpleString()[7:-1] + ",cell:int"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                scores = vector._unit(vector._matrix(part.column(1), sent.value.shape[1])) @ sent.value.T
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores.argmax(1).astype(np.int32))], names=["vec_id", "embedding", "cell"])

        dealt = own.mapInArrow(run, ", ".join(x.replace(":", " ", 1) for x in schema.split(",")))
        dealt.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        own.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        own.where("false").write.mode("overwrite").parquet(f"{path}/schema")
        return CellIndex.load(own.sparkSession, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        schema = spark.read.parquet(f"{path}/schema").schema.add("cell", "integer")
        vectors, sizes = spark.read.schema(schema).parquet(f"{path}/cells"), np.zeros(len(rows), np.int64)
        for r in vectors.groupBy("cell").count().collect():  # a row a cell
            sizes[r.cell] = r["count"]
        return CellIndex(vectors, np.array([r.centroid for r in rows]), sizes)

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` cells with the nearest centroids of each query."""
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, :probes]

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
        """(query_id, doc, score, rank) over the probed cells; with as many probes as cells it is the exact search.  Ids are numbers."""
        spark = queries.sparkSession
        blocks = max(1, -(-queries.count() // vector.BLOCK))
        schema = pa.schema([("query_id", pa.int64()), ("doc", pa.int64()), ("score", pa.float64())])
        out = None
        for block in range(blocks):
            own = queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block).select(F.col(query_id).cast("long"), embedding).toArrow()
            ids, wanted = own.column(0).to_numpy(), vector._unit(vector._matrix(own.column(1), self.centroids.shape[1]))
            cells = self.probed(wanted, probes)
            asking = {int(c): np.flatnonzero((cells == c).any(1)) for c in np.unique(cells)}
            sent = spark.sparkContext.broadcast((ids, wanted, asking))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, wanted, asking = sent.value
                best_ids, best = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)
                for whole in batches:
                    for start in range(0, whole.num_rows, 4096):
                        part = whole.slice(start, 4096)
                        found, cell = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                        rows = vector._unit(vector._matrix(part.column(1), wanted.shape[1]))
                        for c in np.unique(cell):
                            q, own = asking[int(c)], np.flatnonzero(cell == c)
                            scores = vector.rounded(wanted[q] @ rows[own].T)
                            row, doc, score = vector._best(np.hstack([best[q], scores]), np.hstack([best_ids[q], np.broadcast_to(found[own], scores.shape)]), k)
                            place = np.arange(len(row)) - np.searchsorted(row, row)
                            best[q] = -np.inf
                            best_ids[q[row], place], best[q[row], place] = doc, score
                row, column = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best_ids[row, column]), pa.array(best[row, column])], schema=schema)

            read = self.vectors.where(F.col("cell").isin(list(asking))).select(F.col("vec_id").cast("long"), "embedding", "cell")
            part = read.mapInArrow(run, "query_id long, doc long, score double")
            if blocks > 1:
                part = stored(part, "nearest")
                sent.destroy()
            out = part if out is None else out.unionByName(part)
        return top_k(out, k)

    def read_share(self, queries: np.ndarray, probes: int) -> float:
        """The mean share of all vectors that a query is compared with."""
        return float(self.sizes[self.probed(vector._unit(queries), probes)].sum(1).mean() / max(1, self.sizes.sum())) if len(queries) else 0.0


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact search's rows that were found."""
    hit = exact.select("query_id", "doc").join(found.select("query_id", "doc", F.lit(1).alias("hit")), ["query_id", "doc"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
