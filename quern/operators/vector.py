"""Exact vector search by cosine, and checks of a vector table.

Queries are taken in blocks of bounded size.  A block goes to all tasks, each of
which multiplies it with its rows and sends the k best per query on; so what is
shuffled is k rows for each query and task, whatever the number of vectors.  Of
several blocks one is held at a time: its results are written before the next.

A query may ask for tags: its ``where`` is a list of lists, of each of which a
vector's ``tags`` must have one, so a batch with many filters is one search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.bm25 import top_k
from quern.sources.shared import stored

#: Queries that are sent to the tasks at once.
BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; what is null or of another width is zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    if len(flat) == len(column):
        return flat
    out = np.zeros((len(column), width))
    out[fits.to_numpy(zero_copy_only=False)] = flat
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _allowed(where: list | None, tags: list[list | None]) -> np.ndarray:
    """Which rows have a tag of every list."""
    wanted = [set(x) for x in where or ()]
    return np.array([all(not own.isdisjoint(x) for x in wanted) for own in (set(t or ()) for t in tags)], bool)


def rounded(scores: np.ndarray, digits: int = 6) -> np.ndarray:
    """Halves go away from zero, as in Spark's and SQL's round; numpy's own go to the even neighbour, and cosines of short texts are often such halves."""
    scaled = scores * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 10.0**digits


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k largest finite scores of each row, ties by the least id."""
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero((scores >= least) & np.isfinite(scores))
    else:
        row, column = np.nonzero(np.isfinite(scores))
    own, found = scores[row, column], ids[row, column]
    order = np.lexsort((found, -own, row))
    row, found, own = row[order], found[order], own[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], found[place < k], own[place < k]


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 20, query_id: str = "query_id", vector_id: str = "vec_id", embedding: str = "embedding", keep_self: bool = True, where: str | None = None, tags: str | None = None) -> DataFrame:
    """(query_id, doc, score, rank): the k nearest vectors of each query; null and zero vectors score 0.

    ``vectors`` may be filtered before, or by ``tags`` for each query; ``keep_self`` decides whether a vector finds itself.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))
    number = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    schema = pa.schema([("query_id", pa.int64()), ("doc", pa.int64()), ("score", pa.float64())])
    asked = F.col(where) if where else F.lit(None).cast("array<array<string>>")
    own_tags = F.col(tags) if tags else F.lit(None).cast("array<string>")
    out = None
    for block in range(blocks):
        own = queries.where(number == block).select(F.col(query_id).cast("long"), embedding, asked.alias("where")).toArrow()
        ids, width = own.column(0).to_numpy(), pc.max(pc.list_value_length(own.column(1))).as_py() or 1
        filters: dict[str, tuple[list, list[int]]] = {}
        for i, x in enumerate(own.column(2).to_pylist()):
            if x:
                filters.setdefault(repr(x), (x, []))[1].append(i)
        sent = spark.sparkContext.broadcast((ids, _unit(_matrix(own.column(1), width)), list(filters.values())))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, wanted, filters = sent.value
            best_ids, best = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)
            for whole in batches:
                for start in range(0, whole.num_rows if len(ids) else 0, 4096):
                    part = whole.slice(start, 4096)
                    found = part.column(0).to_numpy(zero_copy_only=False)
                    scores = rounded(wanted @ _unit(_matrix(part.column(1), wanted.shape[1])).T)
                    if not keep_self:
                        scores[ids[:, None] == found] = -np.inf
                    for x, rows in filters:
                        scores[np.ix_(rows, np.flatnonzero(~_allowed(x, part.column(2).to_pylist())))] = -np.inf
                    row, doc, score = _best(np.hstack([best, scores]), np.hstack([best_ids, np.broadcast_to(found, scores.shape)]), k)
                    best_ids, best = np.zeros_like(best_ids), np.full_like(best, -np.inf)
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    best_ids[row, place], best[row, place] = doc, score
            row, column = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best_ids[row, column]), pa.array(best[row, column])], schema=schema)

        part = vectors.select(F.col(vector_id).cast("long"), embedding, own_tags.alias("tags")).mapInArrow(run, "query_id long, doc long, score double")
        if blocks > 1:
            part = stored(part, "nearest")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return top_k(out, k)


#: Steps of a quantised value to either side of zero.
STEPS = 127


def quantised(embedding: Column) -> Column:
    """(values, step): a vector as bytes, its largest value being 127 steps; a null or zero vector has step 0 and keeps its size."""
    most = lambda v: F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    step = lambda v: T.bound(F.coalesce(most(v), F.lit(0.0)) / STEPS, lambda s: F.struct(F.transform(v, lambda x: F.when(s > 0, F.round(x.cast("double") / s)).otherwise(0.0).cast("byte")).alias("values"), s.alias("step")))
    return T.bound(embedding, step)


def integer_cosine(a: Column, b: Column) -> Column:
    """The cosine of two quantised vectors: dot products are of whole numbers, and their steps cancel."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("int") * q.cast("int")), F.lit(0), lambda s, z: s + z)
    return product(a["values"], b["values"]) / F.nullif(F.sqrt(product(a["values"], a["values"]).cast("double") * product(b["values"], b["values"])), F.lit(0.0))


def quantisation_report(queries: DataFrame, vectors: DataFrame, fetched: int = 20, k: int = 5, vector_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per query how far scores of its ``fetched`` nearest shift with bytes, and how many of the best ``k`` stay among the best ``k``."""
    near = vector_search(queries, vectors, fetched, vector_id=vector_id, embedding=embedding)
    own = near.join(queries.select("query_id", quantised(F.col(embedding)).alias("a")), "query_id").join(vectors.select(F.col(vector_id).alias("doc"), quantised(F.col(embedding)).alias("b")), "doc")
    scored = own.select("query_id", "doc", "score", "rank", F.round(integer_cosine(F.col("a"), F.col("b")), 6).alias("bytes"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bytes"), "doc"))
    told = scored.withColumn("again", again)
    return told.groupBy("query_id").agg(F.round(F.max(F.abs(F.col("score") - F.col("bytes"))), 6).alias("largest_shift"), F.count_if((F.col("rank") <= k) & (F.col("again") <= k)).alias("kept"))


def self_check(vectors: DataFrame, every: int = 100, vector_id: str = "vec_id", group: str = "label", embedding: str = "embedding") -> DataFrame:
    """For every ``every``-th vector whether it finds itself, another of its group, or another group's first."""
    queries = vectors.where(F.col(vector_id) % every == 0)
    found = vector_search(queries.withColumnRenamed(vector_id, "query_id"), vectors, 1, vector_id=vector_id, embedding=embedding)
    groups = vectors.select(F.col(vector_id).alias("doc"), F.col(group).alias("found_group"))
    own = vectors.select(F.col(vector_id).alias("query_id"), F.col(group).alias("own_group"))
    verdict = F.when(F.col("query_id") == F.col("doc"), "exact").when(F.col("own_group") == F.col("found_group"), "same_group").otherwise("cross_group")
    return found.join(groups, "doc").join(own, "query_id").select("query_id", "doc", "score", verdict.alias("verdict"))


def vector_stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows, zero vectors, dimensions and norms."""
    n = norm(F.col(embedding))
    return vectors.agg(F.count("*").alias("n"), F.count_if(n == 0).alias("zero_vectors"), F.min(F.size(embedding)).alias("min_dim"), F.max(F.size(embedding)).alias("max_dim"), F.round(F.min(n), 4).alias("min_norm"), F.round(F.max(n), 4).alias("max_norm"))


def build_store(vectors: DataFrame, path: str, model: str, batch: str, vector_id: str = "vec_id", reset: bool = False) -> DataFrame:
    """Adds a batch of vectors to the store at ``path`` and returns what it holds: a folder for each model and batch.

    A batch that is there already is written anew, vectors of other models stay apart, and ``reset`` empties the model's folder first.
    """
    spark = vectors.sparkSession
    if reset:
        vectors.where("false").write.mode("overwrite").parquet(f"{path}/model={model}")
    vectors.write.mode("overwrite").parquet(f"{path}/model={model}/batch={batch}")
    return read_store(spark, path, model)


def read_store(spark, path: str, model: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/model={model}").parquet(f"{path}/model={model}/batch=*")
