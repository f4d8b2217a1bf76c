"""From queries to candidates, results and answers.

Everything is keyed by query_id, so a batch of queries is one plan and a single
query is a batch of one.  Chunks are a table with chunk_id, text, doc_id,
journal, pub_year, lang and is_table; ids are numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import lexicon as L
from quern.functions import text as T
from quern.operators import bm25, context, filters, fusion, generate, models, query, rerank, vector
from quern.sources.shared import shared_folder


@dataclass(frozen=True)
class Retriever:
    """A chunk table with its index and vectors (chunk_id, embedding)."""

    chunks: DataFrame
    index: bm25.Index
    vectors: DataFrame
    embedder: Callable[[], models.Embedder] = models.hashing_embedder
    scorer: models.Scorer = models.overlap_scorer

    @staticmethod
    def build(chunks: DataFrame, path: str | None = None, embedder: Callable[[], models.Embedder] = models.hashing_embedder, scorer: models.Scorer = models.overlap_scorer) -> Retriever:
        """Index and vectors are written under ``path``, a folder of the application's own without one, and searched from there."""
        path = path or f"{shared_folder(chunks.sparkSession)}/retriever-{uuid.uuid4().hex}"
        return Retriever(chunks, bm25.saved_index(chunks, f"{path}/index", doc_id="chunk_id"), Retriever.embedded(chunks, f"{path}/vectors", embedder), embedder, scorer)

    @staticmethod
    def embedded(chunks: DataFrame, path: str, embedder: Callable[[], models.Embedder] = models.hashing_embedder) -> DataFrame:
        """The chunks' vectors, written once."""
        vectors = models.embed(chunks.select("chunk_id", "text"), embedder).select("chunk_id", "embedding")
        return vector.build_store(vectors, path, "embedder", "all", vector_id="chunk_id").select("chunk_id", "embedding")

    @staticmethod
    def _wanted() -> Column:
        """What an enhanced query asks of a chunk's tags: one of every list."""
        tagged = lambda name, values: F.transform(values, lambda x: F.concat(F.lit(f"{name}="), x))
        lists = F.array(
            F.when(F.size("years") > 0, tagged("pub_year", F.col("years"))), F.when(F.col("is_table"), F.array(F.lit("is_table=true"))), F.when(F.col("filter_lang").isNotNull(), tagged("lang", F.array("filter_lang"))),
        )
        return F.array_compact(lists)

    def retrieve(self, queries: DataFrame, k_vector: int = 20, k_keyword: int = 20, strategy: str = "rrf", where: dict | None = None, lexicon: query.Lexicon | None = None, as_of_year: int = L.YEAR_MAX) -> DataFrame:
        """Fused candidates of (query_id, text): a vector path for each variant of a query and one keyword path, both filtered before ranking.

        ``where`` filters the chunks of all queries; without it each query has the filters that its text asks for.
        All queries, variants and filters are one vector search and one keyword search.
        """
        enhanced = query.enhance(queries, lexicon, as_of_year).withColumn("where", self._wanted() if where is None else F.array().cast("array<array<string>>"))
        tags = F.array(*(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("pub_year", "is_table", "lang")))
        chunks = self.chunks.where(filters.predicate(where)) if where else self.chunks
        tagged = chunks.select("chunk_id", tags.alias("tags"))
        variants = enhanced.select("query_id", "where", F.posexplode("variants").alias("n", "text")).withColumn("key", F.col("query_id") * 4 + F.col("n"))
        near = vector.vector_search(models.embed(variants, self.embedder), self.vectors.join(tagged, "chunk_id"), k_vector, query_id="key", vector_id="chunk_id", where="where", tags="tags")
        n = F.pmod("query_id", F.lit(4)).cast("int")
        paths = [fusion.path(near.where(n == i).withColumn("query_id", F.floor(F.col("query_id") / 4)), i, f"vector_{i}", "vector") for i in range(3)]
        # a query that names nothing of the lexicon is searched by its own words
        words = F.coalesce(F.nullif("keyword_query", F.lit("")), F.col("cleaned"))
        scored = bm25.scores(self.index, enhanced.select("query_id", words.alias("text")), allowed=tagged.select(F.col("chunk_id").alias("doc")) if where else None)
        asked = scored.join(enhanced.where(F.size("where") > 0).select("query_id", "where"), "query_id").join(tagged.withColumnRenamed("chunk_id", "doc"), "doc")
        kept = asked.where(F.forall("where", lambda x: F.arrays_overlap(x, F.col("tags")))).select("query_id", "doc", "score")
        free = scored.join(enhanced.where(F.size("where") == 0).select("query_id"), "query_id", "left_semi").select("query_id", "doc", "score")
        paths.append(fusion.path(bm25.top_k(kept.unionByName(free), k_keyword), 3, "bm25", "keyword"))
        return fusion.materialize(fusion.STRATEGIES[strategy](fusion.union(paths)), self.chunks.withColumn("__id", F.col("chunk_id")), "__id")

    def search(self, queries: DataFrame, top_n: int = 5, weights: dict[str, float] | None = None, reranked: bool = True, snippet: int = 400, **options) -> DataFrame:
        """The best chunks of each query, by criteria where ``reranked``, with a snippet; the full text stays."""
        found = self.retrieve(queries, **options)
        if not reranked:
            out = found.where(F.col("fused_rank") <= top_n).withColumn("score", F.col("fused_score"))
        else:
            cut = found.where(F.col("fused_rank") <= 20).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
            known = rerank.venue_authority(self.chunks).select(F.col("venue").alias("journal"), F.col("authority").alias("known"))
            rows = cut.join(known, "journal", "left").withColumn("authority", rerank.authority(F.col("journal"), F.col("known")))
            rows = rows.withColumn("recency", rerank.recency(F.expr("try_cast(pub_year as int)")))
            rows = rows.withColumn("relevance", models.relevance(rows, self.scorer))
            out = rerank.rerank(rows, top_n, weights).withColumn("score", F.col("rerank_score")).drop("known", "query")
        return out.withColumn("snippet", F.substr(T.text_of("text"), F.lit(1), F.lit(snippet)))

    def answer(self, queries: DataFrame, top_n: int = 12, budget: int = L.MAX_TOKENS, make: Callable[[], models.Generator] = lambda: models.echo_generator, evaluate: bool = True, review: bool = True, **options) -> DataFrame:
        """An answer for every query; one without context has an empty answer and a warning."""
        found = self.search(queries, top_n, **options)
        rows = found.withColumn("source", F.col("doc_id").cast("string")).drop("score", "relevance")
        built = context.assemble(rows, budget)
        asked = queries.select("query_id", F.col("text").alias("question")).join(built, "query_id", "left").withColumn("context_text", F.coalesce("context_text", F.lit("")))
        return generate.answer(asked, make, evaluate, review)
