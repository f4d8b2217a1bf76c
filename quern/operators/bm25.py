"""Inverted index and BM25 ranking.

The index is three tables: postings (term, doc, len, tf), terms (term, df, idf)
and docs (doc, len).  A posting carries its document's length, so scoring joins
only the few terms of the queries with the postings; statistics are those of the whole corpus also where candidates are filtered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import lexicon as L
from quern.functions.text import tokens
from quern.sources.shared import bucketed, read_bucketed, stored


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    n_docs: int
    average_length: float

    def save(self, path: str) -> None:
        """Postings and terms are sorted by term, so a query's terms reach few row groups; the size is a table of one row."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        for name in ("postings", "terms"):
            getattr(self, name).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/{name}")
        self.docs.sparkSession.createDataFrame([(self.n_docs, self.average_length)], "n_docs long, average_length double").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/docs"), *spark.read.parquet(f"{path}/size").first())


def _size(docs: DataFrame) -> tuple[int, float]:
    row = docs.agg(F.count("*").alias("n"), F.avg("len").alias("a")).first()
    return row.n, row.a or 0.0


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", stop_words: list[str] = L.STOP_WORDS, partitions: int | None = None) -> Index:
    """Postings by one pre-aggregating shuffle; documents without tokens count with length 0.

    ``partitions`` spreads the documents first, for a table in few files.
    """
    documents = documents.select(doc_id, text)
    documents = documents.repartition(partitions, doc_id) if partitions else documents
    own = documents.select(F.col(doc_id).alias("doc"), tokens(F.col(text), stop_words).alias("tokens"))
    docs = own.select("doc", F.size("tokens").cast("long").alias("len"))
    postings = own.select("doc", F.size("tokens").cast("long").alias("len"), F.explode("tokens").alias("term")).groupBy("term", "doc", "len").agg(F.count("*").alias("tf"))
    return _index(postings, docs)


def _index(postings: DataFrame, docs: DataFrame) -> Index:
    n, average = _size(docs)
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", inverse_frequency(F.col("df"), F.lit(n)))
    return Index(postings, terms, docs, n, average)


def saved_index(documents: DataFrame, path: str, **options) -> Index:
    """The index, built in one pass over the texts and written to ``path``: terms and sizes come from the written postings and lengths.

    Postings are a table bucketed by document, so neither building it nor adding up a document's score shuffles them.
    """
    spark = documents.sparkSession
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    partitions = options.get("partitions") or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).repartition(partitions, "doc")
    found = tokens(F.col("text"), options.get("stop_words", L.STOP_WORDS))
    # a document's row with no term is its length
    rows = own.select("doc", found.alias("tokens")).select("doc", F.size("tokens").cast("long").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("term"))
    every = bucketed(rows.groupBy("term", "doc", "len").agg(F.count("*").alias("tf")), f"{path}/all", partitions, "doc", ["term"])
    built = _index(every.where("term is not null"), every.where("term is null").select("doc", "len"))
    built.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    return Index(built.postings, spark.read.parquet(f"{path}/terms"), built.docs, built.n_docs, built.average_length)


def inverse_frequency(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


#: Rows of a batch of queries (of a term, or of a term and a level) that are broadcast; more are joined by Spark's choice.
BROADCAST_ROWS = 1_000_000


def _few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _wanted(queries: DataFrame, terms: DataFrame, query_id: str, text: str, stop_words: list[str]) -> DataFrame:
    """(term, df, idf, query_id, times) of the queries' words that the index has; they go to the terms and then to the postings, which stay where they are."""
    own = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text), stop_words)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    own = stored(own, "wanted")
    return F.broadcast(terms.join(F.broadcast(own), "term")) if _few(own) else terms.join(own, "term")


def scores(index: Index, queries: DataFrame, query_id: str = "query_id", text: str = "text", allowed: DataFrame | None = None, k1: float = L.K1, b: float = L.B, stop_words: list[str] = L.STOP_WORDS) -> DataFrame:
    """(query_id, doc, score) of all documents that share a term; a repeated query word counts each time.

    ``allowed`` (doc) is a filter before ranking; statistics stay those of the whole index.
    """
    wanted = _wanted(queries, index.terms, query_id, text, stop_words)
    postings = index.postings if allowed is None else index.postings.join(allowed, "doc", "left_semi")
    found = postings.join(wanted, "term")
    length = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.lit(index.average_length or 1.0))
    part = F.col("times") * F.col("idf") * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + length)
    return found.groupBy("query_id", "doc").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, score: str = "score", item: str = "doc") -> DataFrame:
    """The k best rows of each query with their rank; scores are rounded to 6 digits, ties go by id."""
    by = by or ["query_id"]
    ranked = scored.withColumn(score, F.round(score, 6))
    order = Window.partitionBy(*by).orderBy(F.desc(score), item)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    return top_k(scores(index, queries, **options), k)


#: A block holds about so many postings of one term at most, all with weights of one of the levels.
BLOCK_POSTINGS, LEVELS = 1024, 16


@dataclass(frozen=True)
class BlockIndex:
    """Postings in blocks of alike weights, for top-k search that skips blocks.

    ``blocks``: (doc, term, level, part, weight), a table bucketed by document in which a block's postings of a bucket follow each
    other; ``bounds``: (term, level, part, n, bound) with the greatest weight in each block, without the term's idf; ``terms`` as in
    ``Index``.  Weights hold for the k1 and b that it was built with.
    """

    blocks: DataFrame
    bounds: DataFrame
    terms: DataFrame

    @staticmethod
    def build(index: Index, path: str, k1: float = L.K1, b: float = L.B, partitions: int | None = None) -> BlockIndex:
        """Postings stay with their documents (of a saved index in ``partitions`` they aren't shuffled); a frequent term's blocks are spread over parts by its documents' hashes."""
        length = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.lit(index.average_length or 1.0))
        weight = F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + length)
        # only terms of more than a block have parts: one for each BLOCK_POSTINGS postings of the table at most
        frequent = index.terms.where(F.col("df") > BLOCK_POSTINGS).select("term", F.ceil(F.col("df") / F.lit(BLOCK_POSTINGS)).cast("int").alias("parts"))
        own = index.postings.join(F.broadcast(frequent) if _few(frequent) else frequent, "term", "left").withColumn("weight", weight)
        level = F.least(F.lit(LEVELS - 1), F.floor(F.col("weight") / F.lit(k1 + 1) * LEVELS).cast("int"))
        own = own.select("doc", "term", level.alias("level"), F.pmod(F.xxhash64("doc"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "weight")
        partitions = partitions or int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = bucketed(own.repartition(partitions, "doc"), f"{path}/blocks", partitions, "doc", ["term", "level", "part"])
        blocks.groupBy("term", "level", "part").agg(F.count("*").alias("n"), F.max("weight").alias("bound")).write.mode("overwrite").parquet(f"{path}/bounds")
        index.terms.write.mode("overwrite").parquet(f"{path}/terms")
        return BlockIndex.load(index.terms.sparkSession, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BlockIndex:
        return BlockIndex(read_bucketed(spark, f"{path}/blocks"), spark.read.parquet(f"{path}/bounds"), spark.read.parquet(f"{path}/terms"))

    def _scored(self, keys: DataFrame) -> DataFrame:
        """(query_id, doc, score) of the postings in the blocks of ``keys`` (query_id, term, level, factor, and part unless all are meant); neither postings nor scores are shuffled."""
        own = F.broadcast(keys) if _few(keys) else keys
        rows = self.blocks.join(own, [c for c in ("term", "level", "part") if c in keys.columns])
        return rows.groupBy("query_id", "doc").agg(F.sum(F.col("factor") * F.col("weight")).alias("score"))

    def _levels(self, queries: DataFrame, k: int, query_id: str, text: str, stop_words: list[str]) -> DataFrame:
        """(query_id, term, level, factor, needed): LEVELS rows for each term of a query at most, however many blocks and postings it has.

        The best levels of each term give scores that are too low rather than too high; the k-th of them is a floor.  A document in a level scores no more than the level's bound and the other terms' greatest.
        """
        factors = _wanted(queries, self.terms, query_id, text, stop_words).select("query_id", "term", (F.col("times") * F.col("idf")).alias("factor"))
        words = factors.select("term").distinct()
        levels = self.bounds.join(F.broadcast(words) if _few(words) else words, "term").groupBy("term", "level").agg(F.sum("n").alias("own"), F.max("bound").alias("bound"))
        levels = levels.join(factors, "term").withColumn("most", F.col("factor") * F.col("bound"))
        by_term = Window.partitionBy("query_id", "term")
        above = F.sum("own").over(by_term.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1))
        levels = levels.select("query_id", "term", "level", "factor", "most", F.max("most").over(by_term).alias("greatest"), (F.coalesce(above, F.lit(0)) < k).alias("first"))
        levels = stored(levels, "levels")
        floor = top_k(self._scored(levels.where("first").select("query_id", "term", "level", "factor")), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        every = levels.select("query_id", "term", "greatest").distinct().groupBy("query_id").agg(F.sum("greatest").alias("every"))
        told = levels.join(every, "query_id").join(floor, "query_id", "left")
        # scores are rounded to 6 digits, so a rounding more or less doesn't decide
        needed = F.col("every") - F.col("greatest") + F.col("most") >= F.coalesce("floor", F.lit(0.0)) - 2e-6
        return stored(told.select("query_id", "term", "level", "factor", needed.alias("needed")), "levels")

    def plan(self, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text", stop_words: list[str] = L.STOP_WORDS) -> DataFrame:
        """The blocks of the queries' terms with needed: whether one of their documents may be among the k best."""
        levels = self._levels(queries, k, query_id, text, stop_words)
        return self.bounds.join(F.broadcast(levels) if _few(levels) else levels, ["term", "level"])

    def search(self, queries: DataFrame, k: int = 20, query_id: str = "query_id", text: str = "text", stop_words: list[str] = L.STOP_WORDS) -> DataFrame:
        """What ``search`` over the whole index gives."""
        levels = self._levels(queries, k, query_id, text, stop_words)
        return top_k(self._scored(levels.where("needed").select("query_id", "term", "level", "factor")), k)


def overfetch(scored: DataFrame, allowed: DataFrame, k: int, factor: int = 5) -> DataFrame:
    """The k best of the best k * factor rows that are allowed: filtering after ranking, which can lose matches."""
    fetched = top_k(scored, k * factor).drop("rank")
    return top_k(fetched.join(allowed, "doc", "left_semi"), k)
