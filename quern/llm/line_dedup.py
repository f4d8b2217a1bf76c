"""Line dedup: later copies of repeated runs of lines are deleted, with DataFrame functions only.

Each document is a sequence of line ids; lines without a word are skipped.  A
suffix array over all sequences is made by distributed prefix doubling: rows are
(document, position), the rank of a suffix by its first line comes from a global
sort of the line hashes, and each round pairs the rank at a position with the one
2^k lines further on, sorts the pairs that occur and numbers them in order, which
ranks the suffixes by their first 2^(k+1) lines.  Suffixes whose rank is their
own repeat nothing and leave the rounds (prefix doubling with discarding), as do
stretches of repeated lines with fewer than ``min_words`` words.

The suffixes that agree in n lines stand next to each other in the array: an
interval whose longest common prefix is n or more.  Two ranks that cover the n
lines, one from the first line on and one up to the last, tell which interval it
is, so its bounds and its first occurrence come from one pre-aggregating shuffle.
A run counts from ``min_words`` words on.  The intervals looked at are, from each
position, the shortest prefix that counts and the longer ones that don't count
without their first line; every maximal repeated run is the union of such
prefixes, and none of them has more than ``min_words`` lines, which bounds the
rounds.  All of an interval but its first occurrence are later copies.

Rank tables are joined with rows by rank; both sides are read from written
tables, so the engine can split a rank that many rows share.

Defined cases: order is by doc_id (null first), then a hash of the text, then
line; rows that agree in doc_id and text are one document and get one result;
a copy may overlap the run that it repeats; lines are compared whole, by 128
bits of hash; a null text stays null; a text whose lines are all deleted becomes
empty; very long texts are rows like others, their lines stand in many rows; an
empty table stays empty; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import plain_names, stored

#: A repeated run is deleted if it has this many words.
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
_DOCUMENT = ["doc_id", "text_hash"]


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line with a word: document, position among these, place among all, words, the line's hashes and an id of the row."""
    line = lambda x, i: F.struct(i.alias("at"), x.alias("line"))
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.filter(F.transform(F.split("text", "\n"), line), lambda x: x.line.rlike(WORD)).alias("lines"))
    rows = split.select("*", F.posexplode("lines").alias("pos", "x")).drop("lines")
    own = rows.select("doc_id", "text_hash", "pos", "x.at", F.regexp_count("x.line", F.lit(WORD)).alias("words"), F.xxhash64("x.line").alias("a"), F.xxhash64(F.lit(2), "x.line").alias("b"))
    return own.withColumn("row", F.xxhash64("doc_id", "text_hash", "pos"))


def _ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows have, numbered in their order."""
    found = rows.groupBy(*keys).agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high")
    return stored(found.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("rank")), "ranks")


def _stretches(rows: DataFrame, min_words: int) -> DataFrame:
    """``rows`` in stretches of neighbouring lines that have ``min_words`` words, with the least and the greatest number
    of lines of the prefixes to look at (null where too few words follow)."""
    once = rows.repartition(*_DOCUMENT).dropDuplicates([*_DOCUMENT, "pos"])
    own = Window.partitionBy(*_DOCUMENT)
    once = once.withColumn("stretch", F.col("pos") - F.row_number().over(own.orderBy("pos")))
    own = Window.partitionBy(*_DOCUMENT, "stretch")
    once = once.withColumn("all", F.sum("words").over(own)).where(F.col("all") >= min_words)
    once = once.withColumn("upto", F.sum("words").over(own.orderBy("pos"))).withColumn("before", F.col("upto") - F.col("words"))
    # the lines before which fewer words stand, and those up to which fewer words follow the first line
    short, rest = (own.orderBy(c).rangeBetween(0, min_words - 1) for c in ("before", "upto"))
    once = once.withColumn("least", F.when(F.max("upto").over(short) - F.col("before") >= min_words, F.count("*").over(short)))
    return once.withColumn("most", F.greatest("least", F.count("*").over(rest))).select(*_DOCUMENT, "pos", "at", "row", "least", "most", "rank")


def suffix_ranks(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """The stretches of repeated lines, and for each k (doc_id, text_hash, pos, row, rank): the rank of the suffix
    from a position on by its first 2^k lines, where another suffix has the same lines."""
    lines = stored(_lines(docs), "lines")
    ranked = lines.join(_ranks(lines, ["a", "b"]), ["a", "b"]).drop("a", "b")
    base = stored(_stretches(ranked, min_words), "stretches")
    longest = base.agg(F.max(F.when(F.col("least").isNotNull(), F.col("most"))).alias("n")).first().n or 1
    levels = [base.select(*_DOCUMENT, "pos", "row", "rank")]
    while 2 ** len(levels) <= longest:
        half = 2 ** (len(levels) - 1)
        onward = Window.partitionBy(*_DOCUMENT).orderBy("pos").rangeBetween(half, half)
        pairs = stored(levels[-1].withColumn("next", F.max("rank").over(onward)).where("next is not null").withColumnRenamed("rank", "first"), "pairs")
        ranked = pairs.join(_ranks(pairs, ["first", "next"]), ["first", "next"]).select(*_DOCUMENT, "pos", "row", "rank")
        levels.append(stored(ranked, "suffixes"))
    return base, levels


def _intervals(base: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(doc_id, text_hash, first, last, n, x, y): each prefix to look at with its first and last line's place, its number of lines, and the two ranks that cover it."""
    every = [base.select(*_DOCUMENT, "pos", "at", "least", "most", F.lit(0).alias("k"), "rank")]
    every += [x.select(*_DOCUMENT, "pos", F.lit(k).alias("k"), "rank") for k, x in enumerate(levels) if k]
    rows = every[0]
    for x in every[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    of_level = [F.max(F.when(F.col("k") == k, F.col("rank"))) for k in range(len(levels))]
    rows = rows.repartition(*_DOCUMENT).groupBy(*_DOCUMENT, "pos").agg(F.max("at").alias("at"), F.max("least").alias("least"), F.max("most").alias("most"), F.array(*of_level).alias("ranks"))
    whole = rows.groupBy(*_DOCUMENT).agg(F.array_sort(F.collect_list(F.struct("pos", "at", "least", "most", "ranks"))).alias("lines"))
    lines = F.col("lines")

    def prefixes(x: Column, i: Column) -> Column:
        def one(n: Column) -> Column:
            k = sum(((n >= 2**j).cast("int") for j in range(1, len(levels))), F.lit(0))
            back = i + n - F.element_at(F.array(*(F.lit(2**j) for j in range(len(levels)))), k + 1)
            return F.struct(x.at.alias("first"), F.get(lines, i + n - 1).at.alias("last"), n.alias("n"), F.get(x.ranks, k).alias("x"), F.get(F.get(lines, back).ranks, k).alias("y"))

        return F.transform(F.sequence(x.least, x.most), one)

    some = F.transform(lines, lambda x, i: F.when(x.least.isNotNull(), F.filter(prefixes(x, i), lambda p: p.x.isNotNull() & p.y.isNotNull())).otherwise(F.array()))
    return whole.select(*_DOCUMENT, F.explode(F.flatten(some)).alias("p")).select(*_DOCUMENT, "p.*")


def _deleted(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, first, last): the later copies of repeated runs."""
    prefixes = stored(_intervals(*suffix_ranks(docs, min_words)), "prefixes")
    at = F.struct("doc_id", "text_hash", "first")
    intervals = prefixes.groupBy("n", "x", "y").agg(F.min(at).alias("origin"), F.max(at).alias("end")).where("origin < end").drop("end")
    return prefixes.join(stored(intervals, "intervals"), ["n", "x", "y"]).where(~at.eqNullSafe(F.col("origin"))).select("doc_id", "text_hash", "first", "last").distinct()


def _rewritten(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs`` under plain names with the deduplicated text, __n_lines of the text before and __n_deleted of these."""
    docs = plain_names(docs)
    deleted = _deleted(docs, min_words)
    before = Window.partitionBy("doc_id", "text_hash").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(F.max("last").over(before), F.lit(-1))
    gaps = deleted.withColumn("free", ends + 1).withColumn("new", F.greatest(F.lit(0), F.col("last") - F.greatest(ends, F.col("first") - 1)))
    # what is kept: the lines between the deleted runs, and those after the last of them
    kept = gaps.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.array_sort(F.collect_list(F.when(F.col("first") > F.col("free"), F.struct(F.col("free").alias("start"), (F.col("first") - F.col("free")).alias("n"))))).alias("__kept"),
        F.max("last").alias("__last"),
        F.sum("new").alias("__new"),
    )
    joined = docs.select("*", F.xxhash64("text").alias("__own")).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    out = joined.withColumn("__lines", F.split("text", "\n"))
    n = F.size(F.col("__lines"))
    tail = F.when(n > F.col("__last") + 1, F.slice("__lines", F.col("__last") + 2, n - F.col("__last") - 1)).otherwise(F.array().cast("array<string>"))
    rest = F.concat(F.flatten(F.transform("__kept", lambda x: F.slice("__lines", x.start + 1, x.n))), tail)
    text = F.when(F.col("__last").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    own = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*own, F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("long").alias("__n_lines"), F.coalesce("__new", F.lit(0)).cast("long").alias("__n_deleted"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the deduplicated text and the columns n_lines, of the text before, and n_deleted of these; columns of these names are replaced."""
    docs = docs.drop("n_lines", "n_deleted")
    return _rewritten(docs, min_words).toDF(*docs.columns, "n_lines", "n_deleted")


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs`` with the deduplicated text; rows that lost all of their words go."""
    done = _rewritten(docs, min_words).where((F.col("__n_deleted") == 0) | F.col("text").rlike(WORD))
    return done.drop("__n_lines", "__n_deleted").toDF(*docs.columns)
