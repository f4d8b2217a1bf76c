"""Corpus profiling: completeness, encoding, lengths, strata, sections, acronyms, concepts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import lexicon as L
from quern.functions import text as T
from quern.sources.shared import stored

QUANTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def missingness(df: DataFrame, fields: Sequence[str], sample_id: str | None = None, sample: int = 15) -> DataFrame:
    """(field, n_empty, empty_rate) per field, and the first ids with an empty value if asked for; one scan."""
    pairs = [F.struct(F.lit(f).alias("field"), F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", 1).otherwise(0).alias("empty")) for f in fields]
    ids = [F.col(sample_id).alias("__id")] if sample_id else []
    long = df.select(F.explode(F.array(*pairs)).alias("x"), *ids)
    out = [F.sum("x.empty").cast("long").alias("n_empty"), F.round(F.avg("x.empty"), 6).alias("empty_rate")]
    counts = long.groupBy(F.col("x.field").alias("field")).agg(*out)
    if not sample_id:
        return counts
    first = long.where("x.empty = 1").withColumn("n", F.row_number().over(Window.partitionBy("x.field").orderBy("__id"))).where(F.col("n") <= sample)
    return counts.join(first.groupBy(F.col("x.field").alias("field")).agg(F.array_sort(F.collect_list("__id")).alias("sample_ids")), "field", "left")


def positive_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("int"), F.lit(0)).alias("yes")) for f in flags]
    return df.select(F.explode(F.array(*pairs)).alias("x")).groupBy(F.col("x.field").alias("field")).agg(F.sum("x.yes").cast("long").alias("n"), F.round(F.avg("x.yes"), 6).alias("rate"))


def encoding_health(df: DataFrame, raw: str | None = None, text: str = "text") -> DataFrame:
    """Rows with bytes that are no UTF-8 (of the binary column ``raw``), with mojibake, and with CJK characters."""
    own = T.text_of(text)
    bad = F.count_if(~F.is_valid_utf8(F.col(raw))) if raw else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("n"), bad.alias("n_bad_bytes"), F.count_if(T.mojibake_count(own) > 0).alias("n_mojibake"), F.count_if(T.occurrences(own, T.CJK) > 0).alias("n_cjk"))


def quantile_table(df: DataFrame, value: Column, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """n, linear quantiles, mean, population deviation and median of a value."""
    at = F.percentile(value, F.array(*map(F.lit, quantiles)))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), at.alias("q"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("stddev"), F.median(value).alias("median"))
    names = [f"p{int(q * 100)}" for q in quantiles]
    return out.select(*by, "n", *(F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(names)), "mean", "stddev", "median")


def histogram(df: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    """(bin, low, n, fill): rows in half-open bins from each edge to the next; the last bin is open."""
    number = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    low = F.get(F.array(*(F.lit(float(e)) for e in edges)), F.col("bin"))
    counted = df.select(number.cast("int").alias("bin")).where("bin >= 0").groupBy("bin").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("bin", low.alias("low"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def group_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def positions(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with pos, the row's place from 0 on in the order of the keys, and total.

    Rows are dealt out by ranges of the keys and sorted there; a place is the row's number in its part plus the sizes
    of the parts before, which are one row for each part.
    """
    held = stored(df.orderBy(*keys).withColumn("__number", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__number", 33)
    sizes = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    own = Window.orderBy("__part")
    before = sizes.select("__part", (F.sum("__n").over(own) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    out = held.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn("pos", F.col("__before") + F.col("__number") - F.shiftleft("__part", 33)).select(*df.columns, "pos", "total")


def strata(df: DataFrame, value: str, key: str = "doc_id", parts: int = 3) -> DataFrame:
    """(key, value, stratum): parts of equal numbers by (value, key), cut at n * k // parts."""
    own = positions(df.select(key, value), value, key)
    # the number of cuts at or before the place
    return own.select(key, value, F.expr(f"((pos + 1) * {parts} + total - 1) div total - 1").cast("int").alias("stratum"))


def section_matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: counters of the 8 classes, imrad_like and n_headings."""
    classes = [*dict.fromkeys(L.SECTION_CLASSES.values()), "cjk_section"]
    found = docs.select(doc_id, F.explode_outer(F.filter(F.transform(T.lines(F.col(text)), T.section_class), lambda x: x.isNotNull())).alias("class"))
    out = found.groupBy(doc_id).agg(*(F.count_if(F.col("class") == c).alias(c) for c in classes))
    imrad = (F.col("intro") > 0) & (F.col("methods") > 0) & (F.col("results") > 0) & ((F.col("discussion") > 0) | (F.col("conclusion") > 0))
    return out.withColumn("imrad_like", imrad.cast("int")).withColumn("n_headings", sum((F.col(c) for c in classes), F.lit(0)))


def acronym_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(acronym, n, n_docs, expansion_example): all occurrences, documents, and the example of the longest document, then largest id."""
    own = docs.select(doc_id, F.length(T.text_of(text)).alias("__chars"), T.acronyms(F.col(text)).alias("a"), T.acronym_definitions(F.col(text)).alias("d"))
    counts = own.select(doc_id, F.explode("a").alias("acronym")).groupBy("acronym").agg(F.count("*").alias("n"), F.count_distinct(doc_id).alias("n_docs"))
    defined = own.select(doc_id, "__chars", F.posexplode("d").alias("at", "x")).select("__chars", doc_id, "at", F.col("x.acronym").alias("acronym"), F.col("x.phrase").alias("phrase"))
    best = defined.groupBy("acronym").agg(F.max_by("phrase", F.struct("__chars", doc_id, -F.col("at"))).alias("expansion_example"))
    return counts.join(best, "acronym", "left")


def most_common(counts: DataFrame, item: str, most: int, n: str = "n") -> DataFrame:
    """The ``most`` rows with the largest counts, ties by the item."""
    return counts.orderBy(F.desc(n), item).limit(most)


def concept_counts(docs: DataFrame, concepts: dict[str, str] = L.CONCEPTS, text: str = "text") -> DataFrame:
    """(concept, n): mentions of each pattern as whole words, case aside; patterns may overlap."""
    edge, end = "(?i)(?<![A-Za-z0-9_])(?:", ")(?![A-Za-z0-9_])"
    sums = docs.agg(*(F.sum(T.occurrences(T.text_of(text), edge + p + end)).cast("long").alias(f"c{i}") for i, p in enumerate(concepts.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("concept"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n")) for i, name in enumerate(concepts)))
    return sums.select(F.inline(pairs))


def pack_lengths(units: Column, size: Column) -> Column:
    """Sums of consecutive unit lengths, as many units each as fit into ``size``; one unit is never split."""
    start = F.struct(F.lit(0).cast("long").alias("cur"), F.array().cast("array<long>").alias("done"))
    step = lambda acc, n: F.when((acc.cur > 0) & (acc.cur + n > size), F.struct(n.alias("cur"), F.array_append(acc.done, acc.cur).alias("done"))).otherwise(F.struct((acc.cur + n).alias("cur"), acc.done.alias("done")))
    return F.aggregate(units, start, step, lambda acc: F.when(acc.cur > 0, F.array_append(acc.done, acc.cur)).otherwise(acc.done))


def split_units(lengths: Column, size: Column) -> Column:
    """Lengths with those above ``size`` cut into parts of it."""
    parts = lambda n: F.concat(F.array_repeat(size, F.floor(n / size).cast("int")), F.when(n % size > 0, F.array(n % size)).otherwise(F.array().cast("array<long>")))
    return F.flatten(F.transform(lengths, lambda n: F.when(n > size, parts(n)).otherwise(F.array(n))))


def chunk_size_simulation(docs: DataFrame, lengths: str, sizes: Sequence[int], doc_id: str = "doc_id", keep: float = 0.875) -> DataFrame:
    """A row per size: units above it, documents that need a cut, chunks, their lengths, fill and number with overlap."""
    grid = docs.select(doc_id, F.col(lengths).cast("array<long>").alias("l"), F.explode(F.array(*(F.lit(s).cast("long") for s in sizes))).alias("size"))
    own = grid.withColumn("over", F.size(F.filter("l", lambda n: n > F.col("size")))).withColumn("chunks", pack_lengths(split_units(F.col("l"), F.col("size")), F.col("size")))
    per_doc = own.groupBy("size").agg(
        F.sum("over").cast("long").alias("units_over"), F.round(100 * F.sum("over") / F.sum(F.size("l")), 4).alias("over_pct"), F.count_if(F.col("over") > 0).alias("docs_split"),
        F.sum(F.size("chunks")).cast("long").alias("n_chunks"), F.percentile(F.size("chunks"), 0.5).alias("per_doc_p50"), F.max(F.size("chunks")).alias("per_doc_max"),
    )
    each = own.select("size", F.explode("chunks").alias("n")).groupBy("size").agg(F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("q"), F.max("n").alias("len_max"))
    out = per_doc.join(each, "size")
    return out.select("size", "units_over", "over_pct", "docs_split", "n_chunks", "per_doc_p50", "per_doc_max", *(F.round(F.get("q", F.lit(i)), 4).alias(n) for i, n in enumerate(("len_p50", "len_p90", "len_p99"))), "len_max", F.round(100 * F.get("q", F.lit(0)) / F.col("size"), 4).alias("fill_p50_pct"), F.floor(F.col("n_chunks") / F.lit(keep)).alias("n_with_overlap"))


def smallest_size(simulation: DataFrame, limits: Sequence[float] = (1.0, 5.0, 10.0)) -> DataFrame:
    """(limit_pct, size): the least size whose share of units above it is within each limit."""
    grid = simulation.select("size", "over_pct", F.explode(F.array(*map(F.lit, limits))).alias("limit_pct"))
    return grid.where("over_pct <= limit_pct").groupBy("limit_pct").agg(F.min("size").alias("size"))
