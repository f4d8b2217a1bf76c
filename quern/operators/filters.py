"""Predicates from metadata filters, licence and cleaning rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import lexicon as L
from quern.sources.shared import stored


def predicate(where: dict) -> Column:
    """A filter of {key: scalar | {"$in": [...]} | {"$gte": x, "$lte": y}} as one condition; values are compared as text, ranges as numbers."""
    parts = [F.lit(True)]
    for key, value in (where or {}).items():
        c = F.col(key)
        if not isinstance(value, dict):
            parts.append(c.cast("string") == str(value).lower() if isinstance(value, bool) else c.cast("string") == str(value))
            continue
        if "$in" in value:
            parts.append(c.cast("string").isin([str(x) for x in value["$in"]]))
        number = F.expr(f"try_cast(`{key}` as int)")
        if "$gte" in value:
            parts.append(number >= int(value["$gte"]))
        if "$lte" in value:
            parts.append(number <= int(value["$lte"]))
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def licence_gate(open_access: Column, manuscript: Column, licence: Column, allowed: list[str] = L.OPEN_LICENCES) -> Column:
    return F.coalesce(open_access & ~manuscript & licence.isin(allowed), F.lit(False))


def clean_cascade(docs: DataFrame, core: Column, n_lines: Column, excluded: list | None = None, min_lines: int = 100) -> DataFrame:
    """``docs`` with drop_reason, the first that holds of excluded, no_text, short, empty_core; null for rows to keep."""
    listed = F.col("doc_id").isin(excluded) if excluded else F.lit(False)
    reason = F.when(listed, "excluded").when(F.coalesce(F.col("text"), F.lit("")) == "", "no_text").when(n_lines < min_lines, "short").when(F.trim(core) == "", "empty_core")
    return docs.withColumn("drop_reason", reason)


def acronym_quality(count: Column, expansion: Column, least: int = 500) -> Column:
    """Whether a mined expansion is fit for queries."""
    first = F.get(F.split(expansion, r"\s+"), F.lit(0))
    bad = expansion.rlike(r"[\t\\]|^[^A-Za-z0-9_]|[0-9]")
    return F.coalesce((count >= least) & (expansion != "") & ~bad & F.length(expansion).between(5, 40) & (F.length(first) >= 3), F.lit(False))


def new_ids(candidates: DataFrame, *seen: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates, each once, whose id is in none of the ``seen`` tables."""
    out = candidates.dropDuplicates([key])
    for s in seen:
        out = out.join(s.select(key), key, "left_anti")
    return out


#: Parts of a topic that are cut to its quota by themselves, so that no task holds a whole topic.
SALTS = 64


#: Topics whose table, a row each, is broadcast; a larger one is joined by Spark's choice.
BROADCAST_TOPICS = 500_000


def _told(rows: DataFrame, topics: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with what a table of a row for each topic says, without a shuffle of a topic's rows where that is small."""
    small = topics.limit(BROADCAST_TOPICS + 1).count() <= BROADCAST_TOPICS
    return rows.join(F.broadcast(topics) if small else topics, "topic_idx", how)


def topic_quota(candidates: DataFrame, quota: int | DataFrame, total: int | None = None, key: str = "doc_id") -> DataFrame:
    """At most ``quota`` ids per topic and ``total`` in all, with topic_rank, as if topics took their ids one after the other.

    Topics come by topic_idx and take by (pos, id) what no earlier topic has taken; ``quota`` may be a table
    (topic_idx, quota).  An id that finds a full topic goes on to its next one: every id asks at its first topic, a
    topic keeps its best, those it turns away ask at their next, until none is turned away, which gives the same.
    """
    spark, extra = candidates.sparkSession, [c for c in candidates.columns if c not in (key, "topic_idx", "pos")]
    wish = F.struct("topic_idx", "pos", *extra)
    # an id stands once in a topic, where it comes first
    asked = candidates.groupBy(key).agg(F.array_sort(F.collect_set(wish)).alias("wishes"))
    first = lambda x, i: (i == 0) | (x["topic_idx"] != F.get("wishes", i - 1)["topic_idx"])
    asked = stored(asked.select(key, F.filter("wishes", first).alias("wishes"), F.lit(0).alias("at")), "asked")
    quotas = quota if isinstance(quota, DataFrame) else None
    own = F.struct("pos", key)
    while True:
        current = asked.select(key, "wishes", "at", F.get("wishes", F.col("at")).alias("own")).select(key, "wishes", "at", "own.topic_idx", "own.pos")
        current = _told(current, quotas) if quotas is not None else current.withColumn("quota", F.lit(quota))
        part = Window.partitionBy("topic_idx", F.pmod(F.xxhash64(key), F.lit(SALTS))).orderBy("pos", key)
        best = current.withColumn("__n", F.row_number().over(part)).where("__n <= quota").select("topic_idx", "pos", key, "quota")
        best = best.withColumn("topic_rank", F.row_number().over(Window.partitionBy("topic_idx").orderBy("pos", key))).where("topic_rank <= quota")
        last = stored(best.groupBy("topic_idx").agg(F.max(own).alias("last"), F.count("*").alias("n")), "last")
        told = _told(current, last, "left")
        out = (F.col("quota") <= 0) | F.coalesce((F.col("n") >= F.col("quota")) & (own > F.col("last")), F.lit(False))
        asked = stored(told.select(key, "wishes", (F.col("at") + out.cast("int")).alias("at"), out.alias("moved")).where(F.col("at") < F.size("wishes")), "asked")
        if not asked.where("moved").limit(1).count():
            break
    wishes = asked.select(key, F.get("wishes", F.col("at")).alias("own")).select(key, "own.*")
    placed = wishes.withColumn("topic_rank", F.row_number().over(Window.partitionBy("topic_idx").orderBy("pos", key)))
    if total is None:
        return placed
    # a row for each topic: how many the topics before it have taken
    sizes = placed.groupBy("topic_idx").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("topic_idx").rowsBetween(Window.unboundedPreceding, -1)))
    return placed.join(sizes.select("topic_idx", "__before"), "topic_idx").where(F.coalesce("__before", F.lit(0)) + F.col("topic_rank") <= total).drop("__before")
