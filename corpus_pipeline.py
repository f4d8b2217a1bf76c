"""The corpus pipeline: quality rules, line dedup, Jaccard join, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all rows of its
predecessor.  The first four return the columns of documents: the quality rules
drop what they reject, line dedup deletes later copies of repeated runs and
drops documents that lose every word to it, the Jaccard join leaves one document
of each group, and decontamination drops documents that hold a benchmark item.
Packing returns the pieces of what is left, with their token ids.

Defined cases, as the operators state them: a document with a null or empty text
has fewer words than the rules ask for and goes in the first stage; very long
texts go through all stages whole; repeated rows are copies, of which the Jaccard
join leaves one, and ties go to the least doc_id (null first, then by row);
columns of any name are carried through the first four stages as they are, but
for n_chars, which follows the text; an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import stored, table
from quern.llm.decontamination import without_leaks
from quern.llm.line_dedup import without_repeated_lines
from quern.llm.ngram_join import without_near_copies
from quern.llm.packing import pack
from quern.llm.quality_rules import fit_quality_model, quality_rules
from quern.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, fit_quality_model(docs, table(spark, sf_dir, "labels")), keep_columns=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = without_repeated_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("packing", packing)]

#: The quality model, MinHash candidates and packing are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
