"""Sources and sinks: texts, metadata, tables, statistics, and resumable appends."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as X

#: The metadata keys of an article and the columns of a manifest.
METADATA = T.StructType([T.StructField(k, T.StringType()) for k in ("pmcid", "version", "pmid", "title", "doi", "license_code", "citation")] + [T.StructField(k, T.BooleanType()) for k in ("is_manuscript", "is_pmc_openaccess")] + [T.StructField(k, T.StringType()) for k in ("text_url", "xml_url")])


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """(path, id, text): a row per file; bytes that are no UTF-8 are replaced; id is the folder's name up to its version."""
    files = spark.read.format("binaryFile").load(glob)
    text = F.when(F.is_valid_utf8(F.col("content")), F.col("content").cast("string")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("path", F.regexp_extract("path", r"/([^/]+?)(?:\.\d+)?/[^/]+$", 1).alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.col("content"))


def read_metadata(spark: SparkSession, glob: str, schema: T.StructType = METADATA) -> DataFrame:
    return spark.read.schema(schema).json(glob, multiLine=True)


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, missing values empty."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path).na.fill("")
    return df.toDF(*(c.removeprefix("\ufeff") for c in df.columns))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table, or no rows where the file is missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def join_texts(metadata: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """All metadata rows; an empty text where there is no file."""
    return metadata.join(texts.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def wide_table(metadata: DataFrame, texts: DataFrame) -> DataFrame:
    """A row per article: metadata, header fields of the text (e-publication date, else date; ISSN, else EISSN) and measures."""
    own = texts.select(F.col("id").alias("pmcid"), "text", "content", X.header_fields(F.col("text")).alias("h"))
    get = lambda *keys: F.coalesce(*(F.try_element_at("h", F.lit(k)) for k in keys), F.lit(""))
    rows = metadata.join(own, "pmcid", "left")
    text = X.text_of("text")
    return rows.select(
        "pmcid", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "pmid", "doi")), F.coalesce("license_code", F.lit("")).alias("license"), get("NLM Title Abbreviation").alias("journal_nlm"),
        F.coalesce(X.first_year(F.col("citation")), F.lit("")).alias("pub_year"), get("Electronic publication date", "Publication date").alias("pub_date_line"), get("ISSN", "EISSN").alias("issn"), get("Publisher").alias("publisher"),
        text.rlike(r"(?im)^\s*(abstract|summary)\b").alias("has_abstract_head"), F.exists(X.lines(text), lambda x: X.section_class(x).isNotNull()).alias("has_section_head"),
        F.size(X.lines(text)).alias("n_lines"), F.length(text).alias("n_chars"), F.round(F.octet_length(text) / 1024, 1).alias("size_kb"),
        F.coalesce((~F.is_valid_utf8(F.col("content"))).cast("int"), F.lit(0)).alias("bad_bytes"), X.mojibake_count(text).alias("mojibake_cnt"), X.occurrences(text, X.CJK).alias("cjk_chars"),
    )


def verified(files: DataFrame, content: str = "content", url: str = "url") -> DataFrame:
    """``files`` with checksum_ok: whether the MD5 of the content is that of the URL; null if the URL has none."""
    return files.withColumn("checksum_ok", F.md5(F.col(content)) == X.url_md5(F.col(url)))


def first_that_works(*fetches: Callable[[str], tuple[bytes, str]]) -> Callable[[str], tuple[bytes, str]]:
    """Each in turn until one doesn't fail, such as a text and then the XML of an article."""

    def fetch(i: str) -> tuple[bytes, str]:
        for n, one in enumerate(fetches, 1):
            try:
                return one(i)
            except Exception:
                if n == len(fetches):
                    raise
        raise ValueError("no way to fetch is given")

    return fetch


def fetched(ids: DataFrame, fetch: Callable[[str], tuple[bytes, str]], key: str = "id") -> DataFrame:
    """(id, content, url, error) by a function that the caller brings; a failing id gives a row with its error."""
    kind = dict(ids.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for i in part[key]:
                try:
                    content, url = fetch(i)
                    rows.append((i, content, url, None))
                except Exception as e:  # an id that can't be had is a result
                    rows.append((i, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "content", "url", "error"])

    return ids.select(key).mapInPandas(run, f"{key} {kind}, content binary, url string, error string")


def latest_versions(listing: DataFrame, key: Column, version: Column) -> DataFrame:
    """(key, latest): of all listed names with a numeric version the one with the largest."""
    return listing.groupBy(key.alias("key")).agg(F.max(version).alias("latest"))


def normalized_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text and numbers without nulls and NaN, as a store takes them."""
    kinds = dict(df.dtypes)

    def plain(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")).cast("string"), F.lit(""))
        return F.col(c) if kinds[c] == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.select(*(plain(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", bom: bool = False) -> None:
    """White space stays as it is; with ``bom`` the first column's name begins with a byte order mark, for programs that need one."""
    df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if bom else df
    df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """A log as a folder of files, each with its header."""
    write_csv(rows, path, "append")


def write_stats(stats: DataFrame, path: str) -> None:
    """A one-row table as one JSON line."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def report(sections: dict[str, DataFrame], title: str, most: int = 200) -> str:
    """Small tables as a Markdown report; a table with more than ``most`` rows is cut, which the report says."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        more, rows = len(rows) > most, rows[:most]
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join(json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (list, dict)) else str(v) for v in r) + " |" for r in rows]
        out += [f"More than {most} rows; these are the first."] * more + [""]
    return "\n".join(out)
