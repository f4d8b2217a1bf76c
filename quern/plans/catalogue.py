"""The queries of the library's own operators over the driver's tables, and the same in SQL.

Documents stand in for articles: source is the journal, and the publication
year is 1992 + doc_id modulo 35.  Items of benchmark are keyword queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import lexicon as L
from quern.functions import text as T
from quern.functions.subword import SubwordCounter
from quern.functions.text import tokens
from quern.operators import bm25, cells, chunk, context, filters, fusion, generate, models, profile, query, rerank, vector
from quern.plans import experiments
from quern.plans.retrieval import Retriever
from quern.sources import io
from quern.sources.shared import made_once, parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: What several statements below share.
_STOP = "(" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + ")"
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[-''][a-z0-9]+)*'), lambda t: length(t) >= 2 and t not in {_STOP})"
_BM25 = f"""
docs as (select doc_id, {_TOKENS} as tokens from documents),
size as (select count(*) as n, avg(len(tokens)) as a from docs),
postings as (select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from docs) group by all),
terms as (select term, count(*) as df from postings group by term),
idfs as (select term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from terms, size),
wanted as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({_TOKENS}) as term from benchmark) group by all),
scored as (
  select query_id, p.doc_id as doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.tokens) / a))), 6) as score
  from postings p join wanted w using (term) join idfs using (term) join docs d on d.doc_id = p.doc_id, size group by all
)"""
_COSINE = "round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6)"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \n\t\r]+'), lambda w: w <> '')"


def _register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").withColumn("pub_year", (F.lit(1992) + F.col("doc_id") % 35).cast("int")).withColumnRenamed("source", "journal")


# ---- profiling


@_register("profile_missingness", """
with own as (select d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic from documents d left join labels l using (doc_id)),
long as (select field, value from (select text, lang, source, quality::varchar as quality, toxic::varchar as toxic from own) unpivot include nulls (value for field in (text, lang, source, quality, toxic)))
select field, sum(case when coalesce(value, '') = '' then 1 else 0 end)::bigint as n_empty, round(avg(case when coalesce(value, '') = '' then 1.0 else 0 end), 6) as empty_rate from long group by field
""")  # fmt: skip
def profile_missingness(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return profile.missingness(own, ["text", "lang", "source", "quality", "toxic"])


@_register("profile_positive_rates", """
select 'quality' as field, sum(quality)::bigint as n, round(avg(quality), 6) as rate from labels union all select 'toxic', sum(toxic)::bigint, round(avg(toxic), 6) from labels
""")  # fmt: skip
def profile_positive_rates(spark, sf_dir):
    return profile.positive_rates(_table(spark, sf_dir, "labels"), ["quality", "toxic"])


@_register("profile_length_quantiles", """
select lang, count(*) as n, round(quantile_cont(n_chars, 0.0), 6) as p0, round(quantile_cont(n_chars, 0.05), 6) as p5, round(quantile_cont(n_chars, 0.25), 6) as p25, round(quantile_cont(n_chars, 0.5), 6) as p50,
  round(quantile_cont(n_chars, 0.75), 6) as p75, round(quantile_cont(n_chars, 0.9), 6) as p90, round(quantile_cont(n_chars, 0.95), 6) as p95, round(quantile_cont(n_chars, 0.99), 6) as p99, round(quantile_cont(n_chars, 1.0), 6) as p100,
  round(avg(n_chars), 6) as mean, round(stddev_pop(n_chars), 6) as stddev, median(n_chars)::double as median from documents group by lang
""")  # fmt: skip
def profile_length_quantiles(spark, sf_dir):
    return profile.quantile_table(_table(spark, sf_dir, "documents"), F.col("n_chars"), ["lang"])


@_register("profile_length_histogram", """
with binned as (select (n_chars >= 0)::int + (n_chars >= 500)::int + (n_chars >= 1000)::int + (n_chars >= 2000)::int + (n_chars >= 5000)::int + (n_chars >= 20000)::int - 1 as bin from documents)
select bin::int as bin, [0.0, 500, 1000, 2000, 5000, 20000][bin + 1]::double as low, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from binned where bin >= 0 group by bin
""")  # fmt: skip
def profile_length_histogram(spark, sf_dir):
    return profile.histogram(_table(spark, sf_dir, "documents"), F.col("n_chars"), [0, 500, 1000, 2000, 5000, 20000])


@_register("profile_lang_counts", "select lang, count(*) as n, count(distinct source) as n_sources from documents group by lang")
def profile_lang_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


@_register("profile_strata", """
with own as (select doc_id, n_chars, row_number() over (order by n_chars, doc_id) - 1 as pos, count(*) over () as n from documents)
select doc_id, n_chars, ((pos >= n // 3)::int + (pos >= 2 * n // 3)::int)::int as stratum from own
""")  # fmt: skip
def profile_strata(spark, sf_dir):
    return profile.strata(_table(spark, sf_dir, "documents"), "n_chars")


@_register("profile_encoding", r"""
select count(*) as n, 0::bigint as n_bad_bytes, count_if(text like '%�%' or text like '%Ã©%' or text like '%Ã¨%' or text like '%â€™%' or text like '%â€œ%' or text like '%ï¿½%')::bigint as n_mojibake,
  count_if(regexp_matches(text, '[\x{4e00}-\x{9fff}]'))::bigint as n_cjk from documents
""")  # fmt: skip
def profile_encoding(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return profile.encoding_health(docs.withColumn("raw", F.col("text").cast("binary")), "raw")


_NOISE = "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(L.NO_ACRONYMS)) + ")"


@_register("profile_acronyms", f"""
with found as (select doc_id, unnest(list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '([A-Za-z0-9_]+)', ' \\1 ', 'g'), ' ([A-Z0-9]{{2,12}}) ', 1), lambda t: regexp_matches(t, '[A-Z]') and t not in {_NOISE})) as acronym from documents)
select acronym, count(*) as n, count(distinct doc_id) as n_docs from found group by acronym
""")  # fmt: skip
def profile_acronyms(spark, sf_dir):
    return profile.acronym_table(_table(spark, sf_dir, "documents")).select("acronym", "n", "n_docs")


@_register("profile_concept_counts", """
with c(concept, pattern) as (values ('the', 'the'), ('of', 'of'), ('de la', 'de la'), ('licence', 'licensed? under'), ('und', 'und'))
select concept, sum(len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9_])', '\\1\\1', 'g'), '(?:^|[^a-z0-9_])' || regexp_replace(pattern, ' ', '  ', 'g') || '(?:$|[^a-z0-9_])')))::bigint as n from documents, c group by concept
""")  # fmt: skip
def profile_concept_counts(spark, sf_dir):
    return profile.concept_counts(_table(spark, sf_dir, "documents"), {"the": "the", "of": "of", "de la": "de la", "licence": "licensed? under", "und": "und"})


@_register("profile_header_kv", r"""
select page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, regexp_extract(url, '^https?://([^/]+)/', 1) as host from pages
""")  # fmt: skip
def profile_header_kv(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"))


@_register("clean_cascade", """
select coalesce(case when doc_id in (3, 7) then 'excluded' when coalesce(text, '') = '' then 'no_text' when len(string_split(text, chr(10))) < 5 then 'short' when trim(text) = '' then 'empty_core' end, 'kept') as drop_reason, count(*) as n from documents group by 1
""")  # fmt: skip
def clean_cascade(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    own = filters.clean_cascade(docs, T.regions(F.col("text")).core, F.size(T.lines(F.col("text"))), [3, 7], min_lines=5)
    return own.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


@_register("token_estimate", """
select doc_id, (case when length(text) > 0 then floor((0 / 1.57 + length(text) / 5.03::double) * 1.3) + 1 else 0 end)::bigint as tokens from documents
""")  # fmt: skip
def token_estimate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(T.text_of("text")).alias("tokens"))


@_register("paragraph_units", r"""
with p as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n[ \t]*(?:\n[ \t]*)+'), lambda p: trim(array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' '))), lambda p: p <> '') as u from documents)
select doc_id, len(u)::int as n_paragraphs, coalesce(list_sum(list_transform(u, lambda x: length(x))), 0)::bigint as n_chars from p
""")  # fmt: skip
def paragraph_units(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("u"))
    return own.select("doc_id", F.size("u").alias("n_paragraphs"), F.aggregate("u", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("n_chars"))


@_register("removed_share", """
select lang, round(100 * (1 - sum(length(string_split(text, chr(10))[1])) / sum(length(text))), 6) as removed_pct, round(sum(length(text)) / sum(len(regexp_extract_all(text, '[^ \\n\\t\\r]+'))), 6) as chars_per_word from documents group by lang
""")  # fmt: skip
def removed_share(spark, sf_dir):
    own = T.text_of("text")
    first = F.length(F.get(F.split(own, "\n"), F.lit(0)))
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(100 * (1 - F.sum(first) / F.sum(F.length(own))), 6).alias("removed_pct"), F.round(F.sum(F.length(own)) / F.sum(F.regexp_count(own, F.lit("[^ \\n\\t\\r]+"))), 6).alias("chars_per_word"))


def _line_words(spark, sf_dir) -> DataFrame:
    words = F.transform(F.split(T.text_of("text"), "\n"), lambda x: F.regexp_count(x, F.lit("[^ \\n\\t\\r]+")).cast("long"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.filter(words, lambda n: n > 0).alias("units"))


_SIMULATED = r"""
with recursive lined as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: len(regexp_extract_all(x, '[^ \n\t\r]+'))), lambda n: n > 0) as l from documents),
grid as (select doc_id, l, size, len(list_filter(l, lambda n: n > size)) as over, flatten(list_transform(l, lambda n: list_concat(list_transform(range(n // size), lambda i: size), case when n % size > 0 then [n % size] else [] end))) as u from lined, (values (64::bigint), (128), (256), (512)) t(size)),
fold(doc_id, size, i, cur, done) as (
  select doc_id, size, 0, 0::bigint, []::bigint[] from grid
  union all
  select f.doc_id, f.size, f.i + 1, case when f.cur > 0 and f.cur + g.u[f.i + 1] > f.size then g.u[f.i + 1] else f.cur + g.u[f.i + 1] end, case when f.cur > 0 and f.cur + g.u[f.i + 1] > f.size then list_append(f.done, f.cur) else f.done end
  from fold f join grid g on g.doc_id = f.doc_id and g.size = f.size where f.i < len(g.u)
),
packed as (select g.size, g.l, g.over, case when f.cur > 0 then list_append(f.done, f.cur) else f.done end as chunks from fold f join grid g on g.doc_id = f.doc_id and g.size = f.size and f.i = len(g.u)),
per_doc as (select size, sum(over)::bigint as units_over, round(100 * sum(over) / sum(len(l)), 4) as over_pct, count_if(over > 0)::bigint as docs_split, sum(len(chunks))::bigint as n_chunks, quantile_cont(len(chunks), 0.5)::double as per_doc_p50, max(len(chunks))::int as per_doc_max from packed group by size),
each as (select size, quantile_cont(n, 0.5) as q50, quantile_cont(n, 0.9) as q90, quantile_cont(n, 0.99) as q99, max(n) as len_max from (select size, unnest(chunks) as n from packed) group by size),
simulated as (select size, units_over, over_pct, docs_split, n_chunks, per_doc_p50, per_doc_max, round(q50, 4)::double as len_p50, round(q90, 4)::double as len_p90, round(q99, 4)::double as len_p99, len_max, round(100 * q50 / size, 4)::double as fill_p50_pct, floor(n_chunks / 0.875)::bigint as n_with_overlap from per_doc join each using (size))
"""


@_register("pack_simulation", _SIMULATED + "select * from simulated")
def pack_simulation(spark, sf_dir):
    return profile.chunk_size_simulation(_line_words(spark, sf_dir), "units", [64, 128, 256, 512])


@_register("smallest_chunk_size", _SIMULATED + "select limit_pct, min(size) as size from simulated, (values (1.0::double), (5.0), (10.0)) t(limit_pct) where over_pct <= limit_pct group by limit_pct")
def smallest_chunk_size(spark, sf_dir):
    return profile.smallest_size(profile.chunk_size_simulation(_line_words(spark, sf_dir), "units", [64, 128, 256, 512]))


# ---- chunks


@_register("chunk_fixed_overlap", f"""
with own as (select doc_id, {_WORDS} as w from documents where len({_WORDS}) > 0),
spans as (select doc_id, w, greatest(0, ceil((len(w) - 16) / 112.0)::int - 1) + 1 as total, unnest(range(0, greatest(0, ceil((len(w) - 16) / 112.0)::int - 1) + 1)) as s from own)
select doc_id || '_' || lpad(s::varchar, greatest(4, length(s::varchar))::int, '0') as chunk_id, doc_id, s::int as chunk_index, total::int as total_chunks, array_to_string(w[s * 112 + 1:s * 112 + 128], ' ') as text, len(w[s * 112 + 1:s * 112 + 128])::int as token_count from spans
""")  # fmt: skip
def chunk_fixed_overlap(spark, sf_dir):
    return chunk.word_windows(_table(spark, sf_dir, "documents"), 128, 16)


@_register("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    return chunk.split_documents(_table(spark, sf_dir, "documents"), 128, 16).select("chunk_id", "doc_id", "chunk_index", "total_chunks", "token_count", "text")


@_register("chunk_whole", f"select doc_id, doc_id::varchar as chunk_id, len({_WORDS})::int as token_count, contains(coalesce(text, ''), chr(9)) as is_table from documents")
def chunk_whole(spark, sf_dir):
    return chunk.whole_documents(_table(spark, sf_dir, "documents")).select("doc_id", "chunk_id", "token_count", "is_table")


_CHUNKS = ORACLE_SQL["chunk_fixed_overlap"]


@_register("chunk_quality", f"""
with chunks as ({_CHUNKS}), flagged as (select concat_ws('|', case when trim(text) = '' then 'empty' end, case when token_count > 8192 then 'over_model_limit' when token_count > 512 then 'over_chunk_size' end, case when token_count > 0 and token_count < 20 then 'too_short' end,
  case when text like '%�%' or text like '%Ã©%' or text like '%Ã¨%' or text like '%â€™%' or text like '%â€œ%' or text like '%ï¿½%' then 'mojibake' end) as issues from chunks)
select issues, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 6) as pct from flagged group by issues
""")  # fmt: skip
def chunk_quality(spark, sf_dir):
    own = chunk.quality_issues(chunk.word_windows(_table(spark, sf_dir, "documents"), 128, 16)).groupBy("issues").agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("issues", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"))


@_register("chunks_per_doc", f"""
with chunks as ({_CHUNKS}), per as (select doc_id, count(*) as n from chunks group by doc_id)
select count(*) as n_docs, round(avg(n), 6) as mean, quantile_cont(n, 0.5)::double as p50, max(n) as largest, count_if(n >= 3)::bigint as multi from per
""")  # fmt: skip
def chunks_per_doc(spark, sf_dir):
    per = chunk.word_windows(_table(spark, sf_dir, "documents"), 128, 16).groupBy("doc_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_docs"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).alias("p50"), F.max("n").alias("largest"), F.count_if(F.col("n") >= 3).alias("multi"))


@_register("adjacent_overlap", f"""
with chunks as ({_CHUNKS}), pairs as (select doc_id, chunk_index, text as a, left(lead(text) over (partition by doc_id order by chunk_index), 400) as b from chunks)
select doc_id, chunk_index, coalesce(list_max(list_filter(range(21, least(200, length(a)) + 1), lambda n: contains(b, right(a, n)))), 0)::int as overlap from pairs where b is not null
""")  # fmt: skip
def adjacent_overlap(spark, sf_dir):
    return chunk.adjacent_overlap(chunk.word_windows(_table(spark, sf_dir, "documents"), 128, 16))


@_register("neighbour_similarity", f"""
with chunks as ({_CHUNKS}), flat as (select doc_id, chunk_index, regexp_replace(lower(text), '\\s+', '', 'g') as t from chunks),
sets as (select doc_id, chunk_index, case when length(t) > 4 then list_distinct(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4))) when length(t) > 0 then [t] else [] end as s from flat),
pairs as (select doc_id, chunk_index, s, lead(s) over (partition by doc_id order by chunk_index) as n from sets)
select doc_id, chunk_index, round(case when len(s) > 0 and len(n) > 0 then len(list_intersect(s, n)) / (len(s) + len(n) - len(list_intersect(s, n)))::double else 0 end, 6) as similarity from pairs where n is not null
""")  # fmt: skip
def neighbour_similarity(spark, sf_dir):
    return chunk.neighbours(chunk.word_windows(_table(spark, sf_dir, "documents"), 128, 16))


# ---- ranking

#: The application's written indexes.
_INDEXES: dict[tuple[str, str], bm25.Index] = {}


def _index(spark, sf_dir) -> bm25.Index:
    """The index of the documents, written once for an application and searched from there."""
    documents = _table(spark, sf_dir, "documents")
    spread = parts(spark, f"{sf_dir}/documents.parquet")
    made: list[bm25.Index] = []
    path = made_once(spark, ("bm25", sf_dir), lambda path: made.append(bm25.saved_index(documents, path, partitions=spread)), f"{sf_dir}/documents.parquet")
    return _INDEXES.setdefault((spark.sparkContext.applicationId, path), *made)


def _queries(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")


@_register("bm25_terms", f"with {_BM25} select term, df, round(idf, 6) as idf from idfs")
def bm25_terms(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@_register("bm25_stats", f"with {_BM25} select (select n from size) as n_docs, (select round(a, 6) from size) as average_length, (select count(*) from terms) as n_terms, (select count(*) from postings) as n_postings")
def bm25_stats(spark, sf_dir):
    index = _index(spark, sf_dir)
    sizes = index.terms.agg(F.count("*").alias("n_terms"), F.sum("df").cast("long").alias("n_postings"))
    return sizes.select(F.lit(index.n_docs).cast("long").alias("n_docs"), F.round(F.lit(index.average_length), 6).alias("average_length"), "n_terms", "n_postings")


@_register("bm25_topk", f"with {_BM25} select * from (select *, row_number() over (partition by query_id order by score desc, doc)::int as rank from scored) where rank <= 10")
def bm25_topk(spark, sf_dir):
    return bm25.search(_index(spark, sf_dir), _queries(spark, sf_dir), 10)


def _blocks(spark, sf_dir) -> bm25.BlockIndex:
    path = made_once(spark, ("blocks", sf_dir), lambda path: bm25.BlockIndex.build(_index(spark, sf_dir), path, partitions=parts(spark, f"{sf_dir}/documents.parquet")), f"{sf_dir}/documents.parquet")
    return bm25.BlockIndex.load(spark, path)


@_register("bm25_topk_blocks", ORACLE_SQL["bm25_topk"])
def bm25_topk_blocks(spark, sf_dir):
    """The same rows from blocks of postings, those that can't matter left out."""
    return _blocks(spark, sf_dir).search(_queries(spark, sf_dir), 10)


@_register("bm25_blocks_read", f"with {_BM25} select query_id, max(df)::bigint as n_postings, true as fewer_read from wanted join terms using (term) group by query_id")
def bm25_blocks_read(spark, sf_dir):
    """A search for the most frequent term of each item: how many postings it has, and whether all searches together needed fewer.

    Of long queries, whose terms' greatest weights add up to far more than any document has, all blocks are needed.
    """
    index, words = _blocks(spark, sf_dir), F.explode(tokens(F.col("text"), L.STOP_WORDS)).alias("term")
    frequent = _queries(spark, sf_dir).select("query_id", words).join(index.terms, "term").groupBy("query_id").agg(F.max(F.struct("df", "term"))["term"].alias("text"))
    per = index.plan(frequent, 10).groupBy("query_id").agg(F.sum("n").alias("n_postings"), F.sum(F.when(F.col("needed"), F.col("n")).otherwise(0)).alias("read"))
    every = per.agg((F.sum("read") < F.sum("n_postings")).alias("fewer_read"))
    return per.select("query_id", "n_postings").crossJoin(F.broadcast(every))


@_register("bm25_topk_filtered", f"""
with {_BM25} select * from (select s.*, row_number() over (partition by query_id order by score desc, doc)::int as rank from scored s where 1992 + doc % 35 between 2020 and 2023) where rank <= 10
""")  # fmt: skip
def bm25_topk_filtered(spark, sf_dir):
    years = query.find_filters("2020-2023", L.YEAR_MAX)[0]
    allowed = _articles(spark, sf_dir).where(filters.predicate(years)).select(F.col("doc_id").alias("doc"))
    return bm25.search(_index(spark, sf_dir), _queries(spark, sf_dir), 10, allowed=allowed)


@_register("bm25_overfetch", f"""
with {_BM25}, fetched as (select * from (select *, row_number() over (partition by query_id order by score desc, doc) as r from scored) where r <= 50)
select query_id, doc, score, row_number() over (partition by query_id order by score desc, doc)::int as rank from fetched where 1992 + doc % 35 >= 2020 qualify rank <= 10
""")  # fmt: skip
def bm25_overfetch(spark, sf_dir):
    allowed = _articles(spark, sf_dir).where(filters.predicate({"pub_year": {"$gte": 2020}})).select(F.col("doc_id").alias("doc"))
    return bm25.overfetch(bm25.scores(_index(spark, sf_dir), _queries(spark, sf_dir)), allowed, 10)


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings")


def _vector_queries(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_VECTOR = f"select q.vec_id as query_id, v.vec_id as doc, {_COSINE} as score, row_number() over (partition by q.vec_id order by {_COSINE} desc, v.vec_id)::int as rank from embeddings q, embeddings v where q.vec_id % 100 = 0"


@_register("vector_topk", f"{_VECTOR} qualify rank <= 10")
def vector_topk(spark, sf_dir):
    return vector.vector_search(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), 10)


@_register("vector_topk_filtered", f"{_VECTOR} and v.label in (1, 2) qualify rank <= 10")
def vector_topk_filtered(spark, sf_dir):
    return vector.vector_search(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir).where(filters.predicate({"label": {"$in": [1, 2]}})), 10)


@_register("vector_self_check", f"""
with best as ({_VECTOR} qualify rank = 1)
select query_id, doc, score, case when query_id = doc then 'exact' when o.label = f.label then 'same_group' else 'cross_group' end as verdict from best join embeddings o on o.vec_id = query_id join embeddings f on f.vec_id = doc
""")  # fmt: skip
def vector_self_check(spark, sf_dir):
    return vector.self_check(_vectors(spark, sf_dir))


@_register("vector_stats", """
with n as (select len(embedding) as d, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as l from embeddings)
select count(*) as n, count_if(l = 0)::bigint as zero_vectors, min(d)::int as min_dim, max(d)::int as max_dim, round(min(l), 4) as min_norm, round(max(l), 4) as max_norm from n
""")  # fmt: skip
def vector_stats(spark, sf_dir):
    return vector.vector_stats(_vectors(spark, sf_dir))


@_register("vector_bytes", f"""
with near as ({_VECTOR} qualify rank <= 20), bytes as (
  select vec_id, list_transform(embedding, lambda x: case when m > 0 then round(x::double / (m / 127)) else 0 end) as v
  from (select vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::double))) as m from embeddings)),
scored as (select query_id, doc, score, rank, round(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 0), 6) as own
  from near join bytes a on a.vec_id = query_id join bytes b on b.vec_id = doc),
told as (select *, row_number() over (partition by query_id order by own desc nulls last, doc) as again from scored)
select query_id, round(max(abs(score - own)), 6) as largest_shift, count_if(rank <= 5 and again <= 5)::bigint as kept from told group by query_id
""")  # fmt: skip
def vector_bytes(spark, sf_dir):
    """What scoring with bytes shifts among the 20 nearest, and how many of the best five it keeps."""
    return vector.quantisation_report(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir))


@_register("chunk_subwords", r"select doc_id, true as within, true as counted from documents where regexp_matches(text, '\S')")
def chunk_subwords(spark, sf_dir):
    """Chunks of 256 subword tokens: per document whether all are within that size, and whether their counts are those of their texts taken anew."""
    import public_tokenizers

    counter = SubwordCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # much is done for each row, so a table in few files is dealt anew
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").repartition(parts(spark, f"{sf_dir}/documents.parquet", 2 << 20), F.xxhash64("doc_id", "text"))
    chunks = chunk.split_documents(docs, 256, 32, counter)
    again = F.pandas_udf(lambda s: s.map(counter), "int")(F.col("text"))
    return chunks.select("doc_id", "token_count", again.alias("again")).groupBy("doc_id").agg(F.min(F.col("token_count") <= 256).alias("within"), F.min(F.col("token_count") == F.col("again")).alias("counted"))


@_register("chunk_covered", r"""
select doc_id, md5(regexp_replace(text, '\s+', '', 'g')) as digest, true as within, true as overlaps from documents where regexp_matches(text, '\S')
""")  # fmt: skip
def chunk_covered(spark, sf_dir):
    """Per document whether its chunks hold its text in order, are within their size, and start with the last 16 words of the part before."""
    # dealt by document, so that its chunks are put together where they are made
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").repartition(parts(spark, f"{sf_dir}/documents.parquet"), "doc_id")
    bare, full = chunk.native_chunks(docs, 112, 0, short=1), chunk.native_chunks(docs, 128, 16, short=1)
    order = lambda c: F.array_sort(F.collect_list(F.struct("chunk_index", c)))
    plain = bare.groupBy("doc_id").agg(order("text").alias("parts"), F.max("token_count").alias("most"))
    own = full.groupBy("doc_id").agg(order("text").alias("chunks"), F.max("token_count").alias("longest")).join(plain, "doc_id")
    tail = lambda x: T.bound(F.filter(F.split(x, r"\s+"), lambda w: w != ""), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - 15), F.lit(16)), " "))
    due = lambda p, i: F.when(i == 0, p["text"]).otherwise(F.concat(tail(F.get("parts", i - 1)["text"]), F.lit(" "), p["text"]))
    same = F.transform("parts", due) == F.transform("chunks", lambda c: c["text"])
    digest = F.md5(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), ""), r"\s+", ""))
    return own.select("doc_id", digest.alias("digest"), ((F.col("most") <= 112) & (F.col("longest") <= 128)).alias("within"), same.alias("overlaps"))


def _cells(spark, sf_dir) -> cells.CellIndex:
    path = made_once(spark, ("cells", sf_dir), lambda path: cells.CellIndex.build(_vectors(spark, sf_dir), path, 16), f"{sf_dir}/embeddings.parquet")
    return cells.CellIndex.load(spark, path)


@_register("vector_cells_all", f"{_VECTOR} qualify rank <= 10")
def vector_cells_all(spark, sf_dir):
    """All cells probed: the exact search's rows."""
    return _cells(spark, sf_dir).search(_vector_queries(spark, sf_dir), 10, probes=16)


@_register("vector_cells_recall", "select count(*) as n_queries, true as recall_reached, true as reads_less from embeddings where vec_id % 100 = 0")
def vector_cells_recall(spark, sf_dir):
    """13 of 16 cells: whether nine tenths of the ten nearest are found, and less than nine tenths of the vectors compared.

    The given vectors point in all directions alike, so a query's nearest lie in most cells; those in clusters need few.
    """
    index, asked = _cells(spark, sf_dir), _vector_queries(spark, sf_dir)
    found = cells.recall(index.search(asked, 10, probes=13), vector.vector_search(asked, _vectors(spark, sf_dir), 10))
    compared = index.read_share(np.array([r.embedding for r in asked.limit(vector.BLOCK).collect()]), 13)
    return found.agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("recall_reached")).withColumn("reads_less", F.lit(compared < 0.9))


def _paths(spark, sf_dir) -> DataFrame:
    """Keyword lists of the items and vector lists of the vectors under the same ids."""
    items = _queries(spark, sf_dir)
    keyword = bm25.search(_index(spark, sf_dir), items, 20)
    own = _vectors(spark, sf_dir).join(items.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    near = vector.vector_search(own, _vectors(spark, sf_dir), 20)
    return fusion.union([fusion.path(near, 0, "vector", "vector"), fusion.path(keyword, 1, "bm25", "keyword")])


_LISTS = f"""{_BM25}, near as (
  select q.vec_id as query_id, 0 as path_idx, 'vector' as path, 'vector' as kind, v.vec_id as id, {_COSINE} as score, row_number() over (partition by q.vec_id order by {_COSINE} desc, v.vec_id) as rank
  from embeddings q, embeddings v where q.vec_id in (select item_id from benchmark) qualify rank <= 20
), lists as (
  select * from near union all
  select query_id, 1, 'bm25', 'keyword', doc, score, row_number() over (partition by query_id order by score desc, doc) as rank from scored qualify rank <= 20
), once as (
  select query_id, id, count(distinct path) as n_paths, min(path_idx * 1000 + rank) as seen from lists group by all
)"""
_RANKED = "select query_id, id, fused_score, n_paths, row_number() over (partition by query_id order by fused_score desc, seen, id)::int as fused_rank"
_FUSED = ["query_id", "id", "fused_score", "n_paths", "fused_rank"]


@_register("fusion_rrf", f"with {_LISTS}, f as (select query_id, id, round(sum(1.0::double / (60 + rank)), 6) as fused_score from lists group by all) {_RANKED} from f join once using (query_id, id)")
def fusion_rrf(spark, sf_dir):
    return fusion.reciprocal_rank(_paths(spark, sf_dir)).select(*_FUSED)


@_register("fusion_weighted", f"""
with {_LISTS}, v as (select *, case when max(score) over w - min(score) over w < 1e-9 then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as value from lists window w as (partition by query_id, path_idx)),
k as (select query_id, id, kind, max(value) as value from v group by all),
f as (select query_id, id, round(sum(case kind when 'vector' then 0.7::double else 0.3::double end * value), 6) as fused_score from k group by all) {_RANKED} from f join once using (query_id, id)
""")  # fmt: skip
def fusion_weighted(spark, sf_dir):
    return fusion.weighted(_paths(spark, sf_dir)).select(*_FUSED)


@_register("fusion_simple", f"with {_LISTS}, f as (select query_id, id, round(1.0::double / row_number() over (partition by query_id order by seen, id), 6) as fused_score from once) {_RANKED} from f join once using (query_id, id)")
def fusion_simple(spark, sf_dir):
    return fusion.first_seen(_paths(spark, sf_dir)).select(*_FUSED)


@_register("filter_in_years", "select doc_id, (1992 + doc_id % 35)::int as pub_year from documents where 1992 + doc_id % 35 in (2020, 2021, 2022, 2023)")
def filter_in_years(spark, sf_dir):
    return _articles(spark, sf_dir).where(filters.predicate(query.find_filters("trials 2020-2023", L.YEAR_MAX)[0])).select("doc_id", "pub_year")


@_register("licence_gate", """
select doc_id, coalesce(quality = 1 and not toxic = 1 and lang in ('en', 'de'), false) as allowed from documents left join labels using (doc_id)
""")  # fmt: skip
def licence_gate(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return own.select("doc_id", filters.licence_gate(F.col("quality") == 1, F.col("toxic") == 1, F.col("lang"), ["en", "de"]).alias("allowed"))


_VENUES = "with v as (select source as venue, count(distinct doc_id) as n_docs from documents group by source) select venue, n_docs, round(least(1.0, 0.4 + 0.6 * ln(1 + n_docs) / ln(1 + max(n_docs) over ())), 4)::double as authority from v"


@_register("venue_authority", _VENUES)
def venue_authority(spark, sf_dir):
    return rerank.venue_authority(_articles(spark, sf_dir))


@_register("rerank_multicriteria", f"""
with {_BM25}, venues as ({_VENUES}), first as (select query_id, doc as id, score, row_number() over (partition by query_id order by score desc, doc) as fused_rank from scored qualify fused_rank <= 20),
criteria as (select query_id, id, fused_rank, coalesce(l.quality, 0)::double as raw, greatest(0.0, least(1.0, (id % 35) / 34.0::double)) as recency, authority from first join documents d on d.doc_id = id join venues on venue = d.source left join labels l on l.doc_id = id),
normal as (select *, case when count(*) over w = 1 then raw when max(raw) over w - min(raw) over w < 1e-9 then 1.0 else (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) end as relevance from criteria window w as (partition by query_id)),
final as (select query_id, id, round(relevance * 0.6::double + recency * 0.25::double + authority * 0.15::double, 6) as rerank_score from normal)
select query_id, id, rerank_score, row_number() over (partition by query_id order by rerank_score desc, id)::int as rerank_rank from final qualify rerank_rank <= 5
""")  # fmt: skip
def rerank_multicriteria(spark, sf_dir):
    found = bm25.search(_index(spark, sf_dir), _queries(spark, sf_dir), 20).withColumnRenamed("doc", "id").withColumnRenamed("rank", "fused_rank")
    articles = _articles(spark, sf_dir)
    known = rerank.venue_authority(articles).select(F.col("venue").alias("journal"), F.col("authority").alias("known"))
    rows = found.join(articles.select(F.col("doc_id").alias("id"), "journal", "pub_year"), "id").join(known, "journal", "left").join(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    rows = rows.withColumn("relevance", F.coalesce("quality", F.lit(0)).cast("double")).withColumn("recency", rerank.recency(F.col("pub_year"))).withColumn("authority", rerank.authority(F.col("journal"), F.col("known")))
    return rerank.rerank(rows).select("query_id", "id", "rerank_score", "rerank_rank")


# ---- context


def _results(spark, sf_dir) -> DataFrame:
    """The 12 best documents of each item with what a context needs."""
    found = bm25.search(_index(spark, sf_dir), _queries(spark, sf_dir), 12).select("query_id", F.col("doc").alias("id"), F.col("score").alias("fused_score"))
    rows = found.join(_articles(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "journal", "pub_year"), "id")
    return rows.withColumn("doc_id", F.col("journal")).withColumn("source", F.col("id").cast("string"))


_FIRST = f"with {_BM25}, first as (select query_id, doc as id, score, row_number() over (partition by query_id order by score desc, doc) as r from scored qualify r <= 12), rows as (select first.*, d.source, d.text from first join documents d on d.doc_id = id), ranked as (select *, row_number() over (partition by query_id, source order by score desc, id) as n from rows), chosen as (select query_id, id, source, text, n, round(score * pow(0.6, n - 1), 6) as diverse_score from ranked where n <= 3)"


_UNIQUE = f"""
with recursive {_BM25}, best as (select query_id, doc as id, score, row_number() over (partition by query_id order by score desc, doc) as r from scored qualify r <= 12),
flat as (select best.*, d.source, d.text, regexp_replace(lower(coalesce(d.text, '')), '\\s+', '', 'g') as t from best join documents d on d.doc_id = id),
sets as (select *, case when length(t) > 4 then list_distinct(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4))) when length(t) > 0 then [t] else [] end as s from flat),
walk(query_id, r, kept, uniq) as (
  select distinct query_id, 0::bigint, []::varchar[][], []::bigint[] from sets
  union all
  select query_id, r + 1, case when copy then kept else list_append(kept, s) end, case when copy then uniq else list_append(uniq, id) end from (
    select w.query_id, w.r, w.kept, w.uniq, x.s, x.id, len(list_filter(w.kept, lambda k: len(list_intersect(k, x.s)) > 0 and len(list_intersect(k, x.s)) / (len(k) + len(x.s) - len(list_intersect(k, x.s)))::double >= {L.DEDUP_THRESHOLD})) > 0 as copy
    from walk w join sets x on x.query_id = w.query_id and x.r = w.r + 1)
),
uniques as (select query_id, unnest(uniq) as id from (select * from walk qualify row_number() over (partition by query_id order by r desc) = 1))"""


@_register("dedup_greedy", f"{_UNIQUE} select query_id, id, score as relevance_score from sets join uniques using (query_id, id)")
def dedup_greedy(spark, sf_dir):
    return context.greedy_dedup(context.context_rows(_results(spark, sf_dir))).select("query_id", "id", "relevance_score")


@_register("diversity_select", f"{_FIRST} select query_id, id, n::int as source_rank, diverse_score, row_number() over (partition by query_id order by diverse_score desc, id)::int as position from chosen")
def diversity_select(spark, sf_dir):
    return context.diversify(context.context_rows(_results(spark, sf_dir))).select("query_id", "id", "source_rank", "diverse_score", "position")


@_register("context_budget", f"""
{_FIRST}, placed as (select *, row_number() over (partition by query_id order by diverse_score desc, id) as position from chosen),
blocks as (select query_id, id, position, floor(length('[' || position || '] 来源: ' || id || '（' || (1992 + id % 35) || ' / ' || source || '）' || chr(10) || trim(text) || chr(10)) as chars, '[' || position || '] 来源: ' || id || '（' || (1992 + id % 35) || ' / ' || source || '）' || chr(10) || trim(text) || chr(10) as block from placed),
costed as (select query_id, id, position, (floor((2 / 1.57::double + (length(block) - 2) / 5.03::double) * 1.3) + 1)::bigint as tokens from blocks)
select query_id, id, position::int as position, tokens from (select *, sum(tokens) over (partition by query_id order by position) as upto from costed) where upto <= 2500
""".replace("floor(length('[' || position || '] 来源: ' || id || '（' || (1992 + id % 35) || ' / ' || source || '）' || chr(10) || trim(text) || chr(10)) as chars, ", ""))  # fmt: skip
def context_budget(spark, sf_dir):
    chosen = context.diversify(context.context_rows(_results(spark, sf_dir)))
    return context.fill_budget(chosen).where("not truncated").select("query_id", "id", "position", "tokens")


def _estimate(text: str) -> str:
    wide = f"len(regexp_extract_all({text}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'))"
    return f"(case when length({text}) > 0 then floor(({wide} / 1.57::double + (length({text}) - {wide}) / 5.03::double) * 1.3) + 1 else 0 end)::bigint"


def _truncated(text: str, budget: str) -> str:
    """``text`` cut to about ``budget`` estimated tokens, at a sentence end if there is one."""
    share = f"(len(regexp_extract_all({text}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'))::double / greatest(length({text}), 1))"
    keep = f"floor(({budget}) * (1.57::double * {share} + 5.03::double * (1 - {share})) / 1.3::double)::int"
    head = f"substring({text}, 1, greatest({keep}, 0))"
    whole = f"regexp_extract({head}, '(?s)^(.*[.!?。！？；;])', 1)"
    return f"(case when {_estimate(text)} <= ({budget}) then {text} when {keep} <= 0 then '' when {whole} <> '' then {whole} else rtrim({head}) end)"


_ASSEMBLED = f"""{_UNIQUE},
ranked as (select query_id, id, s.source, s.text, s.score, row_number() over (partition by query_id, s.source order by s.score desc, id) as n from sets s join uniques using (query_id, id)),
chosen as (select *, round(score * pow(0.6, n - 1), 6) as diverse_score from ranked where n <= 3),
placed as (select *, row_number() over (partition by query_id order by diverse_score desc, id) as position from chosen),
headed as (select *, '[' || position || '] 来源: ' || id || '（' || (1992 + id % 35) || ' / ' || source || '）' as header, trim(text) as body from placed),
blocks as (select *, header || chr(10) || body || chr(10) as block from headed), costed as (select *, {_estimate("block")} as tokens from blocks),
summed as (select *, {L.MAX_TOKENS} - (sum(tokens) over (partition by query_id order by position) - tokens)::bigint as room from costed),
cuts as (select *, tokens <= room as fits, case when tokens > room and room >= {L.MIN_CHUNK_TOKENS} then trim({_truncated("body", f"room - {_estimate('header')} - 1")}) end as cut from summed),
shortened as (select *, case when coalesce(cut, '') <> '' then header || chr(10) || cut || chr(10) end as shorter from cuts),
used as (select *, case when fits then block when shorter is not null and {_estimate("shorter")} <= room then shorter end as final from shortened),
texts as (select query_id, trim(string_agg(final, chr(10) order by position)) as context_text, count(final) as n_selected, count(*) as n_chosen from used group by query_id),
assembled as (select query_id, coalesce(context_text, '') as context_text, r.n as n_retrieved, n_selected, r.n - u.n as dropped_by_dedup, u.n - n_chosen as dropped_by_diversity, n_chosen - n_selected as dropped_by_budget
  from texts join (select query_id, count(*) as n from sets group by query_id) r using (query_id) join (select query_id, count(*) as n from uniques group by query_id) u using (query_id))"""


@_register("context_truncated", f"{_ASSEMBLED} select query_id, id, position::int as position, {_estimate('final')} as tokens, not fits as truncated, md5(final) as block from used where final is not null")
def context_truncated(spark, sf_dir):
    """The rows of each context with the one that is cut."""
    chosen = context.diversify(context.greedy_dedup(context.context_rows(_results(spark, sf_dir))))
    return context.fill_budget(chosen).select("query_id", "id", "position", "tokens", "truncated", F.md5("block").alias("block"))


@_register("context_assembled", f"{_ASSEMBLED} select * from assembled")
def context_assembled(spark, sf_dir):
    return context.assemble(_results(spark, sf_dir)).drop("selected")


@_register("source_stats", f"""
{_FIRST}, per as (select query_id, source, count(*) as n from chosen group by all)
select query_id, sum(n)::bigint as n_chunks, count(*) as unique_docs, (select min(1992 + id % 35)::varchar from chosen c where c.query_id = per.query_id) as year_min, (select max(1992 + id % 35)::varchar from chosen c where c.query_id = per.query_id) as year_max from per group by query_id
""")  # fmt: skip
def source_stats(spark, sf_dir):
    return context.source_stats(context.diversify(context.context_rows(_results(spark, sf_dir)))).select("query_id", "n_chunks", "unique_docs", "year_min", "year_max")


def _rendered(stage: str, **values: str) -> str:
    """The first 200 characters of a stage's prompt, which the echoing generator replies."""
    text = generate.STAGES[stage].template
    parts = "'" + text.replace("'", "''") + "'"
    for name, value in values.items():
        parts = parts.replace("{" + name + "}", f"' || {value} || '")
    return f"trim(left({parts}, 200))"


_ANSWERS = f"""{_ASSEMBLED}, asked as (select a.query_id, context_text as ctx, coalesce(b.text, '') as q, trim(context_text) <> '' as has from assembled a join benchmark b on b.item_id = a.query_id),
judged as (select *, case when has then {_rendered("evidence_evaluator", context="ctx", question="q")} else '' end as evaluation from asked),
drafted as (select *, case when has then {_rendered("answer_generator", context="ctx", question="q", evidence_assessment="evaluation")} else '' end as draft from judged),
reviewed as (select *, case when draft <> '' then {_rendered("critical_reviewer", context="ctx", question="q", draft_answer="draft")} else '' end as review from drafted),
finished as (select *, case when review <> '' then {_rendered("final_assembler", context="ctx", question="q", draft_answer="draft", review="review", disclaimer="'" + generate.DISCLAIMER.replace("'", "''") + "'")} else '' end as final from reviewed),
lined as (select *, list_transform(string_split(case when final <> '' then final else draft end, chr(10)), lambda x: rtrim(x, ' ' || chr(9))) as l from finished),
tidied as (select *, regexp_replace(trim(array_to_string(list_filter(l, lambda x, i: x <> '' or (i > 1 and l[i - 1] <> '')), chr(10)), ' ' || chr(9) || chr(10)), '【\\s*(\\d+)\\s*】', '[\\1]', 'g') as body from lined)"""


@_register("generated_answers", f"""{_ANSWERS}
select query_id, case when not has then '' when contains(body, '{generate.DISCLAIMER}') then body else body || chr(10) || chr(10) || '{generate.DISCLAIMER}' end as answer, case when not has then 'empty context' when review <> '' and final = '' then 'no final text, draft kept' end as warning from tidied
""")  # fmt: skip
def generated_answers(spark, sf_dir):
    built = context.assemble(_results(spark, sf_dir))
    return generate.answer(built.join(_queries(spark, sf_dir).withColumnRenamed("text", "question"), "query_id")).select("query_id", "answer", "warning")


@_register("evidence_filter", f"""
{_FIRST}, placed as (select query_id, id, row_number() over (partition by query_id order by diverse_score desc, id)::int as position from chosen),
flagged as (select *, case query_id % 3 when 0 then position in (1, 3) else false end as usable from placed), known as (select *, bool_or(usable) over (partition by query_id) as has from flagged)
select query_id, id, position, case when has then 'filtered' when query_id % 3 < 2 then 'ids not in context, all kept' else 'no usable ids, all kept' end as filter_note from known where usable or not has
""")  # fmt: skip
def evidence_filter(spark, sf_dir):
    rows = context.diversify(context.context_rows(_results(spark, sf_dir)))
    ids = F.when(F.col("query_id") % 3 == 0, F.array(F.lit(1), F.lit(3))).when(F.col("query_id") % 3 == 1, F.array(F.lit(99)))
    return generate.filter_context(rows, _queries(spark, sf_dir).select("query_id", ids.alias("ids"))).select("query_id", "id", "position", "filter_note")


@_register("corpus_copies", r"""
with recursive worded as (select doc_id, n_chars, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents),
own as (select row_number() over (order by n_chars desc, doc_id) as r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from worded),
firsts as (select list_sort(s) as s, min(r) as r from own where len(s) > 0 group by all),
shingles as (select r, len(s) as n, unnest(s) as x from firsts),
alike as (select b.r, a.r as before from shingles a join shingles b on a.x = b.x and a.r < b.r group by b.r, a.r having count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
asked as (select r, list(before) as befores, row_number() over (order by r) as n from alike group by r),
gone as (select 0::bigint as n, []::bigint[] as out union all
  select a.n, case when len(list_filter(a.befores, lambda x: not list_contains(g.out, x))) > 0 then list_append(g.out, a.r) else g.out end from gone g join asked a on a.n = g.n + 1),
last as (select out from gone order by n desc limit 1)
select doc_id, len(s) = 0 or (own.r in (select r from firsts) and not list_contains(last.out, own.r)) as unique from own, last
""")  # fmt: skip
def corpus_copies(spark, sf_dir):
    """Every document against all others, the longest first."""
    return context.similar_rows_dropped(_table(spark, sf_dir, "documents").withColumn("score", F.col("n_chars").cast("double")), 0.8, "doc_id", "score", shingles=T.word_runs)


_SPLIT = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> '')"


@_register("grounded_answers", f"""
{_FIRST}, placed as (select query_id, coalesce(text, '') as text, row_number() over (partition by query_id order by diverse_score desc, id)::int as position from chosen),
asked as (select item_id as query_id, list_distinct({_SPLIT.format("coalesce(text, '')")}) as w from benchmark),
covered as (select p.*, w, len(list_intersect(w, {_SPLIT.format("p.text")})) as c from placed p join asked using (query_id)),
judged as (select *, c > 0 and 2 * c >= max(c) over (partition by query_id) as usable from covered),
kept as (select *, bool_or(usable) over (partition by query_id) as has from judged),
sentences as (select query_id, position, w, i, regexp_replace(trim(string_split(trim(text), '. ')[i], ' ' || chr(10) || chr(9) || chr(13)), '\\s+', ' ', 'g') as s from kept, unnest(range(1, len(string_split(trim(text), '. ')) + 1)) as t(i) where usable or not has),
best as (select *, len(list_intersect(w, {_SPLIT.format("s")})) as c from sentences where s <> '' qualify row_number() over (partition by query_id, position order by len(list_intersect(w, {_SPLIT.format("s")})) desc, i) = 1),
drafted as (select * from best qualify row_number() over (partition by query_id, s order by position) = 1),
reviewed as (select *, 2 * c >= max(c) over (partition by query_id) as stays from drafted),
used as (select query_id, string_agg(position::varchar, ',' order by position) filter (where usable) as usable from kept group by query_id)
select query_id, coalesce(any_value(u.usable), '') as usable, string_agg(s || ' [' || position || ']', chr(10) order by position) as draft, string_agg(s || ' [' || position || ']', chr(10) order by position) filter (where stays) as final
from reviewed join used u using (query_id) group by query_id
""")  # fmt: skip
def grounded_answers(spark, sf_dir):
    """Quoted answers: what the evaluation calls usable decides what is quoted, and the review which lines stay."""
    rows = context.diversify(context.context_rows(_results(spark, sf_dir)))
    header = context.block_header(F.col("position"), F.col("source"), F.col("pub_year").cast("string"), F.col("journal"))
    evidence = rows.select("query_id", "position", F.concat(header, F.lit("\n"), F.trim(T.text_of("text")), F.lit("\n")).alias("block"))
    found = generate.grounded_answers(evidence, _queries(spark, sf_dir).withColumnRenamed("text", "question"))
    return found.select("query_id", F.array_join(F.array_sort("ids"), ",").alias("usable"), "draft", "final")


@_register("evidence_from_replies", ORACLE_SQL["evidence_filter"])
def evidence_from_replies(spark, sf_dir):
    """As evidence_filter, with the ids read from replies: JSON, fenced JSON, JSON in prose with other quotes, and one that says nothing."""
    rows = context.diversify(context.context_rows(_results(spark, sf_dir)))
    usable = F.get(F.array(F.lit('{"usable_ids": [1, "3"]}'), F.lit('<think>{</think>```json\n{"usable_ids": [1, 3]}\n```'), F.lit("Well, “this”: {'usable_ids': [1, 3,]} is it.")), (F.floor(F.col("query_id") / 3) % 3).cast("int"))
    reply = F.when(F.col("query_id") % 3 == 0, usable).when(F.col("query_id") % 3 == 1, F.lit('{"usable_ids": [99]}')).otherwise(F.lit("I can't tell."))
    told = generate.evaluations(_queries(spark, sf_dir).select("query_id", reply.alias("reply")))
    return generate.filter_context(rows, told).select("query_id", "id", "position", "filter_note")


# ---- the rest


@_register("anti_join_new_ids", "select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def anti_join_new_ids(spark, sf_dir):
    return filters.new_ids(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"))


@_register("topic_quota", """
with recursive fresh as (select doc_id, source, lang from documents where doc_id not in (select doc_id from labels)),
wishes as (select doc_id, 2 * (hash_of % 7) as topic_idx, doc_id as pos from (select *, substr(source, 4)::int as hash_of from fresh) union all select doc_id, 2 * (doc_id % 5) + 1, -doc_id from fresh union all select doc_id, 20 + (doc_id % 3), doc_id from fresh),
topics as (select topic_idx, list(doc_id order by pos, doc_id) as ids, row_number() over (order by topic_idx) as n from wishes group by topic_idx),
taken as (
  select 0::bigint as n, -1::bigint as topic_idx, []::bigint[] as own, []::bigint[] as every
  union all
  select t.n, t.topic_idx, list_filter(t.ids, lambda i: not list_contains(s.every, i))[1:least(20, greatest(0, 200 - len(s.every)))], list_concat(s.every, list_filter(t.ids, lambda i: not list_contains(s.every, i))[1:least(20, greatest(0, 200 - len(s.every)))])
  from taken s join topics t on t.n = s.n + 1
)
select topic_idx, unnest(own) as doc_id, unnest(range(1, len(own) + 1))::int as topic_rank from taken where len(own) > 0
""")  # fmt: skip
def topic_quota(spark, sf_dir):
    """Every new document stands in three topics, so full ones send it on."""
    fresh = filters.new_ids(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "source")
    topics = [(2 * (F.substr("source", F.lit(4)).cast("int") % 7), F.col("doc_id")), (2 * (F.col("doc_id") % 5) + 1, -F.col("doc_id")), (20 + F.col("doc_id") % 3, F.col("doc_id"))]
    wishes = fresh.select("doc_id", F.explode(F.array(*(F.struct(t.cast("long").alias("topic_idx"), p.alias("pos")) for t, p in topics))).alias("x")).select("doc_id", "x.*")
    return filters.topic_quota(wishes, 20, 200).select("topic_idx", "doc_id", "topic_rank")


@_register("latest_version", "select o_custkey as key, max(struct_pack(d := o_orderdate, k := o_orderkey)).k as latest from orders group by o_custkey")
def latest_version(spark, sf_dir):
    found = io.latest_versions(_table(spark, sf_dir, "orders"), F.col("o_custkey"), F.struct("o_orderdate", "o_orderkey"))
    return found.select("key", F.col("latest.o_orderkey").alias("latest"))


@_register("turn_context", """
select conv_id, turn, role, lag(role) over w as previous_role, sum(length(coalesce(text, ''))) over (partition by conv_id order by turn rows unbounded preceding)::bigint as chars_so_far from conversations window w as (partition by conv_id order by turn)
""")  # fmt: skip
def turn_context(spark, sf_dir):
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", F.lag("role").over(own).alias("previous_role"), F.sum(F.length(T.text_of("text"))).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("chars_so_far"))


@_register("random_sample", "select doc_id from documents order by md5(doc_id::varchar || '42'), doc_id limit 20")
def random_sample(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("42"))), "doc_id").limit(20)


@_register("text_checksums", "select doc_id, md5(text) as digest, length(text) as n_chars, strlen(text)::int as n_bytes, len(string_split(text, chr(10)))::int as n_lines from documents")
def text_checksums(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.size(F.split("text", "\n")).alias("n_lines"))


@_register("term_hits", "select doc_id, (contains(lower(text), 'licen') or contains(lower(text), 'password')) as hit from documents")
def term_hits(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.any_term(F.col("text"), ["licen", "PASSWORD"]).alias("hit"))


@_register("experiment_compare", """
with scores as (select lang as setting, source as query_id, avg(n_chars) as score from documents group by all),
best as (select query_id, first(setting order by score desc, setting) as setting from scores group by query_id), wins as (select setting, count(*) as wins from best group by setting),
means as (select setting, count(distinct query_id) as n_queries, round(avg(score), 6) as mean_score from scores group by setting)
select setting, n_queries, mean_score, round(mean_score - max(mean_score) over (), 6) as delta, coalesce(wins, 0) as wins from means left join wins using (setting)
""")  # fmt: skip
def experiment_compare(spark, sf_dir):
    scores = _table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("setting"), F.col("source").alias("query_id")).agg(F.avg("n_chars").alias("score"))
    return experiments.compare(scores)


@_register("filter_compliance", "select source, round(avg(case when lang = 'en' then 1.0 else 0 end), 6) as compliance from documents group by source")
def filter_compliance(spark, sf_dir):
    return experiments.compliance(_table(spark, sf_dir, "documents"), F.col("lang") == "en", "source")


@_register("chunk_renumber", f"""
with chunks as ({_CHUNKS}), kept as (select doc_id, chunk_index as old_index from chunks where token_count >= 100),
numbered as (select *, (row_number() over (partition by doc_id order by old_index) - 1)::int as chunk_index, count(*) over (partition by doc_id)::int as total_chunks from kept)
select doc_id, old_index, chunk_index, total_chunks, doc_id || '_' || lpad(chunk_index::varchar, greatest(4, length(chunk_index::varchar))::int, '0') as chunk_id from numbered
""")  # fmt: skip
def chunk_renumber(spark, sf_dir):
    kept = chunk.word_windows(_table(spark, sf_dir, "documents"), 128, 16).where("token_count >= 100").withColumn("old_index", F.col("chunk_index"))
    return chunk.renumber(kept).select("doc_id", "old_index", "chunk_index", "total_chunks", "chunk_id")


@_register("metadata_normalized", "select doc_id, coalesce(quality::varchar, '') as quality, coalesce(lang, '') as lang from documents left join labels using (doc_id)")
def metadata_normalized(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "lang")
    return io.normalized_metadata(own, ["quality", "lang"])


def _embedded(table: str, key: str) -> str:
    """(key, embedding) by the hashing embedder: signed sums of the words' hashes, at unit length in single precision."""
    return f"""(
  with words as (select {key}, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) as w from {table}),
  hashed as (select {key}, ('0x' || left(md5(w), 8))::ubigint as h from words), summed as (select {key}, (h % 64)::int as d, sum(case when h >= 2147483648 then 1 else -1 end)::int as v from hashed group by all),
  sized as (select {key}, sqrt(sum(v * v))::real as size from summed group by {key})
  select t.{key}, list(case when coalesce(size, 0) > 0 then (coalesce(v, 0)::real / size)::real else 0::real end order by n.d) as embedding from (select distinct {key} from {table}) t cross join (select unnest(range(64))::int as d) n left join summed s on s.{key} = t.{key} and s.d = n.d left join sized z on z.{key} = t.{key} group by t.{key})"""


#: The items have no names of the lexicon and ask for no years: their own text is the vector path and, as no keywords come of it, the keyword path.
_HYBRID = f"""with q as {_embedded("benchmark", "item_id")}, v as {_embedded("documents", "doc_id")},
near as (select q.item_id as query_id, v.doc_id as chunk_id, row_number() over (partition by q.item_id order by coalesce({_COSINE}, 0) desc, v.doc_id) as rank from q, v qualify rank <= 20), {_BM25},
lists as (select query_id, chunk_id, 0 as path, rank from near union all select query_id, doc, 3, row_number() over (partition by query_id order by score desc, doc) as rank from scored qualify rank <= 20),
fused as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 6) as fused_score, count(*)::bigint as n_paths, min(path * 1000 + rank) as seen from lists group by all),
found as (select query_id, chunk_id, fused_score, n_paths, row_number() over (partition by query_id order by fused_score desc, seen, chunk_id)::int as fused_rank from fused)"""


def _retriever(spark, sf_dir) -> Retriever:
    """Over the written index of the documents and their vectors, written once too."""
    chunks = _articles(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", "doc_id", "journal", F.col("pub_year").cast("string").alias("pub_year"), "lang", T.is_table(T.text_of("text")).alias("is_table"))
    spread = chunks.repartition(parts(spark, f"{sf_dir}/documents.parquet"), "chunk_id")
    path = made_once(spark, ("vectors", sf_dir), lambda path: Retriever.embedded(spread, path), f"{sf_dir}/documents.parquet")
    return Retriever(chunks, _index(spark, sf_dir), vector.read_store(spark, path, "embedder").select("chunk_id", "embedding"))


@_register("retrieved_candidates", f"{_HYBRID} select * from found")
def retrieved_candidates(spark, sf_dir):
    return _retriever(spark, sf_dir).retrieve(_queries(spark, sf_dir)).select("query_id", "chunk_id", "fused_score", "n_paths", "fused_rank")


@_register("search_results", f"""
{_HYBRID}, venues as ({_VENUES}), asked as (select item_id as query_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) as w from benchmark),
criteria as (select query_id, chunk_id, fused_rank, d.text, case when len(w) > 0 then len(list_intersect(w, string_split_regex(lower(coalesce(d.text, '')), '\\s+')))::double / len(w) else 0.0 end as raw, greatest(0.0, least(1.0, (chunk_id % 35) / 34.0::double)) as recency, authority
  from found join documents d on d.doc_id = chunk_id join venues on venue = d.source join asked using (query_id) where fused_rank <= 20),
normal as (select *, case when count(*) over w = 1 then raw when max(raw) over w - min(raw) over w < 1e-9 then 1.0 else (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) end as relevance from criteria window w as (partition by query_id)),
final as (select query_id, chunk_id, left(text, 400) as snippet, round(relevance * 0.6::double + recency * 0.25::double + authority * 0.15::double, 6) as rerank_score from normal)
select query_id, chunk_id, rerank_score, row_number() over (partition by query_id order by rerank_score desc, chunk_id)::int as rerank_rank, snippet from final qualify rerank_rank <= 5
""")  # fmt: skip
def search_results(spark, sf_dir):
    return _retriever(spark, sf_dir).search(_queries(spark, sf_dir)).select("query_id", "chunk_id", "rerank_score", "rerank_rank", "snippet")


@_register("embedded_items", f"with q as {_embedded('benchmark', 'item_id')} select item_id as query_id, len(embedding)::int as dim, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as norm, round(list_sum(list_transform(range(1, 65), lambda i: i * embedding[i]::double)), 3) as moment from q")
def embedded_items(spark, sf_dir):
    moment = F.aggregate(F.transform("embedding", lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return models.embed(_queries(spark, sf_dir)).select("query_id", F.size("embedding").alias("dim"), F.round(vector.norm(F.col("embedding")), 4).alias("norm"), F.round(moment, 3).alias("moment"))


from quern.plans import stores, written  # noqa: E402, F401  their queries are registered here
