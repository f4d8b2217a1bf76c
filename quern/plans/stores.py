"""Queries that write tables in every format, read them again, and go on from what is written; and the same in SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import bm25, chunk, context, filters, fusion, generate, models, profile, rerank, vector
from quern.plans import experiments
from quern.plans.catalogue import _BM25, _COSINE, _FIRST, _WORDS, _articles, _index, _paths, _queries, _register, _results, _table, _vector_queries, _vectors
from quern.sources import io, pages, remote
from quern.sources.shared import shared_folder
from quern.streaming import incremental


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _documents(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


_PLAIN = "select doc_id::varchar as doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, md5(coalesce(text, '')) as text from documents"


@_register("csv_round_trip", _PLAIN)
def csv_round_trip(spark, sf_dir):
    io.write_csv(_documents(spark, sf_dir), path := _folder(spark, "csv"), bom=True)
    return io.read_text_csv(spark, path).withColumn("text", F.md5("text"))


@_register("jsonl_round_trip", "select doc_id, lang, source, md5(text) as text from documents")
def jsonl_round_trip(spark, sf_dir):
    own = _documents(spark, sf_dir)
    io.write_jsonl(own, path := _folder(spark, "jsonl"))
    return spark.read.schema(own.schema).json(path).withColumn("text", F.md5("text"))


@_register("parquet_round_trip", "select doc_id, lang, source, md5(text) as text from documents")
def parquet_round_trip(spark, sf_dir):
    io.write_parquet(_documents(spark, sf_dir), path := _folder(spark, "parquet"))
    return spark.read.parquet(path).withColumn("text", F.md5("text"))


@_register("log_appended", "select lang, (2 * count(*))::bigint as n from documents group by lang")
def log_appended(spark, sf_dir):
    rows, path = _documents(spark, sf_dir).select("doc_id", "lang"), _folder(spark, "log")
    for _ in range(2):
        io.append_log(rows, path)
    return io.read_text_csv(spark, path).groupBy("lang").agg(F.count("*").alias("n"))


@_register("stats_written", "select count(*) as n, sum(length(text))::bigint as n_chars, count(distinct source) as n_sources from documents")
def stats_written(spark, sf_dir):
    stats = _documents(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.count_distinct("source").alias("n_sources"))
    io.write_stats(stats, path := _folder(spark, "stats"))
    return spark.read.schema(stats.schema).json(path)


@_register("missing_file", "select doc_id, lang, null::varchar as note from documents")
def missing_file(spark, sf_dir):
    """Documents with the notes of a file that isn't there."""
    notes = io.read_or_empty(spark, _folder(spark, "nothing") + ".csv", "doc_id long, note string")
    return _documents(spark, sf_dir).select("doc_id", "lang").join(notes, "doc_id", "left")


@_register("searched_sources", "select source as query, row_number() over (partition by source order by doc_id)::int as pos, doc_id::varchar as id from documents where source is not null qualify pos <= 50")
def searched_sources(spark, sf_dir):
    """A search for each source, a partition each, over replies recorded from the documents."""
    pages.register(spark)
    docs = _documents(spark, sf_dir).where("source is not null")
    names = [r.source for r in docs.select("source").distinct().orderBy("source").limit(1000).collect()]
    urls = spark.createDataFrame([(x, remote.search_url(x, 50)) for x in names], "source string, url string")
    ranked = docs.select("source", "doc_id").withColumn("pos", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("pos <= 50")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("doc_id").cast("string").alias("id")))), lambda x: x["id"])
    body = F.to_json(F.struct(F.struct(F.col("ids").alias("idlist")).alias("esearchresult")))
    pages.record(ranked.groupBy("source").agg(ids.alias("ids")).join(urls, "source").select("url", body.alias("body")), path := _folder(spark, "pages"))
    return spark.read.format("article_search").option("over", json.dumps(names)).option("most", 50).option("pages", path).load()


@_register("listed_versions", """
with own as (select 'p' || left(o_orderpriority, 1) || '/' as prefix, o_orderkey from orders)
select prefix, prefix || 'v.' || o_orderkey || '/' as folder, o_orderkey = max(o_orderkey) over (partition by prefix) as latest from own
""")  # fmt: skip
def listed_versions(spark, sf_dir):
    """A listing for each priority, whose orders stand for versions, in pages that name the next one; the latest has the largest number at its end."""
    pages.register(spark)
    a_page = 5000
    orders = _table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1)), F.lit("/")).alias("prefix"), "o_orderkey", F.floor(F.col("o_orderkey") / a_page).alias("page"))
    last = orders.groupBy("prefix").agg(F.max("page").alias("last"))
    prefixes = [r.prefix for r in last.select("prefix").orderBy("prefix").limit(1000).collect()]
    urls = spark.createDataFrame([(x, remote.listing_url("own", x)) for x in prefixes], "prefix string, start string")
    every = last.select("prefix", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("page"))
    entry = F.concat(F.lit("<CommonPrefixes><Prefix>"), F.col("prefix"), F.lit("v."), F.col("o_orderkey").cast("string"), F.lit("/</Prefix></CommonPrefixes>"))
    bodies = orders.groupBy("prefix", "page").agg(F.array_join(F.collect_list(entry), "").alias("entries"))
    following = F.when(F.col("page") < F.col("last"), F.concat(F.lit("<NextContinuationToken>"), (F.col("page") + 1).cast("string"), F.lit("</NextContinuationToken>"))).otherwise("")
    url = F.when(F.col("page") == 0, F.col("start")).otherwise(F.concat("start", F.lit("&continuation-token="), F.col("page").cast("string")))
    replies = every.join(bodies, ["prefix", "page"], "left").join(urls, "prefix").select(url.alias("url"), F.concat(F.coalesce("entries", F.lit("")), following).alias("body"))
    pages.record(replies, path := _folder(spark, "pages"))
    return spark.read.format("prefix_listing").option("over", json.dumps(prefixes)).option("bucket", "own").option("pages", path).load()


@_register("article_files", """
select 'PMC' || item_id as pmcid, case when item_id % 4 = 0 then '' else 'Item ' || item_id end as title, case when item_id % 5 = 0 then '' else '12-' || item_id end as issn, (2000 + item_id % 20)::varchar as pub_year,
  case when item_id % 5 = 0 then 1 else length(text) + length('ISSN: 12-' || item_id) + 2 end::int as n_chars, case when item_id % 5 = 0 then 1 else len(string_split(text, chr(10))) + 2 end::int as n_lines, 0 as bad_bytes from benchmark
""".replace("case when item_id % 5 = 0 then 1 else length", "case when item_id % 5 = 0 then 0 else length"))  # fmt: skip
def article_files(spark, sf_dir):
    """A folder per item with its metadata, and for most with its text, read again and joined; items without a text keep their row."""
    items, path = _table(spark, sf_dir, "benchmark"), _folder(spark, "files")
    name = F.concat(F.lit("PMC"), F.col("item_id").cast("string"))
    texts = items.where("item_id % 5 <> 0").select(F.concat(name, F.lit(".2")).alias("folder"), F.concat(F.lit("ISSN: 12-"), F.col("item_id").cast("string"), F.lit("\n"), T.text_of("text")).alias("value"))
    texts.write.partitionBy("folder").text(f"{path}/texts")
    title = F.when(F.col("item_id") % 4 != 0, F.concat(F.lit("Item "), F.col("item_id").cast("string")))
    meta = items.select(name.alias("pmcid"), title.alias("title"), F.concat(F.lit("J "), (2000 + F.col("item_id") % 20).cast("string")).alias("citation"))
    meta.withColumn("folder", F.col("pmcid")).write.partitionBy("folder").json(f"{path}/metadata")
    found = io.read_texts(spark, f"{path}/texts/*/*.txt").withColumn("id", F.regexp_replace("id", "^folder=", ""))
    wide = io.wide_table(io.read_metadata(spark, f"{path}/metadata/*/*.json"), found)
    return wide.select("pmcid", "title", "issn", "pub_year", "n_chars", "n_lines", "bad_bytes")


@_register("checksums_verified", "select doc_id, case doc_id % 3 when 0 then true when 1 then false end as checksum_ok from documents")
def checksums_verified(spark, sf_dir):
    text = T.text_of("text").cast("binary")
    digest = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("&md5="), F.upper(F.md5(text)))).when(F.col("doc_id") % 3 == 1, F.lit("?md5=" + "0" * 32)).otherwise("")
    files = _documents(spark, sf_dir).select("doc_id", text.alias("content"), F.concat(F.lit("s3://b/k?versionId=1"), digest).alias("url"))
    return io.verified(files).select("doc_id", "checksum_ok")


@_register("url_helpers", "select page_id, 'https://b.s3.amazonaws.com/' || page_id || '/x' as https, (page_id % 10)::varchar as prefix, 'PMC' || page_id as pmc from pages")
def url_helpers(spark, sf_dir):
    i = F.col("page_id").cast("string")
    bucket = F.concat(F.lit("s3://b/"), i, F.lit("/x?md5=1"))
    return _table(spark, sf_dir, "pages").select("page_id", T.https_url(bucket).alias("https"), T.id_prefix(F.concat((F.col("page_id") % 10).cast("string"), F.lit("_a_b"))).alias("prefix"), T.pmc_id(F.concat(F.when(F.col("page_id") % 2 == 0, "pmc").otherwise(""), i)).alias("pmc"))


@_register("resumed_append", "select doc_id, md5(text) as text from documents where doc_id is not null")
def resumed_append(spark, sf_dir):
    """Half of the rows, then all of them: each is written once."""
    rows, path = _documents(spark, sf_dir).where("doc_id is not null").select("doc_id", F.md5("text").alias("text")), _folder(spark, "resumed")
    for part in (rows.where("doc_id % 2 = 0"), rows):
        incremental.append_missing(part, path, "doc_id")
    return spark.read.parquet(path)


@_register("resumed_vectors", "select item_id as query_id, 'b' as model, false as went_on from benchmark")
def resumed_vectors(spark, sf_dir):
    """Vectors of one model are gone on with, those of another are made anew."""
    items, path = _queries(spark, sf_dir), _folder(spark, "vectors")
    step = lambda name: lambda df: models.embed(df).select("query_id", F.lit(name).alias("model"), "embedding")
    incremental.append_stamped(items.where("query_id % 2 = 0"), path, "query_id", "a", step("a"))
    if not incremental.append_stamped(items, path, "query_id", "a", step("a")):
        raise AssertionError("what was there isn't gone on with")
    went_on = incremental.append_stamped(items, path, "query_id", "b", step("b"))
    return spark.read.parquet(f"{path}/rows").select("query_id", "model", F.lit(went_on).alias("went_on"))


@_register("index_saved", f"with {_BM25} select * from (select *, row_number() over (partition by query_id order by score desc, doc)::int as rank from scored) where rank <= 3")
def index_saved(spark, sf_dir):
    _index(spark, sf_dir).save(path := _folder(spark, "index"))
    return bm25.search(bm25.Index.load(spark, path), _queries(spark, sf_dir), 3)


@_register("vector_store", f"select q.vec_id as query_id, v.vec_id as doc, {_COSINE} as score, row_number() over (partition by q.vec_id order by {_COSINE} desc, v.vec_id)::int as rank from embeddings q, embeddings v where q.vec_id % 100 = 0 qualify rank <= 5")
def vector_store(spark, sf_dir):
    """Two batches, one of them written again, and a reset before the first."""
    own, path = _vectors(spark, sf_dir), _folder(spark, "store")
    vector.build_store(own.where("vec_id % 3 = 0"), path, "m", "stale")
    vector.build_store(own.where("vec_id % 2 = 0"), path, "m", "even", reset=True)
    for _ in range(2):
        held = vector.build_store(own.where("vec_id % 2 = 1"), path, "m", "odd")
    return vector.vector_search(_vector_queries(spark, sf_dir), held, 5)


@_register("embedded_batches", "select vec_id, label from embeddings")
def embedded_batches(spark, sf_dir):
    own, path = _vectors(spark, sf_dir), _folder(spark, "batches")
    for part in range(3):
        held = vector.build_store(own.where(F.pmod("vec_id", F.lit(3)) == part), path, "m", str(part))
    return held.select("vec_id", "label")


# ---- pairs, grids, samples and small operators


@_register("jaccard_pairs", f"""
{_FIRST}, flat as (select query_id, id, regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g') as t from rows),
sets as (select query_id, id, case when length(t) > 4 then list_distinct(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4))) when length(t) > 0 then [t] else [] end as s from flat)
select x.query_id, x.id as a, y.id as b, round(case when len(x.s) > 0 and len(y.s) > 0 then len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::double else 0 end, 6) as similarity from sets x join sets y on x.query_id = y.query_id and x.id < y.id
""")  # fmt: skip
def jaccard_pairs(spark, sf_dir):
    return experiments.similar_pairs(_results(spark, sf_dir), "query_id", "id")


@_register("budget_grid", f"""
{_FIRST}, placed as (select *, row_number() over (partition by query_id order by diverse_score desc, id) as position from chosen),
blocks as (select query_id, '[' || position || '] 来源: ' || id || '（' || (1992 + id % 35) || ' / ' || source || '）' || chr(10) || trim(text) || chr(10) as block, position from placed),
costed as (select query_id, position, (floor((2 / 1.57::double + (length(block) - 2) / 5.03::double) * 1.3) + 1)::bigint as tokens from blocks), summed as (select *, sum(tokens) over (partition by query_id order by position) as upto from costed)
select setting, query_id, count_if(upto <= setting::int)::bigint as n from summed, (values ('500'), ('1000'), ('2500')) t(setting) group by all having count_if(upto <= setting::int) > 0
""")  # fmt: skip
def budget_grid(spark, sf_dir):
    """All queries under several budgets: how many whole rows a context gets."""
    chosen = context.diversify(context.context_rows(_results(spark, sf_dir)))
    run = lambda budget: lambda rows: context.fill_budget(rows, budget).where("not truncated").groupBy("query_id").agg(F.count("*").alias("n"))
    return experiments.grid(chosen, {str(b): run(b) for b in (500, 1000, 2500)})


@_register("fusion_grid", "select item_id as query_id, s as setting from benchmark, (values ('rrf'), ('simple'), ('weighted')) t(s)")
def fusion_grid(spark, sf_dir):
    """Every item has a best candidate under every way to fuse."""
    settings = {name: lambda rows, f=f: f(rows).where("fused_rank = 1").select("query_id") for name, f in fusion.STRATEGIES.items()}
    return experiments.grid(_paths(spark, sf_dir), settings).select("query_id", "setting")


@_register("systematic_sample", """
with own as (select doc_id, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents) select doc_id from own where pos % greatest(1, n // 30) = 0 and pos < 30 * greatest(1, n // 30)
""")  # fmt: skip
def systematic_sample(spark, sf_dir):
    return experiments.systematic_sample(_documents(spark, sf_dir).select("doc_id"), "doc_id", 30)


@_register("trial_head", "select doc_id, lang from documents order by doc_id limit 25")
def trial_head(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", "lang").orderBy("doc_id").limit(25)


@_register("ordered_distinct", "select source, min(doc_id) as first_seen, (row_number() over (order by min(doc_id)))::int as place from documents group by source")
def ordered_distinct(spark, sf_dir):
    first = _documents(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("first_seen"))
    return profile.positions(first, "first_seen").select("source", "first_seen", (F.col("pos") + 1).cast("int").alias("place"))


@_register("hard_windows", f"""
with own as (select doc_id, {_WORDS} as w from documents), starts as (select doc_id, w, unnest(range(0, ((len(w) + 199) // 200)::int)) as s from own where len(w) > 0)
select doc_id, s::int as chunk_index, array_to_string(w[s * 200 + 1:s * 200 + 200], ' ') as text, len(w[s * 200 + 1:s * 200 + 200])::int as token_count from starts
""")  # fmt: skip
def hard_windows(spark, sf_dir):
    return chunk.word_windows(_documents(spark, sf_dir), 200, 0).select("doc_id", "chunk_index", "text", "token_count")


@_register("acronym_gates", """
select doc_id from documents where length(coalesce(lang, '')) > 1 and doc_id % 3 <> 0 and doc_id % 7 <> 1
""")  # fmt: skip
def acronym_gates(spark, sf_dir):
    """Names that are made to pass or to fail one gate each."""
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, "to no good").when(i % 7 == 1, "some 2nd name").otherwise("heart failure")
    return _documents(spark, sf_dir).where((F.length("lang") > 1) & filters.acronym_quality(F.lit(600), name)).select("doc_id")


@_register("scored_sigmoid", "select doc_id, round(1 / (1 + exp(-(length(coalesce(text, '')) / 1000.0::double - 2))), 6) as p from documents")
def scored_sigmoid(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.round(T.sigmoid(F.length(T.text_of("text")) / 1000 - 2), 6).alias("p"))


@_register("source_lines", f"""
{_FIRST}, placed as (select *, row_number() over (partition by query_id order by diverse_score desc, id) as position from chosen)
select query_id, string_agg('[' || position || '] ' || source || ' (' || (1992 + id % 35) || ' / ' || source || ')', chr(10) order by position) as sources from placed group by query_id
""")  # fmt: skip
def source_lines(spark, sf_dir):
    return generate.format_sources(context.diversify(context.context_rows(_results(spark, sf_dir))))


@_register("empty_contexts", "select item_id as query_id, '' as answer, 'empty context' as warning from benchmark")
def empty_contexts(spark, sf_dir):
    asked = _queries(spark, sf_dir).select("query_id", F.col("text").alias("question"), F.lit("  ").alias("context_text"))
    return generate.answer(asked).select("query_id", "answer", "warning")


@_register("generated_json", """select item_id as query_id, '{"id": ' || item_id || '}' as json, true as success from benchmark""")
def generated_json(spark, sf_dir):
    prompts = _queries(spark, sf_dir).select("query_id", F.concat(F.lit('{"id": '), F.col("query_id").cast("string"), F.lit("}, "), T.text_of("text")).alias("prompt"))
    done = generate.generate_json(prompts)
    return done.select("query_id", "json", F.col("result.success").alias("success"))


@_register("venue_rerank", "select source as venue, round(least(1.0, 0.4 + 0.6 * ln(1 + count(distinct doc_id)) / ln(1 + max(count(distinct doc_id)) over ())), 4)::double as authority from documents group by source")
def venue_rerank(spark, sf_dir):
    known = rerank.venue_authority(_articles(spark, sf_dir))
    return known.select("venue", rerank.authority(F.col("venue"), F.col("authority")).alias("authority"))


def corpus_report(spark, sf_dir: str, size: int = 128, overlap: int = 16) -> str:
    """Settings, documents, lengths, drops, chunks, chunks per document and flags of a corpus, as Markdown."""
    docs = _documents(spark, sf_dir)
    chunks = chunk.word_windows(docs, size, overlap)
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    lengths = docs.withColumn("n_chars", F.length(T.text_of("text")))
    sections = {
        "Settings": spark.createDataFrame([(size, overlap)], "size int, overlap int"),
        "Documents by language": profile.group_counts(docs, "lang").orderBy("lang"),
        "Lengths": profile.quantile_table(lengths, F.col("n_chars"), []),
        "Dropped": docs.agg(F.count_if(F.trim(T.text_of("text")) == "").alias("empty"), F.count("*").alias("all")),
        "Chunks": chunks.agg(F.count("*").alias("chunks"), F.min("token_count").alias("least"), F.round(F.avg("token_count"), 2).alias("mean"), F.max("token_count").alias("most")),
        "Chunks per document": per.agg(F.round(F.avg("n"), 2).alias("mean"), F.max("n").alias("most"), F.count_if(F.col("n") >= 3).alias("with_3_or_more")),
        "Flags": chunk.quality_issues(chunks, size).groupBy("issues").agg(F.count("*").alias("n")).orderBy("issues"),
    }
    return io.report(sections, "Corpus")


_REPORTED = ["Settings", "Documents by language", "Lengths", "Dropped", "Chunks", "Chunks per document", "Flags"]


@_register("report_sections", "select * from (values " + ", ".join(f"({i}, '{name}')" for i, name in enumerate(_REPORTED)) + ") t(place, section)")
def report_sections(spark, sf_dir):
    """The report written as a text, read again, and its sections in order."""
    text = corpus_report(spark, sf_dir)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path := _folder(spark, "report"))
    lines = io.read_texts(spark, f"{path}/*.txt").select(F.explode(F.filter(T.lines(F.col("text")), lambda x: x.startswith("## "))).alias("x"))
    return lines.withColumn("place", F.monotonically_increasing_id().cast("int")).select("place", F.substr("x", F.lit(4)).alias("section"))
