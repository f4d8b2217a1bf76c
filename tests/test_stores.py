from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import bm25, context, models, profile, vector
from quern.plans import catalogue, experiments
from quern.sources import io, remote
from quern.sources.shared import made_once, parts, shared_folder, stored
from quern.streaming import incremental


def test_listings_have_all_pages():
    pages = {"": "<CommonPrefixes><Prefix>a.1/</Prefix></CommonPrefixes><NextContinuationToken>t&amp;1</NextContinuationToken>", "t%261": "<CommonPrefixes><Prefix>a.2/</Prefix></CommonPrefixes>"}
    opener = lambda url, _: pages[url.partition("continuation-token=")[2]].encode()
    assert remote.list_prefixes("b", "a", opener) == ["a.1/", "a.2/"]


def test_the_next_way_to_fetch():
    def gone(i):
        raise OSError(i)

    fetch = io.first_that_works(gone, lambda i: (b"xml", i))
    assert fetch("1") == (b"xml", "1")
    with pytest.raises(OSError):
        io.first_that_works(gone, gone)("1")


def test_reports_say_what_they_leave_out(spark):
    text = io.report({"ids": spark.range(5).orderBy("id")}, "R", most=3)
    assert "| 2 |" in text and "| 3 |" not in text and "More than 3 rows" in text
    assert "More than" not in io.report({"ids": spark.range(3)}, "R", most=3)


def test_csv_keeps_white_space_and_drops_its_mark(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 'x\n"y", z\\'), ("é", None)], "k string, v string")
    io.write_csv(df, str(tmp_path / "c"), bom=True)
    assert sorted(map(tuple, io.read_text_csv(spark, str(tmp_path / "c")).collect())) == [(" a ", 'x\n"y", z\\'), ("é", "")]


def test_stamped_targets(spark, tmp_path):
    rows = spark.range(4).withColumnRenamed("id", "doc_id")
    went_on = [incremental.append_stamped(rows.where(f"doc_id < {n}"), str(tmp_path / "t"), "doc_id", stamp, lambda df, s=stamp: df.withColumn("m", F.lit(s))) for n, stamp in ((2, "a"), (4, "a"), (3, "b"))]
    assert went_on == [False, True, False]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t" / "rows")).collect())) == [(0, "b"), (1, "b"), (2, "b")]


def test_positions_and_strata(spark):
    df = spark.range(100).selectExpr("id as doc_id", "id % 7 as v").repartition(5)
    want = {r: i for i, r in enumerate(sorted((i % 7, i) for i in range(100)))}
    got = profile.positions(df, "v", "doc_id").collect()
    assert {(r.v, r.doc_id): r.pos for r in got} == want and {r.total for r in got} == {100}
    for parts in (1, 3, 7, 150):
        cuts = [100 * k // parts for k in range(1, parts)]
        assert {(r.v, r.doc_id): r.stratum for r in profile.strata(df, "v", parts=parts).collect()} == {k: sum(p >= c for c in cuts) for k, p in want.items()}
    assert profile.positions(df.where("false"), "v").count() == 0


def test_pairs_grid_and_latencies(spark):
    rows = spark.createDataFrame([(1, 1, "abcdef"), (1, 2, "abcdef"), (1, 3, "xyz"), (2, 1, "abcdef")], "q int, id int, text string")
    assert {tuple(r) for r in experiments.similar_pairs(rows, "q", "id").collect()} == {(1, 1, 2, 1.0), (1, 1, 3, 0.0), (1, 2, 3, 0.0)}
    assert experiments.similar_pairs(rows, "q", "id", threshold=0.5).count() == 1
    assert sorted(r.setting for r in experiments.grid(rows, {"x": lambda d: d.where("id = 1"), "y": lambda d: d.where("id = 3")}).collect()) == ["x", "x", "y"]
    ticks = iter([0.0, 1.0, 1.0, 4.0])
    got = experiments.latencies(lambda x: x, [1, 2], lambda: next(ticks))
    assert (got["n"], got["mean"], got["p50"], got["max"]) == (2, 2.0, 3.0, 3.0) and experiments.latencies(print, [])["n"] == 0


def test_filters_of_single_queries(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10], ["even" if i % 2 == 0 else "odd", f"n={i}"]) for i in range(10)], "vec_id long, embedding array<float>, tags array<string>")
    q = spark.createDataFrame([(1, [1.0, 0.0], [["odd"]]), (2, [1.0, 0.0], [["even"], ["n=4", "n=8"]]), (3, [1.0, 0.0], []), (4, [1.0, 0.0], [["none"]])], "query_id long, embedding array<float>, w array<array<string>>")
    got = {}
    for r in vector.vector_search(q, v, 2, where="w", tags="tags").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc)
    assert got == {1: [1, 3], 2: [4, 8], 3: [0, 1]}


def test_ties_in_blocks_of_vectors(spark):
    v = spark.range(6000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding")).repartition(3)
    q = v.where("vec_id = 17").withColumnRenamed("vec_id", "query_id")
    assert [r.doc for r in vector.vector_search(q, v, 4, keep_self=False).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_written_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, None), (4, "the")], "doc_id long, text string")
    built, saved = bm25.build_index(docs), bm25.saved_index(docs, str(tmp_path / "i"), partitions=2)
    assert (built.n_docs, built.average_length) == (saved.n_docs, saved.average_length)
    for name in ("postings", "terms", "docs"):
        columns = getattr(built, name).columns
        assert sorted(map(tuple, getattr(built, name).collect())) == sorted(map(tuple, getattr(saved, name).select(*columns).collect()))
    q = spark.createDataFrame([(1, "cat dog")], "query_id long, text string")
    assert bm25.search(built, q).collect() == bm25.search(saved, q).collect()


def test_contexts_are_assembled_without_python(spark, data):
    plan = context.assemble(catalogue._results(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_shared_tables(spark):
    calls = []
    make = lambda path: (calls.append(path), spark.range(3).write.parquet(path))
    assert made_once(spark, ("t", 1), make) == made_once(spark, ("t", 1), make) and len(calls) == 1
    assert calls[0].startswith(shared_folder(spark)) and stored(spark.range(2), "x").count() == 2


def test_half_way_cosines_round_as_in_sql(spark):
    """65/128 is 0.5078125, and a vector of these eighths has a length of exactly 1."""
    v = [(1, [65 / 128, 110 / 128, 7 / 128, 3 / 128, 1 / 128, 0.0]), (2, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    assert sum(x * x for x in v[0][1]) == 1.0
    vectors = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0] + [0.0] * 5), (8, [-1.0] + [0.0] * 5)], "query_id long, embedding array<float>")
    found = {(r.query_id, r.doc): r.score for r in vector.vector_search(queries, vectors, 2).collect()}
    assert found[7, 1] == 0.507813 and found[8, 1] == -0.507813 and found[7, 2] == 0.0


def test_embedding_of_a_long_text_has_the_exact_length():
    """4097 squared is beyond what a float holds exactly."""
    counts = [4097] * 3 + [5] * 7
    alone = {}
    for w in map("w{}".format, range(200)):
        alone.setdefault(int(np.flatnonzero(models.hashing_embedder()([w])[0])[0]), w)
    own = list(alone.values())[: len(counts)]
    text = " ".join(" ".join([w] * n) for w, n in zip(own, counts, strict=True))
    length = np.float32(np.sqrt(sum(n * n for n in counts)))
    assert sorted(np.abs(models.hashing_embedder()([text])[0]))[-10:] == sorted(np.float32(n) / length for n in counts)


def test_partitions_follow_the_size_of_a_table(spark, tmp_path):
    path, cores = f"{tmp_path}/a table", spark.sparkContext.defaultParallelism
    spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("x")).repartition(3).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "a table").iterdir() if not f.name.endswith(".crc"))
    assert parts(spark, path) == cores and parts(spark, path, size // 50) in (50, 51)


def test_index_is_built_in_as_many_parts_as_the_table_asks_for(spark, data, tmp_path, monkeypatch):
    seen = []
    keep = bm25.saved_index
    monkeypatch.setattr(catalogue, "parts", lambda *_: 37)
    monkeypatch.setattr(catalogue, "made_once", lambda spark, key, make, source: make(str(tmp_path)) or str(tmp_path))
    monkeypatch.setattr(bm25, "saved_index", lambda *a, **b: seen.append(b["partitions"]) or keep(*a, **b))
    catalogue._index(spark, data)
    assert seen == [37]


def test_scores_are_added_up_where_a_document_lies(spark, tmp_path):
    """Neither the postings nor their scores are shuffled: only the few best of each task."""
    docs = spark.createDataFrame([(i, f"cat w{i % 5} dog") for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "cat w3"), (2, "dog dog")], "query_id long, text string")
    saved = bm25.saved_index(docs, str(tmp_path / "i"), partitions=3)
    plan = bm25.scores(saved, q)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert bm25.search(saved, q, 7).collect() == bm25.search(bm25.build_index(docs), q, 7).collect()


def test_a_grid_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)
    rows = spark.range(4).select(F.udf(lambda x: made.add(1) or x, "long")("id").alias("id"))
    found = experiments.grid(rows, {"a": lambda d: d, "b": lambda d: d.where("id > 1")}).collect()
    assert len(found) == 6 and made.value == 4


def test_block_scores_are_added_up_where_a_document_lies(spark, tmp_path, monkeypatch):
    """What is sent to the blocks doesn't grow with their number, and neither postings nor scores are shuffled."""
    docs = spark.createDataFrame([(i, " ".join(["cat"] * (i % 4) + ["dog"] * (i % 3)) + f" w{i % 5}") for i in range(200)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "cat w3"), (2, "dog dog")], "query_id long, text string")
    monkeypatch.setattr(bm25, "BLOCK_POSTINGS", 4)
    saved = bm25.saved_index(docs, str(tmp_path / "i"), partitions=3)
    index = bm25.BlockIndex.build(saved, str(tmp_path / "b"), partitions=3)
    sent = index._levels(q, 5, "query_id", "text", bm25.L.STOP_WORDS)
    assert sent.count() <= 3 * bm25.LEVELS < index.plan(q, 5).count()
    plan = index._scored(sent.select("query_id", "term", "level", "factor"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    again = bm25.BlockIndex(spark.read.parquet(str(tmp_path / "b" / "blocks")), index.bounds, index.terms)
    assert index.search(q, 5).collect() == again.search(q, 5).collect() == bm25.search(saved, q, 5).collect()
