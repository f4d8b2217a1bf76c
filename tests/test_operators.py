from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import bm25, cells, chunk, context, filters, fusion, generate, models, profile, query, rerank, vector
from quern.sources import io
from quern.streaming import incremental


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id long, path_idx int, path string, kind string, id long, score double, rank int")


TWO = [(1, 0, "a", "vector", 7, 0.9, 1), (1, 0, "a", "vector", 8, 0.5, 2), (1, 1, "b", "keyword", 7, 3.0, 1), (1, 1, "b", "keyword", 9, 1.0, 2)]


def test_reciprocal_rank(spark):
    got = {r.id: r for r in fusion.reciprocal_rank(lists(spark, TWO)).collect()}
    assert got[7].fused_score == pytest.approx(2 / 61, abs=1e-6) and got[7].fused_rank == 1 and got[7].n_paths == 2
    assert got[7].path_ranks == {"a": 1, "b": 1} and got[8].fused_rank == 2 and got[9].fused_rank == 3


def test_weighted_and_first_seen(spark):
    got = {r.id: r.fused_score for r in fusion.weighted(lists(spark, TWO)).collect()}
    assert got == {7: pytest.approx(1.0), 8: 0.0, 9: 0.0}
    got = {r.id: (r.fused_score, r.fused_rank) for r in fusion.first_seen(lists(spark, TWO)).collect()}
    assert got == {7: (1.0, 1), 8: (0.5, 2), 9: (pytest.approx(1 / 3, abs=1e-6), 3)}


def test_equal_scores_normalise_to_one(spark):
    got = fusion.weighted(lists(spark, [(1, 0, "a", "vector", i, 0.4, i) for i in (1, 2)])).collect()
    assert [r.fused_score for r in got] == [0.7, 0.7]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, None)], "doc_id long, text string")
    index = bm25.build_index(docs)
    assert (index.n_docs, index.average_length) == (3, pytest.approx(4 / 3))
    got = {r.doc: r.score for r in bm25.search(index, spark.createDataFrame([(1, "cat cat")], "query_id long, text string"), 5).collect()}
    idf = math.log(1 + 2.5 / 1.5)
    assert got == {1: pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (4 / 3))), abs=1e-6)}


def test_bm25_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 3} other") for i in range(9)], "doc_id long, text string")
    index, q = bm25.build_index(docs), spark.createDataFrame([(1, "word1")], "query_id long, text string")
    index.save(str(tmp_path))
    assert bm25.search(bm25.Index.load(spark, str(tmp_path)), q, 9).collect() == bm25.search(index, q, 9).collect()


def test_native_chunks_are_those_of_the_row_wise_splitter(spark):
    rng = random.Random(11)
    joints = [" ", " ", " ", ". ", "\n", "\n\n", "。", "！", "  ", "\t"]
    texts = ["".join(rng.choice(["a", "bc", "déf", "语言", "x1"]) + rng.choice(joints) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += [None, "", " \n ", "one", "w" * 500, " ".join(["same"] * 50), "a b c\n\n" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap, short in [(30, 6, 20), (12, 0, 3), (24, 5, 1)]:
        by_rows = sorted(map(tuple, chunk.split_documents(docs, size, overlap, short=short).select("doc_id", "chunk_index", "total_chunks", "text", "token_count", "next_char", "chunk_id", "is_table").collect()))
        native = chunk.native_chunks(docs, size, overlap, short)
        assert sorted(map(tuple, native.select("doc_id", "chunk_index", "total_chunks", "text", "token_count", "next_char", "chunk_id", "is_table").collect())) == by_rows
        assert "Python" not in native._jdf.queryExecution().executedPlan().toString()


def test_native_chunks_are_evaluated_once(spark):
    """Each separator's parts are split once, not once more in a filter, and counts of joined parts are those of the parts."""
    docs = spark.createDataFrame([(1, "a b. c"), (2, "")], "doc_id long, text string")
    plan = chunk.native_chunks(docs, 30, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(f"\\Q{x}\\E") == 1 for x in ("。", "！", ". "))
    joints = [". ", ".", " . ", "。", " 。", "。 ", " ", "  ", "\n. ", "？！"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bc", "", "语"]) + rng.choice(joints) for _ in range(90)) for _ in range(40)]
    own = spark.createDataFrame([(x,) for x in texts], "text string")
    for size in (1, 4, 9):
        got = own.select("text", chunk.recursive_parts(F.col("text"), size).alias("parts")).collect()
        assert all(r.parts == chunk.recursive_split(r.text, size) for r in got)


def test_grounded_answers_make_their_evidence_once(spark):
    made = spark.sparkContext.accumulator(0)
    block = F.udf(lambda x: made.add(1) or x, "string")
    rows = spark.createDataFrame([(1, 1, "[1] a\nCats sleep\n"), (1, 2, "[2] b\nDogs bark\n")], "query_id long, position int, block string").withColumn("block", block("block"))
    questions = spark.createDataFrame([(1, "what do cats do")], "query_id long, question string")
    assert len(generate.grounded_answers(rows, questions).collect()) == 1 and made.value == 2


def test_stages_depend_on_each_other(spark):
    blocks = ["Cats sleep a lot. Cats chase red mice at night", "Dogs bark. Nothing here", "Red mice hide. They run at night from cats", "Cats chase red mice at night"]
    rows = spark.createDataFrame([(1, i, f"[{i}] 来源: s{i}\n{b}\n") for i, b in enumerate(blocks, 1)] + [(2, 1, "[1] 来源: x\nunrelated text\n")], "query_id long, position int, block string")
    questions = spark.createDataFrame([(1, "cats chase red mice at night"), (2, "quite different")], "query_id long, question string")
    got = {r.query_id: r for r in generate.grounded_answers(rows, questions).collect()}
    assert got[1].ids == [1, 3, 4] and got[1].filter_note == "filtered"  # the evaluation leaves the second out
    assert got[1].draft == "Cats chase red mice at night [1]\nThey run at night from cats [3]"  # and a sentence stands once
    assert got[2].ids == [] and got[2].draft == got[2].final == "unrelated text [1]"

    class Strict(generate.ExtractiveGenerator):
        def __call__(self, prompt, system=""):
            if system == generate.STAGES["critical_reviewer"].system:
                return "[3] has too little of the question"
            if system == generate.STAGES["answer_generator"].system and "different" in prompt:
                raise ValueError("no")
            return super().__call__(prompt, system)

    got = {r.query_id: r for r in generate.grounded_answers(rows, questions, Strict).collect()}
    assert got[1].final == "Cats chase red mice at night [1]" and got[2].final == ""


def test_usable_ids_of_json_stay_in_the_jvm(spark):
    replies = ['{"usable_ids": [1, "2", "x"]}', "```json\n{\"usable_ids\": [3]}\n```", "Well {'usable_ids': [4,]}", '{"other": 1}', "[1, 2]", "", None, '{"usable_ids": []}', "<think>a</think>{\"usable_ids\":[ 5 ]}"]
    df = spark.createDataFrame(list(enumerate(replies)), "query_id long, reply string")
    told = generate.evaluations(df)
    assert {r.query_id: r.ids for r in told.collect()} == {i: generate.usable_ids(x) for i, x in enumerate(replies)}
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "isnull" in plan.partition("ArrowEvalPython")[2]


def test_quantised_vectors(spark):
    rows = [(1, [1.0, -0.5, 0.25]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [2.0, -1.0, 0.5]), (5, [0.1, 0.9, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.q for r in v.select("vec_id", vector.quantised(F.col("embedding")).alias("q")).collect()}
    assert list(got[1]["values"]) == [127, -64, 32] and list(got[2]["values"]) == [0, 0, 0] and got[2]["step"] == 0.0 and got[3]["values"] is None
    q = v.where("vec_id in (1, 2)").withColumnRenamed("vec_id", "query_id")
    report = {r.query_id: r for r in vector.quantisation_report(q, v, 5, 2).collect()}
    assert report[1].kept == 2 and report[1].largest_shift < 0.01


def test_blocks_give_the_same_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(40)], k=rng.randint(1, 60)))) for i in range(400)] + [(900, ""), (901, None)]
    index = bm25.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    q = spark.createDataFrame([(1, "w0 w1 w30"), (2, "w39 w39"), (3, "w5"), (4, "nothing"), (5, "w0 w2 w3 w4 w8 w20")], "query_id long, text string")
    monkeypatch.setattr(bm25, "BLOCK_POSTINGS", 40)
    blocks = bm25.BlockIndex.build(index, str(tmp_path / "b"))
    assert blocks.bounds.where("n > 120").count() == 0
    for k in (1, 5, 1000):
        assert sorted(map(tuple, blocks.search(q, k).collect())) == sorted(map(tuple, bm25.search(index, q, k).collect()))
    plan = blocks.plan(q, 5)
    assert plan.where("not needed").count() > 0 and "SortMergeJoin" not in blocks._scored(plan.where("needed").select("query_id", "term", "level", "part", "factor"))._jdf.queryExecution().optimizedPlan().toString()


def test_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 12))
    rows = [(i, (centers[i % 8] + 0.3 * rng.normal(size=12)).tolist()) for i in range(800)] + [(900, None), (901, [0.0] * 12), (902, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 10 = 0 and vec_id < 800").withColumnRenamed("vec_id", "query_id")
    index = cells.CellIndex.build(v, str(tmp_path / "c"), 8)
    assert index.sizes.sum() == 803 and sorted(r.vec_id for r in index.vectors.collect()) == sorted(r[0] for r in rows)
    exact = sorted(map(tuple, vector.vector_search(q, v, 10).collect()))
    assert sorted(map(tuple, index.search(q, 10, probes=8).collect())) == exact
    monkeypatch.setattr(vector, "BLOCK", 30)
    near = index.search(q, 10, probes=2)
    assert cells.recall(near, vector.vector_search(q, v, 10)).agg({"recall": "avg"}).first()[0] >= 0.9
    assert index.read_share(np.array([r.embedding for r in q.collect()]), 2) < 0.5
    assert "cell" in index.vectors.where("cell in (1, 2)")._jdf.queryExecution().executedPlan().toString().partition("PartitionFilters")[2][:60]
    assert cells.CellIndex.build(v.where("false"), str(tmp_path / "none"), 4).search(q, 3).count() == 0


def test_vector_search_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(99, [0.0, 0.0]), (100, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, vector.vector_search(q, v, 3).collect()))
    monkeypatch.setattr(vector, "BLOCK", 2)
    assert sorted(map(tuple, vector.vector_search(q, v, 3).collect())) == whole
    assert [r[1] for r in whole if r[0] == 2 and r[3] == 1] == [2]
    assert vector.vector_search(q, v, 3, keep_self=False).where("query_id = doc").count() == 0


def test_diversity_case(spark):
    rows = [(1, i, "A", s, f"t{i}") for i, s in enumerate((0.95, 0.93, 0.92, 0.91))] + [(1, 9, "B", 0.80, "b")]
    df = spark.createDataFrame(rows, "query_id long, id long, doc_id string, relevance_score double, text string")
    got = [(r.id, r.diverse_score) for r in context.diversify(df).orderBy("position").collect()]
    assert got == [(0, 0.95), (9, 0.8), (1, 0.558), (2, 0.3312)]


def test_greedy_dedup(spark):
    texts = ["metformin lowers blood glucose in adults", "Metformin lowers  blood glucose in adults.", "something else entirely here", ""]
    df = spark.createDataFrame([(1, i, t, 1.0 - i / 10) for i, t in enumerate(texts)], "query_id long, id long, text string, relevance_score double")
    assert sorted(r.id for r in context.greedy_dedup(df).collect()) == [0, 2, 3]


def test_budget_truncates_the_first_that_does_not_fit(spark):
    long = " ".join(f"Sentence {i} says something." for i in range(100))
    rows = [(1, i, i + 1, "s", "J", 2000, long) for i in range(3)]
    df = spark.createDataFrame(rows, "query_id long, id long, position int, source string, journal string, pub_year int, text string")
    got = context.fill_budget(df, 1200).orderBy("position").collect()
    assert [r.truncated for r in got] == [False, True] and sum(r.tokens for r in got) <= 1200
    assert context.fill_budget(df, 50).count() == 0


def test_rerank_defaults(spark):
    years = spark.createDataFrame([(1992,), (2026,), (None,), (1980,)], "y int").select(rerank.recency(F.col("y")).alias("r")).collect()
    assert [r.r for r in years] == [0.0, 1.0, 0.5, 0.0]
    venues = spark.createDataFrame([("", None), ("unseen", None), ("Lancet", None), ("x", 0.7)], "v string, k double")
    assert [r.a for r in venues.select(rerank.authority(F.col("v"), F.col("k")).alias("a")).collect()] == [0.3, 0.45, 1.0, 0.7]
    one = spark.createDataFrame([(1, 5, 1, 0.2, 0.5, 0.5)], "query_id long, id long, fused_rank int, relevance double, recency double, authority double")
    assert rerank.rerank(one, weights={"relevance": 2.0, "other": 9.0}).first().rerank_score == 0.2


def test_filters(spark):
    df = spark.createDataFrame([(1, "2020", True), (2, "x", False), (3, None, None)], "id long, pub_year string, is_table boolean")
    ids = lambda where: [r.id for r in df.where(filters.predicate(where)).collect()]
    assert ids({"pub_year": {"$in": ["2020", "2021"]}}) == [1] == ids({"pub_year": {"$gte": 2019, "$lte": 2020}}) == ids({"is_table": True})
    assert ids({}) == [1, 2, 3] and ids({"pub_year": "x", "is_table": False}) == [2]


def test_similar_rows_against_the_fold(spark):
    """A group of more than 1,000 near copies, chains of copies of copies, exact copies and rows without text."""
    rng = random.Random(6)
    base = "".join(rng.choices("abcdefgh", k=120))
    near = lambda text, n: "".join(rng.choice("xyz") if rng.random() < n else c for c in text)
    texts = [near(base, 0.01) for _ in range(1100)]
    for _ in range(8):
        text = "".join(rng.choices("abcdefgh", k=80))
        for _ in range(6):
            texts.append(text)
            text = near(text, 0.03)
    texts += ["ab", "ab", "abcd", "abcde", "", None, " \n"] + texts[:5]
    rows = [(i, rng.choice([0.5, 1.0, 2.0]), t) for i, t in enumerate(texts)]
    sets = {}
    for i, _, t in rows:
        plain = "".join((t or "").lower().split())
        sets[i] = {plain[k : k + 4] for k in range(len(plain) - 3)} if len(plain) > 4 else {plain} - {""}
    kept, due = [], {}
    for i, _, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        due[i] = not any(len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) - 1e-12 for j in kept if sets[i])
        kept += [i] * due[i]
    df = spark.createDataFrame(rows, "id long, relevance_score double, text string")
    got = {r.id: r.unique for r in context.similar_rows_dropped(df).collect()}
    assert got == due and sum(due.values()) > 10
    assert context.similar_rows_dropped(df.where("false")).collect() == []


def test_different_rows_that_share_shingles_need_few_rounds(spark, monkeypatch):
    rng, names = random.Random(3), []
    texts = list({" ".join(sorted(rng.sample("abcdefghijkl", 6))) for _ in range(130)})
    df = spark.createDataFrame([(i, 1.0, t) for i, t in enumerate([*texts, *texts[:3]])], "id long, relevance_score double, text string")
    keep = context.stored
    monkeypatch.setattr(context, "stored", lambda own, name: names.append(name) or keep(own, name))
    found = {r.id: r.unique for r in context.similar_rows_dropped(df, 0.8, shingles=lambda c: F.split(c, " ")).collect()}
    assert found == {i: i < len(texts) for i in range(len(texts) + 3)}
    assert names.count("unique") <= 8


def taken_in_turn(rows, quota, total):
    """Topics one after the other."""
    seen, out = set(), []
    for topic in sorted({r[1] for r in rows}):
        need, added = min(quota if isinstance(quota, int) else quota.get(topic, 0), (total or 10**9) - len(out)), 0
        for key, _, _ in sorted((r for r in rows if r[1] == topic), key=lambda r: (r[2], r[0])):
            if added < need and key not in seen:
                seen.add(key)
                added += 1
                out.append((topic, key, added))
    return out


def test_topic_quota(spark):
    rng, schema = random.Random(8), "doc_id long, topic_idx long, pos long"
    for ids, topics, quota, total in [(3, 2, 1, None), (30, 5, 3, None), (60, 9, 4, 20), (25, 25, 1, None), (40, 4, 0, 5)]:
        rows = [(i, t, rng.randrange(10)) for i in range(ids) for t in rng.sample(range(topics), rng.randint(1, min(3, topics)))]
        got = filters.topic_quota(spark.createDataFrame(rows + rows[:2], schema), quota, total).select("topic_idx", "doc_id", "topic_rank").collect()
        assert sorted(map(tuple, got)) == sorted(taken_in_turn(rows, quota, total))
    # an id beyond a topic's quota is left to the next
    rows = [(1, 0, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1)]
    assert sorted(r.doc_id for r in filters.topic_quota(spark.createDataFrame(rows, schema), 1).collect()) == [1, 2]
    own = spark.createDataFrame([(0, 2), (1, 1)], "topic_idx long, quota int")
    assert sorted(r.doc_id for r in filters.topic_quota(spark.createDataFrame(rows, schema), own).collect()) == [1, 2, 3]


def test_recursive_split_keeps_everything():
    text = "First para one. Sentence two here.\n\nSecond para " + "word " * 40 + "end"
    parts = chunk.recursive_split(text, 10)
    assert max(map(chunk.word_count, parts)) <= 10
    assert " ".join(parts).split() == text.split()
    assert chunk.recursive_split("", 10) == [] and chunk.recursive_split("a" * 50, 5, len) == ["a" * 5] * 10


def test_merge_short():
    c = lambda t: {"text": t, "token_count": len(t.split()), "next_char": ""}
    merged, gone, stayed = chunk.merge_short([c("head"), c("a " * 30), c("tail end")], 40, chunk.word_count)
    assert [x["token_count"] for x in merged] == [33] and (gone, stayed) == (2, 0)
    merged, gone, stayed = chunk.merge_short([c("head"), c("a " * 40), c("tail")], 40, chunk.word_count)
    assert [x["token_count"] for x in merged] == [1, 40] and (gone, stayed) == (1, 1)


def test_chunks_of_documents(spark):
    docs = spark.createDataFrame([(1, "w " * 300), (2, None), (3, "short")], "doc_id long, text string")
    rows = chunk.split_documents(docs, 64, 8).orderBy("doc_id", "chunk_index").collect()
    assert max(r.token_count for r in rows) <= 64 and rows[0].chunk_id == "1_0000" and {r.doc_id for r in rows} == {1, 3}
    issues = {r.issues for r in chunk.quality_issues(chunk.split_documents(docs, 64, 8), 64).collect()}
    assert "too_short" in issues


def test_pack_lengths(spark):
    df = spark.createDataFrame([([3, 3, 5, 9, 1],)], "l array<long>")
    size = F.lit(6).cast("long")
    assert df.select(profile.split_units(F.col("l"), size).alias("x")).first().x == [3, 3, 5, 6, 3, 1]
    assert df.select(profile.pack_lengths(profile.split_units(F.col("l"), size), size).alias("x")).first().x == [6, 5, 6, 4]


def test_acronym_table_takes_the_longest_document(spark):
    docs = spark.createDataFrame([(1, "heart failure (HF) HF"), (2, "high frequency (HF) and a much longer text here")], "doc_id long, text string")
    r = profile.acronym_table(docs).where("acronym = 'HF'").first()
    assert (r.n, r.n_docs, r.expansion_example) == (3, 2, "high frequency")


def test_missingness_with_samples(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", "x"), (3, None, "y")], "id long, a string, b string")
    got = {r.field: (r.n_empty, r.sample_ids) for r in profile.missingness(df, ["a", "b"], "id").collect()}
    assert got == {"a": (2, [2, 3]), "b": (1, [1])}


# ---- queries


def test_year_filters():
    f = lambda t: query.find_filters(t, 2026)[0].get("pub_year")
    assert f("2020-2023") == {"$in": ["2020", "2021", "2022", "2023"]} == f("2023至2020")
    assert f("since 2024") == {"$in": ["2024", "2025", "2026"]} == f("2024年以后") == f("近三年") == f("last 3 years")
    assert f("before 1993") == {"$in": ["1992", "1993"]} and f("in 2019") == "2019" and f("id 120205") is None


def test_mentions_are_joined(spark):
    queries = spark.createDataFrame([(1, "MIDAS and MI, Heart Failure"), (2, "服用aspirin后 二甲双胍"), (3, None), (4, "eGFR ＨＦ")], "query_id long, text string")
    got = {(r.query_id, r.surface, r.term) for r in query.mentions(queries, query.Lexicon(corpus={"MIDAS": "some study"})).collect()}
    assert got == {(1, "MI", "myocardial infarction"), (1, "mi", "myocardial infarction"), (1, "MIDAS", "some study"), (1, "heart failure", "heart failure"), (2, "aspirin", "aspirin"), (2, "二甲双胍", "metformin"), (4, "eGFR", "egfr"), (4, "egfr", "egfr"), (4, "HF", "heart failure"), (4, "hf", "heart failure")}


def test_names_need_borders():
    u = query.understand("MIDAS and MI")
    assert u["expansions"] == {"MI": "myocardial infarction"} and u["vector_query"] == "MIDAS and myocardial infarction (MI)"
    assert query.understand("服用aspirin后")["entities"]["drug"] == ["aspirin"]


def test_chinese_query_becomes_english_words():
    u = query.understand("二甲双胍对糖尿病有何影响？")
    assert u["lang"] == "zh" and "metformin" in u["keyword_query"].split() and u["variants"][1] == "diabetes mellitus metformin"
    assert u["vector_query"] == u["cleaned"] == "二甲双胍对糖尿病有何影响?"


@pytest.mark.parametrize("text", [None, "", "   ", "x" * 6000, "qwrtp zxcv"])
def test_odd_queries(text):
    assert query.understand(text)["lang"] == "en"


# ---- generation


@pytest.mark.parametrize(("reply", "value"), [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('Sure: {"a": 1}. Done', {"a": 1}), ('{"a": [1, 2,],}', {"a": [1, 2]}), ("{“a”: 1}", {"a": 1}),
    ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}), ('<think>{"x"</think>[1]', [1]), ("{'a': True}", {"a": True}), ("none here", None), ("", None), (None, None), ('{"a": [1], "b": "x', {"a": [1], "b": "x"}),
])
def test_extract_json(reply, value):
    assert generate.extract_json(reply) == value


def test_tolerant_reader():
    assert generate.extract_json('see [note here], then {"a": "he said \\"hi\\"", b: None, "c": \'it\\\'s\'}') == {"a": 'he said "hi"', "b": None, "c": "it's"}
    assert generate.extract_json('{"a": "x\x01y", "b": -2.5e3, "c') == {"a": "xy", "b": -2500.0}
    assert generate.extract_json("```json\n-2.5\n```") == -2.5 and generate.extract_json("[" * 5000) is not None


def test_usable_ids():
    assert generate.usable_ids('{"usable_ids": [1, "3", "x"]}') == [1, 3]
    assert generate.usable_ids("可用证据编号：3,5") == [3, 5] and generate.usable_ids("可用证据编号：无可用证据") == []
    assert generate.usable_ids("1 - 支持 - a\n2 - 不支持 - b") == [1] and generate.usable_ids("?") is None and generate.usable_ids("") is None


def test_templates_leave_braces_alone(spark):
    s = generate.Stage("x", "", "Q {question} C {context} {other}")
    assert s.required == ["context", "question"]
    values = {"question": "{context}", "context": "p{value} {"}
    assert s.render(**values) == "Q {context} C p{value} { {other}"
    df = spark.createDataFrame([values], "question string, context string")
    assert df.select(s.column(question=F.col("question"), context=F.col("context")).alias("x")).first().x == s.render(**values)


def test_evidence_filter_fails_open(spark):
    rows = spark.createDataFrame([(q, p) for q in (1, 2, 3) for p in (1, 2)], "query_id long, position int")
    ids = spark.createDataFrame([(1, [2]), (2, [9]), (3, None)], "query_id long, ids array<int>")
    got = {(r.query_id, r.position): r.filter_note for r in generate.filter_context(rows, ids).collect()}
    assert set(got) == {(1, 2), (2, 1), (2, 2), (3, 1), (3, 2)} and got[2, 1].startswith("ids not in")


def test_a_failing_model_stops_nothing(spark):
    def make():
        def reply(prompt, system):
            if "bad" in prompt:
                raise ValueError("no")
            return "Answer 【 1 】"

        return reply

    df = spark.createDataFrame([(1, "q", "ctx"), (2, "bad", "ctx"), (3, "q", "")], "query_id long, question string, context_text string")
    got = {r.query_id: r for r in generate.answer(df, make).collect()}
    assert got[1].answer == "Answer [1]\n\n" + generate.DISCLAIMER and got[3].answer == "" and got[3].warning == "empty context"
    assert got[2].draft == ""


def test_default_models(spark):
    df = models.embed(spark.createDataFrame([("a b",), ("",)], "text string"))
    assert [round(sum(x * x for x in r.embedding), 4) for r in df.collect()] == [1.0, 0.0]
    df = spark.createDataFrame([("a b", "b c"), ("x", None)], "query string, text string")
    assert [r.s for r in df.select(models.relevance(df).alias("s")).collect()] == [0.5, 0.0]


def test_relevance_reads_whole_texts(spark):
    df = spark.createDataFrame([("late words", "x " * 1500 + "late words"), ("late words", "x " * 1500)], "query string, text string")
    assert [r.s for r in df.select(models.relevance(df).alias("s")).collect()] == [1.0, 0.0]
    assert [r.s for r in df.select(models.relevance(df, most_chars=2000).alias("s")).collect()] == [0.0, 0.0]


# ---- sources and resumable work


def test_files(spark, tmp_path):
    for name, content in (("PMC1.1/a.txt", b"ISSN: 1\ntext"), ("PMC2.3/b.txt", b"caf\xff")):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_bytes(content)
        (tmp_path / name).with_suffix(".json").write_text('{"pmcid": "%s", "title": "T", "citation": "J 2019"}' % name.split(".")[0])
    texts = io.read_texts(spark, f"{tmp_path}/*/*.txt")
    assert {r.id: r.text for r in texts.collect()} == {"PMC1": "ISSN: 1\ntext", "PMC2": "caf�"}
    wide = {r.pmcid: r for r in io.wide_table(io.read_metadata(spark, f"{tmp_path}/*/*.json"), texts).collect()}
    assert wide["PMC1"].issn == "1" and wide["PMC1"].pub_year == "2019" and wide["PMC2"].bad_bytes == 1


def test_csv_jsonl_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ('q"uo,te', "é")], "x string, y string")
    io.append_log(df, str(tmp_path / "log"))
    io.append_log(df, str(tmp_path / "log"))
    assert io.read_text_csv(spark, str(tmp_path / "log")).where("y = ''").count() == 2
    io.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert "| a | None |" in io.report({"rows": df}, "R")
    assert io.read_or_empty(spark, str(tmp_path / "none.csv"), "a string").count() == 0


def test_checksums_and_fetching(spark):
    import hashlib

    good = hashlib.md5(b"x").hexdigest()

    def fetch(i):
        if i == "3":
            raise OSError("gone")
        return b"x", f"s3://b/k?md5={good if i == '1' else 'f' * 32}"

    rows = io.verified(io.fetched(spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), fetch)).collect()
    assert [(r.checksum_ok, bool(r.error)) for r in rows] == [(True, False), (False, False), (None, True)]


def test_resumable_append(spark, tmp_path):
    target, source = str(tmp_path / "t"), str(tmp_path / "s")
    rows = lambda a, b: spark.range(a, b).withColumnRenamed("id", "doc_id")
    incremental.append_missing(rows(0, 5), target, "doc_id")
    incremental.append_missing(rows(3, 8).union(rows(3, 8)), target, "doc_id")
    assert sorted(r.doc_id for r in spark.read.parquet(target).collect()) == list(range(8))
    rows(6, 10).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("doc_id long").parquet(source)
        incremental.follow(stream, target, "doc_id", str(tmp_path / "c")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(target).collect()) == list(range(10))
