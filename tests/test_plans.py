from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.plans import experiments
from quern.plans.retrieval import Retriever

TEXTS = ["metformin lowers mortality in diabetes mellitus", "aspirin and bleeding after stroke", "a table of warfarin doses\t1\t2", "heart failure and myocardial infarction", "unrelated words about gardens"]


@pytest.fixture(scope="module")
def retriever(spark):
    rows = [(i, t, f"d{i % 3}", ["Lancet", "J", ""][i % 3], str(2018 + i), "en", "\t" in t) for i, t in enumerate(TEXTS)]
    return Retriever.build(spark.createDataFrame(rows, "chunk_id long, text string, doc_id string, journal string, pub_year string, lang string, is_table boolean"))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


@pytest.mark.parametrize("strategy", ["rrf", "weighted", "simple"])
def test_retrieve(spark, retriever, strategy):
    found = retriever.retrieve(asked(spark, "MI and HF", "metformin mortality 2018-2019", ""), strategy=strategy).collect()
    best = {r.query_id: r.chunk_id for r in found if r.fused_rank == 1}
    assert best[0] == 3 and best[1] == 0
    assert {r.pub_year for r in found if r.query_id == 1} <= {"2018", "2019"}
    assert all("bm25" in r.path_scores or r.n_paths >= 1 for r in found)


def test_search_and_answer(spark, retriever):
    q = asked(spark, "warfarin tables", "aspirin bleeding")
    found = retriever.search(q, 2, snippet=10).collect()
    assert {r.query_id: r.chunk_id for r in found if r.rerank_rank == 1} == {0: 2, 1: 1} and all(len(r.snippet) <= 10 for r in found)
    assert retriever.search(q, 2, reranked=False).where("fused_rank > 2").count() == 0
    got = {r.query_id: r for r in retriever.answer(q, where={"pub_year": "2019"}).collect()}
    assert got[0].warning is None and "aspirin" in got[1].context_text and "warfarin" not in got[0].context_text
    none = retriever.answer(asked(spark, "anything"), where={"pub_year": "1900"}).first()
    assert none.answer == "" and none.warning == "empty context"


def test_experiments(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.5), ("a", 2, 0.1), ("b", 2, 0.7), ("c", 1, 0.9)], "setting string, query_id int, score double")
    got = {r.setting: (r.mean_score, r.wins) for r in experiments.compare(df).collect()}
    assert got == {"a": (0.5, 1), "b": (0.6, 1), "c": (0.9, 0)}
    assert {r.query_id: r.compliance for r in experiments.compliance(df, F.col("score") > 0.6).collect()} == {1: pytest.approx(2 / 3, abs=1e-6), 2: 0.5}
    assert [r.id for r in experiments.systematic_sample(spark.range(100), "id", 4).orderBy("id").collect()] == [0, 25, 50, 75]


def test_readiness(spark, data):
    checks = experiments.default_checks(spark, data) | {"broken": lambda: 1 / 0}
    got = {n: ok for n, ok, _ in experiments.readiness(checks)}
    assert got.pop("broken") is False and all(got.values())
