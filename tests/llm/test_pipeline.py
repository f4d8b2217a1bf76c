from __future__ import annotations

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_one_by_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, data), "stage")
        assert docs.columns == columns and 0 < docs.count() <= seen, name
        seen = docs.count()
    assert docs.where("n_chars <> length(text)").count() == 0
    last = pipeline.STAGES[-1][1](spark, docs, data)
    assert last.agg({"doc_id": "count"}).first()[0] >= seen and last.select("doc_id").distinct().count() == seen
    pieces = sorted((r.doc_id, r.start, r.ids_crc32) for r in pipeline.run(spark, data).collect())
    assert pieces == sorted((r.doc_id, r.start, r.ids_crc32) for r in last.collect())


def test_planted_rows(spark, data, tmp_path):
    """Copies, near copies, a leak and junk among clean documents."""
    import shutil

    import random

    for t in ("labels", "benchmark"):
        shutil.copy(f"{data}/{t}.parquet", tmp_path)
    known = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").select("doc_id")
    words = sorted({w for r in spark.read.parquet(f"{data}/documents.parquet").join(known, "doc_id").collect() for w in r.text.split()})
    rng = random.Random(6)
    made = lambda: [rng.choice(words) for _ in range(120)]
    clean = made()
    near = [*clean[:60], "changed", *clean[61:]]
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first().text
    texts = [" ".join(clean), " ".join(clean), " ".join(near), " ".join(made()) + "\n" + item, " ".join(made()), "few words", None]
    rows = [(10**6 + k, t) for k, t in enumerate(texts)]
    extra = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.read.parquet(f"{data}/documents.parquet").unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, str(tmp_path)), "stage")
    assert {r.doc_id - 10**6 for r in docs.where("doc_id >= 1000000").collect()} == {0, 4}


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_tables(spark, data, name):
    from cases import documents, empty

    stage = dict(pipeline.STAGES)[name]
    docs = documents(spark)
    out = stage(spark, docs, data)
    assert out.count() <= docs.count() or name == "packing"
    assert name == "packing" or out.columns == docs.columns
    assert stage(spark, empty(spark), data).count() == 0
