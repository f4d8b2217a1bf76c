from __future__ import annotations

import pytest
from oracle_util import connection, differences

from quern.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, data, con, name):
    assert not differences(catalogue.QUERIES[name](spark, data), con, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_does_not_need_the_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['quern.llm'] = None\nimport importlib.util as u; f = u.find_spec\nu.find_spec = lambda n, *a: None if n in ('quern.llm', 'corpus_pipeline') else f(n, *a)\nimport __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


@pytest.mark.parametrize(("name", "key"), [("profile_sections", "doc_id"), ("header_fields", "id")])
def test_covers_all_documents(spark, data, name, key):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    assert {r[0] for r in catalogue.QUERIES[name](spark, data).select(key).collect()} == {r[0] for r in documents.select("doc_id").collect()}


def test_sections_and_header_fields_of_written_rows(spark, tmp_path):
    rows = [
        (1, "1. Introduction\nx\nMaterials and methods:\ny\nRESULTS\nz\nDiscussion\nReferences"), (2, "1 资料与方法\n文\nAim"), (3, "nothing here"),
        (4, "ISSN: 1-2\nDOI: a/b\nISSN: 9\nOther: x\nPublisher:  P "),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in catalogue.QUERIES["profile_sections"](spark, str(tmp_path)).collect()}
    assert found[1].imrad_like == 1 and found[1].n_headings == 5 and found[2].cjk_section == 1 and found[3].n_headings == 0
    fields = [(r.key, r.value) for r in catalogue.QUERIES["header_fields"](spark, str(tmp_path)).where("id = 4").collect()]
    assert sorted(fields) == [("DOI", "a/b"), ("ISSN", "1-2"), ("Publisher", "P")]
