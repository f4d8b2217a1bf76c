from __future__ import annotations

import random
from datetime import datetime, timedelta
from statistics import median

import numpy as np
import pytest

from quern.llm.queries import op13_rolling_exact_median
from quern.llm.rolling_median import MergeSortTree, doubled_medians, rolling_medians

SCHEMA = "click_id long, ts timestamp_ntz, kind string, value double, n long, chunk long, series string"


def test_tree_against_sorting():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 31, 200):
        values = rng.integers(-20, 20, n)
        tree = MergeSortTree(values)
        lo = rng.integers(0, n, 300)
        hi = lo + 1 + (rng.random(300) * (n - lo)).astype(int)
        k = (rng.random(300) * (hi - lo)).astype(int)
        bound = rng.integers(-25, 25, 300)
        assert tree.select(lo, hi, k).tolist() == [sorted(values[a:b])[i] for a, b, i in zip(lo, hi, k)]
        assert tree.below(lo, hi, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, bound)]
        got = doubled_medians(tree, lo, hi)
        for a, b, m, d in zip(lo, hi, *got):
            own = values[a:b].tolist()
            assert m == 2 * median(own) and d == 2 * median(abs(2 * x - m) for x in own)


def plain(rows, minutes=60):
    """Every window looked up by itself."""
    once = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2] or "", r[3] is not None, r[3] or 0)):
        once.setdefault(r[0], r)
    cents = lambda v: None if v is None or not np.isfinite(v) else int(np.floor(100 * v + 0.5))
    out = {}
    for i, ts, kind, value, *_ in once.values():
        own = [cents(r[3]) for r in once.values() if r[2] == kind and ts - timedelta(minutes=minutes) < r[1] <= ts and cents(r[3]) is not None]
        if len(own) < 2:
            out[i] = (kind, len(own), None, None, None)
            continue
        m = int(2 * median(own))
        d = int(2 * median(abs(2 * x - m) for x in own))
        c = cents(value)
        out[i] = (kind, len(own), m, d, None if c is None else 2 * abs(2 * c - m) > 3 * d)
    return out


@pytest.mark.parametrize("chunk_minutes", [60, 120, 7])
def test_documents_against_windows(spark, chunk_minutes):
    rng = random.Random(chunk_minutes)
    start = datetime(1969, 12, 31, 20, 30)
    rows = []
    for i in range(900):
        ts = start + timedelta(microseconds=rng.choice([0, 1, 3_599_999_999, 3_600_000_000, rng.randrange(36_000_000_000)]))
        value = rng.choice([None, float("nan"), float("inf"), -3.005, 0.0, round(rng.expovariate(0.02), 2), 1e6])
        rows.append((rng.randrange(10_000), None if i % 50 == 0 else ts, rng.choice([None, "a", "b", "view"]), value, 0, 1, "x"))
    rows += rows[:40] + [(None, start, "a", 1.0, 0, 1, "x"), (None, start, "a", 2.0, 0, 1, "x")]
    got = rolling_medians(spark.createDataFrame(rows, SCHEMA), chunk_minutes=chunk_minutes).collect()
    assert len(got) == len({r.click_id for r in got})
    assert {r.click_id: tuple(r)[1:] for r in got} == plain(rows)


def test_whole_batches_and_long_ids(spark, monkeypatch):
    monkeypatch.setattr("quern.llm.rolling_median.TREE_ROWS", 64)
    start = datetime(2024, 3, 10, 1, 0)
    rows = [(i, start + timedelta(seconds=i * 7 % 20_000), "k", float(i % 13), 0, 0, "") for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.click_id: tuple(r)[1:] for r in rolling_medians(df).collect()}
    assert got == plain(rows)
    text = rolling_medians(df.selectExpr("cast(click_id as string) click_id", "cast(ts as timestamp) ts", "kind", "value"))
    assert {int(r.click_id): tuple(r)[1:] for r in text.collect()} == got


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rolling_medians(df).collect() == []
    with pytest.raises(ValueError):
        rolling_medians(df, id_column="n")


def test_query_has_every_click(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/clicks.parquet").select("click_id", "ts", "kind", "value").collect()]
    got = {r.click_id: tuple(r)[1:] for r in op13_rolling_exact_median(spark, data).collect()}
    assert len(got) == len({r[0] for r in rows if r[1] is not None})
