from __future__ import annotations

import math
import random
import re

import pytest
import xxhash
from cases import documents, empty
from pyspark.sql import functions as F

from quern.llm.quality_rules import fit_quality_model, quality_rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def corpus():
    rng = random.Random(3)
    good = lambda: " ".join(f"{rng.choice('abcdefg')}{rng.choice('xyz')}w{min(rng.randrange(8), rng.randrange(8))}" for _ in range(rng.randint(25, 60)))
    return [good() for _ in range(60)] + [good().upper().replace(" ", "!! ") for _ in range(20)] + ["a b c d e f g h " * 5 + "x\nx\nx", "é|# " * 9 + "\x0b\x1c\x85 ok", None, ""]


def test_counts_match_the_definitions(spark):
    texts = corpus()
    for r in quality_rules(documents(spark, texts, [*range(len(texts))]), None).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert r.kept != r.base_failed


def test_junk_goes_and_clean_text_stays(spark):
    texts = corpus()
    docs = documents(spark, texts, [*range(len(texts))])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 80, 2)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    model = fit_quality_model(docs, labels)
    kept = {r.doc_id for r in quality_rules(docs, model).where("kept").collect()}
    assert kept == set(range(60))
    rows = quality_rules(docs, model, keep_columns=True)
    assert {r.doc_id for r in rows.collect()} == kept and rows.columns == docs.columns


def plain_buckets(text):
    """The buckets of the words and of neighbours, from their hashes in whole numbers."""
    mask, m = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        x = ((x ^ (x >> 31)) * m) & mask
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & mask
        return x ^ (x >> 32)

    def both(a, b):
        out = 0
        for h in (a, b):
            out = ((out ^ h) * m) & mask
            out ^= out >> 32
        return mixed(out)

    hashes = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [mixed(h) >> 48 for h in hashes] + [both(a, b) >> 48 for a, b in zip(hashes, hashes[1:])]


def test_score_and_verdict_against_plain_counting(spark):
    texts = corpus()
    docs = documents(spark, texts, [*range(len(texts))])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    order = {q: [r.doc_id for r in labels.where(f"quality = {q}").orderBy(F.xxhash64("doc_id")).collect()] for q in (1, 0)}
    trusted, aside = order[1][::2], order[1][1::2]
    raw, target = [0.5] * (1 << 16), [0.5] * (1 << 16)
    for i, text in enumerate(texts):
        for b in plain_buckets(text):
            raw[b] += 1
            target[b] += i in trusted
    ratio = [math.log(t / sum_t) - math.log(r / sum_r) for sum_t, sum_r in [(sum(target), sum(raw))] for t, r in zip(target, raw)]
    scores = [sum(ratio[b] for b in bs) / max(1, len(bs)) for bs in map(plain_buckets, texts)]
    judged = [(scores[i], i in aside) for i in aside + order[0]]
    values = sorted({s for s, _ in judged})
    cuts = [values[0] - 1, *((a + b) / 2 for a, b in zip(values, values[1:])), values[-1] + 1]
    good, bad = [s for s, g in judged if g], [s for s, g in judged if not g]
    cost = lambda c: 40 * sum(s < c for s in good) / len(good) + sum(s >= c for s in bad) / len(bad)
    least = min(map(cost, cuts))
    model = fit_quality_model(docs, labels)
    assert cost(model.threshold) == pytest.approx(least)
    for r in quality_rules(docs, model).collect():
        assert r.score == pytest.approx(scores[r.doc_id], abs=1e-9)
        assert r.kept == (not base(texts[r.doc_id])[-1] and scores[r.doc_id] >= model.threshold)


@pytest.mark.parametrize("which", ["quality = 1", "false"])
def test_without_labels_the_rules_decide(spark, which):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").where(which)
    assert fit_quality_model(documents(spark), labels) is None


def test_odd_tables(spark):
    got = {r.doc_id: r for r in quality_rules(documents(spark), None).collect()}
    assert len(got) == documents(spark).count() and got[0].n_words == 0 and not got[0].kept and got[7].n_words == 60_001
    assert quality_rules(empty(spark), None).count() == 0


def test_sampled_ids_start_no_python_workers(spark):
    from quern.llm.quality_rules import _marked

    ids = _marked(spark, [3, 1], [2])
    assert sorted(map(tuple, ids.collect())) == [(1, True), (2, False), (3, True)]
    assert _marked(spark, [3], []).dtypes == [("doc_id", "bigint"), ("good", "boolean")]
    assert "PythonRDD" not in ids._jdf.queryExecution().toRdd().toDebugString()
