from __future__ import annotations

import random
from collections import Counter

import pytest
from cases import documents, empty

from quern.llm.line_dedup import dedup_lines, suffix_ranks, without_repeated_lines


def brute(texts, least):
    """Deletes each line that lies in a run of ``least`` words or more that occurs earlier, all runs tried."""
    split = [[(at, x) for at, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    seen, gone = {}, set()
    for d, lines in enumerate(split):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for _, x in lines[i:j]) >= least:
                    key = tuple(x for _, x in lines[i:j])
                    if key in seen:
                        gone |= {(d, at) for at in range(lines[i][0], lines[j - 1][0] + 1)}
                    else:
                        seen[key] = (d, i)
    return ["\n".join(x for at, x in enumerate(t.split("\n")) if (d, at) not in gone) for d, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))) for _ in range(9)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for _ in range(14)]
    docs = documents(spark, texts, [*range(14)]).drop("n_deleted")
    got = dedup_lines(docs, 6).orderBy("doc_id").collect()
    assert [r.text for r in got] == brute(texts, 6)
    assert all(r.n_lines == len(t.split("\n")) for r, t in zip(got, texts, strict=True))


def test_first_copies_stay(spark):
    run = "\n".join(f"line {i} of a passage that repeats in many places of it" for i in range(6))
    docs = documents(spark, [f"head\n{run}\ntail", f"other\n\n{run}", run, "short\nshort"], [4, 5, 9, 1])
    got = {r.doc_id: r.text for r in without_repeated_lines(docs).collect()}
    assert got == {4: f"head\n{run}\ntail", 5: "other\n", 1: "short\nshort"}
    assert without_repeated_lines(docs).columns == docs.columns


def test_odd_tables(spark):
    docs = documents(spark)
    got = dedup_lines(docs.drop("n_deleted"))
    assert got.count() == docs.count() and got.where("text is null").count() == 1 and got.agg({"n_deleted": "sum"}).first()[0] == 0
    twice = docs.unionByName(docs)
    assert without_repeated_lines(twice).count() == twice.count()
    assert dedup_lines(empty(spark).drop("n_deleted")).count() == 0 and without_repeated_lines(empty(spark)).count() == 0


def test_only_built_in_functions(spark):
    plan = dedup_lines(documents(spark).drop("n_deleted"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_ranks_are_those_of_a_plain_suffix_array(spark, seed):
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice("abcde") + " x" for _ in range(rng.randint(1, 14))) for _ in range(12)]
    lines = {i: t.split("\n") for i, t in enumerate(texts)}
    _, levels = suffix_ranks(documents(spark, texts, [*range(12)]), 12)
    first = {(r.doc_id, r.pos): r["rank"] for r in levels[0].collect()}
    assert len({(lines[d][p], rank) for (d, p), rank in first.items()}) == len(set(first.values()))  # a rank for each line
    for k, level in enumerate(levels):
        prefixes = {(d, p): tuple(first[d, p + i] for i in range(2**k)) for d, p in first if all((d, p + i) in first for i in range(2**k))}
        often = Counter(prefixes.values())
        own = {at: x for at, x in prefixes.items() if often[x] > 1}
        got = {(r.doc_id, r.pos): r["rank"] for r in level.collect()}
        assert got.keys() == own.keys() and len(levels) > 2
        # the order of suffixes by rank is that of their lines' ranks, and equal ranks have equal lines
        by_rank = sorted({(got[at], x) for at, x in own.items()})
        assert [x for _, x in by_rank] == sorted(set(own.values()))
