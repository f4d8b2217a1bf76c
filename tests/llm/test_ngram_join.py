from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from cases import documents, empty

from quern.llm import ngram_join
from quern.llm.common import WordHashes
from quern.llm.components import components
from quern.llm.ngram_join import jaccard_classes, least_matches, shingles, without_near_copies


def corpus(seed=3, n=25):
    """Families of texts with a few changed words, exact copies and unrelated texts."""
    rng, texts = random.Random(seed), []
    word = lambda: f"w{rng.randrange(3000)}"
    for _ in range(n):
        base = [word() for _ in range(rng.randint(4, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def brute(texts):
    cache = WordHashes()
    sets = [frozenset(shingles(t or "", cache).tolist()) for t in texts]
    classes = defaultdict(list)
    for i, s in enumerate(sets):
        classes[s].append(i)
    heads = {min(v): s for s, v in classes.items() if s}
    links, root = defaultdict(int), {i: i for i in range(len(texts))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in heads:
        for b in heads:
            if a < b and len(heads[a] & heads[b]) >= 0.8 * len(heads[a] | heads[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    return {i: (find(min(classes[s])), min(classes[s]), len(classes[s]), links[min(classes[s])]) if s else (i, i, 1, 0) for i, s in enumerate(sets)}


def result(df):
    return {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in df.collect()}


def test_matches_brute_force(spark):
    texts = corpus() + [None, "", "a b", "a b", "A, b!", "a b c"]
    docs = documents(spark, texts, [*range(len(texts))])
    want = brute(texts)
    assert result(jaccard_classes(docs)) == want
    kept = without_near_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v[0] for v in want.values()}) and kept.columns == docs.columns


def test_small_blocks_and_groups_lose_nothing(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in range(40)]
    docs = documents(spark, texts, [*range(40)])
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "TILE", 5)
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 300)
    assert result(jaccard_classes(docs)) == brute(texts)


def test_tiles_are_bounded():
    sizes = np.array([5, 5, 900_000, 200_000, 3_000_000, 1] + [1] * 3000)
    tile = ngram_join._tiles(sizes)
    assert tile[:6].tolist() == [0, 0, 0, 1, 2, 3] and np.bincount(tile).max() == ngram_join.TILE
    pairs = np.array([(a, b) for a in range(9) for b in range(a + 1, 9)])
    found = set()
    for members, bounds, partners in ngram_join._grouped(pairs[:, 0], pairs[:, 1], tile):
        assert len(set(tile[members])) <= 2
        found |= {(a, b) for a, i, j in zip(members, bounds, bounds[1:], strict=False) for b in partners[i:j]}
    assert found == set(map(tuple, pairs))


def test_odd_tables(spark):
    assert jaccard_classes(empty(spark)).count() == 0 and without_near_copies(empty(spark)).count() == 0
    got = {r.doc_id: r for r in jaccard_classes(documents(spark)).collect()}
    assert len(got) == documents(spark).count() and got[3].class_id is None and got[3].n_copies == 3  # with a null id
    # texts without words stay, each by itself; of the three copies the one with the null id stays
    assert sorted(r.doc_id is None or r.doc_id for r in without_near_copies(documents(spark)).collect()) == sorted([0, 1, 2, 5, 6, 7, 8, True])


def test_pruning_bound():
    t = 0.8 + 0.2 / 256
    for n, m in least_matches(0.8, 1e-6):
        tail = lambda k: sum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(k + 1))
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    s = ngram_join.signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.12


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.u: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components(edges.where("false")).count() == 0
    with pytest.raises(RuntimeError):
        components(edges, rounds=1)
