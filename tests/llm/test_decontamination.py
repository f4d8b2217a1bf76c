from __future__ import annotations

import random

import numpy as np
from cases import documents, empty

from quern.llm.decontamination import greedy_tiles, leaks, without_leaks

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def brute_tiles(item, text, least):
    """Greedy string tiling by comparing all positions, the longest first."""
    used_i, used_t, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and not used_i[i + n] and not used_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return total
        for k in range(n):
            used_i[i + k] = used_t[t + k] = True
        total += n


def test_tiles_cover_as_much_as_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randrange(1, 5) for _ in range(rng.randint(3, 14))]
        text = [rng.randrange(1, 5) for _ in range(rng.randint(3, 30))]
        seeds = {tuple(item[i : i + 3]) for i in range(len(item) - 2)}
        starts = np.array([t for t in range(len(text) - 2) if tuple(text[t : t + 3]) in seeds], np.int64)
        tiles = greedy_tiles(np.array(item, np.uint64), np.array(text, np.uint64), starts, 3)
        for i, t, n in tiles:
            assert item[i : i + n] == text[t : t + n]
        marks = [k for i, _, n in tiles for k in range(i, i + n)]
        assert len(marks) == len(set(marks))
        assert len(marks) == brute_tiles(item, text, 3)


def test_reordered_passages_are_caught(spark):
    words = ITEM.split()
    texts = [f"before {ITEM} after", " ".join([*words[12:], "middle", *words[:12]]), " ".join(words[:8] + ["x"] * 20), "Alpha, beta; GAMMA delta. " + " ".join(words[4:]), None, ""]
    docs = documents(spark, texts, [*range(6)])
    items = spark.createDataFrame([(5, ITEM), (5, ITEM), (9, ITEM.upper()), (1, None), (2, "too short"), (None, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks(docs, items).collect()}
    assert set(got) == {(0, 5), (1, 5), (3, 5)}
    assert got[0, 5].coverage == 1.0 and got[0, 5].tiles == [[0, 1, 20]] and len(got[1, 5].tiles) == 2
    clean = without_leaks(docs, items)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4, 5] and clean.columns == docs.columns


def test_short_items_match_whole(spark):
    docs = documents(spark, ["it says Red; herring here", "red and herring", "a herring red", "one two three four and five", "red", None], [*range(6)])
    items = spark.createDataFrame([("a", "red herring"), ("b", "ONE two three four"), ("c", " ,"), ("d", "RED, HERRING")], "item_id string, text string")
    got = {(r.doc_id, r.item_id, r.coverage): r.tiles for r in leaks(docs, items).collect()}
    assert got == {(0, "a", 1.0): [[0, 2, 2]], (3, "b", 1.0): [[0, 0, 4]]}
    assert sorted(r.doc_id for r in without_leaks(docs, items).collect()) == [1, 2, 4, 5]


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + f" {ITEM}"
    docs = documents(spark, [text, text.removesuffix(ITEM)], [1, 2])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [(r.doc_id, r.tiles) for r in leaks(docs, items).collect()] == [(1, [[0, 300_000, 20]])]


def test_blocks_change_nothing(spark):
    rng = random.Random(1)
    items = [" ".join(f"w{rng.randrange(500)}" for _ in range(25)) for _ in range(30)]
    texts = [f"{items[i % 30]} tail {i}" if i % 3 else " ".join(f"w{rng.randrange(500)}" for _ in range(80)) for i in range(60)]
    docs, bench = documents(spark, texts, [*range(60)]), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one = sorted((r.doc_id, r.item_id, r.coverage) for r in leaks(docs, bench).collect())
    assert one == sorted((r.doc_id, r.item_id, r.coverage) for r in leaks(docs, bench, block_words=100).collect())
    assert {x[0] for x in one} == {i for i in range(60) if i % 3}
    assert without_leaks(docs, bench, block_words=100).count() == 20


def test_odd_tables(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leaks(documents(spark), bench).count() == 0 and leaks(empty(spark), bench).count() == 0
    assert leaks(documents(spark), bench.where("false")).count() == 0
    assert without_leaks(documents(spark), bench.where("false")).count() == documents(spark).count()
