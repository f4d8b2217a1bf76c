from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from cases import documents, empty

from quern.llm.toxicity import DECAY, SPAN, _gram_matrix, _stretches, between_words, character_classes, fit, landmark_basis, nystroem, toxicity

INSULTS = ["idiot", "worthless", "pathetic", "clown"]


def corpus(n=600, seed=5):
    rng = random.Random(seed)
    parts = ["the", "re", "ation", "an", "ing", "ou", "on", "st", "ed", "ly", "or", "ha", "es", "wh"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        words = [word() for _ in range(rng.randint(10, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, toxic, " ".join(words).capitalize() + "."))
    return rows


def test_held_out_accuracy_and_disguises():
    rows = corpus()
    model = fit([(y, t.lower()) for _, y, t in rows[:400]], landmarks=120)
    held = rows[400:]
    predicted = model.scores([t for _, _, t in held]) >= 0.7
    truth = np.array([y for _, y, _ in held], bool)
    assert (predicted == truth).mean() > 0.97
    hidden = ["the i d i o t here", "an id-iot", "IDIOT", "so w.o.r.t.h.l.e.s.s", "a clowwn"]
    assert (model.scores(hidden) >= 0.7).all() and model.scores([""])[0] == 0


def test_margins_match_the_kernel_written_out():
    rows = corpus(200)
    model = fit([(y, t.lower()) for _, y, t in rows], landmarks=40)

    def margin(unit):
        c = [*(int(model.table[ord(x)]) for x in unit), 0]  # a unit's end is a character too
        total = square = 0.0
        for i in range(len(c)):
            for k in range(i + 2, min(len(c), i + SPAN)):
                for j in range(i + 1, k):
                    total += DECAY ** (k - i - 2) * float(model.weight[(c[i] * 64 + c[j]) * 64 + c[k]])
                    square += DECAY ** (2 * (k - i) - 4)
        return total / max(1.0, square) ** 0.5 + model.bias

    for unit in ("idiot", "theation", "ab", "pathetic", "re"):
        assert abs(model.margins([unit])[0] - margin(unit)) < 1e-5
    assert abs(model.margins(["theation idiot re"])[0] - max(map(margin, ("theation", "idiot", "re")))) < 1e-5


def two_languages(n=1500, seed=3):
    """The second language's insults are made of its common parts: a stem, which is a clean word by itself, and an ending."""
    rng = random.Random(seed)
    parts = ["ach", "lich", "keit", "ein", "er", "en", "sch", "ge", "st", "ung", "pf", "tz"]
    ends = ["er", "en", "ein", "st", "ge", "pf", "sch", "tz"]
    rows = [(*r[:3], "one") for r in corpus(n // 2, seed)]
    for i in range(n // 2, n):
        toxic = int(rng.random() < 0.2)
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(10, 60))]
        words = [w for w in words if not (w.startswith("achlich") and w != "achlich")] + ["achlich"] * (rng.random() < 0.05)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), "achlich" + rng.choice(ends))
        rows.append((i, toxic, " ".join(words), "two"))
    return rows


def test_insults_made_of_common_parts():
    rows = two_languages()
    rng = random.Random(1)
    rng.shuffle(rows)
    model = fit([(y, t.lower()) for _, y, t, _ in rows[:1000]], landmarks=200)
    for language in ("one", "two"):
        held = [r for r in rows[1000:] if r[3] == language]
        predicted = model.scores([t for _, _, t, _ in held]) >= 0.7
        truth = np.array([y for _, y, _, _ in held], bool)
        assert predicted[truth].mean() >= 0.8 and predicted[~truth].mean() < 0.03


def test_query_rows(spark):
    rows = corpus(400)
    docs = documents(spark, [t for _, _, t in rows] + [None, ""], [*range(400), None, 400])
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int").selectExpr("doc_id", "1 as quality", "toxic")
    got = {r.doc_id: r for r in toxicity(docs, labels, landmarks=100).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(400)) and got[None].held_out
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == rows[i][1] for i in held) / len(held) > 0.95


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity(documents(spark), none).collect()} == {0.0} and toxicity(empty(spark), none).count() == 0


def kernel(a, b, table):
    """The kernel of two units from its definition: common subsequences of three characters, over both lengths."""

    def vector(unit):
        c, out = [*(int(table[ord(x)]) for x in unit), 0], {}
        for i, j, k in itertools.combinations(range(len(c)), 3):
            if k - i < SPAN:
                key = (c[i], c[j], c[k])
                out[key] = out.get(key, 0.0) + DECAY ** (k - i - 2)
        pairs = [(i, k) for i, _, k in itertools.combinations(range(len(c)), 3) if k - i < SPAN]
        return out, max(1.0, sum(DECAY ** (2 * (k - i) - 4) for i, k in pairs)) ** 0.5

    (x, n), (y, m) = vector(a), vector(b)
    return sum(w * y.get(key, 0.0) for key, w in x.items()) / n / m


def test_kernel_and_nystroem_map():
    rng = random.Random(2)
    units = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 14))) for _ in range(40)]
    marks = sorted(set(units[:15]))
    table = character_classes(units)
    landmark_map, basis = landmark_basis(marks, table)
    found = _gram_matrix(units, landmark_map, basis, table)
    want = np.array([[kernel(u, m, table) for m in marks] for u in units])
    assert np.allclose(found, want)
    own = np.array([[kernel(u, m, table) for m in marks] for u in marks])
    features = found @ nystroem(basis)
    assert np.allclose(features @ features.T, want @ np.linalg.pinv(own, rcond=1e-6) @ want.T)


def test_long_texts_and_units():
    model = fit([(y, t.lower()) for _, y, t in corpus(400)], landmarks=100)
    rng = random.Random(9)
    clean = " ".join(t for _, y, t in corpus(900, 8) if not y)
    for bad in ("idiot", "i d i o t", "x" * 5000 + "worthless"):
        words = clean.split(" ")
        words.insert(rng.randrange(len(words)), bad)
        whole = " ".join(words)
        assert list(between_words(whole, 1000)) != [whole]
        assert np.maximum.reduce(model.margins(list(between_words(whole, 1000)))) == pytest.approx(model.margins([whole])[0])
    assert _stretches("ab") == ["ab"]
    assert all(len(x) <= 24 for x in _stretches("a" * 24 + "bcd")) and _stretches("a" * 24 + "bcd")[-1].endswith("bcd")


def test_ids_of_other_types(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(f"d{i}", t) for i, _, t in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", y) for i, y, _ in rows], "doc_id string, toxic int")
    got = toxicity(docs, labels, landmarks=50)
    assert got.schema["doc_id"].dataType.simpleString() == "string" and got.count() == 200
