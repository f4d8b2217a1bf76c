from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty

from quern.llm.ppm_scoring import DISCOUNT, HashedCodes, Keys, PartialMatching, _Buckets, _by_length, _Sums, gram_codes, lowered, score_documents, windows


def codes_of(texts, order, most=None):
    """All codes of the texts, and the texts' numbers."""
    codes, numbers = [], []
    for own, group in windows([lowered(t) for t in texts], order, most):
        found, starts = gram_codes(group, order)
        codes.append(found)
        numbers.append(np.repeat(own, np.diff([*starts, len(found)])))
    return np.concatenate(codes), np.concatenate(numbers)


def model_of(texts, order):
    codes, _ = codes_of(texts, order)
    parts = _by_length(*np.unique(codes, return_counts=True), order)
    return PartialMatching(order, [g for g, _ in parts], [n for _, n in parts])


def brute(texts, text, order):
    """log10 of the text by partial matching with dictionaries."""
    counts: dict = {}
    wrap = lambda t: [0xFE] * order + list(lowered(t)) + [0xFF]
    for t in texts:
        s = wrap(t)
        for i in range(order, len(s)):
            for j in range(order, -1, -1):  # a shorter context learns a symbol only where the longer one escaped
                own = counts.setdefault(tuple(s[i - j : i]), Counter())
                own[s[i]] += 1
                if own[s[i]] > 1:
                    break
    total, s = 0.0, wrap(text)
    for i in range(order, len(s)):
        excluded: set = set()
        for j in range(order, -1, -1):
            own = {k: v for k, v in counts.get(tuple(s[i - j : i]), {}).items() if k not in excluded}
            n = sum(own.values())
            if s[i] in own:
                total += math.log10((own[s[i]] - DISCOUNT) / n)
                break
            if own:
                total += math.log10(DISCOUNT * len(own) / n)
                excluded |= set(own)
        else:
            total -= math.log10(256 - len(excluded))
    return total


def test_matches_brute_force():
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abcA é\n") for _ in range(rng.randint(0, 30)))
    train = [text() for _ in range(30)]
    model = model_of(train, 3)
    for t in [*(text() for _ in range(30)), "", "zz", "日本", train[0]]:
        assert model.log10(codes_of([t], 3)[0]).sum() == pytest.approx(brute(train, t, 3))


def test_probabilities_add_up():
    model = model_of(["the theory", "them then", "a thing"], 3)
    for context in (b"the", b"hin", b"zzz", b"xth"):
        codes = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)], np.uint64)
        assert (10.0 ** model.log10(codes)).sum() == pytest.approx(1.0)


def test_hash_table():
    codes = np.unique(np.random.default_rng(0).integers(0, 2**48, 5000, dtype=np.uint64))
    table = HashedCodes(codes)
    assert (table.find(codes) == np.arange(len(codes))).all() and (table.find(codes + np.uint64(2**50)) == -1).all()


@pytest.mark.parametrize("heavy", [3, 100_000])
def test_base_scores(spark, heavy):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["The", "cat", "dog\n", f"x{rng.randrange(40)}"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = documents(spark, texts, [*range(60)])
    words = lambda t: [*lowered(t).split(), b""]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60)}
    counts = Counter(w for i, t in enumerate(texts) if not held[i] for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for r in score_documents(docs, order=3, max_heavy=heavy).collect():
        own = words(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r.score < 0


def test_windows_hold_every_symbol_once():
    texts = ["", "abc", "abcdefghijklmnopqrstuvwxyz", "é" * 9, "x"]
    whole, of = codes_of(texts, 3)
    for most in (1, 4, 7, 30):
        codes, numbers = codes_of(texts, 3, most)
        assert codes.tolist() == whole.tolist() and numbers.tolist() == of.tolist()


def test_better_than_words_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = score_documents(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


@pytest.mark.parametrize("order", [1, 3, 5])
def test_scores_are_those_of_all_grams(spark, order, monkeypatch):
    """Whatever the chunks and buckets, no entry is missing; a byte's n-grams must not be dropped by their number."""
    monkeypatch.setattr("quern.llm.ppm_scoring._CHUNK_CHARS", 50)
    monkeypatch.setattr("quern.llm.ppm_scoring._SLICE_BYTES", 20)
    monkeypatch.setattr("quern.llm.ppm_scoring._TOGETHER", 5)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdE é\n") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    got = {r.doc_id: r.score for r in score_documents(documents(spark, texts, [*range(80)]).repartition(3), order=order).collect()}
    assert all(got[i] == pytest.approx(brute(train, t, order)) for i, t in enumerate(texts))


def test_odd_tables(spark):
    got = score_documents(documents(spark)).collect()
    assert len(got) == documents(spark).count() and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[0] == 1 and {r.doc_id: r.held_out for r in got}[None] is True
    assert score_documents(empty(spark)).count() == 0
    alone = score_documents(documents(spark, ["ab"], [None])).first()  # nothing to learn from
    assert alone.score == pytest.approx(-3 * math.log10(256)) and alone.n_known == 0 and alone.train_tokens == 0


def test_sums_are_those_of_a_counter(monkeypatch):
    monkeypatch.setattr("quern.llm.ppm_scoring._AT_ONCE", 7)
    rng, sums, want = np.random.default_rng(0), _Sums(), Counter()
    for _ in range(60):
        codes = rng.integers(0, 50, rng.integers(0, 6)).astype(np.uint64)
        counts = rng.integers(0, 3, len(codes))
        sums.add(codes, counts)
        for code, n in zip(codes.tolist(), counts.tolist(), strict=True):
            want[code] += n
    codes, counts = sums.done()
    assert codes.tolist() == sorted(want) and counts.tolist() == [want[c] for c in sorted(want)]


def test_waiting_rows_keep_no_batch(monkeypatch):
    """A bucket of many batches: what waits of them isn't their buffers."""
    monkeypatch.setattr("quern.llm.ppm_scoring._WAITING", 1)
    keys, held = Keys(5), []

    def batches():
        grams, counts = (np.arange(50_000, dtype="<u4").tobytes() for _ in range(2))
        for chunk in range(20):
            rows = pa.record_batch([pa.array([chunk]), pa.array([7], pa.int32()), pa.array([grams], pa.binary()), pa.array([counts], pa.binary())], names=["chunk", "bucket", "grams", "counts"])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema) as writer:
                writer.write_batch(rows)
            del rows
            held.append(pa.total_allocated_bytes())
            yield pa.ipc.open_stream(out.getvalue()).read_next_batch()

    waiting = _Buckets(keys)
    (found,) = [(codes, counts) for codes, counts in waiting.read(batches())]
    assert len(found[0]) == 50_000 and found[1].tolist() == [20 * i for i in range(50_000)]
    assert max(held) - held[0] < 4 * 400_000


def test_tasks_grow_in_number_and_words_are_sent_by_bytes(spark, monkeypatch):
    """Each chunk is a task's work whatever the shuffle's partitions; words beyond the bytes that are sent go through the join."""
    monkeypatch.setattr("quern.llm.ppm_scoring._HEAVY_BYTES", 100, raising=False)
    monkeypatch.setattr("quern.llm.ppm_scoring._CHUNK_CHARS", 200)
    monkeypatch.setattr("quern.llm.ppm_scoring._SLICE_BYTES", 100)
    texts = [f"{'x' * 150} a a a b{i} {'é' * 60}" for i in range(40)]
    docs = documents(spark, texts, [*range(40)]).repartition(2)
    sent, dealt, frame = [], [], type(docs)
    broadcast, repartition = type(spark.sparkContext).broadcast, frame.repartition
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    monkeypatch.setattr(frame, "repartition", lambda self, *by: dealt.append(by) or repartition(self, *by))
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    assert [n >= 20 for n, _ in dealt] == [True, True] and list(sent[0]) == [b"a"]
    words = lambda t: [*lowered(t).split(), b""]
    counts = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in words(t))
    size = math.log10(counts.total() + 0.1 * (len(counts) + 1))
    for i, t in enumerate(texts):
        assert got[i].base_score == pytest.approx(sum(math.log10(counts[w] + 0.1) - size for w in words(t))) and got[i].n_known == sum(counts[w] > 0 for w in words(t))
