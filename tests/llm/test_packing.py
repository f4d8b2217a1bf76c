from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from cases import documents, empty

from quern.llm.packing import TournamentTree, WordEncoder, first_fit_decreasing, pack

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_first_fit_matches_a_plain_search():
    rng = random.Random(2)
    for _ in range(50):
        sizes = np.array([rng.randint(1, 100) for _ in range(rng.randint(0, 60))], np.int64)
        bins, offsets = first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            want[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert want == {i: (bins[i], offsets[i]) for i in range(len(sizes))}


def test_tree_takes_the_first_bin_with_room():
    tree = TournamentTree(3, 10)
    assert [tree.take(n) for n in (7, 7, 3, 3, 10)] == [0, 1, 0, 1, 2]


def test_encoder_gives_the_tokenizers_ids():
    tokenizer, encoder = tokenizers.Tokenizer.from_file(PATH), WordEncoder(PATH)
    rng = random.Random(4)
    odd = ["it's", "'tis", "!'s", "ΑΣ", "ΣΑΣ", "İx", "ǅ", "é", "é", "日本語", "123", "a1b2", "<|endoftext|>", "x<|startoftext|>y", "a\xa0b", "\x1c", "...", "_", "THE", "ﬁ", "don't.", "a-b", "aaaaaaa", "x" * 150, "I\u0307", "I\u0307\u0323", "!!!???"]
    for _ in range(60):
        texts = [rng.choice([" ", "\n", "\t ", "  "]).join(rng.choice([*odd, f"w{rng.randrange(99)}"]) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        want = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
        got = encoder.encode(texts, 2)
        assert [got[i].tobytes() for i in range(len(got))] == want


def test_every_id_lies_in_one_piece(spark):
    docs = documents(spark)
    rows = pack(docs, PATH, with_ids=True, group_size=7).collect()
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    want = sorted(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.collect())
    parts: dict = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 4096
        parts.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    whole = []
    for (_, total), own in parts.items():
        starts = {}
        for r in own:
            starts.setdefault(r.start, []).append(bytes(r.ids))
        assert sum(r.length for r in own) == total * len(starts[0])
        whole += [b"".join(starts[s][k] for s in sorted(starts)) for k in range(len(starts[0]))]
    assert sorted(whole) == want
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(empty(spark), PATH).count() == 0


def test_equal_rows_of_many_partitions_meet_in_no_group(spark):
    docs = documents(spark, ["same text"] * 64, [1] * 64).repartition(32)
    assert pack(docs, PATH, group_size=8).selectExpr("sequence_id >> 32 as g").distinct().count() > 1


def test_ids_of_other_types(spark):
    docs = documents(spark).selectExpr("concat('d', doc_id) as doc_id", "text")
    assert {r.doc_id for r in pack(docs, PATH).select("doc_id").distinct().collect()} == {None, *(f"d{i}" for i in range(docs.count() - 1))}


def test_repeated_rows_keep_their_pieces(spark):
    docs = documents(spark, ["a b"] * 50, [None] * 50)
    rows = pack(docs, PATH, group_size=8).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50


def test_merging_holds_a_part_of_the_pre_tokens():
    import tracemalloc

    import pyarrow as pa

    pairs = WordEncoder(PATH).pairs
    rng = random.Random(8)
    pieces = pa.array(["".join(rng.choices("abcdefghij", k=10)) for _ in range(100_000)])
    tracemalloc.start()
    found = pairs.merged(pieces)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(pieces) and most < 40 << 20, most
    for i in [0, 1, *rng.sample(range(len(pieces)), 500), len(pieces) - 1]:
        letters = pieces[i].as_py()
        assert found[i].tolist() == [x.id for x in pairs.model.tokenize(letters)]
