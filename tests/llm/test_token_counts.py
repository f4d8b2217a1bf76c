from __future__ import annotations

import random

import pytest
from cases import documents, empty

from quern.llm.token_counts import PieceCounter, token_counts


def greedy(pieces, word):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("whole", [True, False])
def test_matches_the_greedy_search(whole):
    rng = random.Random(9)
    for _ in range(60):
        pieces = {b"_"} | {bytes(rng.choice(b"_abc") if k == 0 else rng.choice(b"abc") for k in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 25))}
        pieces |= {b"a", b"b", b"c"} if whole else set()
        counter = PieceCounter(pieces, b"_")
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            assert counter[word] == greedy(pieces, b"_" + word)


def test_documents(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    import base64

    with open(path, "rb") as lines:
        pieces = {base64.b64decode(x.split()[0]) for x in lines if x.strip()}
    docs = documents(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in token_counts(docs, path).collect()}
    for i in (0, 1, 2, 3, 4, 6, 8, None):
        words = texts[i].encode().split()
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(greedy(pieces, b" " + w) for w in words))
    assert got[7].n_tokens > 60_000 and token_counts(empty(spark), path).count() == 0
