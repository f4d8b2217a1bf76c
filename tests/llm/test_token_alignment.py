from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from cases import TEXTS, documents, empty

from quern.llm.queries import op11_token_alignment
from quern.llm.token_alignment import Aligner, align_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a▁b and ▁", "<s> x </s> <|endoftext|>", "  lead  and   trail   ", "x \n y\n\n z\t w", "<0x0A> \x00\x01", "\xa0 \xa0 x\xa0 y", "don't  we'll 12 345", " ", "\n", "é日本 \U0001f600 ß"]


def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    return a, b


def plain(texts, kind):
    """Whole texts, token by token."""
    a, b = sides()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        xs, ys = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in xs]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ys for p in [b.id_to_piece(i)]]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append(None)
            continue

        def spans(ids, parts):
            at, out = 0, []
            for i, x in zip(ids, parts):
                out.append((at, at + len(x), i))
                at += len(x)
            return out

        sa, sb = spans(xs, bytes_a), spans(ys, bytes_b)
        shared = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        groups, start = [], 0
        for end in shared:
            groups.append(([x for x in sa if start < x[1] <= end], [x for x in sb if start < x[1] <= end]))
            start = end
        links = {
            "ends": lambda: [(x[2], y[2]) for g in groups for x in g[0] for y in g[1] if x[1] == y[1]],
            "overlaps": lambda: [(x[2], y[2]) for g in groups for x in g[0] for y in g[1] if x[0] < y[1] and y[0] < x[1]],
            "groups": lambda: [(x[2], y[2]) for g in groups for x in g[0] for y in g[1]],
        }
        digest = ";".join(",".join(str(x[2]) for x in g[0]) + "|" + ",".join(str(y[2]) for y in g[1]) for g in groups)
        found.append((len(xs), len(ys), len(groups), links[kind](), hashlib.sha256(digest.encode()).hexdigest(), len(links["overlaps"]()), len(links["groups"]())))
    counts = Counter(x for f in found if f for x in f[3])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, 0, 0, "", 0, 0))
            continue
        out.append((f[0], f[1], f[2], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), *f[4:]))
    return out


@pytest.mark.parametrize("kind", ["ends", "overlaps", "groups"])
def test_against_whole_texts(spark, kind):
    texts = [t if t is None or len(t) < 5000 else t[:4000] for t in TEXTS] + ODD
    docs = documents(spark, texts)
    ids = [*range(len(texts) - 1), None]
    got = {r.doc_id: tuple(r)[1:] for r in align_tokens(docs, *PATHS, links=kind).collect()}
    assert got == dict(zip(ids, plain(texts, kind)))


def test_pieces_align_as_their_text_does():
    rng, letters = random.Random(3), list("ab'sS tll \n\t\r  0123.,!?éßİ日本\U0001f600​ǅ٣Ⅷ² \x85\x1c_-<>▁") + ["ing", "the ", " a"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    aligner = Aligner(*PATHS, "ends")
    assert aligner.cut
    alone = list(aligner.align(texts))
    pieces = list(dict.fromkeys(p for t in texts for p in aligner.pieces(t)))
    entries = dict(zip(pieces, aligner.entries(pieces)))
    for text, whole in zip(texts, alone):
        parts = [entries[p] for p in aligner.pieces(text)]
        if whole is None:
            assert None in parts
        elif None not in parts:
            assert whole[0] == "".join(p[0] for p in parts) and whole[1:6] == tuple(map(sum, zip(*(p[1:6] for p in parts)))) and whole[6] == b"".join(p[6] for p in parts)


def test_long_texts_empty_tables_and_kinds(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in align_tokens(docs, *PATHS).collect()}
    assert got[7].n_a > 60_000 and got[7].n_groups == got[7].n_links and got[3].groups_sha256 == got[None].groups_sha256
    assert align_tokens(empty(spark), *PATHS).collect() == []
    with pytest.raises(ValueError):
        align_tokens(docs, *PATHS, links="none")


def test_query_against_whole_texts(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op11_token_alignment(spark, data).collect()}
    assert got == dict(zip((r.doc_id for r in rows), plain([r.text for r in rows], "ends")))
