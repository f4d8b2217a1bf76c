from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from cases import TEXTS, documents, empty

from quern.llm import personal_data as P
from quern.llm.queries import op12_personal_data


@pytest.fixture(scope="module")
def field():
    return P.fit_field()


def plain_base(text):
    """The patterns as they are stated."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        found += [("card", *m.span())] if 12 <= len(digits) <= 19 and total % 10 == 0 else []
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[1], P.KINDS.index(x[0])))


def test_base_spans_against_the_patterns():
    rng = random.Random(4)
    parts = list("ab.-_%+@ ()0123456789\n") + ["+1 (555) 010-2233", "4111 1111 1111 1111", "a.b@c.d", "10.0.255.1", "@x.y", "256"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert P.base_spans(text) == plain_base(text), text


def test_beliefs_against_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, k = 5, 3
        unary = rng.normal(size=(n, k))
        pairs = np.array([(rng.integers(0, i), i) for i in range(1, n) if rng.random() < 0.8]).reshape(-1, 2).astype(int)
        squares = rng.normal(size=(len(pairs), k, k))
        weight, total = np.zeros((n, k)), 0.0
        for labels in itertools.product(range(k), repeat=n):
            w = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(s[labels[a], labels[b]] for (a, b), s in zip(pairs, squares)))
            total += w
            for i, x in enumerate(labels):
                weight[i, x] += w
        assert np.allclose(np.exp(P.beliefs(unary, pairs, squares)[0]), weight / total)


def test_made_documents_of_another_seed(field):
    rng = random.Random(77)
    right = wrong = missed = 0
    for _ in range(300):
        text, due = P.made_document(rng)
        own = P.candidates(text)
        g = P.graph(text, own)
        got = set(P.spans_of(own, field.labels(g).tolist(), set(g.pairs[g.kinds == 0, 1].tolist())))
        right, wrong, missed = right + len(got & set(due)), wrong + len(got - set(due)), missed + len(set(due) - got)
    assert 2 * right / (2 * right + wrong + missed) > 0.95


def found(text, field):
    base, spans = P.find_spans([text], field)[0]
    assert set(base) <= set(spans)
    return [(kind, text[a:b]) for kind, a, b in spans]


def test_what_patterns_miss(field):
    assert found("the erntou +1 (269) 555-3296 4524132264652876 and onrend", field) == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]
    assert found("at 38.253.197.126 4880761348116108 ly", field) == [("ip", "38.253.197.126"), ("card", "4880761348116108")]
    assert found("write to ana.li [at] post1 [dot] org soon", field) == [("email", "ana.li [at] post1 [dot] org")]


def test_labels_agree_over_the_text(field):
    far = " word" * 3000
    assert found("erre 555-3296 the", field) == []
    assert found(f"erre +1 (269) 555-3296 the{far} ti 555-3296 er", field)[1:] == [("phone", "555-3296")]
    # messages go through more than one link
    assert len(found(f"phone +1 (269) 555-3296 the{far} ti 555-3296 er{far} mi 555-3296 lo", field)) == 3


def test_clean_texts_stay(field):
    for text in ["In 2019, version 4.0.1 of 12 items (1998) cost 12.50 on 2024-01-15.", "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\"", "order 123456789012 at 9.30", "look at that dot there", "a@b", "+5 %", "1 2 3 4 5 6"]:
        assert found(text, field) == []


def test_odd_tables(spark, field):
    docs = documents(spark, [*TEXTS[:-1], "mail a.b@c.de or +1 (269) 555-3296"])
    got = {r.doc_id: r for r in P.personal_data(docs, field, with_masked=True).collect()}
    assert got[None].masked == "mail [email] or [phone]" and [tuple(s) for s in got[None].base] == [("email", 5, 13), ("phone", 17, 34)]
    assert all(not got[i].spans for i in range(9)) and got[7].masked == TEXTS[7] and got[0].masked == ""
    assert P.personal_data(empty(spark), field).collect() == []
    with pytest.raises(ValueError):
        P.personal_data(docs.withColumnRenamed("doc_id", "base"), field, "base")


def test_long_runs_take_no_long_time(field):
    for text in ["x" * 300_000, "1" * 300_000, "1 " * 20_000, "a@" * 50_000, "+1" * 50_000, "1.2." * 50_000, "x at y dot z " * 3000, "+1 (269) 555-3296 " * 2000]:
        P.find_spans([text], field)


def test_query(spark, data, field):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in op12_personal_data(spark, data).collect():
        base = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in P.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in P.find_spans([texts[r.doc_id]], field)[0][1])
