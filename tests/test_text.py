from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import lexicon as L
from quern.functions import text as T


@pytest.fixture()
def one(spark):
    def run(expression, text=None, **values):
        df = spark.createDataFrame([{"text": text, **values}], "text string" + "".join(f", {k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
        return df.select(expression.alias("x")).first().x

    return run


def test_tokens_of_both_scripts(one):
    assert one(T.tokens(F.col("text")), "The T2DM-risk of don't 心肌梗死 a") == ["t2dm-risk", "don't", "心", "肌", "梗", "死", "心肌", "肌梗", "梗死"]
    assert one(T.tokens(F.col("text")), None) == []


@pytest.mark.parametrize(("text", "chunk", "query"), [("", "en", "en"), ("abcd", "en", "en"), ("心" + "a" * 20, "mixed", "en"), ("心心aaaa", "zh", "mixed"), ("心心心a", "zh", "zh")])
def test_language(one, text, chunk, query):
    assert one(T.language(F.col("text")), text) == chunk
    assert one(T.query_language(F.col("text")), text) == query


def test_clean_makes_half_width(one):
    assert one(T.clean(F.col("text")), "　Ａ１？  b\n c ") == "A1? b c"


def test_estimate_tokens(one):
    assert one(T.estimate_tokens(F.col("text")), "") == 0
    assert one(T.estimate_tokens(F.col("text")), "a" * 503) == 131
    assert one(T.estimate_tokens(F.col("text")), "心" * 157) == 131


def test_shingles_and_jaccard(one):
    assert one(T.char_shingles(F.col("text")), "A b c d e") == ["abcd", "bcde"]
    assert one(T.char_shingles(F.col("text")), "ab") == ["ab"]
    assert one(T.char_shingles(F.col("text")), " ") == []
    same = T.jaccard(T.char_shingles(F.col("text")), T.char_shingles(F.col("other")))
    assert one(same, "metformin lowers", other="Metformin  lowers") == 1.0
    assert one(same, "metformin lowers", other="metformin lowers.") == pytest.approx(12 / 13)
    assert one(same, "", other="x") == 0.0


@pytest.mark.parametrize("budget", [100, 200, 400])
def test_truncation_ends_a_sentence_within_the_budget(one, budget):
    text = " ".join(f"Sentence number {i} tells a little about nothing much." for i in range(80))
    cut = one(T.truncate_at_sentence(F.col("text"), budget), text)
    assert cut.endswith(".") and text.startswith(cut)
    assert one(T.estimate_tokens(F.col("text")), cut) <= budget
    assert one(T.truncate_at_sentence(F.col("text"), 10_000), text) == text


def test_regions(one):
    full = "head\n\x9f====\x9f\nbody\nReferences\n[1]"
    r = one(T.regions(F.col("text")), full)
    assert (r.body, r.core, r.tail_cut) == ("body\nReferences\n[1]", "body", True)
    r = one(T.regions(F.col("text")), "a\nReferences")
    assert (r.body, r.core, r.tail_cut) == ("a\nReferences", "a\nReferences", False)


def test_paragraphs_and_sentences(one):
    assert one(T.paragraphs(F.col("text")), " a\n b\n\n \nc\n") == ["a b", "c"]
    assert one(T.sentences(F.col("text")), "One. Two! Three") == ["One.", "Two!", "Three"]


def test_headings(one):
    for line, kind in [("2. Materials and Methods:", "methods"), ("AIM", "objective"), ("1.2 资料", "cjk_section"), ("Results were good", None), ("x" * 81, None)]:
        assert one(T.section_class(F.col("text")), line) == kind


def test_acronyms_and_definitions(one):
    assert one(T.acronyms(F.col("text")), "HbA1c MI T2DM 123 THE USA mi") == ["MI", "T2DM", "THE"]
    assert [tuple(x) for x in one(T.acronym_definitions(F.col("text")), "acute myocardial infarction (AMI) and x (Y)")] == [("acute myocardial infarction", "AMI")]


def test_small_helpers(one):
    assert one(T.first_year(F.col("text")), "J Med. 2019; 3:1999") == "2019"
    assert one(T.first_year(F.col("text")), "none") is None
    assert one(T.citations(F.col("text")), "x [3] y [1][3]") == [1, 3]
    assert one(T.https_url(F.col("text")), "s3://b/k/x.txt?md5=1") == "https://b.s3.amazonaws.com/k/x.txt"
    assert one(T.url_md5(F.col("text")), "s3://b/k?md5=" + "aB" * 16) == "ab" * 16
    assert one(T.pmc_id(F.col("text")), "pmc12") == "PMC12" == one(T.pmc_id(F.col("text")), "12")
    assert one(T.id_prefix(F.col("text")), "a_b_c") == "a"
    assert one(T.mojibake_count(F.col("text")), "caf�, â€™") == 2
    assert one(T.any_term(F.col("text"), ["BC"]), "abcd") is True


def test_subword_counts_are_the_tokenizer_s():
    import base64
    import random

    import tiktoken

    from quern.functions.subword import PRETOKENS, SubwordCounter, merged
    from quern.operators import chunk

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    exact = tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
    counter, rng = SubwordCounter(path), random.Random(4)
    letters = list("ab'sS tll \n\t\r  0123.,!?éßİ日本\U0001f600\x00​ǅ٣² \x85_-<|>") + ["ing", "the ", " a", "'re"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["", "a" * 5000, "<|endoftext|>"]
    for text in texts:
        assert counter(text) == len(exact.encode_ordinary(text))
        n = rng.randint(0, 12)
        tail = counter.tail(text, n)
        assert counter(tail) <= n and text.rstrip().endswith(tail)
    assert b"".join(merged("héllo wörld".encode(), ranks)) == "héllo wörld".encode()
    parts = chunk.recursive_split(" ".join(f"word{i % 7}ing" for i in range(300)), 40, counter)
    assert len(parts) > 5 and all(counter(p) <= 40 for p in parts)


def test_running_counts_are_those_of_the_whole_text():
    import random

    import public_tokenizers

    from quern.functions.subword import SubwordCounter
    from quern.operators import chunk

    counter, rng = SubwordCounter(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(1)
    bits = ["'", "r", "e", "'re", " ", "  ", "\n", "don't", " word", "123", ". ", "。", "!!", " ?", " é", "L'", " 've", "\t"]
    for _ in range(500):
        own, text = counter.running(), ""
        for _ in range(10):
            piece = "".join(rng.choices(bits, k=rng.randrange(4)))
            assert own.with_piece(piece) == counter(text + piece) and counter.over(text + piece, 7) == (counter(text + piece) > 7)
            own.add(piece)
            text += piece
    text, seen = " ".join(rng.choices([*bits, "tokens", "counted"], k=3000)), []

    class Watched(SubwordCounter):
        def cuts(self, part):
            seen.append(len(part))
            return super().cuts(part)

    assert chunk.recursive_split(text, 200, Watched(counter.path)) == chunk.recursive_split(text, 200, lambda x: counter(x))
    assert sum(seen) < 20 * len(text)  # each piece was counted with all before it in its chunk


def test_definitions_are_found_in_one_pass(spark):
    """As the plain pattern finds them, also at the end of a run of many words."""
    rng = random.Random(8)
    signs = ["a", "bc", "D", "-", "-x", " ", " ", " ", "\t", "\n", "(HF)", "(H-2F)", "(H)", "(", ")", "(hf)", "7", ".", "é"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 90))) for _ in range(3000)] + ["", "long " * 14 + "name (LN)", "a b (AB) (CD)", "a b(AB)c d(CD)"]
    own = spark.createDataFrame([(x,) for x in texts], "text string")
    got = [(r.text, [tuple(x) for x in r.d]) for r in own.select("text", T.acronym_definitions(F.col("text")).alias("d")).collect()]
    plain = re.compile(L.DEFINITION)
    assert sum(len(d) for _, d in got) > 20
    assert all(d == [x for x in plain.findall(text) if len(x[0]) <= L.LONGEST_PHRASE] for text, d in got)
    plan = own.select(T.acronym_definitions(F.col("text")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # the texts are scanned once
    many = spark.createDataFrame([("word " * 200_000 + "heart failure (HF)",)], "text string")
    found = many.select(T.acronym_definitions(F.col("text")).alias("d")).first().d
    assert [tuple(x) for x in found] == [("word " * 6 + "heart failure", "HF")]
