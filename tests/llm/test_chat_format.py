from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from quern.llm.chat_format import CONTROLS, escape, format_conversations, format_turns, marked_template, read_marked, unescape

PARTS = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "a", " ", "\n", "é"]), max_size=12).map("".join)


@given(PARTS)
def test_escape_round_trip(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)


@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_spans_hold_the_turns(turns):
    done = format_turns(turns, marked_template)
    assert [read_marked(done.text[a:b]) for a, b in done.spans] == turns
    assert [unescape(done.text[a:b]) for a, b in done.text_spans] == [t for _, t in turns]
    assert done.rewritten_at == -1 and (not turns or done.spans[-1][1] == len(done.text))


def test_rewriting_templates_are_found():
    forgetful = lambda turns: "".join(f"[{r}:{t if i + 2 >= len(turns) else '...'}]" for i, (r, t) in enumerate(turns))
    assert format_turns([("u", "a"), ("b", "c"), ("u", "d")], forgetful).rewritten_at == 2
    assert format_turns([("u", "a"), ("b", "c")], forgetful).rewritten_at == -1
    turns = [("u", "aaaa"), ("assistant", "bbbb"), ("u", "dd"), ("assistant", "cccc")]
    done = format_turns(turns, forgetful)
    assert done.spans == [None] * 4 and [x and done.text[slice(*x)] for x in done.text_spans] == [None, None, "dd", "cccc"]


def test_masks_under_rewritten_history(spark):
    """A mask holds the assistant's texts, each once, or there is none."""
    rows = [(c, i, r, t) for c, turns in enumerate([[("user", "a"), ("assistant", "bb")], [("user", "a"), ("assistant", "bb"), ("user", "a"), ("assistant", "a")]]) for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    forgetful = lambda turns: "".join(f"[{r}:{t if i + 2 >= len(turns) else '...'}]" for i, (r, t) in enumerate(turns))
    counted = lambda turns: f"{len(turns)} turns " + "".join(f"[{r}:{t}]" for r, t in turns)
    twice = lambda turns: counted(turns) * 2
    read = lambda span: ("assistant", span)
    want = [["bb"], ["bb", "a"]]
    for template, lost in ((forgetful, {1}), (counted, set()), (twice, {0, 1})):
        for r in format_conversations(df, template, read, lambda x: x).collect():
            if r.rewritten_at < 0:
                continue
            assert r.turns_sha256 is None and r.spans is None
            assert (None if r.loss_spans is None else [r.formatted[a:b] for a, b in r.loss_spans]) == (None if r.conv_id in lost else want[r.conv_id])


def test_text_that_looks_like_the_template():
    for text in ("", "A", "]", "a]", "user:", "[user:A]", "AB" * 5):
        done = format_turns([("user", text), ("user", text)], lambda turns: "".join(f"[{r}:{t}]" for r, t in turns))
        assert [done.text[a:b] for a, b in done.text_spans] == [text, text]


def test_rendering_goes_by_the_turns():
    calls = []
    format_turns([("user", "x")] * 50, lambda turns: calls.append(len(turns)) or "".join(t for _, t in turns))
    assert len(calls) <= 101 and sum(calls) <= 50 * 52


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("a", 0, "assistant", "x" * 300_000)], "conv_id string, turn long, role string, text string")
    assert [(r.conv_id, r.loss_chars) for r in format_conversations(df).collect()] == [("a", 300_000)]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, "user", "y"), (None, 0, "assistant", "z"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "'q' as formatted")
    got = {r.conv_id: r for r in format_conversations(df).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\n\nassistant\n</s>[INST] ok\n") and got[1].loss_sha256 == digest("</s>[INST] ok") and got[1].loss_chars == 13
    assert got[2].turns_sha256 == digest("\nx\nuser\ny\n") and got[2].loss_chars == 0 and got[2].loss_sha256 == digest("")
    assert got[3].n_turns == 2 and got[None].loss_chars == 1
    a, b = got[1].loss_spans[0]
    assert unescape(got[1].formatted[a:b]) == "</s>[INST] ok"
    assert format_conversations(df.where("false")).count() == 0
