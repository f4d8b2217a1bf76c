"""Chat formatting: incremental rendering with a black-box template.

A template is any function from the turns so far to one string.  A conversation
is rendered after each of its turns; where the output of k turns is a prefix of
the output of k + 1, the rest is the span of turn k + 1.  A template whose
output doesn't extend the one before rewrites history, which is reported with
the first such turn.  Where a turn's text lies inside its span is found without
looking into the template: the turn is rendered once more with a letter that the
span doesn't hold, and what both spans share at either end is the template's
own.  Where history is rewritten, spans of earlier outputs say nothing about the
last one: turns then have no span, and a turn's text has one only if a letter in
its place changes the last output in one stretch that reads back as the text.

Defined cases: turns are ordered by turn, then role and text (nulls first), so
ties and repeated rows give one result; a null role or text is empty; a very
long text is one turn like others; a conversation without rows doesn't appear,
so an empty table gives none; rows with a null conversation id form one
conversation; a conversation whose history is rewritten has a null digest of its
turns, and null loss columns unless every text under the mask has its span;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import task

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: The control strings of the template below.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = re.compile(r"([<\[])(\\*/?(?:s>|INST\]))")
_UNESCAPE = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")


def escape(text: str) -> str:
    """A backslash goes into each control string, one more where there are some already; so no control string is left."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def marked_template(turns: list[Turn]) -> str:
    """``<s>[INST]role[/INST]text</s>`` for each turn, role and text escaped."""
    return "".join(f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)


def read_marked(span: str) -> Turn:
    """Role and text of one span of the template above."""
    role, _, text = span.removeprefix("<s>[INST]").removesuffix("</s>").partition("[/INST]")
    return unescape(role), unescape(text)


Span = tuple[int, int]


@dataclass(frozen=True)
class Formatted:
    """The rendered text, each turn's span and the span of its text (None where there is none), and the first turn that rewrote history (or -1)."""

    text: str
    spans: list[Span | None]
    text_spans: list[Span | None]
    rewritten_at: int


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def _changed(own: str, probed: str) -> Span:
    """The stretch of ``own`` outside of what both share at their start and at their end."""
    head = _shared(own, probed)
    tail = _shared(own[head:][::-1], probed[head:][::-1])
    return head, len(own) - tail


def _probe(text: str) -> str:
    """A character that the text doesn't hold."""
    return next(c for c in map(chr, range(65, 0x110000)) if c.isalpha() and c not in text)


def _in_last_output(turns: list[Turn], template: Template, output: str, decode: Callable[[str], str]) -> list[Span | None]:
    """For each turn where its text stands in the output of all turns."""
    out: list[Span | None] = []
    for k, (role, text) in enumerate(turns):
        probed = template([*turns[:k], (role, _probe(output)), *turns[k + 1 :]])
        start, end = _changed(output, probed)
        out.append((start, end) if probed != output and decode(output[start:end]) == text else None)
    return out


def format_turns(turns: list[Turn], template: Template, decode: Callable[[str], str] = lambda x: x) -> Formatted:
    """Renders every prefix of the turns and compares neighbours; ``decode`` reads a rendered text back."""
    before, spans, text_spans, rewritten = template([]), [], [], -1
    for k, (role, _) in enumerate(turns):
        output, start = template(turns[: k + 1]), len(before)
        if not output.startswith(before):
            rewritten = k if rewritten < 0 else rewritten
        if rewritten < 0:
            span = output[start:]
            probed = template([*turns[:k], (role, _probe(span))])
            if probed.startswith(before):
                head, end = _changed(span, probed[start:])
                text_spans.append((start + head, start + end))
            else:
                text_spans.append(None)
            spans.append((start, len(output)))
        before = output
    if rewritten >= 0:
        spans, text_spans = [None] * len(turns), _in_last_output(turns, template, before, decode)
    return Formatted(before, spans, text_spans, rewritten)


def format_conversations(turns: DataFrame, template: Template = marked_template, read: Callable[[str], Turn] = read_marked, decode: Callable[[str], str] = unescape, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: text, spans, loss spans and digests of what is read back from the text.

    A conversation is one output string, so its turns meet in one task.
    """
    schema = pa.schema([
        ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten_at", pa.int64()),
    ])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.struct(t.role, t.text))
    grouped = turns.groupBy("conv_id").agg(ordered.alias("turns"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def one(rows: list[dict]) -> dict:
        done = format_turns([(r["role"], r["text"]) for r in rows], template, decode)
        out = {"formatted": done.text, "spans": None, "loss_spans": None, "n_turns": len(rows), "turns_sha256": None, "loss_chars": None, "loss_sha256": None, "formatted_chars": len(done.text), "rewritten_at": done.rewritten_at}
        roles = [r["role"] for r in rows]
        if done.rewritten_at < 0:
            found = [read(done.text[start:end]) for start, end in done.spans]
            roles = [role for role, _ in found]
            out |= {"spans": [list(x) for x in done.spans], "turns_sha256": hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in found).encode()).hexdigest()}
        masked = [x for x, role in zip(done.text_spans, roles, strict=True) if role in loss_roles]
        if None not in masked:
            plain = [decode(done.text[first:last]) for first, last in masked]
            out |= {"loss_spans": [list(x) for x in masked], "loss_chars": sum(map(len, plain)), "loss_sha256": hashlib.sha256("".join(plain).encode()).hexdigest()}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for start in range(0, part.num_rows, 500):
                rows = part.slice(start, 500)
                done = pa.RecordBatch.from_pylist([one(x) for x in rows.column(1).to_pylist()], schema=schema)
                yield pa.RecordBatch.from_arrays([rows.column(0), *done.columns], names=["conv_id", *schema.names])

    return grouped.mapInArrow(task(run), f"conv_id {kind}, formatted string, spans array<array<long>>, loss_spans array<array<long>>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_at long")
