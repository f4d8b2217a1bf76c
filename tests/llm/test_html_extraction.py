from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from quern.llm.boosting import boost
from quern.llm.html_extraction import Page, extract, extract_pages, make_page, make_plain_page, train


@pytest.fixture(scope="module")
def trees():
    return train()


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = boost(x, y, trees=30, depth=3)
    z = rng.random((500, 4))
    assert ((model.decision(z) > 0) == ((z[:, 0] > 0.5) ^ (z[:, 2] > 0.3))).mean() > 0.95


def test_pages_that_the_trees_have_not_seen(trees):
    scores = []
    for seed in range(10**9, 10**9 + 120):
        source, article = make_page(seed)
        want = Counter(w for x in Page(source).text if x in article for w in x.split())
        got = Counter(extract([source], trees)[0].split())
        scores.append(2 * (want & got).total() / max(1, want.total() + got.total()))
    assert np.mean(scores) > 0.95


def test_other_layouts_that_the_trees_have_not_seen(trees):
    scores = []
    for seed in range(10**9, 10**9 + 150):
        source, article = make_plain_page(seed)
        want = Counter(w for x in Page(source).text if x in article for w in x.split())
        got = Counter(extract([source], trees)[0].split())
        scores.append(2 * (want & got).total() / max(1, want.total() + got.total()))
    assert np.mean(scores) > 0.95


SIX = [f"Reading number {i} of the list" for i in range(6)]
FIVE = [f"Paragraph {i} tells a little. It has a second sentence, too." for i in range(5)]


@pytest.mark.parametrize(("source", "blocks"), [
    ("<p>One short block. With a second sentence.</p>", ["One short block. With a second sentence."]),
    ("Plain text without any tag. Nothing else.", ["Plain text without any tag. Nothing else."]),
    ("<html><head><title>t</title></head><body>Only words here</body></html>", ["Only words here"]),
    ("<article><h1>Readings</h1><ul>" + "".join(f"<li><a href=/{i}>{x}</a></li>" for i, x in enumerate(SIX)) + "</ul></article>", ["Readings", *SIX]),
    ("<nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav><article><h1>Readings</h1><ul>" + "".join(f"<li><a href=/{i}>{x}</a></li>" for i, x in enumerate(SIX)) + "</ul></article><footer>Made by us</footer>", ["Readings", *SIX]),
    ("<article><h1>T</h1>" + "".join(f"<p>{x}</p>" for x in FIVE) + "</article>", ["T", *FIVE]),
    ("<body><h1>T</h1>" + "".join(f"<p>{x}</p>" for x in FIVE), ["T", *FIVE]),
    ("<nav><a href=/>Home</a></nav><main><h1>T</h1>" + "".join(f"<p>{x}</p>" for x in FIVE) + "</main><footer>us</footer>", ["T", *FIVE]),
])
def test_nothing_of_a_plain_article_goes(source, blocks, trees):
    assert extract([source], trees)[0].split("\n\n") == blocks


def test_blocks_references_and_white_space(trees):
    body = "".join(f"<p>Sentence {i} of the article says something of interest, and more.</p>" for i in range(5))
    page = f"<html><head><title>T</title><script>x='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><article><h1>A  &amp;\n B</h1><p>caf&eacute;&nbsp;one<br>two <b>bold</b>ly &#x41;&lt;{body}</article><footer>&copy; us</footer>"
    got = extract([page], trees)[0].split("\n\n")
    assert got[:2] == ["A & B", "café one two boldly A<"] and len(got) == 7


def test_nothing_is_kept_below_what_was_dropped():
    page = Page("<div><nav><p>a b c</p><div><p>d e</p></div></nav><p>f g</p></div>")
    rng = np.random.default_rng(0)
    for _ in range(200):
        kept = page.decode(rng.normal(0, 3, len(page.tag)))
        for i, p in enumerate(page.parent):
            if i and kept[p]:
                assert kept[i]


@pytest.mark.parametrize("source", ["", "text only", "<", "<p", "<!-- open", "<script>never closed <p>x", "</p></div>", "<a <b>>", "<p class='a\"b>x</p>", "<div " * 2000, "<p>" * 3000 + "deep", "<table><td>a<tr><td>b", "\x00<p>\ud83d</p>"])
def test_broken_pages(source, trees):
    assert isinstance(extract([source], trees)[0], str)


def test_rows(spark, trees):
    rows = [(1, "u", None), (2, None, "<article><p>Some text that is long enough, it seems. And more of it.</p></article>"), (2, None, ""), (None, "x", "<p>a</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "3 as n_chars")
    got = extract_pages(df, trees).collect()
    assert len(got) == 4 and got[0].text == "" and got[0].n_chars == 0 and got[1].n_chars == len(got[1].text) > 0
    assert extract_pages(df.where("false"), trees).count() == 0


def test_only_raw_text_is_left_out():
    page = "<body><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><object data=a>Fallback</object><svg><path d='M0'/><text>Label</text></svg><noscript><p>Plain</p></noscript><script>no</script><style>no</style><select><option>One<option>Two</select><p>Last</p>"
    assert [x for x in Page(page).text if x] == ["Let x=1 be.", "Fallback", "Label", "Plain", "One", "Two", "Last"]
    for tag in ("object", "select", "math", "svg", "video", "canvas", "audio", "noscript"):
        assert "Rest of the page" in Page(f"<body><p>First</p><{tag}><p>Rest of the page</p></body>").text
