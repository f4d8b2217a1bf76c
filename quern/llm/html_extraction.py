"""HTML extraction: boosted trees over DOM nodes and a hierarchical decoding.

A page becomes a tree of block elements whose leaves are runs of text.  Every
node has features: its tag, tokens of its class, id and role, its depth, its
place among its siblings and in the page, and the text, links, marks and tags of
its subtree.  Boosted trees give the odds that a node belongs to the article.
The decoding chooses for each element whether all of it is kept, all of it is
dropped, or its children decide, such that the product of the chosen nodes'
probabilities is largest; so nothing is kept below what was dropped as a whole.

The trees are trained here on pages of ``make_page``, which builds articles and
what surrounds them in many ways and knows which run of text is which, and of
``make_plain_page``: one block, no tags, short headings, lists of links.  A page
of which nothing would be kept, though nothing in it is marked as menu, header,
footer or the like, is kept whole.

Defined cases: a null or empty page gives an empty text; tags that were never
closed end with the page, other end tags are ignored; scripts, styles,
titles, templates, text areas and frames are no text, all other elements are
ordinary nodes (formulas: part of the run of text); where all of an element is as
likely as its parts, all of it is kept; a very long page is one tree like others;
rows are extracted one by one, repeated ones too; an empty table gives no rows;
other columns are ignored; page ids are whole numbers.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.boosting import BoostedTrees, boost
from quern.llm.common import slices, task

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|/([a-zA-Z][^\s>/]*+)[^>]*+(?:>|\Z)|([a-zA-Z][^\s>/]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|([a-zA-Z][^\s>/]*+)([^>]*+)(?:>|\Z))""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
# HTML elements by kind.
_RAW = frozenset("script style template iframe textarea title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source map area label math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts menclose".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAGS = "#text p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd div section article main nav header footer aside form fieldset button table tr td th blockquote pre figure figcaption address details summary body html".split()
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
#: What ends an open element of the key when a start tag of the value comes, up to the bound.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUND = frozenset("ul ol dl table html body article section div".split())
# Tokens that authors give to what surrounds an article, and to the article.
_AROUND = frozenset("nav navigation menu navbar menubar header masthead head topbar banner footer foot bottom sidebar side aside rail ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted notice cookie cookies consent alert gdpr popup modal overlay newsletter subscribe subscription signup login signin form search share sharing social related recommended recommend more trending popular comment comments reply replies respond discussion disqus thread breadcrumb breadcrumbs crumbs pager pagination tags tag meta byline copyright legal disclaimer widget toolbar skip complementary contentinfo dialog feedback poll survey tools links teaser outbrain taboola".split())
_WITHIN = frozenset("article articlebody content contents main post posting entry story body text page maincontent blog news prose copy paragraph section".split())
_COMMENTS = frozenset("comment comments reply replies respond discussion disqus thread feedback".split())
_ADS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted outbrain taboola".split())


class Page:
    """The tree of a page, as one list per property; node 0 is the root, children follow their parents."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names, self.text = ["html"], [-1], [()], [""]
        self.links = [0]
        self.inner = [0]  # inline tags within a run of text
        stack, names = [0], ["html"]
        pieces: list[str] = []
        link_chars = link_depth = inline = 0

        def flush() -> None:
            nonlocal link_chars, inline
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    self._add("#text", stack[-1], (), text, min(link_chars, len(text)), inline)
                pieces.clear()
            link_chars = inline = 0

        at, end = 0, len(source)
        while at < end:
            found = _TAG.search(source, at)
            if not found:
                pieces.append(source[at:])
                break
            if found.start() > at:
                pieces.append(source[at : found.start()])
                link_chars += (found.start() - at) if link_depth else 0
            at = found.end()
            closing, opening, attributes = found.group(1), found.group(2) or found.group(4), found.group(3) or found.group(5) or ""
            if opening:
                tag = opening.lower()
                if tag == "br":
                    pieces.append(" ")
                elif tag in _RAW and not attributes.endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                    at = close.end() if close else end
                elif tag in _INLINE:
                    inline += 1
                    link_depth = link_depth + 1 if tag == "a" else link_depth
                elif tag in _VOID:
                    if tag in ("hr", "input"):
                        flush()
                elif attributes.endswith("/") and (tag == "svg" or "svg" in names):  # ends itself
                    flush()
                elif tag not in ("html", "head", "body") or tag == "body":
                    flush()
                    link_depth = 0
                    self._close_for(tag, stack, names)
                    stack.append(self._add(tag, stack[-1], tuple(self._tokens(attributes)) if attributes else (), "", 0, 0))
                    names.append(tag)
            elif closing:
                tag = closing.lower()
                if tag == "a":
                    link_depth = max(0, link_depth - 1)
                elif tag not in _INLINE and tag not in _VOID:
                    flush()
                    link_depth = 0
                    if tag in names[1:]:
                        while names[-1] != tag:
                            names.pop()
                            stack.pop()
                        names.pop()
                        stack.pop()
        flush()

    def _add(self, tag: str, parent: int, names: tuple, text: str, links: int, inner: int) -> int:
        for column, value in ((self.tag, tag), (self.parent, parent), (self.names, names), (self.text, text), (self.links, links), (self.inner, inner)):
            column.append(value)
        return len(self.tag) - 1

    @staticmethod
    def _tokens(attributes: str) -> set[str]:
        found = {t.lower() for groups in _NAMES.findall(attributes) for x in groups if x for t in _TOKEN.findall(x)}
        return found | {x.lower() for groups in _NAMES.findall(attributes) for x in groups if x.isalpha()}

    @staticmethod
    def _close_for(tag: str, stack: list[int], names: list[str]) -> None:
        if names[-1] == "p":
            names.pop()
            stack.pop()
        for other in _CLOSES.get(tag, ()):
            for i in range(len(names) - 1, 0, -1):
                if names[i] == other:
                    del names[i:], stack[i:]
                    break
                if names[i] in _BOUND:
                    break

    def features(self) -> np.ndarray:
        """A row for each node."""
        n = len(self.tag)
        chars = np.array([len(x) for x in self.text], float)
        words = np.array([x.count(" ") + 1 if x else 0 for x in self.text], float)
        stops = np.array([x.count(". ") + x.count("? ") + x.count("! ") + x.endswith((".", "?", "!", '."')) for x in self.text], float)
        commas = np.array([x.count(",") for x in self.text], float)
        links, inner = np.array(self.links, float), np.array(self.inner, float)
        runs = (chars > 0).astype(float)
        long_runs = (chars > 80).astype(float)
        before = np.concatenate([[0], np.cumsum(chars)[:-1]])
        sums = np.stack([chars, words, stops, commas, links, inner, runs, long_runs, np.ones(n)], 1)
        parent, depth = self.parent, np.zeros(n)
        kids = np.zeros(n)
        place = np.zeros(n)
        ancestors = np.zeros((n, 6))
        tokens = np.zeros((n, 4))
        flags = {"nav": 0, "footer": 1, "aside": 2, "form": 3, "header": 4, "article": 5, "main": 5}
        for i, names in enumerate(self.names):
            if names:
                own = set(names)
                tokens[i] = (len(own & _AROUND), len(own & _WITHIN), len(own & _COMMENTS), len(own & _ADS))
        inherited = tokens.copy()
        same: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = kids[p]
            kids[p] += 1
            key = (p, self.tag[i])
            same[key] = same.get(key, 0) + 1
            ancestors[i] = ancestors[p]
            flag = flags.get(self.tag[i])
            if flag is not None:
                ancestors[i, flag] = 1
            inherited[i] += inherited[p]
        for i in range(n - 1, 0, -1):
            sums[parent[i]] += sums[i]
        up = np.array([max(0, p) for p in parent])
        total = max(1.0, sums[0, 0])
        text, size = sums[:, 0], np.maximum(1, sums[:, 0])
        code = np.array([_TAG_AT.get(t, len(_TAGS)) for t in self.tag])
        kind = lambda *names: np.isin(code, [_TAG_AT[x] for x in names]).astype(float)
        alike = np.array([same.get((parent[i], self.tag[i]), 1) for i in range(n)], float)
        siblings = np.maximum(1, kids[up])
        previous, following = np.zeros(n), np.zeros(n)
        last: dict[int, int] = {}
        for i in range(1, n):
            p = parent[i]
            j = last.get(p)
            if j is not None:
                previous[i], following[j] = sums[j, 0], sums[i, 0]
            last[p] = i
        columns = [
            code, code[up], kind("#text"), kind("h1", "h2", "h3", "h4", "h5", "h6"), depth, place / siblings, siblings, alike,
            np.log1p(text), np.log1p(sums[:, 1]), sums[:, 2] / np.maximum(1, sums[:, 1]), sums[:, 3] / np.maximum(1, sums[:, 1]), sums[:, 4] / size,
            sums[:, 5] / np.maximum(1, sums[:, 6]), sums[:, 6], sums[:, 7] / np.maximum(1, sums[:, 6]), text / sums[:, 8], text / total,
            text / np.maximum(1, text[up]), before / total, (before + text) / total, np.log1p(previous), np.log1p(following), np.log1p(text[up]),
            sums[up, 4] / np.maximum(1, text[up]), sums[up, 7] / np.maximum(1, sums[up, 6]), np.minimum(2, sums[:, 2]),
            *tokens.T, *inherited.T, *ancestors.T,
        ]
        return np.stack(columns, 1)

    def plain(self) -> bool:
        """Whether no element looks like more than an article: by its tag, or by what its author calls it."""
        return not ({"nav", "footer", "aside", "form", "header"} & set(self.tag)) and all(_AROUND.isdisjoint(x) for x in self.names)

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Which nodes are kept: per element all, nothing or as its children decide."""
        n, parent = len(self.tag), self.parent
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        every, none, mixed = keep.copy(), drop.copy(), np.full(n, np.log(0.3))
        leaf = np.array([t == "#text" for t in self.tag])
        mixed[leaf] = -np.inf
        empty = np.ones(n, bool)
        for i in range(n - 1, 0, -1):
            empty[i] &= not leaf[i]
            if empty[i]:
                continue  # without text below
            p = parent[i]
            empty[p] = False
            every[p] += every[i]
            none[p] += none[i]
            mixed[p] += max(every[i], none[i], mixed[i])
        state = np.zeros(n, np.int8)  # 1: all, 0: nothing, 2: its children decide
        for i in range(n):
            above = state[parent[i]] if i else 2
            state[i] = above if above != 2 else int(np.argmax((none[i], every[i], mixed[i])))
        return state == 1


#: Kinds of page that make_page builds, and how often each part appears.
_SYLLABLES = "an ba con de er fo ga he in jo ka lo men no or pa qui re sa ti un ver wa xi yo zu".split()


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3, 4)))) for _ in range(n))


def _sentences(rng: random.Random, n: int) -> str:
    return " ".join(_words(rng, rng.choice((1, 3, 5, 8, 12, 20, 35))).capitalize() + rng.choice("....?!") for _ in range(n))


def make_page(seed: int) -> tuple[str, set[str]]:
    """A page and the runs of text that are its article; every run of text is there once."""
    rng, article = random.Random(seed), set()

    def unique(text: str, main: bool) -> str:
        text = f"{text} {rng.randrange(10**9)}" if rng.random() < 0.3 or not text else text
        if main:
            article.add(" ".join(text.split()))
        return html.escape(text, quote=False)

    def attribute(*choices: str) -> str:
        name = rng.choice(choices)
        return f' {rng.choice(("class", "id"))}="{name}"' if name and rng.random() < 0.85 else f' class="{rng.choice("xyzqw")}{rng.randrange(99)}"' if rng.random() < 0.4 else ""

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{unique(_words(rng, rng.randint(1, 4)), False)}</a></li>' for i in range(n))

    def boilerplate(kind: str) -> str:
        short = lambda a=1, b=3: unique(_sentences(rng, rng.randint(a, b)), False)
        if kind == "nav":
            tag = rng.choice(("nav", "div", "ul", "div"))
            return f'<{tag}{attribute("menu", "nav", "navigation", "main-menu", "")}>' + (links(rng.randint(3, 9)) if tag == "ul" else f"<ul>{links(rng.randint(3, 9))}</ul>") + f"</{tag}>"
        if kind == "header":
            tag = rng.choice(("header", "div"))
            return f'<{tag}{attribute("header", "site-header", "masthead", "banner")}><div>{unique(_words(rng, rng.randint(1, 5)), False)}</div><p>{short(1, 2)}</p></{tag}>'
        if kind == "footer":
            tag = rng.choice(("footer", "footer", "div"))
            return f'<{tag}{attribute("footer", "site-footer", "bottom", "copyright")}>&copy; {unique(_words(rng, 2), False)} &middot; {short(1, 2)}</{tag}>'
        if kind == "sidebar":
            tag = rng.choice(("aside", "div", "section"))
            return f'<{tag}{attribute("sidebar", "side", "related", "widget", "rail")}><h3>{unique(_words(rng, 2), False)}</h3><ul>{links(rng.randint(2, 7))}</ul><p>{short()}</p></{tag}>'
        if kind == "ad":
            tag = rng.choice(("div", "div", "aside", "p"))
            return f'<{tag}{attribute("ad", "ads", "advert", "sponsored", "promo", "ad-box")}>{short()}</{tag}>'
        if kind == "notice":
            return f'<div{attribute("notice", "cookie-notice", "cookies", "alert", "consent", "newsletter")}><p>{short()}</p>{rng.choice(("", "<button>OK</button>"))}</div>'
        if kind == "form":
            return f'<form{attribute("search", "login", "signup", "")}><label>{unique(_words(rng, 2), False)}</label><input><p>{short(1, 1)}</p><button>{unique(_words(rng, 1), False)}</button></form>'
        if kind == "share":
            return f'<div{attribute("share", "social", "tags", "breadcrumbs")}>{"".join(f"<a>{unique(_words(rng, 1), False)}</a> " for _ in range(3))}</div>'
        outer, inner = rng.choice((("div", "div"), ("section", "article"), ("ol", "li"), ("section", "div"), ("div", "p")))
        return f'<{outer}{rng.choice((" class=comments", attribute("comments", "comment-list", "replies", "discussion", "respond")))}><h3>{unique(_words(rng, 1), False)}</h3>' + "".join(
            f'<{inner}{attribute("comment", "reply", "")}>' + (f"<b>{unique(_words(rng, 1), False)}</b> " if rng.random() < 0.5 else "") + (f"<p>{short(1, 5)}</p>" if inner != "p" else short(1, 5)) + f"</{inner}>" for _ in range(rng.randint(1, 6))
        ) + f"</{outer}>"

    def paragraph() -> str:
        text = unique(_sentences(rng, rng.choice((1, 1, 2, 3, 5, 9))), True)
        kind = rng.random()
        if kind < 0.08:
            return f"<h{rng.choice('234')}>{unique(_words(rng, rng.randint(1, 7)), True)}</h2><p>{text}</p>"
        if kind < 0.14:
            return "<ul>" + "".join(f"<li>{unique(_sentences(rng, 1), True)}</li>" for _ in range(rng.randint(2, 5))) + f"</ul><p>{text}</p>"
        if kind < 0.18:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.26:
            return f"<p><b>{text}<br>"
        if kind < 0.30:
            return f"<div>{text}</div>"
        if kind < 0.33:
            return f"<table><tr><td>{unique(_words(rng, 3), True)}</td><td>{unique(_words(rng, 2), True)}</td></tr></table><p>{text}</p>"
        return f"<p>{text}</p>"

    body = [paragraph() for _ in range(rng.choice((1, 2, 3, 5, 8, 14, 25)))]
    for kind in ("ad", "share", "form", "sidebar", "notice"):
        if rng.random() < 0.12:
            body.insert(rng.randint(0, len(body)), boilerplate(kind))
    heading = f"<h1>{unique(_words(rng, rng.randint(2, 12)), True)}</h1>" if rng.random() < 0.8 else ""
    tag = rng.choice(("article", "article", "main", "div", "section", "td"))
    inner = f'<{tag}{attribute("content", "article", "post", "entry-content", "story", "") if tag != "article" else attribute("", "post", "")}>{heading}{"".join(body)}</{tag}>'
    inner = f"<table><tr>{inner}</tr></table>" if tag == "td" else inner
    if rng.random() < 0.3:
        inner = f'<div{attribute("main", "wrapper", "container", "page")}>{inner}{boilerplate("comments") if rng.random() < 0.4 else ""}</div>'
    top = [boilerplate(k) for k in ("notice", "header", "nav", "ad", "form", "share") if rng.random() < 0.4]
    low = [boilerplate(k) for k in ("share", "comments", "sidebar", "ad", "form", "nav", "notice", "footer") if rng.random() < 0.4]
    rng.shuffle(top)
    page = f"<!DOCTYPE html><html><head><title>{_words(rng, 4)}</title><style>p{{}}</style></head><body><script>var a='</p>';</script>{''.join(top)}<!-- x -->{inner}{''.join(low)}"
    return (page if rng.random() < 0.1 else page + "</body></html>"), article


def make_plain_page(seed: int) -> tuple[str, set[str]]:
    """As make_page, for pages of other layouts: text without tags, one block, a short heading before some paragraphs, an article that is a list of links."""
    rng, article = random.Random(seed), set()

    def main(text: str) -> str:
        article.add(" ".join(text.split()))
        return html.escape(text, quote=False)

    def around(kind: str) -> str:
        items = "".join(f'<li><a href="/{i}">{_words(rng, rng.randint(1, 3))}</a></li>' for i in range(rng.randint(2, 7)))
        return f"<{kind}><ul>{items}</ul></{kind}>" if kind in ("nav", "aside") else f"<{kind}><p>{_sentences(rng, 1)}</p></{kind}>"

    kind = rng.random()
    if kind < 0.12:
        return main(_sentences(rng, rng.randint(1, 4))), article
    if kind < 0.35:
        tag = rng.choice(("p", "p", "div", "pre", "td", "blockquote", "li"))
        block = f"<{tag}>{main(_sentences(rng, rng.randint(1, 4)))}</{tag}>"
        return rng.choice((block, f"<html><head><title>{_words(rng, 2)}</title></head><body>{block}</body></html>", f"<body>{block}")), article
    short = rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if rng.random() < 0.5 else _words(rng, 1).capitalize()
    heading = f"<h{(level := rng.choice('1112'))}>{main(short)}</h{level}>" if rng.random() < 0.85 else ""
    paragraphs = "".join(f"<p>{main(_sentences(rng, rng.randint(1, 5)))}</p>" for _ in range(rng.randint(1, 7)))
    if kind < 0.7:
        inner, tag = heading + paragraphs, rng.choice(("article", "main", "div", "section", ""))
    else:
        items = "".join(f'<li><a href="/{i}">{main(_words(rng, rng.randint(1, 6)).capitalize())}</a></li>' for i in range(rng.randint(3, 9)))
        inner, tag = f"{heading}{paragraphs if rng.random() < 0.4 else ''}<{(listed := rng.choice(('ul', 'ol')))}>{items}</{listed}>", rng.choice(("article", "article", "main"))
    inner = f"<{tag}>{inner}</{tag}>" if tag else inner
    if rng.random() < 0.6 and tag in ("article", "main"):
        inner = "".join(around(k) for k in ("header", "nav") if rng.random() < 0.6) + inner + "".join(around(k) for k in ("aside", "footer") if rng.random() < 0.6)
    return rng.choice((inner, f"<!DOCTYPE html><html><body>{inner}</body></html>")), article


@lru_cache(maxsize=1)
def train(pages: int = 500, plain: int = 250, seed: int = 11) -> BoostedTrees:
    """Trees from made pages; elements that hold both kinds of text teach nothing."""
    rows, labels = [], []
    made = [make_page(seed * 1_000_003 + s) for s in range(pages)] + [make_plain_page(seed * 1_000_003 + s) for s in range(plain)]
    for source, article in made:
        page = Page(source)
        n = len(page.tag)
        good, all_ = np.zeros(n), np.zeros(n)
        for i in range(n - 1, -1, -1):
            if page.text[i]:
                all_[i] += 1
                good[i] += page.text[i] in article
            if i:
                good[page.parent[i]] += good[i]
                all_[page.parent[i]] += all_[i]
        sure = (all_ > 0) & ((good == 0) | (good == all_))
        rows.append(page.features()[sure])
        labels.append((good[sure] > 0).astype(float))
    return boost(np.concatenate(rows), np.concatenate(labels))


def extract(sources: list[str], trees: BoostedTrees) -> list[str]:
    """The article's text of each page."""
    parsed = [Page(x) for x in sources]
    features = [p.features() for p in parsed]
    odds = trees.decision(np.concatenate(features)) if features else np.empty(0)
    out, at = [], 0
    for page, own in zip(parsed, features, strict=True):
        kept = page.decode(odds[at : at + len(own)])
        if not kept.any() and page.plain():
            kept[:] = True
        at += len(own)
        out.append("\n\n".join(t for t, k in zip(page.text, kept, strict=True) if k and t))
    return out


def extract_pages(pages: DataFrame, trees: BoostedTrees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(trees or train())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sources = [x or "" for x in part.column(2).to_pylist()]
            for start, end in slices(map(len, sources), 1_500_000):
                texts = extract(sources[start:end], sent.value)
                own = part.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.int64()), own.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(task(run), "page_id long, url string, text string, n_chars long")
