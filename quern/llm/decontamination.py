"""Benchmark decontamination: greedy string tiling of test items by documents.

Windows of ``min_match`` words that an item and a document share are the seeds.
A document that holds enough seeds of an item is tiled against it: for falling
search lengths, running Karp-Rabin hashes find the common runs of words, and the
longest that don't overlap what is marked already are marked.  The share of the
item's words that get marked is its coverage, whatever order its parts stand in
inside the document; from ``threshold`` on the document is contaminated.

The benchmark is read in blocks of about ``block_words`` words, each of which is
sent to the tasks as one small index, the build side of the join of the seeds; all
documents are held against every block, so nothing of the documents is shuffled.
Where there are several blocks, each one's result is written before the next
block is read, and the block is given up.

Defined cases: words are runs of letters and digits of the lower-cased text, so
case, punctuation and white space don't matter; a null text has no words; items
of equal words count as one, under their least id; an item with fewer than
``min_match`` words is one seed, so it contaminates where all of its words stand
as one run; an item without words contaminates nothing; among tiles of one length
the first of the item goes first; very long texts are matched whole; documents
are taken row by row, so repeated rows and ids and other columns make no
difference; an empty table of either kind gives no leaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import WordHashes, distinct, folded_words, stored, task, text_slices, window_hashes

MIN_MATCH, THRESHOLD, BLOCK_WORDS = 5, 0.5, 1_000_000
#: Slots of the table that most windows of clean documents don't get past.
_SLOTS = 20


class KarpRabin:
    """Hashes of any run of a sequence, from running sums."""

    _BASE = np.uint64(0x5851F42D4C957F2D)

    def __init__(self, words: np.ndarray):
        self.words = words
        n = len(words)
        self.power = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, self._BASE, np.uint64), out=self.power[1:]) if n else None
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.power[:n], out=self.sums[1:])

    def runs(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Equal for equal runs: the sum of word * base^position, raised to the same last position."""
        n = len(self.words)
        return (self.sums[starts + length] - self.sums[starts]) * self.power[n - starts] if n else starts.astype(np.uint64)


def greedy_tiles(item: np.ndarray, text: np.ndarray, starts: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(item start, text start, length) of the tiles; ``starts`` are the text positions where a seed of the item begins."""
    pad = max(len(item), len(text))
    both = KarpRabin(np.concatenate([item, np.zeros(pad - len(item), np.uint64)]))
    other = KarpRabin(np.concatenate([text, np.zeros(pad - len(text), np.uint64)]))
    used_item, used_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles, length = [], len(item)
    while True:
        found = []
        item_at = np.arange(len(item) - length + 1)
        text_at = starts[starts + length <= len(text)]
        table: dict[int, list[int]] = {}
        for at, key in zip(item_at.tolist(), both.runs(item_at, length).tolist(), strict=True):
            if not used_item[at : at + length].any():
                table.setdefault(key, []).append(at)
        ends: dict[int, int] = {}
        for at, key in zip(text_at.tolist(), other.runs(text_at, length).tolist(), strict=True):
            for i in table.get(key, ()):
                if at < ends.get(at - i, 0) or used_text[at : at + length].any() or not np.array_equal(item[i : i + length], text[at : at + length]):
                    continue
                size = length
                while i + size < len(item) and at + size < len(text) and item[i + size] == text[at + size] and not used_item[i + size] and not used_text[at + size]:
                    size += 1
                ends[at - i] = at + size
                found.append((-size, i, at))
        marked = False
        for size, i, at in sorted(found):
            if not used_item[i : i - size].any() and not used_text[at : at - size].any():
                used_item[i : i - size] = used_text[at : at - size] = marked = True
                tiles.append((i, at, -size))
        if marked:
            continue  # what overlapped a marked tile may still hold a run of this length
        if length <= min_match:
            return tiles
        length = max(min_match, length // 2)


class ItemIndex:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        cache, best = WordHashes(), {}
        self.min_match = min_match
        for item_id, text in items:
            words = cache.array(folded_words(text or ""))
            if len(words):
                key = words.tobytes()
                best[key] = min((item_id is None, item_id, words) if key not in best else best[key], (item_id is None, item_id, words), key=lambda x: x[:2])
        every = [(x[1], x[2]) for x in sorted(best.values(), key=lambda x: x[0])]
        self.items = [x for x in every if len(x[1]) >= min_match]
        # number of words -> hash of the whole item -> its id
        self.short: dict[int, dict[int, int]] = {}
        for item_id, words in every:
            if len(words) < min_match:
                self.short.setdefault(len(words), {})[int(window_hashes(words, len(words))[0])] = item_id
        seeds = [window_hashes(w, min_match) for _, w in self.items]
        hashes = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        at = np.concatenate([np.arange(len(x)) for x in seeds]) if seeds else np.empty(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order], item[order], at[order]
        self.slots = np.zeros(1 << _SLOTS, bool)
        self.slots[self.hashes >> np.uint64(64 - _SLOTS)] = True

    def hits(self, windows: np.ndarray) -> np.ndarray:
        """Positions of the windows that are seeds."""
        maybe = np.flatnonzero(self.slots[windows >> np.uint64(64 - _SLOTS)])
        found = np.searchsorted(self.hashes, windows[maybe])
        found[found == len(self.hashes)] = 0
        return maybe[self.hashes[found] == windows[maybe]] if len(self.hashes) else maybe[:0]

    def whole(self, words: np.ndarray) -> list[tuple[int, float, list]]:
        """(item, coverage, tiles) of the items shorter than a seed that the document holds."""
        out = []
        for width, items in self.short.items():
            windows = window_hashes(words, width)
            keys = np.fromiter(items, np.uint64, len(items))
            at = np.flatnonzero(np.isin(windows, keys))
            found, first = np.unique(windows[at], return_index=True)
            out += [(items[int(key)], 1.0, [(0, int(at[i]), width)]) for key, i in zip(found, first, strict=True)]
        return out

    def tilings(self, words: np.ndarray, windows: np.ndarray, hits: np.ndarray, threshold: float) -> Iterator[tuple[int, float, list]]:
        """(item, coverage, tiles) of the items that one document covers up to the threshold."""
        seeds = distinct(windows[hits])
        first, last = np.searchsorted(self.hashes, seeds), np.searchsorted(self.hashes, seeds, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
        items, counts = np.unique(self.item[at], return_counts=True)
        sizes = np.array([len(self.items[i][1]) for i in items])
        for i in items[counts * self.min_match >= threshold * sizes]:
            own = at[self.item[at] == i]
            item = self.items[i][1]
            cover = np.zeros(len(item) + 1, np.int64)
            np.add.at(cover, self.at[own], 1)
            np.add.at(cover, self.at[own] + self.min_match, -1)
            if (np.cumsum(cover)[:-1] > 0).sum() < threshold * len(item):
                continue  # no tiling marks a word outside the seeds
            tiles = greedy_tiles(item, words, hits[np.isin(windows[hits], self.hashes[own])], self.min_match)
            coverage = sum(x[2] for x in tiles) / len(item)
            if coverage >= threshold:
                yield self.items[i][0], coverage, tiles


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks, and the items in blocks of bounded size."""
    words = benchmark.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\W+"))).alias("n")).first().n or 0
    blocks = max(1, -(-words // block_words))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return blocks, ([(r.item_id, r.text) for r in benchmark.select("item_id", "text").where(of == b).distinct().collect()] for b in range(blocks))


def _matched(batches: Iterator[pa.RecordBatch], index: ItemIndex, threshold: float) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Each slice of rows with the tilings of each row."""
    cache = WordHashes()
    for part, texts in text_slices(batches):
        split = [folded_words(x) for x in texts]
        ends = np.cumsum([len(x) for x in split])
        words = cache.array([w for x in split for w in x])
        windows = window_hashes(words, index.min_match)
        hits = index.hits(windows)
        found: list[list] = [[] for _ in texts]
        doc = np.searchsorted(ends, hits, "right")
        inside = hits + index.min_match <= ends[doc] if len(hits) else hits.astype(bool)
        hits, doc = hits[inside], doc[inside]
        for d in distinct(doc):
            start = ends[d] - len(split[d])
            own = hits[doc == d] - start
            found[d] = list(index.tilings(words[start : ends[d]], windows[start : ends[d]], own, threshold))
        if index.short:
            for d, x in enumerate(split):
                found[d] += index.whole(words[ends[d] - len(x) : ends[d]])
        yield part, found


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) for every document row and item whose coverage reaches the threshold."""
    context = docs.sparkSession.sparkContext
    doc_id, item_id = (docs.select("doc_id").schema[0].dataType, benchmark.select("item_id").schema[0].dataType)
    kind = pa.list_(pa.list_(pa.int64()))
    number, blocks = _blocks(benchmark, block_words)
    out = None
    for block in blocks:
        sent = context.broadcast(ItemIndex(block, min_match))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part, found in _matched(batches, sent.value, threshold):
                rows = [(d, *x) for d, own in enumerate(found) for x in own]
                if rows:
                    at, items, coverage, tiles = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(items, to_arrow_type(item_id)), pa.array(coverage), pa.array(tiles, kind)], names=["doc_id", "item_id", "coverage", "tiles"])

        own = docs.select("doc_id", "text").mapInArrow(task(run), f"doc_id {doc_id.simpleString()}, item_id {item_id.simpleString()}, coverage double, tiles array<array<long>>")
        if number > 1:
            own = stored(own, "leaks")
            sent.destroy()
        out = own if out is None else out.unionByName(own)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, as they came, that no item contaminates."""
    context, out = docs.sparkSession.sparkContext, docs
    number, blocks = _blocks(benchmark, block_words)
    for block in blocks:
        sent = context.broadcast(ItemIndex(block, min_match))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part, found in _matched(batches, sent.value, threshold):
                yield part.filter(pa.array([not x for x in found], pa.bool_()))

        out = out.mapInArrow(task(run), docs.schema)
        if number > 1:
            out = stored(out, "clean")
            sent.destroy()
    return out
