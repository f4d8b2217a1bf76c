"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.shared import shared_folder, stored

#: Texts that are handled together in a Python worker hold about this many characters.
SLICE_CHARS = 750_000
#: A worker forgets its word hashes when it holds so many.
CACHED_WORDS = 250_000

#: Longer words aren't remembered.
LONG_WORD = 100

_WORD = re.compile(r"\w+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: What a Python worker keeps from one task to the next, by operator; another operator's task drops it.
_KEPT: dict[str, object] = {}

Batches = Iterator[pa.RecordBatch]


def _given_back() -> None:
    """Free memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept(name: str, make: Callable[[], object]):
    """The worker's object of that name, made if it isn't there."""
    if name not in _KEPT:
        _KEPT[name] = make()
        _given_back()
    return _KEPT[name]


def dropped(broadcast) -> None:
    """Forgets the loaded value of a broadcast in this worker; another task loads it from its file again."""
    broadcast.__dict__.pop("_value", None)


def task(function: Callable[[Batches], Batches], keeps: str = "") -> Callable[[Batches], Batches]:
    """``function`` for mapInArrow: before it what other operators kept goes, after it memory goes back to the system."""

    def run(batches: Batches) -> Batches:
        for name in [x for x in _KEPT if not x.startswith(keeps or "\0")]:
            del _KEPT[name]
        try:
            yield from function(batches)
        finally:
            _given_back()

    return run


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words seen lately."""

    def __missing__(self, word):
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def folded_words(text: str) -> list[str]:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return _WORD.findall(text.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the result."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` consecutive word hashes; empty if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : j + n]) * _MIX
        out ^= out >> np.uint64(32)
    return mix64(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted different values, by sorting, which is faster here than numpy's hashing."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def slices(sizes: Iterable[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about ``most``; each has a row at least."""
    start, total, end = 0, 0, 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of the batches with their texts as strings (null: empty), bounded in characters."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for start, end in slices(lengths, most):
            part = batch.slice(start, end - start)
            yield part, [x or "" for x in part.column(column).to_pylist()]


def spaced(text: bytes, most: int = 1_000_000) -> Iterator[bytes]:
    """The text in pieces of about ``most`` bytes, cut at white space only."""
    start = 0
    while len(text) - start > most:
        found = _SPACE.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with names of its own for all columns but doc_id and text, so that none clashes with an operator's."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)
