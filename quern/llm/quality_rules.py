"""Quality rules: word rules and a hashed n-gram log-likelihood ratio.

Words are runs of anything but ASCII white space.  Hashed words and word pairs
are counted over all documents (the raw corpus) and over trusted documents (the
target); a document's score is the mean over its words and pairs of
log(target share / raw share).  A document is kept if no rule fails and its
score reaches a threshold, which is the same for every document and fitted on a
bounded sample of labelled rows: at most ``sample`` rows of either label, those
with the least hash of the id.  Of the trusted rows every second makes the
target, and the others place the threshold with the untrusted ones.

Defined cases: a null or empty text has no words and fails the rules; a very long
text is scored whole; a score that ties with the threshold is kept; without a
trusted or an untrusted labelled row the score decides nothing; a null id and
repeated rows are scored like any other row; an empty table gives no rows; other
columns are ignored; ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import WordHashes, mix64, task, text_slices, window_hashes

#: Buckets of the hashed words and pairs.
BUCKETS = 1 << 16
_SHIFT = np.uint64(48)
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _word_table(texts: list[str], cache: WordHashes):
    """The texts as bytes, all word hashes, and where each text's words begin (and the last ones end)."""
    raw = [x.encode() for x in texts]
    split = [x.split() for x in raw]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in split], out=starts[1:])
    hashes = cache.array([w for x in split for w in x])
    return raw, hashes, starts


def _features(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document number of each word, then of each pair of neighbours within a document."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs = window_hashes(hashes, 2)
    inside = doc[1:] == doc[:-1]
    return np.concatenate([mix64(hashes), pairs[inside]]) >> _SHIFT, np.concatenate([doc, doc[1:][inside]])


def repeated_words(hashes: np.ndarray, starts: np.ndarray, width: int = 8) -> np.ndarray:
    """Per document the words in windows of ``width`` words that occur in it twice or more."""
    n_docs = len(starts) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(starts))
    windows = window_hashes(hashes, width)
    if not len(windows):
        return np.zeros(n_docs, np.int64)
    at = np.flatnonzero(doc[width - 1 :] == doc[: len(windows)])
    key = mix64(windows[at] + mix64((doc[at] + 1).astype(np.uint64) * _MULTIPLIER))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + width, -1)
    return np.bincount(doc, np.cumsum(edge)[:-1] > 0, n_docs).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    """Log ratio per bucket and the least score that is kept."""

    ratio: np.ndarray
    threshold: float

    def scores(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        bucket, doc = _features(hashes, starts)
        n = len(starts) - 1
        return np.bincount(doc, self.ratio[bucket.astype(np.int64)], n) / np.maximum(np.bincount(doc, minlength=n), 1)


def _bucket_counts(docs: DataFrame, trusted: frozenset) -> DataFrame:
    """(bucket, raw, target) summed over all rows; a task sends each bucket once."""
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, raw, target = WordHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part, texts in text_slices(batches):
            _, hashes, starts = _word_table(texts, cache)
            bucket, doc = _features(hashes, starts)
            bucket = bucket.astype(np.int64)
            raw += np.bincount(bucket, minlength=BUCKETS)
            good = np.fromiter((x in trusted for x in part.column(0).to_pylist()), bool, len(texts))
            target += np.bincount(bucket[good[doc]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(task(run), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the least mean error over both labels, a lost good row counting 40 times; midway between neighbours."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / max(1, g.sum())
    let_in = 1 - np.concatenate([[0], np.cumsum(~g)]) / max(1, (~g).sum())
    cost = 40 * lost + let_in
    cuts = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    cost[1:-1][s[1:] == s[:-1]] = np.inf
    return float(cuts[int(np.argmin(cost))])


def _marked(spark: SparkSession, good: list[int], bad: list[int]) -> DataFrame:
    """(doc_id, good). By Arrow, since rows of Python go through workers of their own, which stay beside the operators'."""
    return spark.createDataFrame(pa.table({"doc_id": pa.array([*good, *bad], pa.int64()), "good": np.repeat([True, False], [len(good), len(bad)])}))


def fit_quality_model(docs: DataFrame, labels: DataFrame, sample: int = 10_000, smoothing: float = 0.5) -> QualityModel | None:
    """Counts over all rows of ``docs``; None where one of the labels has no row."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (1, 0)]
    good, bad = ([r.doc_id for r in x.collect()] for x in chosen)
    if not good or not bad:
        return None
    target_ids, good = good[::2], good[1::2] or good
    counts = _bucket_counts(docs, frozenset(target_ids)).toPandas()
    raw, target = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    raw[counts.bucket] += counts.raw
    target[counts.bucket] += counts.target
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    model = QualityModel(ratio, -np.inf)
    labelled = docs.select("doc_id", "text").join(F.broadcast(_marked(docs.sparkSession, good, bad)), "doc_id")
    schema = pa.schema([("score", pa.float64()), ("good", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part, texts in text_slices(batches):
            _, hashes, starts = _word_table(texts, cache)
            yield pa.RecordBatch.from_arrays([pa.array(model.scores(hashes, starts)), part.column(part.schema.get_field_index("good"))], schema=schema)

    found = labelled.mapInArrow(task(run), "score double, good boolean").toPandas()
    if not found.good.any() or found.good.all():
        return None
    return QualityModel(ratio, _threshold(found.score.to_numpy(), found.good.to_numpy(bool)))


def quality_rules(docs: DataFrame, model: QualityModel | None, keep_columns: bool = False) -> DataFrame:
    """The rule counts, score and verdict of every row; ``keep_columns`` returns the kept rows as they came instead."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    key, text = names.index("doc_id"), names.index("text")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, model = WordHashes(), broadcast.value
        for part, texts in text_slices(batches):
            raw, hashes, starts = _word_table(texts, cache)
            n_words, repeats = np.diff(starts), repeated_words(hashes, starts)
            failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            scores = model.scores(hashes, starts) if model else np.zeros(len(texts))
            kept = ~failed & (scores >= (model.threshold if model else -np.inf))
            if keep_columns:
                yield part.filter(pa.array(kept))
                continue
            chars, symbols, again = [], [], []
            for x, b in zip(texts, raw, strict=True):
                chars.append(len(x) - len(b) + len(b.translate(None, _SPACE)))
                symbols.append(len(b) - len(b.translate(None, _SYMBOLS)))
                lines = [y for y in b.split(b"\n") if y and not y.isspace()]
                again.append(len(lines) - len(set(lines)))
            columns = [part.column(key).cast(pa.int64()), pa.array(n_words), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array(again, pa.int64()), pa.array(repeats), pa.array(failed), pa.array(scores), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    if keep_columns:
        return docs.mapInArrow(task(run), docs.schema)
    docs = docs.select(*names)
    assert names[text] == "text"
    return docs.mapInArrow(task(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
