"""Toxicity: a support vector machine with a gap-weighted subsequence kernel and Nyström landmarks.

A text's units are its words, lower-cased and without marks; words of one letter
that follow each other are joined first, so a spelled-out word is one unit.  The kernel of two units counts
their common subsequences of three characters, a unit's end being one, that span ``SPAN`` characters at
most, each skipped character halving the weight, over the units' lengths;
inserted characters and endings therefore cost little.  Landmark units give the Nyström features, on
which a squared-hinge machine is trained.  Its decision is linear in the
subsequences of the landmarks, so it is kept as one weight per subsequence, and
a unit's margin is a sum of look-ups.  A long unit counts by its best stretch of
``STRETCH`` characters, a text by its best unit.

Labels are of documents, so which units make a document toxic is guessed: units
of toxic documents are positive if the unit, its beginning or a character 4-gram
of it is far more frequent in toxic documents (a heuristic that finds the first
positive units; the machine, not these, scores texts), later also if the machine says so,
and with a character inserted; units of the others are negative, first a sample,
then those that the machine gets most wrong.  What is learned from is bounded by
parameters: ``sample`` labelled documents of either label, those with the least
hash of the id, a quarter of which only places the decision; and ``Bounds`` of
their units.  A unit longer than ``LONG_UNIT`` characters is learned from in
overlapping stretches.  Texts are scored whole; those longer than a slice are
cut between words of two letters and more, which no unit spans.

Defined cases: a null or blank text scores 0; without a labelled row of either
kind all texts score 0; a null id counts as held out; repeated rows are scored
one by one; labels of one id are joined by their largest; other columns are
ignored; an empty table gives no rows; texts of one margin have one score.  With fewer
than 20 rows of either label held aside, the decision is placed on the rows that were learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_bucket, slices, task

SAMPLE, LANDMARKS = 3000, 400
#: Characters of a unit that is learned from, and of texts that are scored together.
LONG_UNIT, SLICE = 24, 400_000
SPAN, DECAY, STRETCH = 6, 0.5, 12
#: What tells toxic documents must stand in this share of them.
LEAST_SHARE = 0.008
#: Character classes; 0 is white space, the last is for characters that the sample doesn't have among its most frequent.
CLASSES = 64
_MARK = 255
_BETWEEN = re.compile(r"(?<=[^\W_]{2})\s+(?=[^\W_]{2})")
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: By the number of characters, the length of a stretch's vector of subsequences, as if each were there once.
_LENGTHS = np.sqrt([max(1.0, sum(DECAY ** (2 * b - 4) * max(0, n - b + 1) for _, b in _PAIRS)) for n in range(STRETCH + SPAN)])


def character_classes(texts: list[str]) -> np.ndarray:
    """The class of every code point: the most frequent characters of the texts have their own."""
    counts = Counter()
    for x in texts:
        counts.update(x)
    table = np.full(0x110000, CLASSES - 1, np.uint8)
    codes = np.arange(0x3001)
    table[codes[[not chr(i).isalnum() for i in codes]]] = _MARK
    frequent = sorted((x for x in counts if x.isalnum()), key=lambda x: (-counts[x], x))[: CLASSES - 2]
    for i, x in enumerate(frequent, 1):
        table[ord(x)] = i
    spaces = [i for i in range(0x3001) if chr(i).isspace()]
    table[spaces] = 0
    return table


def classed(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts' lower-cased characters with two spaces after each text, spelled-out words joined; and where texts begin."""
    low = [x.lower() for x in texts]
    joined = "  ".join(low) + "  "
    own = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.concatenate([[0], np.cumsum([len(x) + 2 for x in low])])
    mark = own == _MARK
    own, starts = own[~mark], starts - np.concatenate([[0], np.cumsum(mark)])[starts]
    space = np.concatenate([[True, True], own == 0, [True, True]])
    at = np.flatnonzero(own == 0) + 2
    between = ~space[at - 1] & ~space[at + 1] & space[at - 2] & space[at + 2]
    drop = np.zeros(len(own), bool)
    drop[at[between] - 2] = True
    return own[~drop], (starts - np.concatenate([[0], np.cumsum(drop)])[starts])[:-1]


def subsequences(own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(start positions, codes, weight) of all subsequences within units, by their two gaps."""
    zeros = np.flatnonzero(own == 0)
    left = np.zeros(len(own), np.int32)  # characters from here to the end of the unit
    previous = np.concatenate([[-1], zeros[:-1]])
    for_each = zeros - previous
    left = np.repeat(zeros, for_each) - np.arange(len(own))
    wide = own.astype(np.int32)
    for a, b in _PAIRS:
        at = np.flatnonzero((left >= b) & (left > 0))
        yield at, (wide[at] * CLASSES + wide[at + a]) * CLASSES + wide[at + b], DECAY ** (b - 2)


@dataclass(frozen=True)
class Bounds:
    """Of the labelled units: the negative ones to begin with, those that are looked through for wrong ones and those added from
    them in a round, the positive ones, and those of them that are learned with an inserted character too."""

    negative: int = 6000
    looked_through: int = 300_000
    added: int = 2000
    positive: int = 4000
    inserted: int = 200


def between_words(text: str, most: int = SLICE) -> Iterator[str]:
    """The text in pieces of about ``most`` characters, cut only where words of two characters at least stand on both sides."""
    start = 0
    while len(text) - start > most:
        found = _BETWEEN.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


@dataclass
class ToxicityModel:
    """Character classes, a weight per subsequence, and where and how steeply the score passes 0.7."""

    table: np.ndarray
    weight: np.ndarray
    bias: float
    cut: float = 0.0
    slope: float = 1.0

    def margins(self, texts: list[str]) -> np.ndarray:
        """The best unit's margin of every text; minus infinity if it has no unit."""
        own, starts = classed(texts, self.table)
        gain = np.zeros(len(own))
        wide = own.astype(np.int32)
        zeros = np.flatnonzero(own == 0)
        end = np.repeat(zeros, zeros - np.concatenate([[-1], zeros[:-1]]))
        left = end - np.arange(len(own))
        for a, b in _PAIRS:
            n = len(own) - b
            if n <= 0:
                continue
            found = self.weight[(wide[:n] * CLASSES + wide[a : n + a]) * CLASSES + wide[b:]]
            found *= DECAY ** (b - 2)
            found[left[:n] < b] = 0
            gain[:n] += found
        total = np.concatenate([[0.0], np.cumsum(gain)])
        at = np.arange(len(own))
        stretch = (total[np.minimum(at + STRETCH, end)] - total[at]) / _LENGTHS[np.minimum(left, STRETCH + SPAN - 1)] + self.bias
        inner = np.concatenate([[False], own[:-1] != 0])
        stretch[(own == 0) | inner & (left < STRETCH)] = -np.inf
        return np.maximum.reduceat(stretch, starts)

    def best_margins(self, texts: list[str]) -> np.ndarray:
        """As ``margins``, for texts of any length."""
        pieces = [(i, piece) for i, x in enumerate(texts) for piece in between_words(x)]
        out = np.full(len(texts), -np.inf)
        for start, end in slices((len(x) for _, x in pieces), SLICE):
            np.maximum.at(out, [i for i, _ in pieces[start:end]], self.margins([x for _, x in pieces[start:end]]))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        margin = self.best_margins(texts)
        exponent = np.clip(self.slope * (margin - self.cut) + np.log(0.7 / 0.3), -60, 60)
        return np.where(np.isneginf(margin), 0.0, np.where(margin >= self.cut, np.maximum(1 / (1 + np.exp(-exponent)), 0.7), np.minimum(1 / (1 + np.exp(-exponent)), 0.6999999)))


def _features(units: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, code, weight) of all subsequences of the units."""
    own, starts = classed(units, table)
    rows, codes, weights = [], [], []
    for at, code, weight in subsequences(own):
        rows.append(np.searchsorted(starts, at, "right") - 1)
        codes.append(code)
        weights.append(np.full(len(code), weight))
    rows = np.concatenate(rows)
    sizes = np.diff(np.concatenate([starts, [len(own)]])) - 2
    return rows, np.concatenate(codes), np.concatenate(weights) / _LENGTHS[np.clip(sizes, 0, STRETCH + SPAN - 1)][rows]


def landmark_basis(marks: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence code -> row, or -1; and the landmarks' vectors over these rows."""
    row, code, weight = _features(marks, table)
    used, column = np.unique(code, return_inverse=True)
    basis = np.zeros((len(used), len(marks)))
    np.add.at(basis, (column, row), weight)
    landmark_map = np.full(CLASSES**3, -1)
    landmark_map[used] = np.arange(len(used))
    return landmark_map, basis


def nystroem(basis: np.ndarray) -> np.ndarray:
    """What maps kernels with the landmarks to features: the inverse root of the landmarks' own kernel."""
    values, vectors = np.linalg.eigh(basis.T @ basis)
    keep = values > 1e-6 * values[-1]
    return vectors[:, keep] / np.sqrt(values[keep])


def _gram_matrix(units: list[str], landmark_map: np.ndarray, landmarks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel of every unit with every landmark."""
    out = np.zeros((len(units), landmarks.shape[1]))
    for start in range(0, len(units), 1000):
        row, code, weight = _features(units[start : start + 1000], table)
        column = landmark_map[code]
        known = column >= 0
        row, column, weight = row[known], column[known], weight[known]
        own = np.unique(column)
        shape = (min(1000, len(units) - start), len(own))
        dense = np.bincount(row * shape[1] + np.searchsorted(own, column), weight, shape[0] * shape[1]).reshape(shape)
        out[start : start + shape[0]] = dense @ landmarks[own]
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 100.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge machine, by Newton steps; both labels weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * len(y) * cost
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(30):
        a = x[active] * share[active, None]
        w = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _inserted(units: list[str]) -> list[str]:
    """Each unit with one character more inside: a letter twice, or one that a hash of the unit chooses."""
    out = []
    for u in units:
        for i in range(1, len(u)):
            out.append(u[:i] + u[i - 1] + u[i:])
            out.append(u[:i] + chr(97 + _order(f"{u}{i}") % 26) + u[i:])
    return out


def _order(x: str) -> int:
    return xxhash.xxh64_intdigest(x)


def _grams(u: str) -> set[str]:
    return {u[i : i + 4] for i in range(len(u) - 3)} or {u}


def _starts(u: str) -> list[str]:
    return [u[:k] for k in range(5, min(len(u), 9) + 1)]


def _telling(in_toxic: Counter, in_clean: Counter, n: int, m: int) -> set[str]:
    """What has a share of the ``m`` clean documents below a twentieth of that of the ``n`` toxic ones, and stands in more toxic ones than chance explains."""
    least = max(3, min(6, 0.03 * n), LEAST_SHARE * n)
    return {g for g, k in in_toxic.items() if k >= least and (in_clean[g] + 0.5) / m < 0.05 * k / n}


def fit(documents: list[tuple[int, str]], landmarks: int = LANDMARKS, bounds: Bounds = Bounds()) -> ToxicityModel | None:
    """The model from (label, units joined by spaces) of labelled documents; None if a label is missing."""
    documents = sorted(documents, key=lambda x: (_order(x[1]), x[0]))
    aside = [x for i, x in enumerate(documents) if i % 4 == 0]
    if sum(y for y, _ in aside) < 20 or sum(1 - y for y, _ in aside) < 20:
        aside, learned = documents, documents
    else:
        learned = [x for i, x in enumerate(documents) if i % 4]
    toxic, clean = ([set(t.split(" ")) - {""} for y, t in learned if y == label] for label in (1, 0))
    if not toxic or not clean:
        return None
    table = character_classes([t for _, t in learned])
    in_toxic, in_clean = Counter(u for d in toxic for u in d), Counter(u for d in clean for u in d)
    n, m = len(toxic), len(clean)
    telling_of = lambda pieces: _telling(*(Counter(g for d in docs for g in {g for u in d for g in pieces(u)}) for docs in (toxic, clean)), n, m)
    anywhere, at_start, whole = telling_of(_grams), telling_of(_starts), telling_of(lambda u: (u,))
    rare = lambda u: in_clean[u] / m < 0.05 * in_toxic[u] / n
    positive = {u for u in in_toxic if rare(u) and (u in whole or u not in in_clean and not (anywhere.isdisjoint(_grams(u)) and at_start.isdisjoint(_starts(u))))}
    if not positive:
        return None
    pool = sorted((u for u in in_clean if len(u) >= 3), key=_order)
    negative = set(pool[: bounds.negative]) - positive
    every_clean, every_toxic = sorted(in_clean, key=_order)[: bounds.looked_through], [sorted(u for u in d if u not in in_clean) for d in toxic]
    model = None
    for _ in range(4):
        up = sorted(positive, key=lambda u: (-in_toxic[u], u))[: bounds.positive]
        up += _inserted(up[: bounds.inserted])
        down = sorted(negative)
        marks = up[: landmarks // 2] + sorted(negative, key=_order)[: landmarks - landmarks // 2]
        landmark_map, basis = landmark_basis(marks, table)
        project = nystroem(basis)
        x = _gram_matrix(up + down, landmark_map, basis, table) @ project
        w, bias = _machine(x, np.concatenate([np.ones(len(up)), -np.ones(len(down))]))
        table_weight = np.zeros(CLASSES**3, np.float32)
        table_weight[landmark_map >= 0] = basis @ (project @ w)
        model = ToxicityModel(table, table_weight, bias)
        wrong = np.concatenate([model.margins(every_clean[i : i + 20_000]) for i in range(0, len(every_clean), 20_000)])
        negative |= {every_clean[i] for i in np.argsort(-wrong, kind="stable")[: bounds.added] if wrong[i] > -1} - positive
        level = max(0.0, float(np.quantile(wrong, 0.9999)))
        for d in every_toxic:
            if d:
                found = model.margins(d)
                best = int(np.argmax(found))
                if found[best] > level:
                    positive.add(d[best])
    labels = np.array([y for y, _ in aside])
    margin = np.concatenate([model.best_margins([t for _, t in aside[i : i + 500]]) for i in range(0, len(aside), 500)])
    order = np.argsort(margin, kind="stable")
    s, y = margin[order], labels[order]
    # the cut with the least weight of errors, shares of each label, a clean document's twelve times a toxic one's; midway between neighbours
    errors = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum()) + 12 * ((y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])) / max(1, (y == 0).sum())
    errors[1:-1][s[1:] == s[:-1]] = np.inf
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    low, high = s[max(0, k - 1)], s[min(len(s) - 1, k)]
    model.cut = float((low + high) / 2) if 0 < k < len(s) and np.isfinite(low) else float(high)
    model.slope = 2.0
    return model


def _stretches(unit: str) -> list[str]:
    """The unit, or overlapping stretches that cover a long one."""
    half = LONG_UNIT // 2
    return [unit] if len(unit) <= LONG_UNIT else [unit[i : i + LONG_UNIT] for i in range(0, len(unit) - half, half)]


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[int, str]]:
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(crc_bucket("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [(r.doc_id, r.toxic) for y in (1, 0) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(ids, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, toxic int")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    schema = pa.schema([("toxic", pa.int32()), ("units", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            units = [" ".join(sorted({y for u in (x or "").lower().split() for y in _stretches(u)})) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(units, pa.string())], schema=schema)

    return [(r.toxic, r.units) for r in found.mapInArrow(task(run), "toxic int, units string").collect()]


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, bounds: Bounds = Bounds()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = fit(_labelled(docs, labels, sample), landmarks, bounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in batches:
            texts = [x or "" for x in part.column(1).to_pylist()]
            for start, end in slices(map(len, texts), SLICE):
                score = model.scores(texts[start:end]) if model else np.zeros(end - start)
                own = part.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(score), pa.array((score >= 0.7).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(True))
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(task(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
