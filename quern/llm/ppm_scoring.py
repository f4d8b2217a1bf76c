"""LM scoring: prediction by partial matching over bytes, beside a word unigram.

The model is a trie of byte contexts up to ``order`` bytes, trained on all
training documents, with all their n-grams: it grows with the input and stands
nowhere as a whole.  Documents form chunks of bounded size; each chunk's distinct
n-grams go by the last two context bytes to the tasks that sum them.  Such a task
has all that the contexts of two bytes and more with this end need, and gets the
shorter ones, 256 ** 2 at most, from the driver; it sends each chunk the
logarithms of its n-grams, with which the chunk's texts are scored.  No entry is
pruned.  A byte is predicted from the longest known context; where it has not
followed that context, an escape leads to the next shorter one, from which the
bytes that the longer one has seen are excluded.  A symbol seen c times among n
after a context with d different symbols has the estimate (c - D) / n, the escape
d * D / n.  After the longest contexts c counts occurrences; after shorter ones
it counts the contexts longer by one in which the symbol was seen, as if only
escapes led there (update exclusion).  The score is log10 of the probability of
the lower-cased text's bytes and an end symbol.

The word unigram's counts cover all training tokens.  Words that are frequent
(at most ``max_heavy`` of them and 16 MB, by one least count) are looked up in
the tasks; all others go through a join on the word, where no key is large by
construction.

Texts that are longer than a slice are walked in windows that overlap by a context.

Defined cases: a null text is empty and consists of the end; a very long text is scored whole; a null id counts
as held out; repeated rows and ids are scored row by row and counted as often as
they stand; other columns are ignored; an empty table gives no rows; words with
ties in count are taken by their order; without any training text every symbol
has the probability 1 / 256.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_bucket, distinct, dropped, slices, spaced, stored, task, text_slices

ORDER, MAX_HEAVY, _HEAVY_BYTES = 5, 200_000, 16_000_000
#: What an estimate takes from each seen symbol for the escape.
DISCOUNT = 0.3
#: Symbols that no UTF-8 text holds: what stands before a text, and what ends it.
_BEFORE, _END = 0xFE, 0xFF
_SYMBOLS = 256
_SLICE_BYTES = 300_000
#: Characters of a chunk; n-grams that are evaluated together, a bucket at least; bytes that wait in memory meanwhile.
_CHUNK_CHARS, _TOGETHER, _WAITING = 16_000_000, 200_000, 16_000_000
#: Bytes of rows that are taken out of an Arrow batch together; n-grams that are summed, hashed, evaluated or sent together.
_TAKEN, _AT_ONCE = 4_000_000, 500_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HASH = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def lowered(text: str | None) -> bytes:
    """The bytes with A-Z in lower case."""
    return (text or "").encode().translate(_LOWER)


def windows(texts: list[bytes], order: int, most: int | None = None) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of windows of about ``most`` bytes, with the number of the text of each: the padding, the text and its end in pieces, each after the context that its first symbol has."""
    most = most or _SLICE_BYTES
    before, end = bytes([_BEFORE]) * order, bytes([_END])
    numbers, group, size = [], [], 0
    for i, text in enumerate(texts):
        whole = before + text + end
        for start in range(0, len(whole) - order, most):
            numbers.append(i)
            group.append(whole[start : start + most + order])
            size += len(group[-1])
            if size >= most:
                yield numbers, group
                numbers, group, size = [], [], 0
    if group:
        yield numbers, group


def gram_codes(group: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per symbol of the windows after their first ``order`` bytes its context and itself as one number; and where each window begins."""
    joined = np.frombuffer(b"".join(group), np.uint8)
    sizes = np.array([len(x) for x in group], np.int64)
    codes = np.zeros(len(joined) - order, np.uint64)
    for j in range(order + 1):
        codes <<= np.uint64(8)
        codes |= joined[j : len(joined) - order + j]
    own = np.ones(len(codes), bool)
    starts = np.cumsum(sizes)[:-1]
    for j in range(order):
        own[starts - order + j] = False  # what spans two windows
    return codes[own], np.concatenate([[0], np.cumsum(sizes - order)[:-1]])


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their sums."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def _blocks(n: int) -> Iterator[slice]:
    """Consecutive ranges of ``n`` entries."""
    return (slice(start, min(start + _AT_ONCE, n)) for start in range(0, n, _AT_ONCE))


class HashedCodes:
    """Open addressing: code -> position in the given array."""

    def __init__(self, codes: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(1, len(codes)) * 1.5)))))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.position = np.full(size, _EMPTY), np.zeros(size, np.int32)
        for block in _blocks(len(codes)):
            self._put(codes, np.arange(block.start, block.stop))

    def _put(self, codes: np.ndarray, todo: np.ndarray) -> None:
        slot = (codes[todo] * _HASH >> self.shift).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = codes[todo[free]]
            done = np.zeros(len(todo), bool)
            done[free] = self.keys[slot[free]] == codes[todo[free]]
            self.position[slot[done]] = todo[done]
            todo, slot = todo[~done], (slot[~done] + 1) & self.mask

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Positions, -1 for those that aren't there."""
        slot = (codes * _HASH >> self.shift).astype(np.int64)
        keys = self.keys[slot]
        out = np.where(keys == codes, self.position[slot], -1)
        todo = np.flatnonzero((keys != codes) & (keys != _EMPTY))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            keys = self.keys[slot]
            hit = keys == codes[todo]
            out[todo[hit]] = self.position[slot[hit]]
            more = ~hit & (keys != _EMPTY)
            todo, slot = todo[more], slot[more]
        return out


def _at(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in sorted codes, -1 for those that aren't there."""
    if not len(codes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


@dataclass
class PartialMatching:
    """The trie as sorted n-grams with counts, per length, and what follows from them."""

    order: int
    grams: list[np.ndarray]  # [j]: codes of j context bytes and a symbol
    counts: list[np.ndarray]
    contexts: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        self.contexts, self.total, self.kinds, self.excluded = [], [], [], []
        for j in range(self.order + 1):
            own = self.grams[j] >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
            self.contexts.append(own[first])
            self.total.append(self._by_context(self.counts[j], first))
            self.kinds.append(np.diff(first, append=len(own)))
            if j:  # what the symbols of a context weigh after the context shorter by one
                self.excluded.append(self._by_context(self.counts[j - 1][_at(self.grams[j - 1], self._suffix(self.grams[j], j))], first))
            else:
                self.excluded.append(np.zeros(len(first)))
        j = self.order
        self.longest = np.log10((self.counts[j] - DISCOUNT) / np.repeat(self.total[j], self.kinds[j]))
        self.table = None

    def __getstate__(self) -> dict:
        """The hash table is made where it is used."""
        return self.__dict__ | {"table": None}

    @staticmethod
    def _by_context(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums for each context, whose n-grams begin at ``first``."""
        return np.add.reduceat(counts, first).astype(float) if len(first) else np.empty(0)

    @staticmethod
    def _suffix(codes: np.ndarray, length: int) -> np.ndarray:
        """The last ``length`` bytes."""
        return codes & np.uint64((1 << (8 * length)) - 1)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's symbol after its context."""
        if self.table is None:
            self.table = HashedCodes(self.grams[self.order])
        at = self.table.find(codes)
        out = np.where(at >= 0, self.longest[at], 0.0) if len(self.longest) else np.zeros(len(codes))
        todo = np.flatnonzero(at < 0)
        if not len(todo):
            return out
        longer = np.full(len(todo), -1)  # position of the context that is longer by one, if it is known
        for j in range(self.order, -1, -1):
            own = codes[todo]
            gram = self._suffix(own, j + 1)
            context = _at(self.contexts[j], gram >> np.uint64(8))
            known = context >= 0
            total, kinds = np.zeros(len(todo)), np.zeros(len(todo))
            total[known], kinds[known] = self.total[j][context[known]], self.kinds[j][context[known]]
            under = longer >= 0
            if j < self.order and under.any():
                total[under] -= self.excluded[j + 1][longer[under]]
                kinds[under] -= self.kinds[j + 1][longer[under]]
            at = _at(self.grams[j], gram)
            seen = at >= 0
            out[todo[seen]] += np.log10((self.counts[j][at[seen]] - DISCOUNT) / total[seen])
            escape = ~seen & (total > 0)
            out[todo[escape]] += np.log10(DISCOUNT * kinds[escape] / total[escape])
            todo, longer = todo[~seen], context[~seen]
        left = _SYMBOLS - (self.kinds[0][0] if len(self.kinds[0]) else 0)
        out[todo] -= np.log10(max(1, left))
        return out


class Keys:
    """n-gram codes with the last two context bytes, their bucket, in front, so that sorted keys stand by bucket."""

    def __init__(self, order: int):
        self.ends = min(2, order)  # context bytes of the bucket
        self.end_bits, self.rest_bits = np.uint64(8 * self.ends), np.uint64(8 * (order - self.ends + 1))
        self.mask = np.uint64((1 << int(self.end_bits)) - 1)
        self.rest_type = np.dtype("<u4" if self.rest_bits <= 32 else "<u8")

    def of(self, codes: np.ndarray) -> np.ndarray:
        rest = (codes >> (self.end_bits + np.uint64(8)) << np.uint64(8)) | (codes & np.uint64(0xFF))
        return ((codes >> np.uint64(8) & self.mask) << self.rest_bits) | rest

    def codes(self, keys: np.ndarray) -> np.ndarray:
        rest = keys & np.uint64((1 << int(self.rest_bits)) - 1)
        return (rest >> np.uint64(8) << (self.end_bits + np.uint64(8))) | (keys >> self.rest_bits << np.uint64(8)) | (rest & np.uint64(0xFF))

    def joined(self, buckets: np.ndarray, lengths: np.ndarray, rests: bytes) -> np.ndarray:
        """The keys of rows of (bucket, bytes of the rests)."""
        return (np.repeat(buckets.astype(np.uint64), lengths // self.rest_type.itemsize) << self.rest_bits) | np.frombuffer(rests, self.rest_type).astype(np.uint64)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of consecutive pieces of ``values``; ``ends`` has where each ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _rows(schema: pa.Schema, n: int, /, **columns) -> pa.RecordBatch:
    """A batch whose other columns are null."""
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_CHUNKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])
_CHUNKED_SQL = "chunk long, bucket int, grams binary, counts binary, word binary, gram long, n long"


def _packed(rows: pa.RecordBatch) -> bytes:
    """The rows as one compressed value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(value).read_next_batch()


class _Sums:
    """Distinct codes with their sums, gathered part by part: what is fresh is at most half of what is summed, so only a part of it is sorted at a time."""

    def __init__(self):
        self.summed, self.parts, self.fresh = None, [], 0

    def __len__(self) -> int:
        """Codes that are held, those of fresh parts as often as they came."""
        return self.fresh + (len(self.summed[0]) if self.summed else 0)

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((codes, counts))
        self.fresh += len(codes)
        if self.fresh > max(_AT_ONCE, (len(self) - self.fresh) // 2):
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            parts, self.parts, self.fresh = self.parts, [], 0
            codes, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            if self.summed:
                old, sums = self.summed
                at = np.searchsorted(old, codes)
                known = at < len(old)
                known[known] = old[at[known]] == codes[known]
                sums[at[known]] += counts[known]
                codes, counts, at = codes[~known], counts[~known], at[~known]
                self.summed = None
                codes, counts = np.insert(old, at, codes), np.insert(sums, at, counts)
            self.summed = codes, counts
        return self.summed


def _chunked(docs: DataFrame, order: int) -> DataFrame:
    """Rows of three kinds: slices of documents, packed, with their chunk (bucket -1); a chunk's n-grams of a bucket with their
    counts in training documents; counts of words and the different n-grams as long as a bucket's context, of training documents."""
    keys = Keys(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, short, read = Counter(), np.zeros(1 << 8 * (keys.ends + 1), bool), 0
        chunk, row, chars, sums = TaskContext.get().partitionId() << 30, TaskContext.get().partitionId() << 40, 0, _Sums()

        def of_words():
            out = _rows(_CHUNKED, len(words), word=pa.array(words.keys(), pa.binary()), n=pa.array(words.values(), pa.int64()))
            words.clear()
            return out

        def of_chunk():
            codes, often = sums.done()
            cuts = np.flatnonzero(np.diff((codes >> keys.rest_bits).astype(np.int32), prepend=-1, append=-1))
            for start, end in slices(np.diff(cuts).tolist(), _AT_ONCE):  # whole buckets
                own, counts, ends = codes[cuts[start] : cuts[end]], often[cuts[start] : cuts[end]], cuts[start + 1 : end + 1] - cuts[start]
                rest = (own & np.uint64((1 << int(keys.rest_bits)) - 1)).astype(keys.rest_type)
                yield _rows(_CHUNKED, len(ends), chunk=pa.array(np.full(len(ends), chunk)), bucket=pa.array((own[ends - 1] >> keys.rest_bits).astype(np.int32)), grams=_binary(rest, ends), counts=_binary(counts.astype("<u4"), ends))

        for own, raw in text_slices(batches, most=_SLICE_BYTES):
            held = own.column(2).to_pylist()
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(raw))), own.column(0), own.column(2), pa.array(raw, pa.string())], names=["row", "doc_id", "held_out", "text"])
            yield _rows(_CHUNKED, 1, chunk=pa.array([chunk]), bucket=pa.array([-1], pa.int32()), grams=pa.array([_packed(rows)], pa.binary()))
            row += len(raw)
            for out in (False, True):
                texts = [lowered(x) for x, h in zip(raw, held, strict=True) if h == out]
                if not texts:
                    continue
                for _, group in windows(texts, order):
                    codes = gram_codes(group, order)[0]
                    new, often = np.unique(keys.of(codes), return_counts=True)
                    sums.add(new, np.zeros(len(new), np.int64) if out else often.astype(np.int64))
                    if not out:
                        short[(codes & np.uint64(len(short) - 1)).astype(np.int64)] = True
                if not out:
                    for text in texts:
                        for piece in spaced(text):
                            words.update(piece.split())
                    words[b""] += len(texts)  # the end
                    read += sum(map(len, texts))
            chars += sum(map(len, raw))
            if chars >= _CHUNK_CHARS:
                yield from of_chunk()
                chunk, chars, sums = chunk + 1, 0, _Sums()
            if len(words) > 200_000 or read > 100_000_000:  # the second for long words
                yield of_words()
                read = 0
        if len(sums):
            yield from of_chunk()
        yield of_words()
        seen = np.flatnonzero(short) if keys.ends else np.empty(0, np.int64)
        yield _rows(_CHUNKED, len(seen), gram=pa.array(seen), n=pa.array(np.ones(len(seen), np.int64)))

    return docs.select("doc_id", "text", "held_out").mapInArrow(task(run), _CHUNKED_SQL)


def _least_count(counts: DataFrame, most: int) -> int:
    """The least n such that at most ``most`` words of ``_HEAVY_BYTES`` have n or more; looks at a bounded histogram."""
    bucket = F.floor(F.log2("n") * 8).cast("int")
    found = counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("word")).alias("size"), F.min("n").alias("n"), F.max("n").alias("top")).orderBy(F.desc("bucket")).collect()
    least, rows, size = (found[0].top + 1 if found else 1), 0, 0
    for row in found:
        rows, size = rows + row.rows, size + row["size"]
        if rows > most or size > _HEAVY_BYTES:
            break
        least = row.n
    return least


class _Buckets:
    """The rows (chunk, bucket, grams, counts) of a task, sorted by bucket: whole buckets together, summed; the rows wait in a file."""

    def __init__(self, keys: Keys):
        self.keys = keys

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and their sums, for one or more whole buckets; ``waiting`` has their rows until the next ones are asked for."""
        self._clear()
        last = None
        for batch in batches:
            bucket = batch.column(1).to_numpy().copy()  # a view would keep the whole batch
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else []
            for start, end in zip(cuts, cuts[1:], strict=False):
                if last is not None and bucket[start] != last and len(self.sums) >= _TOGETHER:
                    yield self.sums.done()
                    self._clear()
                last = bucket[start]
                self._add(batch.slice(start, end - start))
            batch = None  # before the next one comes
        if len(self.sums):
            yield self.sums.done()
        self.file.close()

    def _clear(self) -> None:
        self.sums, self.index = _Sums(), []
        self.file = tempfile.SpooledTemporaryFile(_WAITING)

    def _add(self, rows: pa.RecordBatch) -> None:
        for at, size in slices(pc.binary_length(rows.column(2)).to_pylist(), _TAKEN):
            part = rows.slice(at, size - at)
            rests, lengths = b"".join(part.column(2).to_pylist()), pc.binary_length(part.column(2)).to_numpy()
            chunks, buckets = (part.column(i).to_numpy().copy() for i in range(2))
            self.file.write(rests)
            self.index.append((chunks, buckets, lengths))
            self.sums.add(self.keys.joined(buckets, lengths, rests), np.frombuffer(b"".join(part.column(3).to_pylist()), "<u4").astype(np.int64))

    def waiting(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
        """(chunks, buckets, bytes of each row's rests, all these bytes)."""
        self.file.seek(0)
        for chunks, buckets, lengths in self.index:
            yield chunks, buckets, lengths, self.file.read(int(lengths.sum()))


def _by_length(codes: np.ndarray, counts: np.ndarray, most: int, least: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams with ``least`` to ``most`` context bytes that end those of ``most``: these with their counts, the others with the number of n-grams longer by one that they end."""
    out = [_summed(codes, counts)]
    for j in range(most - 1, least - 1, -1):
        longer = out[0][0] & np.uint64((1 << (8 * (j + 1))) - 1)
        out.insert(0, _summed(longer, np.ones(len(longer), np.int64)))
    return out


def _logs(grams: DataFrame, low: list[tuple[np.ndarray, np.ndarray]], order: int, tasks: int) -> DataFrame:
    """(chunk, bucket, logs): for each row of ``grams`` the log10 of each n-gram's last symbol."""
    keys = Keys(order)
    rows = grams.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("logs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = _Buckets(keys)
        for found, counts in waiting.read(batches):
            seen = counts > 0
            parts = [*low, *_by_length(keys.codes(found[seen]), counts[seen], order, keys.ends)]
            model = PartialMatching(order, [p[0] for p in parts], [p[1] for p in parts])
            logs = np.concatenate([model.log10(keys.codes(found[block])).astype("<f4") for block in _blocks(len(found))])
            del parts, model
            for chunks, buckets, lengths, rests in waiting.waiting():
                own = logs[np.searchsorted(found, keys.joined(buckets, lengths, rests))]
                ends = np.cumsum(lengths) // keys.rest_type.itemsize
                yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(buckets), _binary(own, ends)], schema=schema)

    return rows.mapInArrow(task(run), "chunk long, bucket int, logs binary")


def score_documents(docs: DataFrame, order: int = ORDER, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    held_out = F.coalesce(crc_bucket("doc_id", 10) == 0, F.lit(True))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    chunked = stored(_chunked(docs, order), "chunked")
    counts = stored(chunked.where("n is not null").groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word is not null").select("word", "n")
    size = words.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    tokens, kinds = size.n or 0, size.kinds
    ends = Keys(order).ends
    # 256 ** ends rows at most
    shortest = counts.where("gram is not null").groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * ends) - 1)).alias("gram")).agg(F.count("*").alias("n")).toArrow()
    low = _by_length(shortest.column(0).to_numpy().astype(np.uint64), shortest.column(1).to_numpy().astype(np.int64), ends - 1) if ends else []
    # a task for each chunk, so what a task reads doesn't grow with the table
    tasks = max(spark.sparkContext.defaultParallelism, chunked.where("bucket = -1").select("chunk").distinct().count())
    logs = _logs(chunked.where("bucket >= 0").select("chunk", "bucket", "grams", "counts"), low, order, tasks)
    least = _least_count(words, max_heavy)
    heavy = {bytes(w): float(np.log10(n + 0.1)) for w, n in zip(*words.where(F.col("n") >= least).toArrow().to_pydict().values(), strict=True)}
    sent = spark.sparkContext.broadcast(heavy)
    scale = float(np.log10(tokens + 0.1 * (kinds + 1)))
    kind = docs.schema["doc_id"].dataType
    rest_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    keys = Keys(order)

    def scored_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Slices of a chunk's documents with the table of its n-grams and their logarithms, which come after them by bucket."""
        packed, logs, last = [], bytearray(), None

        def whole_chunk():
            sums = _Sums()
            for value in packed:
                for _, group in windows([lowered(x) for x in _unpacked(value).column("text").to_pylist()], order):
                    codes = distinct(keys.of(gram_codes(group, order)[0]))
                    sums.add(codes, np.zeros(len(codes), np.int8))
            table, values = HashedCodes(sums.done()[0]), np.frombuffer(logs, "<f4")
            del sums
            for value in packed:
                yield _unpacked(value), table, values

        part = None
        for batch in batches:
            for start, end in slices(pc.binary_length(batch.column(2)).to_pylist(), _TAKEN):
                part = batch.slice(start, end - start)
                for chunk, bucket, value in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if chunk != last:
                        if packed:
                            yield from whole_chunk()
                        last, packed, logs = chunk, [], bytearray()
                    if bucket < 0:
                        packed.append(value)
                    else:
                        logs += value
            batch = part = None  # before the next one comes
        if packed:
            yield from whole_chunk()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = sent.value
        look = heavy.get
        for own, table, values_of in scored_slices(batches):
            texts = [lowered(x) for x in own.column("text").to_pylist()]
            n_tokens, known, logs, rest = [], [], [], []
            for text in texts:
                n, sums, rare = 1, look(b"", None), Counter()  # the end
                if sums is None:
                    sums, rare[b""] = 0.0, 1
                for piece in spaced(text):
                    found = piece.split()
                    values = list(map(look, found))
                    n += len(found)
                    if None in values:
                        rare.update(w for w, v in zip(found, values, strict=True) if v is None)
                        values = [v for v in values if v is not None]
                    sums += sum(values)
                n_tokens.append(n)
                known.append(n - rare.total())
                rest.append([{"word": w, "n": k} for w, k in rare.items()])
                logs.append(sums)
            scores = np.zeros(len(texts))
            for numbers, group in windows(texts, order):
                codes, starts = gram_codes(group, order)
                np.add.at(scores, numbers, np.add.reduceat(values_of[table.find(keys.of(codes))].astype(float), starts))
            columns = {"row": own.column("row"), "doc_id": own.column("doc_id"), "held_out": own.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "known": pa.array(known, pa.int64()), "logs": pa.array(logs, pa.float64()), "score": pa.array(scores), "rest": pa.array(rest, rest_type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        del heavy, look
        dropped(sent)  # the joins that follow need the memory

    texts = chunked.where("bucket = -1").select("chunk", "bucket", F.col("grams").alias("logs"))
    together = texts.unionByName(logs).repartition(tasks, "chunk").sortWithinPartitions("chunk", "bucket")
    done = stored(together.mapInArrow(task(run), f"row long, doc_id {kind.simpleString()}, held_out boolean, n_tokens long, known long, logs double, score double, rest array<struct<word:binary,n:int>>"), "scored")
    rare = done.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n")
    looked = rare.join(words.where(F.col("n") < least).withColumnRenamed("n", "c"), "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = looked.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(c + F.lit(0.1))).alias("more_logs"))
    out = done.drop("rest").join(sums, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
