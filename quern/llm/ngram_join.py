"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Texts are sets of shingles of five words.  Rows with equal sets form a class,
and only one row of a class, its representative, is compared further.  The
representatives' MinHash signatures are cut into bands; representatives that
share a band's key are candidates.  Buckets of candidates are cut into blocks,
and each pair of blocks is a unit of work of bounded size; a pair of texts is
looked at in the first band that it shares only.  Its signatures are compared a
few values at a time: after each step the pair is dropped if the posterior
probability that its similarity reaches the threshold (uniform prior) is below
``tolerance``.  All others are verified on their full shingle sets.  Pairs are
never rows: representatives of a unit form tiles of bounded size, two tiles at
most are verified together, each representative with the list of its partners
there, and verified links leave as counts and as edges to the least partner.

A pair at the threshold shares no band with a probability of 1.3e-7, and is
pruned with one of about 1e-6; above the threshold both fall quickly.

Defined cases: words are runs of letters and digits of the lower-cased text; a
text of one to four words is one shingle; a text without words, or a null text,
has no shingle, is like no other, and is a class of its own; representatives
have the least (doc_id, row), so ties go by id; repeated rows are copies of each
other, also of a null id; a very long text is compared whole, in a tile of its
own; an empty table gives no rows; other columns are kept where rows are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import WordHashes, distinct, folded_words, mix64, plain_names, slices, stored, task, text_slices, window_hashes
from quern.llm.components import components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
VALUES = BANDS * ROWS
TOLERANCE, STEP = 1e-6, 25
#: Representatives in a block; and about how many of them, and of their shingles, a tile holds.
BLOCK, TILE, TILE_SHINGLES = 1024, 1024, 1_000_000
#: Slots of the filter that keeps texts without candidates out of the shuffle.
SLOTS = 1 << 20


def shingles(text: str, cache: WordHashes) -> np.ndarray:
    """The sorted set of the text's shingles."""
    words = cache.array(folded_words(text))
    if not len(words):
        return words
    return distinct(window_hashes(words, min(WIDTH, len(words))))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * VALUES + 1, dtype=np.uint64))
    return (seeds[:VALUES] >> np.uint64(32)).astype(np.uint32), (seeds[VALUES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (none empty) 8 bits of each of its least permuted values."""
    out = np.empty((len(sets), VALUES), np.uint8)
    salts, factors = _permutations()
    start = 0
    while start < len(sets):  # about as many shingles at a time as the processor's cache holds
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= 40_000):
            total += len(sets[end])
            end += 1
        joined = np.concatenate(sets[start:end])
        values = (joined ^ (joined >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in sets[start:end]])[:-1]])
        work = np.empty_like(values)
        for k in range(VALUES):
            np.bitwise_xor(values, salts[k], out=work)
            np.multiply(work, factors[k], out=work)
            least = np.minimum.reduceat(work, starts)
            out[start:end, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
        start = end
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Per row the key of each band."""
    bands = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        key = key << np.uint64(8) | bands[:, :, r]
    return mix64(key | (np.arange(BANDS, dtype=np.uint64) << np.uint64(40)))


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """(compared values, least matches): with fewer, the posterior of the threshold is below the tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose
    upper tail at t is the probability of at most m successes among n + 1 trials at t.
    """
    t, out = threshold + (1 - threshold) / 256, []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def surviving(signature: np.ndarray, first: np.ndarray, second: np.ndarray, band: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs (first, second) of rows share ``band`` first and are not pruned."""
    left, matches, at = np.arange(len(first)), np.zeros(len(first), np.int64), 0
    for n, least in least_matches(threshold, tolerance):
        matches = matches + (signature[first[left], at:n] == signature[second[left], at:n]).sum(1)
        keep = matches >= least
        left, matches, at = left[keep], matches[keep], n
        if not len(left):
            return left
    out = []
    for start in range(0, len(left), 20_000):
        part = left[start : start + 20_000]
        same = (signature[first[part]] == signature[second[part]]).reshape(-1, BANDS, ROWS).all(2)
        out.append(part[same.argmax(1) == band[part]])
    return np.concatenate(out)


def _sketched(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a row number, the number and fingerprint of their shingles and their signature."""
    extra = [("__row", pa.int64()), ("__n", pa.int64()), ("__a", pa.int64()), ("__b", pa.int64()), ("__sig", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, row = WordHashes(), TaskContext.get().partitionId() << 40
        for part, texts in text_slices(batches):
            sets = [shingles(x, cache) for x in texts]
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)
            full = [i for i, x in enumerate(sets) if len(x)]
            signature: list[bytes | None] = [None] * len(sets)
            for i, x in zip(full, signatures([sets[i] for i in full]), strict=True):
                signature[i] = x.tobytes()
            columns = [np.arange(row, row + len(sets)), [len(x) for x in sets], prints[:, 0], prints[:, 1], signature]
            row += len(sets)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, (_, t) in zip(columns, extra, strict=True))], names=[*part.schema.names, *(n for n, _ in extra)])

    kinds = {"__sig": T.BinaryType()}
    return docs.mapInArrow(task(run), T.StructType([*docs.schema.fields, *(T.StructField(n, kinds.get(n, T.LongType())) for n, _ in extra)]))


def _banded(representatives: DataFrame) -> DataFrame:
    """(key, band, row) of every band of every representative."""
    schema = pa.schema([("key", pa.int64()), ("band", pa.int16()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for start in range(0, part.num_rows, 5000):
                own = part.slice(start, 5000)
                signature = np.frombuffer(b"".join(own.column(1).to_pylist()), np.uint8).reshape(-1, VALUES)
                n = len(signature)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(signature).ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int16), n)), pa.array(np.repeat(own.column(0).to_numpy(), BANDS))], schema=schema)

    return representatives.select("row", "sig").mapInArrow(task(run), "key long, band short, row long")


def _units(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, which come together, about ``most`` rows at a time."""
    rest: list[pa.RecordBatch] = []
    held = 0
    for part in batches:
        for start in range(0, part.num_rows, most):
            rest.append(part.slice(start, most))
            held += rest[-1].num_rows
            if held < most:
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            columns = [table.column(k).to_numpy() for k in keys]
            last = np.ones(held, bool)
            for c in columns:
                last &= c == c[-1]
            cut = held - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut).to_batches()
                held -= cut
    if held:
        yield pa.Table.from_batches(rest)


def _groups(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each run of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _tiles(sizes: np.ndarray) -> np.ndarray:
    """The tile of each representative: neighbours of TILE members and TILE_SHINGLES shingles at most, or one alone."""
    out, held, members, tile = np.zeros(len(sizes), np.int64), 0, 0, 0
    for i, size in enumerate(sizes.tolist()):
        if members and (members >= TILE or held + size > TILE_SHINGLES):
            tile, held, members = tile + 1, 0, 0
        out[i], held, members = tile, held + size, members + 1
    return out


def _grouped(first: np.ndarray, second: np.ndarray, tile: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs by the tiles of their members: (members, bounds, partners) with the partners of each member from one bound to the next."""
    low, high = np.minimum(tile[first], tile[second]), np.maximum(tile[first], tile[second])
    order = np.lexsort((second, first, high, low))
    first, second, low, high = first[order], second[order], low[order], high[order]
    cuts = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]]))
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        members = np.union1d(first[start:end], second[start:end])
        yield members, np.searchsorted(first[start:end], np.append(members, members[-1] + 1)), second[start:end]


def _candidates(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(group, row, partners) from members (key, low, high, own, band, row, n, sig): each surviving pair once, its rows in one group."""
    schema = pa.schema([("group", pa.int64()), ("row", pa.int64()), ("partners", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 32
        for table in _units(batches, ["key", "low", "high"], 2 * BLOCK):
            key, low, high, own, band, row, size = (table.column(c).to_numpy() for c in ("key", "low", "high", "own", "band", "row", "n"))
            signature = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)
            unit = _groups([key, low, high])
            n, apart, pairs = len(unit), 1, []
            while apart < n:
                first = np.flatnonzero(unit[:-apart] == unit[apart:])
                if not len(first):
                    break
                second = first + apart
                # rows of one block meet where both blocks of a unit are the same
                mixed = (low[first] == high[first]) | (own[first] != own[second])
                first, second = first[mixed], second[mixed]
                left = surviving(signature, first, second, band[first], threshold, tolerance)
                pairs.append((first[left], second[left]))
                apart += 1
            if not sum(len(x) for x, _ in pairs):
                continue
            # a representative stands in a unit of each of its bands; here it counts once, where it stands first
            rows, at, index = np.unique(row, return_index=True, return_inverse=True)
            order = np.argsort(at)
            place = np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows))
            first, second = (place[index[np.concatenate(x)]] for x in zip(*pairs, strict=True))
            rows, tile = rows[order], _tiles(size[at][order])
            for own_rows, bounds, partners in _grouped(first, second, tile):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(rows[partners]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own_rows), group)), pa.array(rows[own_rows]), lists], schema=schema)
                group += 1

    return members.mapInArrow(task(run), "group long, row long, partners array<long>")


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the others (none empty) has in common with ``own``; all sorted and distinct."""
    joined = np.concatenate(others)
    at = np.searchsorted(own, joined)
    at[at == len(own)] = 0
    return np.add.reduceat((own[at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in others])[:-1]]))


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(row, root, n) from (group, row, partners, text): links of the row within the group, and the least row they lead to."""
    schema = pa.schema([("row", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for table in _units(batches, ["group"], 128):
            number = _groups([table.column("group").to_numpy()])
            for g in range(int(number[-1]) + 1):
                own = np.flatnonzero(number == g)
                part = table.slice(int(own[0]), len(own))
                rows = part.column("row").to_pylist()
                sets = dict(zip(rows, (shingles(x.as_py() or "", cache) for x in part.column("text")), strict=True))
                links, root = dict.fromkeys(rows, 0), {x: x for x in rows}

                def find(x, root=root):
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for a, partners in zip(rows, part.column("partners").to_pylist(), strict=True):
                    x = sets[a]
                    others = [b for b in partners if min(len(x), len(sets[b])) >= threshold * max(len(x), len(sets[b])) - 1e-9]
                    for start, end in slices((len(sets[b]) for b in others), TILE_SHINGLES):
                        some = [sets[b] for b in others[start:end]]
                        for b, y, shared in zip(others[start:end], some, _shared(x, some).tolist(), strict=True):
                            if shared >= threshold * (len(x) + len(y) - shared) - 1e-9:
                                links[a] += 1
                                links[b] += 1
                                i, j = find(a), find(b)
                                root[max(i, j)] = min(i, j)
                linked = [x for x in rows if links[x]]
                yield pa.RecordBatch.from_arrays([pa.array(linked, pa.int64()), pa.array([find(x) for x in linked], pa.int64()), pa.array([links[x] for x in linked], pa.int64())], schema=schema)

    return rows.mapInArrow(task(run), "row long, root long, n long")


def _classes(docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and per class (a, b, row, doc_id, n_copies, keeper, class_id, n_links)."""
    rows = stored(_sketched(docs), "sketches")
    some = rows.where("__n > 0")
    classes = some.groupBy(F.col("__a").alias("a"), F.col("__b").alias("b")).agg(F.min(F.struct("doc_id", "__row")).alias("r"), F.count("*").alias("n_copies"))
    classes = stored(classes.select("a", "b", F.col("r.doc_id").alias("doc_id"), F.col("r.__row").alias("row"), "n_copies"), "classes")
    signed = stored(classes.select("row").join(some.select(F.col("__row").alias("row"), F.col("__n").alias("n"), F.col("__sig").alias("sig")), "row"), "signed")
    banded = _banded(signed)
    shared = stored(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = banded.join(shared, "key").withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "band", "row")
    members = members.join(signed, "row").select("key", "low", "high", "own", "band", "row", "n", "sig")
    units = members.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "row")
    found = stored(_candidates(units, threshold, tolerance), "candidates")
    slot = F.pmod(F.xxhash64("row"), F.lit(SLOTS)).cast("int").alias("slot")
    slots = found.select(slot).distinct()  # SLOTS rows at most
    texts = some.select(F.col("__row").alias("row"), "text").withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")
    grouped = found.join(texts, "row").select("group", "row", "partners", "text").repartition("group").sortWithinPartitions("group", "row")
    links = stored(_verified(grouped, threshold), "links")
    roots = components(links.select(F.col("row").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("row").agg(F.sum("n").alias("n_links"))
    linked = classes.join(counts, "row").join(roots.withColumnRenamed("u", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    heads = linked.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("h"))
    linked = linked.join(heads, "root").select("row", "n_links", F.col("h.doc_id").alias("class_id"), F.col("h.row").alias("keeper"))
    out = classes.join(linked, "row", "left").select(
        "a", "b", "row", "doc_id", "n_copies",
        F.when(F.col("keeper").isNull(), F.col("row")).otherwise(F.col("keeper")).alias("keeper"),
        F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    return rows, stored(out, "classes")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row: doc_id; class_id, the least id that links of the threshold lead to; copy_id, the least id with
    the same shingles; n_copies, the rows with these; n_links, the other texts that it is linked with."""
    rows, classes = _classes(docs.select("doc_id", "text"), threshold, tolerance)
    own = classes.select("a", "b", "class_id", F.col("doc_id").alias("copy_id"), "n_copies", "n_links", F.lit(True).alias("found"))
    key = (rows["__a"] == own["a"]) & (rows["__b"] == own["b"])
    out = rows.select("doc_id", "__a", "__b", "__n").join(own, key, "left")
    alone = F.col("found").isNull()
    return out.select(
        rows["doc_id"], F.when(alone, rows["doc_id"]).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, rows["doc_id"]).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("__n").alias("n_shingles"),
    )


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs``, as they came, with one row left of every group that links or equal shingles connect."""
    rows, classes = _classes(plain_names(docs), threshold, tolerance)
    kept = classes.where("row = keeper").select(F.col("row").alias("__row"), F.lit(True).alias("__kept"))
    out = rows.join(kept, "__row", "left").where("__kept or __n = 0")
    return out.select(*plain_names(docs).columns).toDF(*docs.columns)
