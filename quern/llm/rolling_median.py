"""Rolling exact medians and median absolute deviations by a merge-sort tree.

A series' rows are cut into chunks of time, each with a halo of the rows that the
windows of its first rows reach back to, so chunks are independent.  Several
chunks share one tree over the order of their values.  A node holds the time
positions of its values, sorted; beside each position stands how many before it
go to the left child (fractional cascading), so a window found once at the root
by binary search is followed down without searching again.  A descent selects a
window's value of any rank; counts of values below a bound come from the same
walk, and the median absolute deviation is found by bisection on the radius,
between the two that the quartiles give.

Defined cases: a row whose time is null has no window and goes; each id is taken
once, a null id too, and of rows of one id that differ the least by time, series
and value stays; a null series is a series; a value that is null, not finite or
beyond 2^58 cents has no cents, but its row still gets its window's figures; rows
at one time see each other, and equal values count as often as they stand there;
with fewer than two cents in the window the figures are null; other columns are
left out, whatever their names; an empty table gives no rows.  A task holds one
batch of chunks: a chunk's rows and one window before it are the least that it
needs, so its memory goes with how many rows a series has in a chunk and a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import task

MICROS_A_MINUTE = 60_000_000
#: Chunks are put together in one tree until they have so many rows.
TREE_ROWS = 1 << 15
#: Values beyond this have no cents: four times the greatest still fits 64 bits.
MOST_CENTS = 1 << 58


class MergeSortTree:
    """Over ``values`` in the order of their time positions."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.depth = max(1, int(n).bit_length())
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        at = np.arange(n, dtype=np.int32)
        self.lefts: list[np.ndarray] = []
        for shift in range(self.depth - 1, -1, -1):
            left = (rank >> shift) & 1 == 0
            before = np.zeros(n + 1, np.int32)
            np.cumsum(left, out=before[1:])
            self.lefts.append(before)
            start = (rank >> (shift + 1)) << (shift + 1)
            own = before[:-1] - before[start]
            place = np.where(left, start + own, start + (1 << shift) + at - start - own)
            below = np.empty(n, np.int32)
            below[place] = rank
            rank = below

    def select(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` (from 0) among the positions from ``lo`` to before ``hi``, which must hold more than ``k``."""
        node, lo, hi, k = np.zeros(len(k), np.int32), lo.astype(np.int32), hi.astype(np.int32), k.astype(np.int32)
        for level, before in enumerate(self.lefts):
            first = before[node]
            left_lo, left_hi = before[node + lo] - first, before[node + hi] - first
            count = left_hi - left_lo
            right = k >= count
            k -= np.where(right, count, 0)
            lo, hi = np.where(right, lo - left_lo, left_lo), np.where(right, hi - left_hi, left_hi)
            node += right.astype(np.int32) << (self.depth - 1 - level)
        return self.sorted[node]

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values at the positions from ``lo`` to before ``hi`` are less than ``bound``."""
        rank = np.searchsorted(self.sorted, bound).astype(np.int32)
        node, lo, hi, found = np.zeros(len(rank), np.int32), lo.astype(np.int32), hi.astype(np.int32), np.zeros(len(rank), np.int32)
        for level, before in enumerate(self.lefts):
            shift = self.depth - 1 - level
            first = before[node]
            left_lo, left_hi = before[node + lo] - first, before[node + hi] - first
            right = (rank >> shift) & 1 == 1
            found += np.where(right, left_hi - left_lo, 0)
            lo, hi = np.where(right, lo - left_lo, left_lo), np.where(right, hi - left_hi, left_hi)
            node += right.astype(np.int32) << shift
        return found


def doubled_medians(tree: MergeSortTree, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doubled median, doubled median of the deviations of the doubled values from it) of each window, which must not be empty."""
    n = hi - lo
    low, high = (n - 1) // 2, n // 2
    middle = tree.select(lo, hi, low)
    median = middle + np.where(low == high, middle, tree.select(lo, hi, high))
    # some high + 1 neighbours in value order are within the radius of rank high: those from the first quartile on bound it from both sides
    quartile = low // 2
    one, other = median - 2 * tree.select(lo, hi, quartile), 2 * tree.select(lo, hi, quartile + high) - median
    least, most = np.maximum(np.minimum(one, other), 0), np.maximum(one, other)
    todo = np.flatnonzero(least < most)
    while len(todo):
        radius = (least[todo] + most[todo]) // 2
        m, a, b = median[todo], lo[todo], hi[todo]
        # |2 v - m| <= r: v from (m - r) / 2, rounded up, to (m + r) / 2, rounded down
        within = tree.below(a, b, (m + radius) // 2 + 1) - tree.below(a, b, -((radius - m) // 2))
        enough = within > high[todo]
        most[todo] = np.where(enough, radius, most[todo])
        least[todo] = np.where(enough, least[todo], radius + 1)
        todo = todo[least[todo] < most[todo]]
    total = 2 * most
    even = np.flatnonzero(low < high)
    m, a, b, r = median[even], lo[even], hi[even], most[even]
    from_, to = tree.below(a, b, (m - r) // 2 + 1), tree.below(a, b, -((-r - m) // 2))  # |2 v - m| < r
    inner = np.flatnonzero(to - from_ == high[even])  # then the other middle deviation is the greatest of these
    m, a, b = m[inner], a[inner], b[inner]
    widest = np.maximum(m - 2 * tree.select(a, b, from_[inner]), 2 * tree.select(a, b, to[inner] - 1) - m)
    total[even[inner]] += widest - r[inner]
    return median, total


def _micros(column: str, kind: T.DataType) -> Column:
    """Microseconds since 1970, without a zone where the column has none."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(column))
    days = F.expr(f"datediff(cast(`{column}` as date), date'1970-01-01')").cast("long")
    seconds = F.hour(column) * 3600 + F.minute(column) * 60
    return (days * 86_400 + seconds) * F.lit(1_000_000) + (F.expr(f"extract(second from `{column}`)") * 1_000_000).cast("long")


def _figures(series: np.ndarray, micros: np.ndarray, cents: pa.Array, own: np.ndarray, window: int, span: int) -> list[pa.Array]:
    """n, median2, mad4 and far of the rows that ``own`` marks; rows stand in order of ``series`` (chunks, numbered) and time."""
    has = np.asarray(pc.is_valid(cents))
    value = np.asarray(pc.fill_null(cents, 0), np.int64)
    key = series * np.int64(span + 2 * window) + micros
    held = key[has]
    lo, hi = np.searchsorted(held, key[own] - window, "right"), np.searchsorted(held, key[own], "right")
    n = hi - lo
    some = n >= 2
    median, mad = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    if some.any():
        median[some], mad[some] = doubled_medians(MergeSortTree(value[has]), lo[some], hi[some])
    off = np.abs(2 * value[own] - median)
    far = off > mad + mad // 2  # 2 off > 3 mad
    return [pa.array(n, pa.int64()), pa.array(median, pa.int64(), mask=~some), pa.array(mad, pa.int64(), mask=~some), pa.array(far, pa.bool_(), mask=~(some & has[own]))]


def rolling_medians(rows: DataFrame, id_column: str = "click_id", time_column: str = "ts", series_column: str = "kind", value_column: str = "value", minutes: int = 60, chunk_minutes: int = 120) -> DataFrame:
    """(id, series, n, median2, mad4, far) of every id: its window holds its series' rows of the last ``minutes``, its own time included."""
    window, span = minutes * MICROS_A_MINUTE, chunk_minutes * MICROS_A_MINUTE
    fields = [rows.schema[c] for c in (id_column, series_column)]
    if {id_column, series_column} & {"n", "median2", "mad4", "far"}:
        raise ValueError("the id and the series may not have the name of a figure")
    micros = _micros(time_column, rows.schema[time_column].dataType)
    scaled = F.floor(F.lit(100) * F.col(value_column).cast("double") + F.lit(0.5))
    plain = rows.where(F.col(time_column).isNotNull()).select(F.col(id_column).alias("id"), micros.alias("us"), F.col(series_column).alias("series"), F.when(F.abs(F.col(value_column).cast("double")) < MOST_CENTS / 100, scaled).alias("cents"))
    once = plain.groupBy("id").agg(F.min(F.struct("us", "series", "cents")).alias("x")).select("id", "x.*")
    chunk_of = lambda x: F.expr(f"(({x}) - pmod({x}, {span})) div {span}")
    own, reached = chunk_of("us"), chunk_of(f"us + {window - 1}")
    chunks = once.withColumn("own", own).withColumn("chunk", F.explode(F.sequence(F.col("own"), F.when(F.col("cents").isNull(), F.col("own")).otherwise(reached))))
    dealt = chunks.select("id", "series", "chunk", "cents", (F.col("us") - F.col("chunk") * span + window).alias("us"), (F.col("own") == F.col("chunk")).alias("own"))
    dealt = dealt.repartition("series", "chunk").sortWithinPartitions("series", "chunk", "us")
    schema = T.StructType([fields[0], fields[1], T.StructField("n", T.LongType()), T.StructField("median2", T.LongType()), T.StructField("mad4", T.LongType()), T.StructField("far", T.BooleanType())])
    names = schema.fieldNames()

    def figured(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        part = part.combine_chunks()
        own = np.asarray(part.column("own"))
        number = np.zeros(part.num_rows, np.int64)
        number[starts[1:]] = 1
        found = _figures(np.cumsum(number), np.asarray(part.column("us"), np.int64), part.column("cents").combine_chunks(), own, window, span)
        mine = part.filter(pa.array(own)).combine_chunks()
        first = [mine.column(c).combine_chunks() for c in ("id", "series")]
        return pa.RecordBatch.from_arrays([*[x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in first], *found], names=names)

    def starts_of(part: pa.Table) -> np.ndarray:
        """The rows at which a chunk begins."""
        series, chunk = part.column("series").combine_chunks(), part.column("chunk").combine_chunks()
        n = len(chunk)
        other = pc.or_(pc.fill_null(pc.not_equal(series.slice(1), series.slice(0, n - 1)), False), pc.not_equal(pc.is_null(series.slice(1)), pc.is_null(series.slice(0, n - 1))))
        return np.r_[0, 1 + np.flatnonzero(np.asarray(pc.or_(other, pc.not_equal(chunk.slice(1), chunk.slice(0, n - 1)))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size < TREE_ROWS:
                continue
            part = pa.Table.from_batches(waiting)
            starts = starts_of(part)
            end = int(starts[-1])  # the last chunk may go on
            if end:
                yield figured(part.slice(0, end), starts[:-1])
                rest = part.slice(end)
                waiting, size = rest.to_batches(), rest.num_rows
        if size:
            part = pa.Table.from_batches(waiting)
            yield figured(part, starts_of(part))

    return dealt.mapInArrow(task(run), schema)
