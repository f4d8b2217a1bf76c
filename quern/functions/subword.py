"""Token counts by a public byte-pair vocabulary, for chunk sizes and overlaps that are exact in a model's tokens."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import regex

#: A fixed pattern of byte-level vocabularies: where a text is cut before pairs are merged.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cuts whose counts a worker remembers, and the longest of them.
REMEMBERED, LONG = 200_000, 64


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one cut: of all neighbours the pair with the least rank merges first, the leftmost of equals.

    Neighbours are linked and pairs wait in a heap, so a long cut takes n log n steps.
    """
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    waiting: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0:
            both = parts[i] + parts[right[i]]
            if both in ranks:
                heapq.heappush(waiting, (ranks[both], i, both))

    for i in range(len(parts)):
        offer(i)
    while waiting:
        _, i, both = heapq.heappop(waiting)
        j = right[i]
        if parts[i] is None or j < 0 or parts[i] + parts[j] != both:
            continue  # one of the two has merged since
        parts[i], parts[j] = both, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    return [x for x in parts if x is not None]


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """The pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(x.split()[0]): int(x.split()[1]) for x in lines if x.strip()}


#: What follows can change the last cuts of a text: an end of white space, a run, and an apostrophe with a letter that becomes a contraction.
OPEN_CUTS = 3


class Running:
    """The count of a text that grows by pieces; cuts before the last ``OPEN_CUTS`` are counted once.  Of another pattern than ``PRETOKENS`` all stay open."""

    def __init__(self, counter: SubwordCounter):
        self.counter, self.closed, self.open, self.last = counter, 0, "", ("", [], [])

    def with_piece(self, piece: str) -> int:
        """The count of the text with ``piece`` at its end."""
        cuts = self.counter.cuts(self.open + piece)
        counts = self.counter.each(cuts)
        self.last = (piece, cuts, counts)
        return self.closed + sum(counts)

    def add(self, piece: str) -> None:
        if self.counter.pattern != PRETOKENS:
            self.open += piece
            return
        if self.last[0] != piece or not piece:
            self.with_piece(piece)
        _, cuts, counts = self.last
        self.closed += sum(counts[:-OPEN_CUTS])
        self.open, self.last = "".join(cuts[-OPEN_CUTS:]), ("", [], [])


class SubwordCounter:
    """Counts tokens, and cuts overlaps by them; holds the path alone until it counts, so it goes to tasks as it is."""

    def __init__(self, path: str, pattern: str = PRETOKENS):
        self.path, self.pattern = path, pattern

    def _count(self, cut: str) -> int:
        known = _counts(self.path)
        n = known.get(cut)
        if n is None:
            raw, ranks = cut.encode(), ranks_of(self.path)
            n = 1 if raw in ranks else len(merged(raw, ranks))
            if len(cut) <= LONG:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[cut] = n
        return n

    def cuts(self, text: str) -> list[str]:
        return _pattern(self.pattern).findall(text)

    def __call__(self, text: str) -> int:
        return sum(self.each(self.cuts(text)))

    def each(self, cuts: list[str]) -> list[int]:
        found = list(map(_counts(self.path).get, cuts))
        return [self._count(x) if n is None else n for x, n in zip(cuts, found, strict=True)] if None in found else found

    def over(self, text: str, size: int) -> bool:
        """Whether ``text`` has more than ``size`` tokens, told from its beginning where it is long."""
        total = 0
        for found in _pattern(self.pattern).finditer(text):
            total += self._count(found.group())
            if total > size:
                return True
        return False

    def running(self) -> Running:
        """A count of a text that grows."""
        return Running(self)

    def tail(self, text: str, n: int) -> str:
        """The longest end of the text that begins at a cut and has ``n`` tokens at most, by itself too; without white space around it."""
        cuts = self.cuts(text)
        total, start = 0, len(cuts)
        while start and total + self._count(cuts[start - 1]) <= n:
            start -= 1
            total += self._count(cuts[start])
        while start < len(cuts):
            found = "".join(cuts[start:]).strip()
            if self(found) <= n:
                return found
            start += 1
        return ""


@lru_cache(maxsize=2)
def _counts(path: str) -> dict[str, int]:
    return {}


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    return regex.compile(pattern)
