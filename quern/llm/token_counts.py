"""Token counts: greedy longest-match piece counts by a linear automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of
pieces that following the link pops, both computed once.  A word is read byte
by byte, each byte follows one edge or some links, and the pops add up to the
number of pieces; the pieces themselves are never built.

Defined cases: a null or blank text has 0 words and 0 tokens; rows are kept as
they are, so repeated rows, ties and other columns don't matter; a very long text
is counted whole; an empty table gives no rows; a word that the vocabulary can't
cover counts as one unknown piece; ids are whole numbers.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import CACHED_WORDS, LONG_WORD, kept, task, text_slices


class PieceCounter(dict):
    """word -> number of pieces; ``pieces`` are byte strings, those that start a word begin with ``marker``."""

    def __init__(self, pieces: Iterable[bytes], marker: bytes = b" "):
        super().__init__()
        self.marker = marker
        edges: dict[int, int] = {}
        final, depth = {0: False}, 1
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                child = edges.get(key)
                if child is None:
                    child = edges[key] = depth
                    final[child] = False
                    depth += 1
                node = child
            final[node] = node != 0
        children: dict[int, list[tuple[int, int]]] = {}
        for key, child in edges.items():
            children.setdefault(key >> 8, []).append((key & 255, child))
        link, pops = [-1] * depth, [0] * depth
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children.get(parent, ()):
                queue.append(node)
                if final[node]:
                    link[node], pops[node] = 0, 1
                    continue
                state, popped = link[parent], pops[parent]
                while state >= 0 and (state << 8 | byte) not in edges:
                    popped += pops[state]
                    state = link[state]
                if state >= 0:
                    link[node], pops[node] = edges[state << 8 | byte], popped
        self.edges, self.link, self.pops = edges, link, pops

    def count(self, word: bytes) -> int:
        """Pieces of the marked word; 1 if some part of it is in no piece."""
        edges, link, pops = self.edges, self.link, self.pops
        node = total = 0
        for byte in self.marker + word:
            child = edges.get(node << 8 | byte)
            while child is None:
                if link[node] < 0:
                    return 1
                total += pops[node]
                node = link[node]
                child = edges.get(node << 8 | byte)
            node = child
        while node:
            if link[node] < 0:
                return 1
            total += pops[node]
            node = link[node]
        return total

    def __missing__(self, word: bytes) -> int:
        value = self.count(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


def rank_file_counter(path: str) -> PieceCounter:
    """The counter of a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return PieceCounter(base64.b64decode(line.split()[0]) for line in lines if line.strip())


def token_counts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of every row; ``vocabulary`` is a rank file's path that every executor can open."""
    field = docs.schema[id_column]
    schema = pa.schema([(id_column, pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(f"token_counts {vocabulary}", lambda: rank_file_counter(vocabulary))
        for part, texts in text_slices(batches, text_column):
            split = [x.encode().split() for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(map(len, split), pa.int64()), pa.array((sum(map(counter.__getitem__, x)) for x in split), pa.int64())], schema=schema)

    return docs.select(field.name, text_column).mapInArrow(task(run, "token_counts "), f"`{id_column}` long, n_words long, n_tokens long")
