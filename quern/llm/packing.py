"""Packing: first-fit decreasing with a tournament tree of bin capacities.

Every text becomes token ids with an end id.  A document that is longer than a
sequence is cut into full sequences and a rest; all pieces are dealt out to
randomised groups of about ``group_size`` pieces, and each group is packed by
first-fit decreasing: a tournament tree over the bins holds the largest room
below each node, so the first bin with enough room is found in logarithmic time.

Defined cases: a null text is empty and has the end id only; a very long text is
cut into pieces like any other that is longer than a sequence; pieces of one
length are packed in the order of their rows; repeated rows and ids give pieces
of their own; a group's size is bounded for any distribution of ids,
since rows are dealt out by a number that is given to each row; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LONG_WORD, kept, slices, stored, task, text_slices
from quern.llm.ppm_scoring import HashedCodes

#: Characters of texts that are encoded together.
_TOGETHER = 1_000_000
#: Bytes of distinct pre-tokens that are merged together.
_MERGED = 100_000


def _byte_units() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_UNITS = _byte_units()
_NO_RANK = 1 << 30


class Ragged:
    """Sequences of ids, one after the other in ``values``; ``bounds`` has where each begins, and the end."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray):
        self.values, self.bounds = values, bounds

    @staticmethod
    def of(parts: list[bytes]) -> Ragged:
        bounds = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in parts], out=bounds[1:])
        return Ragged(np.frombuffer(b"".join(parts), "<u4"), bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.bounds[i] : self.bounds[i + 1]]

    def taken(self, at: np.ndarray) -> Ragged:
        """The sequences at these places, in this order."""
        sizes = np.diff(self.bounds)[at]
        bounds = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        where = np.repeat(self.bounds[at] - bounds[:-1], sizes)
        where += np.arange(len(where))
        return Ragged(self.values[where], bounds)

    def joined(self, cuts: np.ndarray) -> Ragged:
        """Neighbours from one cut to the next as one sequence."""
        return Ragged(self.values, self.bounds[cuts])

    def replaced(self, new: dict[int, bytes]) -> Ragged:
        return Ragged.of([new.get(i, self[i].tobytes()) for i in range(len(self))])

    def followed_by(self, own: np.ndarray) -> Ragged:
        return Ragged(np.concatenate([self.values, own]), np.append(self.bounds, self.bounds[-1] + len(own)))


class BytePairs:
    """The merges of a byte-pair tokenizer with word ends, applied to many pre-tokens at once."""

    def __init__(self, tokenizer):
        described = json.loads(tokenizer.to_str())["model"]
        vocabulary, suffix = described["vocab"], described["end_of_word_suffix"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in described["merges"]]
        self.model = tokenizer.model
        self.units = np.array([vocabulary[_UNITS[b]] for b in range(256)], np.uint64)
        self.last_units = np.array([vocabulary[_UNITS[b] + suffix] for b in range(256)], np.uint64)
        ids = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], np.uint64).reshape(-1, 3)
        self.ranks, self.made = HashedCodes(ids[:, 0] << np.uint64(32) | ids[:, 1]), ids[:, 2]  # places are ranks

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.ranks.find(left << np.uint64(32) | right)
        return np.where(found < 0, _NO_RANK, found)

    def _of_long(self, piece: bytes) -> np.ndarray:
        return np.array([x.id for x in self.model.tokenize("".join(map(_UNITS.__getitem__, piece)))], np.uint64)

    def merged(self, pieces: pa.Array) -> Ragged:
        """The ids of each pre-token (none empty), merged some at a time."""
        raw = pieces.cast(pa.large_binary())
        done = [self._merged(raw.slice(start, end - start)) for start, end in slices(pc.binary_length(raw).to_pylist(), _MERGED)]
        return Ragged(np.concatenate([x.values for x in done]), np.cumsum(np.concatenate([[0], *(np.diff(x.bounds) for x in done)]))) if done else self._merged(raw)

    def _merged(self, raw: pa.Array) -> Ragged:
        """Again and again, each pre-token merges its first pair of the least rank."""
        bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        sizes = np.diff(bounds)
        long = np.flatnonzero(sizes > LONG_WORD)
        done = [self._of_long(raw[int(i)].as_py()) for i in long]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(raw) else np.empty(0, np.uint8)
        symbol = self.units[data]
        symbol[bounds[1:] - 1 - bounds[0]] = self.last_units[data[bounds[1:] - 1 - bounds[0]]]
        piece = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
        short = (sizes <= LONG_WORD)[piece]
        symbol, piece = symbol[short], piece[short]
        ready_symbol, ready_piece = [np.concatenate(done)] if done else [], [np.repeat(long, [len(x) for x in done])] if done else []
        rank = np.full(len(symbol), _NO_RANK)  # of each symbol with the next
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inner] = self._ranked(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            more = best >> 32 < _NO_RANK
            if not more.all():
                ends = np.append(starts[1:], len(symbol))
                over = np.repeat(~more, ends - starts)
                ready_symbol.append(symbol[over])
                ready_piece.append(piece[over])
                shift = np.cumsum(over)
                at = best[more] & 0xFFFFFFFF
                at -= shift[at]
                symbol, piece, rank = symbol[~over], piece[~over], rank[~over]
            else:
                at = best & 0xFFFFFFFF
            symbol[at] = self.made[rank[at]]
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            symbol, piece, rank = symbol[left], piece[left], rank[left]
            at -= np.arange(len(at))  # each piece lost one symbol, after its own place
            rank[at] = _NO_RANK
            for i in (at[(at > 0) & (piece[at - 1] == piece[at])] - 1, at[(at + 1 < len(piece)) & (piece[np.minimum(at + 1, len(piece) - 1)] == piece[at])]):
                rank[i] = self._ranked(symbol[i], symbol[i + 1])
        symbol, piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ready_symbol, ready_piece))
        order = np.argsort(piece, kind="stable")
        out = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(np.bincount(piece, minlength=len(raw)), out=out[1:])
        return Ragged(symbol[order].astype("<u4"), out)


def _composed(words: pa.Array) -> pa.Array:
    """The words in normal form C; none has a line end."""
    wide = pc.invert(pc.string_is_ascii(words))
    text = "\n".join(words.filter(wide).to_pylist())
    if unicodedata.is_normalized("NFC", text):
        return words
    return pc.replace_with_mask(words, wide, pa.array(unicodedata.normalize("NFC", text).split("\n"), words.type))


class WordEncoder:
    """The ids of texts, for a byte-pair tokenizer with word ends that drops white space.

    Such a tokenizer gives a text the ids of its pre-tokens, one after the
    other, and no pre-token holds white space.  So a slice of texts is split at
    white space, its distinct words into pre-tokens, and each distinct pre-token
    is merged once; the ids go back to words and texts by array operations, and
    nothing is remembered from slice to slice.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        steps = described["pre_tokenizer"].get("pretokenizers", [])
        kinds = [x["type"] for x in described["normalizer"].get("normalizers", [])]
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or kinds != ["NFC", "Replace", "Lowercase"] or not described["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path} is no byte-pair tokenizer with word ends")
        self.pairs = BytePairs(self.tokenizer)
        splitter = steps[0]["pattern"]["Regex"]
        self.pattern = regex.compile(f"{splitter}|\n")
        if regex.findall(splitter, "éa") != ["éa"]:
            raise ValueError(f"{path} doesn't keep runs of letters together")
        self.special = "|".join(re.escape(x["content"]) for x in described["added_tokens"])

    def _words(self, words: pa.Array) -> Ragged:
        """The ids of each word."""
        alone = np.flatnonzero(pc.match_substring_regex(words, self.special).to_numpy(zero_copy_only=False)).tolist() if self.special else []
        # as the normalizer does; only this letter becomes two
        forms = pc.utf8_lower(pc.replace_substring(_composed(words), "İ", "i\u0307")).dictionary_encode()
        kinds, simple = forms.dictionary, pc.utf8_is_alpha(forms.dictionary).to_numpy(zero_copy_only=False)
        found = self.pattern.findall("\n".join(["", *kinds.filter(pa.array(~simple)).to_pylist(), ""]))
        rest = pa.array(found[1:], pa.large_string())
        pieces = pa.concat_arrays([kinds.filter(pa.array(simple)), rest]).dictionary_encode()
        at, n = pieces.indices.to_numpy(), int(simple.sum())
        end = pc.index(pieces.dictionary, "\n").as_py()
        if end >= 0:
            ends = np.concatenate([np.arange(n + 1), n + np.flatnonzero(at[n:] == end) + 1])
            kept_pieces = np.ones(len(at), bool)
            kept_pieces[ends[n + 1 :] - 1] = False
            ends = ends - np.concatenate([[0], np.cumsum(~kept_pieces)])[ends]
            at = at[kept_pieces]
        else:
            ends = np.arange(n + 1)
        place = np.empty(len(kinds), np.int64)  # words of letters alone come first
        place[simple], place[~simple] = np.arange(n), n + np.arange(len(kinds) - n)
        out = self.pairs.merged(pieces.dictionary).taken(at).joined(ends).taken(place[forms.indices.to_numpy()])
        return out.replaced({i: np.array(self.tokenizer.encode(words[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes() for i in alone}) if alone else out

    def encode(self, texts: list[str], end_id: int) -> Ragged:
        """The ids of each text, with the end id."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.values.dictionary_encode()
        table = self._words(words.dictionary).followed_by(np.array([end_id], "<u4"))
        ends = split.offsets.to_numpy()
        # the end id is one more word after each text
        at = np.insert(words.indices.to_numpy(), ends[1:], len(words.dictionary))
        return table.taken(at).joined(ends + np.arange(len(ends)))


class TournamentTree:
    """The room of each bin, and above it the largest room of either side."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with room for ``size``, which is taken from it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, all at most ``capacity``; equal sizes keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = TournamentTree(len(sizes), capacity)
    filled = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        found = tree.take(int(sizes[i]))
        bins[i], offsets[i] = found, filled[found]
        filled[found] += sizes[i]
    return bins, offsets


def _cut(bounds: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of every piece of at most ``capacity`` ids."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // capacity)
    text = np.repeat(np.arange(len(sizes)), pieces)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
    return text, start, np.minimum(capacity, sizes[text] - start)


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, a number of the row, and the ids if asked for."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = kept(f"packing {tokenizer}", lambda: WordEncoder(tokenizer)), TaskContext.get().partitionId() << 40
        for part, texts in text_slices(batches, most=_TOGETHER):
            found = encoder.encode(texts, end_id)
            text, start, length = _cut(found.bounds, capacity)
            first = found.bounds[text] + start
            own = [found.values[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            columns = {
                "doc_id": part.column(0).take(pa.array(text)), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(list(map(zlib.crc32, own)), pa.int64()),
                "doc_tokens": pa.array(np.diff(found.bounds)[text], pa.int64()), "row": pa.array(row + text, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(own, pa.binary())
            row += len(texts)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select("doc_id", "text").mapInArrow(task(run, "packing "), f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, row long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, group_size: int = 8192, seed: int = 7, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; each sequence's pieces fill it from 0 without gaps."""
    pieces = stored(tokenized_pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_size))
    # groups get the keys and lengths of pieces alone, and the rest is joined again
    sizes = pieces.select("row", "start", "length").withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row", "start"), F.lit(groups)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        # a fixed order first: rows come in any order after the shuffle
        table = table.sort_by([("row", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        sequence = (table.column("group").to_numpy() << 32) | bins
        return pa.table({"row": table.column("row"), "start": table.column("start"), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offsets, pa.int64())})

    places = sizes.groupBy("group").applyInArrow(run, "row long, start long, sequence_id long, offset long")
    names = [c for c in pieces.columns if c != "row"]
    return pieces.join(places, ["row", "start"]).select(*names, "sequence_id", "offset")
