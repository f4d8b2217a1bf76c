"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers' token ends, as byte offsets, are united; between neighbouring
ends lies an elementary interval, which one token of either side owns (found by
binary search), so each interval is one overlap.  Where both sides end, a group
closes.  Links are the token pairs that end together, all overlapping pairs
(``overlaps``) or the product of each group's sides (``groups``).

A text is cut at single spaces between other characters, where neither
vocabulary has a token that goes on, so its pieces align by themselves; each
different piece is tokenized and aligned once in a while, and a text whose pieces
don't give its bytes back is tokenized whole.  How often two ids are linked in
the corpus comes from the distinct pairs of each stretch of documents, summed in
one shuffle and joined back to the stretches; documents meet the counts of their
own stretch only.

Defined cases: a null or empty text, and one whose tokens don't give back the
space and its bytes on either side, has no tokens: zeros and an empty digest;
repeated rows are rows of their own and their links count each time; ties for a B
id's highest count are all best; a very long text is aligned whole; ids may be of
any type or null; other columns are left out, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import LONG_WORD, distinct, kept, stored, task, text_slices

#: A worker remembers so many aligned pieces at most.
CACHED_PIECES = 200_000
#: So many pieces are tokenized as one text.
JOINED = 2000
#: Characters of the documents that share a stretch.
STRETCH_CHARS = 4_000_000
LINKS = ("ends", "overlaps", "groups")

_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevelTokenizer:
    """A byte-level vocabulary file; special tokens' strings in texts are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, size = _byte_level(), self.tokenizer.get_vocab_size()
        self.bytes = [bytes(letters.get(c, 0x3F) for c in self.tokenizer.id_to_token(i) or "") for i in range(size)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch([f" {x}" for x in texts], add_special_tokens=False)]


class PieceTokenizer:
    """A piece model that puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.model.vocab_size()) for p in [self.model.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _goes_on(vocabulary: list[bytes]) -> bool:
    """Whether some token holds a space after what isn't white space, so that texts may not be cut there."""
    return any(re.search(r"\S \S", x.decode(errors="replace")) or re.search(r"\S $", x.decode(errors="replace")) for x in vocabulary if b" " in x[1:])


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A owner, B owner, whether it closes a group) of each elementary interval; both sides end with the same offset."""
    ends = np.union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return own_a, own_b, (ends_a[own_a] == ends) & (ends_b[own_b] == ends)


def group_products(last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token numbers of all pairs within groups, whose last tokens are given."""
    first_a, first_b = np.r_[0, last_a[:-1] + 1], np.r_[0, last_b[:-1] + 1]
    wide, deep = last_a - first_a + 1, last_b - first_b + 1
    n = wide * deep
    group = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first_a[group] + place // deep[group], first_b[group] + place % deep[group]


class _Numbers(dict):
    """Numbers the keys that it is asked for, from 0 on."""

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        return value


class Aligner(dict):
    """piece -> (group text, A tokens, B tokens, groups, overlaps, group pairs, links as packed pairs of ids), None where bytes differ."""

    def __init__(self, path_a: str, path_b: str, links: str):
        super().__init__()
        self.a, self.b, self.links = ByteLevelTokenizer(path_a), PieceTokenizer(path_b), links
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.cut = not (_goes_on(self.a.bytes) or _goes_on(self.b.bytes))
        sides = ((self.a, ",|"), (self.b, ",;"))
        self.written = [f"{i}{end}" for t, signs in sides for i in range(len(t.bytes)) for end in signs]

    def pieces(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cut else [text]

    def align(self, pieces: list[str]) -> list[tuple | None]:
        """One entry a piece.  Many pieces without white space at their ends are tokenized as one text, where that gives all their bytes."""
        out: list[tuple | None] = [None] * len(pieces)
        alone = [i for i, x in enumerate(pieces) if not self.cut or len(x.strip()) != len(x)]
        plain = sorted(set(range(len(pieces))) - set(alone))
        for at in range(0, len(plain), JOINED):
            own = plain[at : at + JOINED]
            found = self._joined([pieces[i] for i in own])
            if found is None:
                alone += own
            else:
                for i, entry in zip(own, found):
                    out[i] = entry
        if alone:
            for i, entry in zip(alone, self._each([pieces[i] for i in alone])):
                out[i] = entry
        return out

    def _joined(self, pieces: list[str]) -> Iterator[tuple] | None:
        text = " ".join(pieces)
        ids_a, ids_b = self.a.encode([text])[0], self.b.encode([text])[0]
        whole = b" " + text.encode()
        if not b"".join(map(self.a.bytes.__getitem__, ids_a)) == whole == b"".join(map(self.b.bytes.__getitem__, ids_b)):
            return None
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends = np.cumsum([len(x.encode()) + 1 for x in pieces])
        last = [np.searchsorted(np.cumsum(sizes[ids]), ends) for sizes, ids in ((self.sizes_a, ids_a), (self.sizes_b, ids_b))]
        n_a, n_b = (np.diff(x, prepend=-1) for x in last)
        return self._entries(ids_a, n_a, ids_b, n_b)

    def _each(self, pieces: list[str]) -> Iterator[tuple | None]:
        all_a, all_b = self.a.encode(pieces), self.b.encode(pieces)
        sound = []
        for piece, a, b in zip(pieces, all_a, all_b):
            whole = b" " + piece.encode()
            sound.append(b"".join(map(self.a.bytes.__getitem__, a)) == whole == b"".join(map(self.b.bytes.__getitem__, b)))
        all_a, all_b = ([x for x, s in zip(ids, sound) if s] for ids in (all_a, all_b))
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (all_a, all_b))
        ids_a, ids_b = (np.array([i for x in ids for i in x], np.int64) for ids in (all_a, all_b))
        entries = self._entries(ids_a, n_a, ids_b, n_b) if any(sound) else iter(())
        return (next(entries) if s else None for s in sound)

    def _entries(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> Iterator[tuple]:
        own_a, own_b, closes = intervals(np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]))
        last_a, last_b = own_a[closes], own_b[closes]
        if self.links == "ends":
            link_a, link_b = last_a, last_b
        elif self.links == "overlaps":
            link_a, link_b = own_a, own_b
        else:
            link_a, link_b = group_products(last_a, last_b)
        # groups' tokens in order: A's, then B's
        signs_a, signs_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        signs_a[last_a], signs_b[last_b] = 1, 1
        group_a, group_b = np.searchsorted(last_a, np.arange(len(ids_a))), np.searchsorted(last_b, np.arange(len(ids_b)))
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.r_[0, last_b + 1][group_a]] = 2 * ids_a + signs_a
        order[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = 2 * (len(self.a.bytes) + ids_b) + signs_b
        packed = (ids_a[link_a] << 32 | ids_b[link_b]).astype(np.int64)
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        end_groups, end_overlaps, end_links = (np.searchsorted(x, end_a) for x in (last_a, own_a, link_a))
        sizes = np.bincount(group_a, minlength=len(last_a)) * np.bincount(group_b, minlength=len(last_a))
        products = np.r_[0, np.cumsum(sizes)][end_groups]
        written, links = list(map(self.written.__getitem__, order.tolist())), packed.tobytes()
        figures = (end_a, end_b, end_groups, end_overlaps, products)
        ends, link_ends = (end_a + end_b).tolist(), (8 * end_links).tolist()
        return zip(
            ("".join(written[i:j]) for i, j in zip([0, *ends], ends)), *(np.diff(x, prepend=0).tolist() for x in figures), (links[i:j] for i, j in zip([0, *link_ends], link_ends))
        )

    def entries(self, pieces: Iterable[str]) -> list[tuple | None]:
        """Entries of all pieces, from what the worker remembers or new; what it remembers when it has too many are those of now."""
        found = dict(zip(pieces, map(self.get, pieces, repeat(False))))
        new = [x for x, entry in found.items() if entry is False]
        found.update(zip(new, self.align(new)))
        if len(self) + len(new) > CACHED_PIECES:
            self.clear()
            new = islice(found, CACHED_PIECES)
        self.update((x, found[x]) for x in new if len(x) <= LONG_WORD)
        return list(found.values())

    def stretch(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Of texts that are taken together: (five counts, links, digest, numbers of its pairs, their times) of each; the pairs, and their times in all."""
        numbers = _Numbers()
        split = [list(map(numbers.__getitem__, self.pieces(x))) if x else [] for x in texts]
        used = self.entries(numbers)
        if bad := {i for i, x in enumerate(used) if x is None}:
            # such texts are taken whole, and have no tokens if that gives other bytes too
            whole = [i for i, x in enumerate(split) if not bad.isdisjoint(x)]
            again = self.align([texts[i] for i in whole])
            for i, entry in zip(whole, again):
                split[i] = [len(used)] if entry else []
                used += [entry] if entry else []
            used = [x or ("", 0, 0, 0, 0, 0, b"") for x in used]
        written, counts = [x[0] for x in used], np.array([x[1:6] for x in used], np.int64).reshape(-1, 5)
        held = np.frombuffer(b"".join([x[6] for x in used]), np.int64)
        n_links = np.array([len(x[6]) // 8 for x in used], np.int64)
        pairs = distinct(held)
        code, first = np.searchsorted(pairs, held), np.cumsum(n_links) - n_links
        totals, rows = np.zeros(len(pairs), np.int64), []
        for pieces in split:
            mine = np.array(pieces, np.int64)
            n = n_links[mine]
            links = code[np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            links.sort()
            start = np.flatnonzero(np.diff(links, prepend=-1))
            own, times = links[start], np.diff(np.r_[start, len(links)])
            totals[own] += times
            text = "".join(map(written.__getitem__, pieces))[:-1]
            rows.append((*counts[mine].sum(0).tolist(), len(links), hashlib.sha256(text.encode()).hexdigest() if text else "", own, times))
        return rows, pairs, totals


_STRETCH = "stretch long, id {id}, n_a long, n_b long, n_groups long, n_overlaps long, n_group_pairs long, n_links long, groups_sha256 string, codes array<int>, times array<int>, pairs array<long>, totals array<long>"


def _stretches(docs: DataFrame, path_a: str, path_b: str, links: str, id_column: str, text_column: str) -> DataFrame:
    """A row a document with its links as numbers of its stretch's pairs, and a row a stretch with the pairs and how often it has them."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(f"token_alignment {path_a} {path_b} {links}", lambda: Aligner(path_a, path_b, links))
        # a task that is run again gives all its stretches anew under the same names
        context = TaskContext.get()
        stretch = (context.partitionId() if context else 0) << 32
        for part, texts in text_slices(batches, "text", STRETCH_CHARS):
            rows, pairs, totals = aligner.stretch(texts)
            columns = list(zip(*rows))
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            listed = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c), pa.int32())) for c in columns[7:]]
            yield pa.RecordBatch.from_arrays([pa.array([stretch] * len(rows), pa.int64()), part.column("id"), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string()), *listed, *[pa.nulls(len(rows), longs)] * 2], names=names)
            if len(pairs):
                nothing = [pa.nulls(1, kind) for kind in (part.column("id").type, *[pa.int64()] * 6, pa.string(), ints, ints)]
                yield pa.RecordBatch.from_arrays([pa.array([stretch], pa.int64()), *nothing, *(pa.array([x], longs) for x in (pairs, totals))], names=names)
            stretch += 1

    schema = T._parse_datatype_string(_STRETCH.format(id=id_type))
    names = schema.fieldNames()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(task(run, "token_alignment "), schema)


def pair_counts(stretches: DataFrame) -> DataFrame:
    """(pair, n_links, best): how many links hold each pair of ids (packed: A's above 32 bits), and whether that is its B id's highest."""
    pairs = stretches.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.totals").alias("n_links"))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    # a row for each entry of B's vocabulary at most
    highest = pairs.groupBy(b.alias("b")).agg(F.max("n_links").alias("highest"))
    return pairs.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "n_links", (F.col("n_links") == F.col("highest")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", links: str = "ends") -> DataFrame:
    """Per document (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps, n_group_pairs).

    ``path_a`` is a byte-level vocabulary, ``path_b`` a piece model, both readable by every executor.
    """
    if links not in LINKS:
        raise ValueError(f"links is none of {', '.join(LINKS)}")
    made = stored(_stretches(docs, path_a, path_b, links, id_column, text_column), "token-alignment")
    counts = pair_counts(made)
    places = made.where("pairs is not null").select(F.col("stretch").alias("of"), F.posexplode("pairs").alias("code", "pair"))
    known = places.join(counts, "pair").select("of", "code", "n_links", "best")
    rows = made.where("pairs is null").drop("pairs", "totals")
    id_field = T.StructField(id_column, docs.schema[id_column].dataType)
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups_sha256", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_overlaps", "n_group_pairs"))])

    def summed(mine: pa.Table, seen: pa.Table) -> pa.Table:
        code = np.asarray(seen.column("code"), np.int64)
        value, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        value[code], best[code] = np.asarray(seen.column("n_links"), np.int64), np.asarray(seen.column("best"), np.int64)
        sums = []
        for codes, times in zip(mine.column("codes"), mine.column("times")):
            c, n = np.asarray(codes.values, np.int64), np.asarray(times.values, np.int64)
            sums.append((int(best[c] @ n), int(value[c] @ n)))
        n_best, count_sum = (pa.array([x[k] for x in sums], pa.int64()) for k in (0, 1))
        return pa.Table.from_arrays([mine.column("id"), *(mine.column(c) for c in longs[:4]), n_best, count_sum, mine.column("groups_sha256"), mine.column("n_overlaps"), mine.column("n_group_pairs")], names=schema.fieldNames())

    return rows.groupBy("stretch").cogroup(known.groupBy("of")).applyInArrow(summed, schema)
