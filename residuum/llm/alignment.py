"""Alignment of two tokenizers over a corpus, by counts of linked token ids.

Every text is encoded by a byte-level BPE (side A) and by a SentencePiece model
(side B), both over a space and the text. Byte offsets where tokens of both sides
end cut them into groups; tokens whose byte ranges overlap are linked. A pair of
ids counts the documents that hold it linked; the highest count of an A id marks
its best partners.

1. A task encodes its texts word by word: a space before neither a space nor
   other white space, and not behind a space, is a border of both sides, so words
   are aligned apart and a cache holds the common ones. The distinct pairs of a
   block of texts, with the documents that hold them and how often, leave the task
   by stripe: an A id belongs to stripe ``id % stripes``. Neighbouring ids, which
   are alike common, lie in different stripes.
2. A stripe's counts are a dense matrix, its A ids by all of B, to which blocks are
   added with ``np.add.at``; blocks are added in ``salts`` parts first. The maxima
   of its rows mark the best partners. Memory is the same for every corpus.
3. Links and counts of a stripe meet in one partition, in ``salts`` parts, the
   counts first; sums by document return to the block that the documents came from.

No pair of a document is a row; rows are blocks, and a document holds a pair
once, so common tokens make no hot stripe.

Null and empty texts, and texts that either side does not give back byte for byte
(U+2581 in side B), have no tokens: zeros, and no groups. Very long texts are
encoded whole. Repeated rows and null identifiers are documents of their own; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import BoundedCache, Staged, slices

_SPACE = "▁"
_BORDER = re.compile(rf"(?<=[^ {_SPACE}]) (?=[^\s{_SPACE}])")
_BLOCK_TEXTS = 1 << 16  # texts of a block are numbered in 16 bits
_ENCODED, _JOINED = 5_000, 50  # words that are encoded at a time, and of these in one text
_NOT_BEHIND, _NOT_BEFORE = frozenset(_SPACE), frozenset([" ", _SPACE])  # first characters that need no border before, last ones that hold none behind


@dataclass(frozen=True)
class Stripes:
    """The matrix of A ids by B ids in stripes of about equally many A ids."""

    size_a: int
    size_b: int
    number: int

    @property
    def rows(self) -> int:
        return -(-self.size_a // self.number)

    @property
    def cells(self) -> int:
        return self.rows * self.size_b

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells of pairs, ordered by stripe."""
        return (a % self.number * self.rows + a // self.number) * self.size_b + b

    def ids(self, stripe: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return cell // self.size_b * self.number + stripe, cell % self.size_b


class _Flat:
    """The bytes of a vocabulary in one array."""

    def __init__(self, entries: list[bytes]):
        self._bytes = np.frombuffer(b"".join(entries), np.uint8)
        self._size = np.array(list(map(len, entries)), np.int64)
        self._begin = np.cumsum(self._size) - self._size

    def same(self, ids: np.ndarray, raw: bytes) -> bool:
        """The entries of ``ids`` in a row are ``raw``."""
        size = self._size[ids]
        upto = np.cumsum(size)
        if len(raw) != (upto[-1] if len(upto) else 0):
            return False
        shift = np.repeat(self._begin[ids] - (upto - size), size)
        return bool((self._bytes[np.arange(len(raw)) + shift] == np.frombuffer(raw, np.uint8)).all())


class Aligner:
    """Both tokenizers; words between borders aligned through a cache."""

    def __init__(self, path_a: str, path_b: str, stripes: int, cache_words: int = 220_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_file=path_b)
        byte_of = _bytes_of_characters()
        pieces = {i: bytes(byte_of[c] for c in p) if all(c in byte_of for c in p) else p.encode() for p, i in self._a.get_vocab().items()}
        self.bytes_a = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.bytes_b = [self._surface(i) for i in range(self._b.get_piece_size())]
        self._size_a, self._size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self._flat_a, self._flat_b = _Flat(self.bytes_a), _Flat(self.bytes_b)
        self._decimal = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.stripes = Stripes(len(self.bytes_a), len(self.bytes_b), stripes)
        self._known = BoundedCache(cache_words, self._aligned)

    def _surface(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def clear(self) -> None:
        self._known.clear()

    def words(self, text: str | None) -> list[str]:
        """The parts of a text between borders, each of which has lost the space before it."""
        return _BORDER.split(text) if text else []

    def look_up(self, wanted: set[str]):
        return self._known.look_up(wanted)

    def _aligned(self, words: list[str]) -> list[tuple | None]:
        out = []
        for at in range(0, len(words), _ENCODED):
            out += self._align(words[at : at + _ENCODED])
        return out

    def _align(self, words: list[str]) -> list[tuple | None]:
        """Of each word: tokens of A and B, groups, links, the groups as text and the links' cells; None if a side loses bytes.

        Words are encoded many at a time as texts of their own, where their borders hold as well.
        """
        plain = [bool(w) and w[0] not in _NOT_BEHIND and w[-1] not in _NOT_BEFORE and not w[0].isspace() for w in words]
        found = iter(self._halved([w for w, p in zip(words, plain) if p]))
        return [next(found) if p else (self._rows([w], [w]) or [None])[0] for w, p in zip(words, plain)]

    def _halved(self, words: list[str]) -> list[tuple | None]:
        """The rows of many words; where a side loses bytes, those of each half."""
        rows = self._rows(words, [" ".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)])
        if rows is not None:
            return rows
        half = len(words) // 2
        return self._halved(words[:half]) + self._halved(words[half:]) if half else [None]

    def _rows(self, words: list[str], texts: list[str]) -> list[tuple] | None:
        """The rows of ``words``, which ``texts`` hold in order with a space before each; None if a side loses bytes of any."""
        if not words:
            return []
        of_a = [x.ids for x in self._a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (of_a, self._b.encode(texts, num_threads=1)))
        raw = f" {' '.join(words)}".encode("utf-8", "surrogatepass")
        if not self._flat_a.same(a, raw) or not self._flat_b.same(b, raw):
            return None
        size_a = self._size_a[a]
        end_a, end_b = np.cumsum(size_a), np.cumsum(self._size_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        cut_a, cut_b = (np.searchsorted(e, both, "right").tolist() for e in (end_a, end_b))
        text_a, text_b = (list(map(self._decimal.__getitem__, x.tolist())) for x in (a, b))
        groups = [
            f"{','.join(text_a[p:q])}|{','.join(text_b[r:s])}"
            for p, q, r, s in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)
        ]
        first = np.searchsorted(end_b, end_a - size_a, "right")
        number = np.searchsorted(end_b, end_a, "left") + 1 - first
        upto = np.cumsum(number)
        partner = np.arange(number.sum()) - np.repeat(upto - number - first, number)
        cells = self.stripes.keys(np.repeat(a, number), b[partner]).tobytes()
        sizes = np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) if not raw.isascii() else np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(sizes + 1)  # of words, where tokens of both sides end
        stop_a, stop_b, stop_group = (np.searchsorted(e, end, "right") for e in (end_a, end_b, both))
        stop_link = np.append(0, upto)[stop_a]
        steps = [np.diff(x, prepend=0).tolist() for x in (stop_a, stop_b, stop_group, stop_link)]
        groups_to, links_to = stop_group.tolist(), stop_link.tolist()
        return [
            (n_a, n_b, n_g, n_l, ";".join(groups[g - n_g : g]), cells[8 * (x - n_l) : 8 * x])
            for n_a, n_b, n_g, n_l, g, x in zip(*steps, groups_to, links_to)
        ]


def _bytes_of_characters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: most stand for themselves, the others follow U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str, stripes: int) -> Aligner:
    return Aligner(path_a, path_b, stripes)


_OUT = {
    "block": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
    "groups": pa.string(), "stripe": pa.int32(), "cells": pa.binary(), "runs": pa.binary(), "places": pa.binary(), "times": pa.binary(),
}
_OUT_DDL = (
    "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "stripe int, cells binary, runs binary, places binary, times binary"
)


def _batch(columns: dict[str, list | np.ndarray]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in _OUT.items()], list(_OUT))


def _encode(path_a: str, path_b: str, stripes: int, digest: bool):
    """Rows of documents and, for each block of texts and stripe, the linked cells in order with the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(path_a, path_b, stripes)
        block = TaskContext.get().partitionId() << 32
        try:
            for batch in batches:
                texts, ids = batch["text"].to_pylist(), batch["doc_id"]
                for begin, end in slices(texts, 2_000_000):
                    for low in range(begin, end, _BLOCK_TEXTS):
                        some = slice(low, min(end, low + _BLOCK_TEXTS))
                        yield from _block(made, block, ids[some], texts[some], digest)
                        block += 1
        finally:
            made.clear()

    return run


def _block(made: Aligner, block: int, ids: pa.Array, texts: list[str | None], digest: bool) -> Iterator[pa.RecordBatch]:
    split = [made.words(t) for t in texts]
    known = made.look_up(set().union(*split))
    rows, held = [], []
    for words in split:
        parts = [known[w] for w in words]
        if not parts or None in parts:
            rows.append((0, 0, 0, 0, ""))
            held.append(b"")
            continue
        n_a, n_b, n_groups, n_links, groups, cells = zip(*parts)
        groups = ";".join(groups)
        rows.append((sum(n_a), sum(n_b), sum(n_groups), sum(n_links), hashlib.sha256(groups.encode()).hexdigest() if digest else groups))
        held.append(b"".join(cells))
    numbers = np.array([len(x) >> 3 for x in held], np.int64)
    cells = np.frombuffer(b"".join(held), np.int64)
    at, times = np.unique((cells << 16) | np.repeat(np.arange(len(held)), numbers), return_counts=True)
    n = len(texts)
    columns = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups"), map(list, zip(*rows)))) if rows else {}
    yield _batch({"block": np.full(n, block), "place": np.arange(n, dtype=np.int32), "doc_id": ids, **columns})
    cell, place = at >> 16, (at & 0xFFFF).astype(np.uint16)
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # of each cell
    runs = np.diff(np.append(first, len(cell))).astype(np.uint32)
    stripe, inside = np.divmod(cell[first], made.stripes.cells)
    edge = np.flatnonzero(np.diff(stripe, prepend=-1))
    cuts = list(zip(edge.tolist(), [*edge[1:].tolist(), len(stripe)]))
    inside, times = inside.astype(np.uint32), times.astype(np.uint32)
    ends = np.append(first, len(cell)).tolist()
    out = {
        "block": np.full(len(cuts), block), "stripe": stripe[edge].astype(np.int32),
        "cells": [inside[b:e].tobytes() for b, e in cuts], "runs": [runs[b:e].tobytes() for b, e in cuts],
        "places": [place[ends[b] : ends[e]].tobytes() for b, e in cuts], "times": [times[ends[b] : ends[e]].tobytes() for b, e in cuts],
    }
    if cuts:
        yield _batch(out)


class _Dense:
    """A stripe's matrix; only rows in use are read and cleared."""

    def __init__(self, cells: int, width: int):
        self.flat = np.zeros(cells, np.int64)
        self.rows = self.flat.reshape(-1, width)
        self.used = np.zeros(len(self.rows), bool)
        self.width = width

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        np.add.at(self.flat, cells, counts)
        self.used[cells // self.width] = True

    def take(self, mark: bool) -> tuple[np.ndarray, np.ndarray]:
        """Cells above zero and their counts, negative ones for the maxima of rows if ``mark``; clears the matrix."""
        cells, counts = [], []
        for row in np.flatnonzero(self.used):
            values = self.rows[row]
            some = np.flatnonzero(values)
            held = values[some]
            counts.append(np.where(held == held.max(), -held, held) if mark else held)
            cells.append(some + row * self.width)
        self.clear()
        return (np.concatenate(cells), np.concatenate(counts)) if cells else (np.empty(0, np.int64), np.empty(0, np.int64))

    def clear(self) -> None:
        self.rows[self.used] = 0
        self.used[:] = False


_PIECE = 1 << 17  # cells in a row of counts


def _sum(shape: Stripes, mark: bool):
    """Sums of the counts of each stripe (and part) of sorted rows ``stripe, part, cells, counts``."""

    def rows(key: tuple[int, int], dense: _Dense) -> Iterator[pa.RecordBatch]:
        cells, counts = dense.take(mark)
        for at in range(0, len(cells), _PIECE):
            c, n = cells[at : at + _PIECE].astype(np.uint32), counts[at : at + _PIECE]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([c.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())],
                ["stripe", "part", "cells", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, last = None, None
        for batch in batches:
            for stripe, part, cells, counts in zip(*(batch[c].to_pylist() for c in ("stripe", "part", "cells", "counts"))):
                dense = dense or _Dense(shape.cells, shape.size_b)
                if last not in (None, (stripe, part)):
                    yield from rows(last, dense)
                last = (stripe, part)
                number = np.frombuffer(counts, np.uint32 if len(counts) == len(cells) else np.int64)
                dense.add(np.frombuffer(cells, np.uint32).astype(np.int64), number.astype(np.int64))
        if last is not None:
            yield from rows(last, dense)

    return run


def _score(shape: Stripes):
    """Sums by document of each row of links; the counts of a stripe come before its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, last = None, None
        names = ("stripe", "part", "kind", "block", "cells", "counts", "places", "times")
        for batch in batches:
            out = []
            for stripe, part, kind, block, cells, counts, places, times in zip(*(batch[c].to_pylist() for c in names)):
                dense = dense or _Dense(shape.cells, shape.size_b)
                if last != (stripe, part):
                    dense.clear()
                    last = (stripe, part)
                cells = np.frombuffer(cells, np.uint32).astype(np.int64)
                if kind == 0:
                    dense.add(cells, np.frombuffer(counts, np.int64))
                    continue
                count = np.repeat(dense.flat[cells], np.frombuffer(counts, np.uint32))
                place, number = np.frombuffer(places, np.uint16), np.frombuffer(times, np.uint32).astype(np.int64)
                size = int(place.max()) + 1
                best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(best, place, number * (count < 0))
                np.add.at(total, place, number * np.abs(count))
                some = np.flatnonzero(total)
                out.append((block, some.astype(np.uint16).tobytes(), best[some].tobytes(), total[some].tobytes()))
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "places", "best", "total"])

    return run


_DONE = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a block, which come first, and their sums."""
    docs: list[pa.RecordBatch] = []
    best = total = np.empty(0, np.int64)
    block = None

    def emit() -> Iterator[pa.RecordBatch]:
        for rows in docs:
            at = rows["place"].to_numpy()
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in _DONE), pa.array(best[at]), pa.array(total[at])], [*_DONE, "n_best", "count_sum"])

    for batch in batches:
        number = batch["block"].to_numpy()
        edges = np.flatnonzero(np.diff(number, prepend=-1)) if len(number) else []
        for b, e in zip(edges, [*edges[1:], len(number)]):
            part = batch.slice(b, e - b)
            if number[b] != block:
                yield from emit()
                docs, block = [], number[b]
                best, total = np.zeros(_BLOCK_TEXTS, np.int64), np.zeros(_BLOCK_TEXTS, np.int64)
            is_doc = part["kind"].to_numpy() == 0
            if is_doc.any():
                docs.append(part.filter(pa.array(is_doc)))
            sums = part.filter(pa.array(~is_doc))
            for places, x, y in zip(*(sums[c].to_pylist() for c in ("places", "best", "total"))):
                at = np.frombuffer(places, np.uint16)
                best[at] += np.frombuffer(x, np.int64)
                total[at] += np.frombuffer(y, np.int64)
    yield from emit()


class Alignment:
    """What :func:`align` has staged."""

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, digest: bool, stripes: int, salts: int, id_col: str, text_col: str):
        spark = docs.sparkSession
        self._staged = staged = Staged(spark, "alignment")
        made = aligner(path_a, path_b, stripes)
        self.shape = shape = made.stripes
        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
        self._rows = staged.write(rows.mapInArrow(_encode(path_a, path_b, stripes, digest), _OUT_DDL))
        self._links = self._rows.filter("stripe IS NOT NULL")
        self._part = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
        self._parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        parts = self._links.select("stripe", self._part.alias("part"), "cells", F.col("runs").alias("counts"))
        for mark in (False, True):
            parts = parts.repartition("stripe", "part").sortWithinPartitions("stripe", "part")
            parts = parts.mapInArrow(_sum(shape, mark), "stripe int, part int, cells binary, counts binary")
        self._counts = staged.write(parts.drop("part"))

    def pairs(self) -> DataFrame:
        """``a, b, count, best`` of every linked pair of ids."""
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for stripe, cells, counts in zip(*(batch[c].to_pylist() for c in ("stripe", "cells", "counts"))):
                    a, b = shape.ids(stripe, np.frombuffer(cells, np.uint32).astype(np.int64))
                    n = np.frombuffer(counts, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.abs(n)), pa.array(n < 0)], ["a", "b", "count", "best"])

        return self._counts.mapInArrow(run, "a long, b long, count long, best boolean")

    def documents(self) -> DataFrame:
        """``doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum`` of every document."""
        none = lambda kind: F.lit(None).cast(kind)
        counts = self._counts.select(
            "stripe", self._parts.alias("part"), F.lit(0).alias("kind"), none("long").alias("block"), "cells", "counts",
            none("binary").alias("places"), none("binary").alias("times"))
        links = self._links.select("stripe", self._part.alias("part"), F.lit(1).alias("kind"), "block", "cells", F.col("runs").alias("counts"), "places", "times")
        scored = counts.unionByName(links).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "kind")
        scored = scored.mapInArrow(_score(self.shape), "block long, places binary, best binary, total binary")
        own = self._rows.filter("stripe IS NULL").select("block", F.lit(0).alias("kind"), "place", *_DONE)
        both = own.unionByName(scored.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        both = both.repartition("block").sortWithinPartitions("block", "kind")
        return both.mapInArrow(_gather, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")


def align(
    docs: DataFrame, path_a: str, path_b: str, digest: bool = False, stripes: int = 99, salts: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> Alignment:
    """Links between the tokens of a byte-level BPE file and of a SentencePiece model.

    :param digest: keep the SHA-256 of a document's groups in place of the groups
        (``a1,a2|b1;a3|b2,b3``), which are longer than its text.
    :param stripes: a matrix has ``ids of A / stripes`` rows of all B ids.
    :param salts: the links of a stripe are counted and scored in so many parts.
    """
    return Alignment(docs, path_a, path_b, digest, stripes, salts, id_col, text_col)
