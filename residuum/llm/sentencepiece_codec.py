"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut into words where no vocabulary piece can cross; the words that a
worker has not met lately are encoded together. Their symbols lie in one flat
array. Every round looks up each pair of neighbours, cuts words where no piece
can hold both sides any more, finds the pair of least rank in every word (a
segmented minimum, the leftmost of equal ones), merges, and compacts the array;
a word without a known pair leaves.

Besides the least pair of its word, every pair merges at once that the library
would merge in any case before a neighbour changes: its rank is below that of
all pieces that could reach over either of its ends. Equal pairs in a row merge
from the left, every second one. So the merges are the library's, and the rounds
of a text hardly grow with its length: a word of a million characters takes seconds.

Models with byte fallback, the identity normaliser and a dummy prefix are
supported; others are refused. Null counts as the empty text, which has no ids.
Very long texts and words are encoded whole. Repeated rows and null identifiers
are encoded like others; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from residuum.llm.common import BoundedCache, map_batches, slices

SPACE = "▁"
_NONE = np.iinfo(np.int64).max
codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def word_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Words that no piece crosses: at spaces and line ends, or whole texts if pieces go over spaces."""
    pieces = list(pieces)
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return re.compile(".+", re.S)
    line = "" if any("\n" in p for p in pieces) else "\n"
    return re.compile(f"{SPACE}+[^{SPACE}{line}]*" + (f"|\n[^{SPACE}\n]*" if line else ""))


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_path: str, cache_words: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
            raise ValueError("only the identity normaliser with a dummy prefix is supported")
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback are supported")
        kinds = proto.ModelProto.SentencePiece
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.UNUSED)}
        self.byte_ids = np.zeros(256, np.int64)
        surface = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.CONTROL:
                surface.append(b"")
            elif p.type == kinds.UNKNOWN:
                surface.append(trainer.unk_surface.encode())
            else:
                surface.append(p.piece.replace(SPACE, " ").encode())
        self.surface = surface
        self._flat = np.frombuffer(b"".join(surface), np.uint8)
        self._size = np.array([len(s) for s in surface], np.int64)
        self._begin = np.cumsum(self._size) - self._size
        self._build_pairs(model, normal)
        self._words = word_pattern(normal)
        self._known = BoundedCache(cache_words, self._digest)
        self._decimal = [str(i) for i in range(len(surface))]

    def _build_pairs(self, model, normal: dict[str, int]) -> None:
        """Sorted table of symbols that some piece holds side by side, and the piece that the two make."""
        symbols = dict(normal)
        for piece in normal:
            for c in piece:
                symbols.setdefault(c, len(model.pieces) + len(symbols))
        self.base = max(symbols.values(), default=0) + 2  # the last symbol stands for unknown characters
        self._symbol_of = np.full(0x110000, self.base - 1, np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self._symbol_of[ord(c)] = i
        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rank = {i: rank_of[model.pieces[i].score] for i in normal.values()}
        table: dict[int, list[int]] = {}  # two symbols side by side: least rank of a piece over both, the piece they make, its rank
        for piece, i in sorted(normal.items(), key=lambda x: rank[x[1]]):
            for cut in range(1, len(piece)):
                before = [symbols[x] for a in range(cut) if (x := piece[a:cut]) in symbols]
                after = [symbols[x] for b in range(cut, len(piece)) if (x := piece[cut : b + 1]) in symbols]
                for s in before:
                    for t in after:
                        table.setdefault(s * self.base + t, [rank[i], 0, _NONE])
                if piece[:cut] in symbols and piece[cut:] in symbols:
                    table[before[0] * self.base + after[-1]][1:] = i, rank[i]
        pairs = np.array([*table, _NONE], np.int64)
        values = np.array([*table.values(), [_NONE, 0, _NONE]], np.int64)
        order = np.argsort(pairs)
        self._pair = pairs[order]
        self._over, self._makes, self._rank = (np.ascontiguousarray(c) for c in values[order].T)
        shared = np.bincount(list(rank.values()), minlength=len(scores)) > 1
        self._at_once = np.zeros(self.base, bool)  # pieces whose rank no other has
        for i, r in rank.items():
            self._at_once[i] = not shared[r]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and their number for each word.

        A word is a run of symbols that merge only among themselves.
        """
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self._symbol_of[code]
        place = np.arange(len(sym))
        closed = np.zeros(len(sym), bool)  # behind the symbol nothing merges
        closed[np.cumsum(size)[size > 0] - 1] = True
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            key = np.full(len(sym), -1, np.int64)
            key[:-1] = sym[:-1] * self.base + sym[1:]
            key[closed] = -1
            at = np.searchsorted(self._pair, key)
            closed = self._pair[at] != key
            rank = np.where(closed, _NONE, self._rank[at])
            begins = np.flatnonzero(np.append(True, closed[:-1]))
            lengths = np.diff(np.append(begins, len(sym)))
            least = np.minimum.reduceat(rank, begins)
            leaving = np.repeat(least == _NONE, lengths)
            if leaving.any():
                done.append((sym[leaving], place[leaving]))
            merging = self._chosen(rank, at, closed, begins, np.repeat(least, lengths))
            where = np.flatnonzero(merging)
            sym[where] = self._makes[at[where]]
            closed[where] = closed[where + 1]
            keep = ~leaving
            keep[where + 1] = False
            sym, place, closed = sym[keep], place[keep], closed[keep]
        if not done:
            return np.empty(0, np.int64), size
        sym, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)  # characters are numbered through all words
        sym, place = sym[order], place[order]
        word = np.repeat(np.arange(len(words)), size)[place]
        unknown = np.flatnonzero(sym >= len(self.surface))
        if len(unknown):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[place[unknown]].tolist()]
            times = np.ones(len(sym), np.int64)
            times[unknown] = np.fromiter(map(len, raw), np.int64, len(raw))
            first = (np.cumsum(times) - times)[unknown]
            word, sym = np.repeat(word, times), np.repeat(sym, times)
            spread = np.repeat(first - np.cumsum(times[unknown]) + times[unknown], times[unknown])
            sym[spread + np.arange(len(spread))] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.bincount(word, minlength=len(words))

    def _chosen(self, rank: np.ndarray, at: np.ndarray, closed: np.ndarray, begins: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The pairs (by their left symbol) that merge in this round."""
        known = rank != _NONE
        is_least = np.flatnonzero(known & (rank == least))
        chosen = np.zeros(len(rank), bool)
        number = np.searchsorted(begins, is_least, "right")
        chosen[is_least[np.append(True, number[1:] != number[:-1])[: len(is_least)]]] = True
        over = np.where(closed, _NONE, self._over[at])
        left, right = np.append(_NONE, over[:-1]), np.append(over[1:], _NONE)
        again = np.append(False, rank[1:] == rank[:-1]) & known  # the pair before has the same rank
        safe = known & (rank <= right) & ((rank < left) | again) & self._at_once[self._makes[at]]
        # of equal pairs in a row: those before the first unsafe one, every second from the left
        index = np.arange(len(rank))
        start = np.maximum.accumulate(np.where(again, 0, index))
        unsafe = np.maximum.accumulate(np.where(safe, -1, index))
        chosen |= safe & (unsafe < start) & ((index - start) % 2 == 0)
        return chosen

    def words(self, text: str) -> list[str]:
        return self._words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> np.ndarray:
        return self.encode_words(self.words(text))[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Surface of the ids with the dummy prefix still there."""
        size = self._size[ids]
        shift = np.repeat(self._begin[ids] - (np.cumsum(size) - size), size)
        return self._flat[np.arange(len(shift)) + shift].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        raw = self.decode_bytes(np.asarray(ids, np.int64)) if len(ids) else b""
        return raw.removeprefix(b" ").decode("utf-8", "each-byte")

    def _digest(self, words: list[str]) -> list[tuple[str, int, bytes]]:
        """Of each word: its ids in decimal, their number, and the bytes that they decode to."""
        ids, count = self.encode_words(words)
        raw, decimal = self.decode_bytes(ids), [self._decimal[i] for i in ids.tolist()]
        end = np.cumsum(count)
        byte_end = np.append(0, np.cumsum(self._size[ids]))[end]
        spans = zip((end - count).tolist(), end.tolist(), np.append(0, byte_end[:-1]).tolist(), byte_end.tolist())
        return [(",".join(decimal[b:e]), e - b, raw[x:y]) for b, e, x, y in spans]

    def digest_words(self, wanted: set[str]) -> dict[str, tuple[str, int, bytes]]:
        return self._known.look_up(wanted)


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        ids = [c.encode(t or "") for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(rows, run, "doc_id long, ids array<int>")


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, texts, rows = codec(model_path), batch["text"].to_pylist(), []
        for begin, end in slices(texts):
            split = [c.words(t or "") for t in texts[begin:end]]
            known = c.digest_words(set().union(*split))
            for words in split:
                parts = [known[w] for w in words]
                decoded = b"".join([p[2] for p in parts]).removeprefix(b" ")
                decoded = decoded.decode("utf-8", "each-byte").encode()
                ids = ",".join([p[0] for p in parts]).encode()
                rows.append((sum([p[1] for p in parts]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
