"""Token ids as packed matrices, by best-fit-decreasing with a segment tree.

Each task fills windows from the texts of its own partition, in groups of about
``group_tokens`` tokens, so nothing is shuffled and memory is bounded. Texts
longer than a window are split without loss. Pieces are placed from the longest;
a segment tree over the remaining capacities finds the fullest open window that
still holds a piece in ``log2(window)`` steps.

Every window gives a row of exactly ``window`` ids (``pad_id`` behind the last
segment), its cumulative segment lengths (from 0) and positions that restart at
each segment. Ids and positions are little-endian unsigned numbers of 16 bits
where the vocabulary and the window allow it, else of 32. :func:`write_packed`
writes the rows as Parquet; the registered query digests what it has written and
read back. Null text counts as empty and gives its end id; very long texts are cut,
never dropped; repeated rows and null identifiers are written like others; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import Staged, slices
from residuum.llm.word_tokens import word_tokenizer

_ROWS = (
    "row_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, "
    "ids binary, positions binary"
)


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the least one that suffices."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def at_least(self, capacity: int) -> int | None:
        node = capacity + self.leaves
        if self.count[node]:
            return capacity
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def fill_windows(lengths: list[int], window: int) -> list[list[int]]:
    """Pieces of each window, best-fit-decreasing."""
    tree, windows = CapacityTree(window), []
    open_: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        room = tree.at_least(size)
        if room is None:
            windows.append([])
            k, room = len(windows) - 1, window
        else:
            k = open_[room].pop()
            tree.add(room, -1)
        windows[k].append(i)
        if room > size:
            open_.setdefault(room - size, []).append(k)
            tree.add(room - size, 1)
    return windows


def id_type(tokenizer_path: str, *others: int) -> str:
    """The type of the packed ids: 16 bits if the vocabulary and ``others`` fit, else 32."""
    from tokenizers import Tokenizer

    most = max([Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), *others])
    return "<u2" if most <= 1 << 16 else "<u4"


def position_type(window: int) -> str:
    return "<u2" if window <= 1 << 16 else "<u4"


def _windows(tokenizer_path: str, window: int, end_id: int, pad_id: int, group_tokens: int, kind: str):
    """The work of a task: Arrow batches of texts to Arrow batches of windows."""

    count, padding = np.arange(window, dtype=position_type(window)).tobytes(), np.full(window, pad_id, "<u4").tobytes()
    size = np.dtype(position_type(window)).itemsize

    def emit(pieces: list[tuple], first: int) -> pa.RecordBatch:
        rows = []
        for members in fill_windows([len(p[2]) // 4 for p in pieces], window):
            parts = [pieces[i] for i in members]
            lengths = [len(p[2]) // 4 for p in parts]
            pad = window - sum(lengths)
            ids = np.frombuffer(b"".join([p[2] for p in parts]) + padding[: 4 * pad], "<u4").astype(kind).tobytes()
            positions = b"".join([count[: size * n] for n in [*lengths, pad]])
            ends = [0, *accumulate(lengths)]
            rows.append((first + len(rows), [p[0] for p in parts], [p[1] for p in parts], ends, ids, positions))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = ["row_id", "doc_ids", "starts", "cu_seqlens", "ids", "positions"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        tok = word_tokenizer(tokenizer_path, end_id)
        first, held, pieces = TaskContext.get().partitionId() << 33, 0, []
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            for begin, end in slices(texts, 1_000_000):
                for doc_id, raw in zip(ids[begin:end], tok.encode(texts[begin:end])):
                    held += len(raw) // 4
                    pieces += [(doc_id, at // 4, raw[at : at + 4 * window]) for at in range(0, len(raw), 4 * window)]
                if held >= group_tokens:
                    out = emit(pieces, first)
                    first, held, pieces = first + out.num_rows, 0, []
                    yield out
        if pieces:
            yield emit(pieces, first)
        tok.clear()

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def pack_ids(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    group_tokens: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per window: ``row_id``, segments, ids (as :func:`id_type`) and positions (as :func:`position_type`)."""
    run = _windows(tokenizer_path, window, end_id, pad_id, group_tokens, id_type(tokenizer_path, end_id + 1, pad_id + 1))
    return _source(docs, id_col, text_col).mapInArrow(run, _ROWS)


def write_packed(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Write the windows as a Parquet table whose ``ids`` column is the packed matrix, row by row."""
    # rows are a few kilobytes wide, so small row groups lose nothing and hold little memory
    pack_ids(docs, tokenizer_path, **options).write.option("parquet.block.size", 16 << 20).parquet(path)


def read_matrix(packed: DataFrame, kind: str, window: int = 2048):
    """Pairs of row id and row of the id matrix of a packed table, as numpy arrays.

    For a reader on one machine: partitions stream through the driver one at a time.
    """
    for row in packed.select("row_id", "ids").toLocalIterator(prefetchPartitions=False):
        yield row["row_id"], np.frombuffer(row["ids"], kind).reshape(window)


_DIGESTS = "row_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids_crc32 long, positions_crc32 long"


def _digest(batches):
    for b in batches:
        crc = [pa.array([zlib.crc32(x.as_buffer()) for x in b[c]], pa.int64()) for c in ("ids", "positions")]
        names = [c.split()[0] for c in _DIGESTS.split(", ")]
        yield pa.RecordBatch.from_arrays([b["row_id"], b["doc_ids"], b["starts"], b["cu_seqlens"], *crc], names)


def digests(packed: DataFrame) -> DataFrame:
    """The windows with the two matrices replaced by their CRC-32."""
    return packed.mapInArrow(_digest, _DIGESTS).withColumn("n_tokens", F.element_at("cu_seqlens", -1).cast("long"))


def written_digests(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """:func:`digests` of the table that :func:`write_packed` left in the shared folder."""
    path = f"{Staged(docs.sparkSession, 'token-ids').root}/packed"
    write_packed(docs, path, tokenizer_path, **options)
    return digests(docs.sparkSession.read.parquet(path))
