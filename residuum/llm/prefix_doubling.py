"""Repeated byte strings by prefix doubling over every position, with exact ranks.

The first ranks are the bytes themselves, eight to a number. Each round sorts the
rank pairs of a position and of the one ``step`` bytes further in Spark, numbers
the runs of equal pairs anew, and drops positions whose run lies in one document:
16 bytes, then 32, then the whole length, so that no hash stands for a string.

This is the plain form, one row for each position and round, and what
:func:`residuum.llm.suffix_dedup.remove_repeats` does with ``method="doubling"``.
Its shuffles are some forty times the text, so the registered query samples
positions instead; the README has the figures of both. A run is numbered in one
task, which streams it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from residuum.llm.common import Staged, text_bytes

FIRST = 16  # bytes of the first pairs
_PAIRS = "r long, s long, doc long, at long"


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each position of each text the two numbers made of its next sixteen bytes."""
    for batch in batches:
        for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
            raw = np.frombuffer(text_bytes(text), np.uint8)
            n = len(raw) - FIRST + 1
            if n > 0:
                eight = np.zeros(len(raw) - 7, np.uint64)
                for i in range(8):
                    eight = eight << np.uint64(8) | raw[i : len(raw) - 7 + i].astype(np.uint64)
                eight = eight.view(np.int64)
                for b in range(0, n, 100_000):
                    e = min(b + 100_000, n)
                    yield _batch(r=eight[b:e], s=eight[b + 8 : e + 8], doc=np.full(e - b, doc, np.int64), at=np.arange(b, e))


def _runs(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Of pairs sorted by ``r, s, doc``: positions with their new rank; in the last round those that a smaller document has.

    Rows of a run wait while it has one document only, so no more than a document's positions do.
    """
    number = TaskContext.get().partitionId() << 40
    held = np.empty((4, 0), np.int64)
    before = None  # pair, first document and number of the run that goes on, once it has two documents
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch[c].to_numpy() for c in ("r", "s", "doc", "at")])], 1)
        if not rows.shape[1]:
            continue
        new = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(0))
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        first, end = rows[2, begin], rows[2, np.append(begin[1:], rows.shape[1]) - 1]
        ranks = number + np.arange(len(begin))
        several = first != end
        if before is not None and (rows[0, 0], rows[1, 0]) == before[:2]:
            first[0], ranks[0], several[0] = before[2], before[3], True
        number += len(begin)
        keep = several[run] & (rows[2] > first[run]) if last else several[run]
        if keep.any():
            yield _batch(doc=rows[2, keep], at=rows[3, keep], rank=ranks[run[keep]])
        at = begin[-1]
        held = rows[:, :0] if several[-1] else rows[:, at:]
        before = (rows[0, at], rows[1, at], first[-1], ranks[-1]) if several[-1] else None


def _next_pairs(step: int):
    """Of ranks sorted by ``doc, at``: the pairs of positions whose next one, ``step`` further, has a rank too."""

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, at, rank = rows
        key = np.stack([doc, at])
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
        for b, e in zip(begin, np.append(begin[1:], len(doc))):
            place = np.searchsorted(key[1, b:e], at[b:e] + step)
            there = place < e - b
            there[there] = key[1, b:e][place[there]] == at[b:e][there] + step
            if there.any():
                yield _batch(r=rank[b:e][there], s=rank[b:e][place[there]], doc=doc[b:e][there], at=at[b:e][there])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch[c].to_numpy() for c in ("doc", "at", "rank")])], 1)
            if rows.shape[1]:
                cut = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))[-1]
                yield from pairs(rows[:, :cut])
                held = rows[:, cut:]
        yield from pairs(held)

    return run


def covered_positions(docs: DataFrame, staged: Staged, length: int) -> DataFrame:
    """``doc, at`` of every string of ``length`` bytes that a document of a smaller ``doc`` has; ``docs`` is ``doc, text``."""
    if length < FIRST:
        raise ValueError(f"length must be {FIRST} or more")
    pairs, size, ranks = docs.mapInArrow(_first_pairs, _PAIRS), FIRST, None
    while True:
        last = size == length
        dealt = pairs.repartition("r", "s").sortWithinPartitions("r", "s", "doc", "at")
        found = staged.write(dealt.mapInArrow(lambda batches, last=last: _runs(batches, last), "doc long, at long, rank long"))
        if ranks is not None:
            staged.drop(ranks)
        if last:
            return found.select("doc", "at")
        step = min(size, length - size)
        pairs = found.repartition("doc").sortWithinPartitions("doc", "at").mapInArrow(_next_pairs(step), _PAIRS)
        size, ranks = size + step, found
