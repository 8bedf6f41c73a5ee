"""Packing of token sequences by non-negative least squares.

Documents are cut into full windows and one remainder. The histogram of piece
lengths (in steps of ``window / bins``, so of a fixed size) goes to the driver;
there every combination of up to ``depth`` lengths that fills a window is listed
and non-negative least squares gives how often each is repeated. The counts are
rounded down and kept within the histogram. Each piece then finds its sequence
from its number among the pieces of equal length, a prefix sum over partitions;
no length's pieces are gathered in one place. Pieces left over are dealt into
groups of bounded size and packed best-fit-decreasing in each.

Null text counts as empty: one piece holding the end id. Very long texts are cut
into windows and never dropped. Null identifiers and repeated rows are packed like
others, and dealt over the groups like others; an empty table gives no sequences;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.common import Staged, slices
from residuum.llm.word_tokens import word_tokenizer

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, part long, nth long"


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, window: int, bins: int, end_id: int, id_col: str, text_col: str
) -> DataFrame:
    """Pieces of at most ``window`` tokens, numbered within partition and length bin."""
    step = window // bins

    def run(batches):
        seen = np.zeros(bins + 1, np.int64)
        part = TaskContext.get().partitionId()
        tok = word_tokenizer(tokenizer_path, end_id)
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            rows = []
            for begin, end in slices(texts, 1_000_000):
                for doc_id, raw in zip(ids[begin:end], tok.encode(texts[begin:end])):
                    total = len(raw) // 4
                    for start in range(0, total, window):
                        piece = raw[4 * start : 4 * (start + window)]
                        length = len(piece) // 4
                        b = -(-length // step)
                        rows.append((doc_id, start, length, zlib.crc32(piece), total, b, part, int(seen[b])))
                        seen[b] += 1
            if rows:
                kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 2
                names = [c.split()[0] for c in _PIECE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        tok.clear()

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, _PIECE)


@lru_cache(maxsize=4)
def combinations(bins: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """Ascending tuples of up to ``depth`` bins whose sum is ``bins``."""

    def grow(left: int, least: int, more: int):
        yield (left,)
        if more > 1:
            for b in range(least, left // 2 + 1):
                for rest in grow(left - b, b, more - 1):
                    yield (b, *rest)

    return tuple(c for c in grow(bins, 1, depth))


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, max_rounds: int = 2000) -> np.ndarray:
    """Active-set solution of ``min |ax - b|`` with ``x >= 0``."""
    goal = a.T @ b
    x = np.zeros(a.shape[1])
    active = np.empty(0, np.int64)
    scale = np.abs(goal).max(initial=1.0)
    for _ in range(max_rounds):
        slope = goal - a.T @ (a[:, active] @ x[active])
        slope[active] = -1
        j = int(np.argmax(slope))
        if slope[j] <= 1e-6 * scale or len(active) >= a.shape[0]:
            break
        active = np.append(active, j)
        while len(active):
            chosen = a[:, active]
            inner = chosen.T @ chosen + 1e-10 * np.eye(len(active))
            trial = np.linalg.solve(inner, goal[active])
            if (trial > 1e-9).all():
                x[active] = trial
                break
            now = x[active]
            low = trial <= 1e-9
            step = np.min(now[low] / np.maximum(now[low] - trial[low], 1e-300))
            x[active] = now + step * (trial - now)
            gone = x[active] <= 1e-9
            x[active[gone]] = 0
            active = active[~gone]
    return x


def plan_repeats(histogram: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and whole repeat counts that use no more pieces than there are."""
    bins = len(histogram) - 1
    combos = combinations(bins, depth)
    a = np.zeros((bins, len(combos)))
    for j, combo in enumerate(combos):
        for b in combo:
            a[b - 1, j] += 1
    left = histogram[1:].astype(np.int64).copy()
    weight = np.sqrt(np.arange(1, bins + 1) / bins)[:, None]  # a missed long piece costs more
    x = nonnegative_least_squares(a * weight, histogram[1:] * weight[:, 0])
    plan = []
    for j in np.argsort(-x, kind="stable"):
        repeats = int(min(np.floor(x[j] + 1e-6), *(left[b - 1] // combos[j].count(b) for b in set(combos[j]))))
        if repeats > 0:
            plan.append((combos[j], repeats))
            for b in combos[j]:
                left[b - 1] -= repeats
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]], bins: int):
    """For each bin the slots in order: first number, first sequence, place in the sequence."""
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(bins + 1)]
    used, first = [0] * (bins + 1), 0
    for combo, repeats in plan:
        for place, b in enumerate(sorted(combo, reverse=True)):
            slots[b].append((used[b], first, place))
            used[b] += repeats
        first += repeats
    return slots, used, first


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[tuple[int, int]] = []
    count = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect_left(room, (size, -1))
        left, k = room.pop(at) if at < len(room) else (window, count)
        count += k == count
        number[i], offset[i] = k, window - left
        if left > size:
            insort(room, (left - size, k))
    return number, offset


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    bins: int = 256,
    depth: int = 3,
    end_id: int = 1,
    group_pieces: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` there.

    :param bins: length classes; ``window`` must be a multiple.
    :param depth: pieces of a listed combination at most.
    :param group_pieces: about so many left-over pieces are packed in one task.
    """
    if window % bins:
        raise ValueError("window must be a multiple of bins")
    staged = Staged(docs.sparkSession, "packing")
    pieces = staged.write(cut_pieces(docs, tokenizer_path, window, bins, end_id, id_col, text_col))
    counts = pieces.groupBy("bin", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(bins + 1, np.int64)
    for row in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most ``bins`` rows
        histogram[row["bin"]] = row["n"]
    slots, used, sequences = _slots(plan_repeats(histogram, depth), bins)
    groups = -(-int((histogram - np.array(used)).sum()) // group_pieces)

    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(offsets, ["bin", "part"]).withColumn("number", F.col("base") + F.col("nth"))

    starts = [np.array([s[0] for s in x], np.int64) for x in slots]
    firsts = [np.array([s[1] for s in x], np.int64) for x in slots]
    places = [np.array([s[2] for s in x], np.int64) for x in slots]

    def place(frames):
        for pdf in frames:
            sequence, slot = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64)
            bin_, number = pdf["bin"].to_numpy(), pdf["number"].to_numpy()
            for b in np.unique(bin_):
                if used[b]:
                    rows = np.flatnonzero((bin_ == b) & (number < used[b]))
                    k = np.searchsorted(starts[b], number[rows], "right") - 1
                    sequence[rows] = firsts[b][k] + number[rows] - starts[b][k]
                    slot[rows] = places[b][k]
            yield pdf[columns].assign(sequence_id=sequence, slot=slot, turn=pdf["part"] * 7919 + pdf["nth"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kinds = ", ".join(f"{c} long" for c in columns)
    placed = staged.write(numbered.mapInPandas(place, f"{kinds}, sequence_id long, slot long, turn long"))
    staged.drop(pieces)
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    filled = placed.filter("sequence_id >= 0").select(
        *columns, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    )
    if not groups:
        return filled

    def pack_rest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        number, offset = best_fit_decreasing(pdf["length"].to_numpy(), window)
        return pdf[columns].assign(sequence_id=sequences + (int(key[0]) << 32) + number, offset=offset)

    rest = placed.filter("sequence_id < 0").withColumn(
        "deal", F.pmod(F.xxhash64("turn", "length"), F.lit(groups))  # equal rows have unequal turns
    )
    return filled.unionByName(rest.groupBy("deal").applyInPandas(pack_rest, f"{kinds}, sequence_id long, offset long"))
