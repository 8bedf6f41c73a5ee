"""Removal of long repeated byte strings by prefix doubling at sampled positions.

A string of ``length`` bytes is judged by the ranks of its prefixes at growing
lengths. Positions are sampled by content: of the ``GRAM``-byte grams inside a
string the one with the least hash is its anchor, so equal strings have equal
anchors, and any string has one. Every round sorts rows in Spark by rank pairs,
makes new ranks from the runs of equal pairs, and drops positions that are
unique to a document or settled:

1. Grams at the anchors. An anchor whose gram occurs in one document only cannot
   begin or hold a repeat and leaves.
2. Spans: all strings that share an anchor lie side by side, and together make a
   span of ``length`` bytes or more. Rows are sorted by (rank of the gram, rank of
   the span). Of equal spans all but those of the smallest document are past the
   threshold and covered. A span that is the only one of its gram leaves.
3. Single strings of the spans still open, sorted by (rank of the string, rank of
   the gram, document). Strings that a smaller document has are covered.

Ranks are 64-bit hashes, and rows are equal only if both ranks of a pair are.
Before each shuffle a task settles what its own rows show, so a string that a
third of all documents share reaches a later task as one row per earlier task.

Null text is empty. Rows without an identifier, and rows that repeat one, come
after all other documents in an order of their hash, each with its own text; rows
repeated entire are one document and get the same result. Long texts are hashed in overlapping
pieces, so memory grows by little more than a text itself. An empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import NO_ID, Staged, keyed, text_bytes
from residuum.llm.prefix_doubling import covered_positions
from residuum.llm.rolling import Rolling

GRAM = 24
_LOW = (1 << 31) - 1
_PLACE = np.uint64((1 << 20) - 1)
_PIECE = (1 << 20) - 256  # strings of a text that are hashed at a time
_CHUNK = 800_000  # rows that a task settles among themselves before it passes them on


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors(raw: bytes, length: int) -> tuple[Rolling, np.ndarray, np.ndarray]:
    """Hash sums, the gram hashes, and for each string of ``length`` bytes its anchor (the leftmost of the least grams by 44 bits).

    ``raw`` is shorter than 2 ** 20 bytes, so that a number holds the bits of a gram above its place.
    """
    rolling = Rolling(raw)
    grams = rolling.windows(GRAM)
    least = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)
    width = length - GRAM + 1
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return rolling, grams, (least & _PLACE).astype(np.int32)


def pieces(raw: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a text with their places, which overlap so that each string of ``length`` bytes lies whole in the part that it begins in.

    Strings that share an anchor over a border give two spans; such spans differ from whole ones and are
    settled string by string.
    """
    for at in range(0, max(1, len(raw) - length + 1), _PIECE):
        yield at, raw[at : at + _PIECE + length - 1] if len(raw) > _PIECE else raw


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spread(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def _chunks(rows: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for columns in rows:
        held.append(columns)
        size += len(columns[0])
        if size >= _CHUNK:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def _gram_rows(length: int):
    """Of texts: ``kind, rank, doc``; kind 0 is known to repeat, 1 asks, 2 tells that the gram repeats."""

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
                raw = text_bytes(text)
                for _, part in pieces(raw, length) if len(raw) >= length else ():
                    _, grams, place = anchors(part, length)
                    rank = np.unique(grams[place[_runs(place)]])
                    yield rank, np.full(len(rank), doc, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rank, doc in _chunks(of_texts(batches)):
            order = np.lexsort((doc, rank))
            rank, doc = rank[order], doc[order]
            at = _runs(rank)
            several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
            known = several[_spread(at, len(rank))]
            for kind, pick in ((0, np.flatnonzero(known)), (1, at[~several]), (2, at[several])):
                if len(pick):
                    yield _batch(kind=np.full(len(pick), kind, np.int32), rank=_signed(rank[pick]), doc=doc[pick])

    return run


def _columns(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([batch[c].to_numpy().astype(np.int64) for c in names])


def _dealt(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Open rows in the order of their ranks; rows that are settled lie anywhere, spread by document."""
    place = F.when(F.col("kind") == 0, F.xxhash64("doc")).otherwise(F.col(key))
    return rows.withColumn("place", place).repartition("place").drop("place").sortWithinPartitions(key, *order)


def _answer_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: the documents whose gram is in another one."""
    held = np.empty((3, 0), np.int64)
    for batch in batches:
        rows = _columns(batch, "rank", "doc", "kind")
        known = rows[2] == 0
        if known.any():
            yield _batch(doc=rows[1, known], a=rows[0, known])
        rows = np.concatenate([held, rows[:, ~known]], 1)
        if rows.shape[1]:
            # A rank has a row or two for each task and chunk before; the last one may go on.
            cut = _runs(rows[0])[-1]
            yield from _repeated(rows[:, :cut])
            held = rows[:, cut:]
    yield from _repeated(held)


def _repeated(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    if rows.shape[1]:
        rank, doc, kind = rows
        at = _runs(rank)
        several = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) | (np.maximum.reduceat(kind, at) == 2)
        pick = several[_spread(at, len(rank))] & (kind == 1)
        if pick.any():
            yield _batch(doc=doc[pick], a=rank[pick])


def _with_texts(docs: DataFrame, side: DataFrame) -> DataFrame:
    """Texts after the side rows of their document."""
    texts = docs.select("doc", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "text", F.lit(1).alias("late"))
    side = side.select("doc", "a", "b", F.lit(None).cast("string").alias("text"), F.lit(0).alias("late"))
    return texts.unionByName(side).repartition("doc").sortWithinPartitions("doc", "late")


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes, np.ndarray, np.ndarray]]:
    """Document, text and side columns ``a, b`` of each text row of :func:`_with_texts`."""
    held: list[np.ndarray] = []
    last: tuple[int | None, np.ndarray] = (None, np.empty((2, 0), np.int64))
    for batch in batches:
        rows = np.stack([batch[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("a", "b")])
        begin = 0
        for t in np.flatnonzero(batch["late"].to_numpy()):
            doc, text = batch["doc"][t].as_py(), batch["text"][t].as_py()
            side = np.concatenate([*held, rows[:, begin:t]], 1)
            if not side.shape[1] and doc == last[0]:
                side = last[1]
            held, begin, last = [], t + 1, (doc, side)
            yield doc, text_bytes(text), side[0], side[1]
        if begin < rows.shape[1]:
            held.append(rows[:, begin:])


def _span_rows(length: int):
    """Of texts with their repeated grams: ``kind, gram, span, doc, at``; kind 0 is covered, 1 open."""

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for doc, raw, repeated, _ in _each_text(batches):
            if len(raw) < length or not len(repeated):
                continue
            for begin, part in pieces(raw, length):
                rolling, grams, place = anchors(part, length)
                first = _runs(place)
                count = np.diff(np.append(first, len(place)))
                gram = grams[place[first]]
                keep = np.isin(_signed(gram), repeated)
                first, count, gram = first[keep], count[keep], gram[keep]
                span = rolling.hashes(first, first + count - 1 + length)
                yield _signed(gram), _signed(span), np.full(len(gram), doc, np.int64), (first + begin) * 64 + count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, span, doc, at in _chunks(of_texts(batches)):
            order = np.lexsort((doc, span, gram))
            gram, span, doc, at = gram[order], span[order], doc[order], at[order]
            start = _runs(gram, span)
            covered = doc > doc[start][_spread(start, len(doc))]
            yield _batch(kind=np.where(covered, 0, 1).astype(np.int32), gram=gram, span=span, doc=doc, at=at)

    return run


def _settle_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of open spans sorted by ``gram, span, doc``: ``kind, doc, a, b``; 0 covered, 1 open still (``b`` the gram).

    Of a gram with one span so far only the smallest document's rows are held.
    """
    held = np.empty((4, 0), np.int64)
    several_before = head_before = None  # of the gram that goes on: more than one span; its last span and that one's first document
    for batch in batches:
        rows = _columns(batch, "gram", "span", "doc", "at", "kind")
        known = rows[4] == 0
        if known.any():
            yield _batch(kind=np.zeros(known.sum(), np.int32), doc=rows[2, known], a=rows[3, known], b=rows[0, known])
        rows = np.concatenate([held, rows[:4, ~known]], 1)
        if not rows.shape[1]:
            continue
        gram, span, doc, at = rows
        start = _runs(gram, span)
        number = _spread(start, len(gram))
        head = doc[start]
        if head_before is not None and (gram[0], span[0]) == head_before[:2]:
            head[0] = head_before[2]
        covered = doc > head[number]
        if covered.any():
            yield _batch(kind=np.zeros(covered.sum(), np.int32), doc=doc[covered], a=at[covered], b=gram[covered])
        grams = _runs(gram)
        spans = np.bincount(_spread(grams, len(gram))[start], minlength=len(grams))
        several = spans > 1
        if several_before is not None and gram[0] == several_before[0]:
            several[0] |= several_before[1] or (gram[0], span[0]) != head_before[:2]
        row_several = several[_spread(grams, len(gram))]
        yes = ~covered & row_several
        if yes.any():
            yield _batch(kind=np.ones(yes.sum(), np.int32), doc=doc[yes], a=at[yes], b=gram[yes])
        waits = ~covered & ~row_several
        waits[: grams[-1]] = False  # grams that ended with one span have left
        held = rows[:, waits]
        several_before = (gram[-1], bool(several[-1]))
        head_before = (gram[-1], span[-1], head[-1])


def _string_rows(length: int):
    """Of texts with their open spans: ``string, doc, pack`` of each string.

    ``pack`` holds 31 bits of the gram's rank, the start (31 bits, as no text of
    Spark's is longer) and the kind, in that order, so that the shuffle carries three numbers a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, ...]]:
            for doc, raw, at, gram in _each_text(batches):
                if len(at) and len(raw) >= length:
                    first, count = at // 64, at % 64
                    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    starts = np.repeat(first, count) + inner
                    gram = np.repeat(gram, count)
                    for begin, part in pieces(raw, length):
                        own = np.flatnonzero((starts >= begin) & (starts < begin + _PIECE)) if len(raw) > _PIECE else slice(None)
                        inside = starts[own] - begin
                        if len(inside):
                            string = Rolling(part).hashes(inside, inside + length)
                            yield _signed(string), gram[own], np.full(len(inside), doc, np.int64), starts[own]

        for string, gram, doc, at in _chunks(rows()):
            order = np.lexsort((doc, gram, string))
            string, gram, doc, at = string[order], gram[order], doc[order], at[order]
            start = _runs(string, gram)
            covered = doc > doc[start][_spread(start, len(doc))]
            yield _batch(string=string, doc=doc, pack=(gram & _LOW) << 32 | at << 1 | ~covered)

    return run


def _settle_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of strings sorted by ``string, gram, doc``: those that a smaller document has."""
    before = None
    for batch in batches:
        rows = _columns(batch, "string", "doc", "pack")
        known = rows[2] & 1 == 0
        start = rows[2] >> 1 & _LOW
        if known.any():
            yield _batch(doc=rows[1, known], a=start[known] * 64 + 1)
        string, doc, gram = rows[0, ~known], rows[1, ~known], rows[2, ~known] >> 32
        at = start[~known]
        if not len(doc):
            continue
        start = _runs(string, gram)
        head = doc[start].copy()
        if before is not None and (string[0], gram[0]) == before[:2]:
            head[0] = before[2]
        before = (string[-1], gram[-1], head[-1])
        covered = doc > head[_spread(start, len(doc))]
        if covered.any():
            yield _batch(doc=doc[covered], a=at[covered] * 64 + 1)


def removed_runs(at: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs ``(start, end)`` covered by ``count`` strings from ``first`` on, given as ``first * 64 + count``."""
    if not len(at):
        return np.empty((0, 2), np.int64)
    first, end = at // 64, at // 64 + at % 64 - 1 + length
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.append(True, first[1:] > end[:-1])
    begin = np.flatnonzero(new)
    return np.stack([first[begin], end[np.append(begin[1:], len(end)) - 1]], 1)


def covered_strings(docs: DataFrame, staged: Staged, length: int) -> list[DataFrame]:
    """Tables ``doc, a`` of covered strings, ``a`` being ``first * 64 + count``."""
    known = docs.filter(F.octet_length("text") >= length)
    grams = known.mapInArrow(_gram_rows(length), "kind int, rank long, doc long")
    repeated = staged.write(_dealt(grams, "rank").mapInArrow(_answer_grams, "doc long, a long").withColumn("b", F.lit(0).cast("long")))

    spans = _with_texts(known, repeated).mapInArrow(_span_rows(length), "kind int, gram long, span long, doc long, at long")
    settled = staged.write(_dealt(spans, "gram", "span", "doc").mapInArrow(_settle_spans, "kind int, doc long, a long, b long"))
    staged.drop(repeated)

    opened = settled.filter("kind = 1").select("doc", "a", "b")
    strings = _with_texts(known, opened).mapInArrow(_string_rows(length), "string long, doc long, pack long")
    place = F.when(F.col("pack") % 2 == 0, F.xxhash64("doc")).otherwise(F.col("string"))
    dealt = strings.repartition(place).sortWithinPartitions("string", F.shiftright("pack", 32), "doc")
    late = staged.write(dealt.mapInArrow(_settle_strings, "doc long, a long"))
    return [settled.filter("kind = 0").select("doc", "a"), late]


def remove_repeats(
    docs: DataFrame,
    finish: Callable[[bytes, np.ndarray], tuple],
    schema: str,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    method: str = "anchors",
) -> DataFrame:
    """``doc_id`` and what ``finish(text, removed runs)`` gives for every document, columns of ``schema``.

    :param method: ``anchors`` as above, or ``doubling`` over all positions (:mod:`residuum.llm.prefix_doubling`).
    """
    if method == "anchors" and not GRAM < length <= GRAM + 62:
        raise ValueError(f"length must be from {GRAM + 1} to {GRAM + 62}")
    staged = Staged(docs.sparkSession, "suffix-dedup")
    rows, odd = keyed(docs, id_col, text_col, staged)
    rows = rows.withColumnRenamed("doc_id", "doc")
    texts = rows.select("doc", "text")
    if odd:  # only keys made from hashes stand for several rows
        texts = texts.filter(F.col("doc") < NO_ID).unionByName(texts.filter(F.col("doc") >= NO_ID).dropDuplicates(["doc"]))
    if method == "doubling":
        side = covered_positions(texts, staged, length).select("doc", (F.col("at") * 64 + 1).alias("a"))
    else:
        parts = covered_strings(texts, staged, length)
        side = parts[0].unionByName(parts[1])
    side = side.withColumn("b", F.lit(0).cast("long"))
    schema = f"doc long, {schema}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for doc, raw, at, _ in _each_text(batches):
            held.append((doc, *finish(raw, removed_runs(at, length))))
            weight += 1000 + len(raw)
            if weight > 8_000_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=arrow)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=arrow)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    done = _with_texts(texts, side).mapInArrow(run, schema)
    if not odd:
        return done.withColumnRenamed("doc", "doc_id")
    return rows.select("doc", "own").join(done, "doc").select(F.col("own").alias("doc_id"), *names[1:])


def kept_parts(raw: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(raw)]
    return b"".join(raw[b:e] for b, e in zip(edges[::2], edges[1::2]))


def deduplicate(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept`` with the bytes that remain (a cut may fall inside a character)."""
    finish = lambda raw, runs: (kept_parts(raw, runs),)
    return remove_repeats(docs, finish, "kept binary", length, id_col, text_col)


def removal_digests(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", method: str = "anchors"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each document."""

    def finish(raw: bytes, runs: np.ndarray) -> tuple:
        removed = int((runs[:, 1] - runs[:, 0]).sum())
        return len(raw), removed, len(runs), hashlib.sha256(kept_parts(raw, runs)).hexdigest()

    return remove_repeats(docs, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, id_col, text_col, method)
