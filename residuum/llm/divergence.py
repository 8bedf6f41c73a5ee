"""How the sources of a language differ in their words, counted behind a sketch.

Terms are runs of letters of A-Z and of all characters beyond ASCII, A-Z in lower
case. A language keeps the terms of at least ``min_docs`` of its documents. With
add-two smoothing over the kept terms every source has a share of each term, in
whole numbers out of ``SCALE``; two shares ``p`` and ``q`` differ by
``floor((p - q)^2 / (p + q))``.

1. Each task counts the documents of its terms and adds the counts to a count-min
   sketch of fixed size; the sketches of all tasks are added. Counters stop at
   ``min_docs``. A counter is never below a term's document frequency, so a term
   with a smaller one in any row of the sketch cannot be kept.
2. A second pass counts exactly, by language, source and term, and discards
   impossible terms before anything is shuffled; rows leave a task counted.
3. Sources are compared by sparse joins: a source has a row only for terms that
   it holds. With ``z`` the share of a term that a source lacks, the sum over all kept
   terms is ``V f(z, z')``, and for every term held the difference from that. Terms
   of one source alone come from the numbers of terms by share, so only terms
   that two sources share make rows of the pair.

Null texts, languages and sources count as empty; a source without terms, or whose
language keeps none, still has its rows. Every row is a document, repeated rows and
null identifiers too (identifiers are not read). Very long texts are counted whole,
in pieces. An empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.common import Staged, text_bytes
from residuum.llm.rolling import MULTIPLIER, mix

SCALE = 1_000_000_000
_TERM = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PIECE = 1 << 20  # bytes of a text that are split at a time
_HELD = 300_000  # terms that a task holds
_PART = 1 << 16  # counters in a row of a sketch


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    raw, at = text_bytes(text).translate(_TERM), 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


@dataclass(frozen=True)
class Sketch:
    """A count-min sketch of ``depth`` rows of ``2 ** bits`` counters for terms of languages."""

    bits: int
    depth: int

    def places(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The counters of each term, by row of the sketch."""
        seed = np.uint64(crc32(text_bytes(lang)))
        # terms of one checksum share all counters, so none is below the frequency of either
        own = np.fromiter(map(crc32, words), np.uint64, len(words)) << np.uint64(32) | seed
        first = mix(own * MULTIPLIER)
        step = mix(first + MULTIPLIER)
        row = np.arange(self.depth, dtype=np.uint64)[:, None]
        mask = np.uint64((1 << self.bits) - 1)
        return ((first + row * (step | np.uint64(1))) & mask | row << np.uint64(self.bits)).astype(np.int64)

    @property
    def size(self) -> int:
        return self.depth << self.bits


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[str, str, str | None]]:
    yield from zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].to_pylist())


def _sketched(shape: Sketch, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The parts of each task's sketch of document frequencies; counters stop at ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(shape.size, np.uint32)
        held: dict[str, Counter] = {}

        def flush() -> None:
            for lang, docs in held.items():
                words, number = list(docs), np.fromiter(docs.values(), np.uint32, len(docs))
                for at in range(0, len(words), 50_000):
                    for row in shape.places(lang, words[at : at + 50_000]):
                        np.add.at(counters, row, number[at : at + 50_000])
            np.minimum(counters, most, out=counters)
            held.clear()

        for batch in batches:
            for lang, _, text in _columns(batch):
                held.setdefault(lang, Counter()).update(set().union(*terms(text)))
                if sum(map(len, held.values())) > _HELD:
                    flush()
        flush()
        for part in range(-(-shape.size // _PART)):
            block = counters[part * _PART : (part + 1) * _PART]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["part", "counters"])

    return run


def _added(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sums of sorted parts of sketches: one bit for each counter that reaches ``most``."""
    last, total = None, None

    def emit() -> pa.RecordBatch:
        bits = np.packbits(total >= most).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([bits], pa.binary())], ["part", "reached"])

    for batch in batches:
        for part, raw in zip(batch["part"].to_pylist(), batch["counters"].to_pylist()):
            block = np.frombuffer(raw, np.uint32)
            if part != last:
                if last is not None:
                    yield emit()
                last, total = part, np.zeros(len(block), np.uint32)
            total = np.minimum(total + block, most)
    if last is not None:
        yield emit()


def document_frequency_sketch(rows: DataFrame, shape: Sketch, min_docs: int) -> np.ndarray:
    """Whether each counter of the merged sketch reaches ``min_docs``, 8 to a byte."""
    parts = rows.mapInArrow(_sketched(shape, min_docs), "part int, counters binary")
    merged = parts.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: _added(b, min_docs), "part int, reached binary")
    out = np.zeros(-(-shape.size // 8), np.uint8)
    for row in merged.toLocalIterator():  # the sketch's size, whatever the corpus
        at = row["part"] * _PART // 8
        out[at : at + len(row["reached"])] = np.frombuffer(row["reached"], np.uint8)
    return out


def _counted(shape: Sketch, reached) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts by key (:func:`_parts`) of language, source and possible term; for each source met, a row with an empty term.

    ``docs`` are the documents of the language that hold the term, on one of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(reached.value).astype(bool)
        held: dict[tuple[str, str], Counter] = {}
        docs: dict[str, Counter] = {}
        met: set[tuple[str, str]] = set()
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, number in docs.items():
                words = list(number)  # each is looked up once for all sources
                possible: set[bytes] = set()
                for at in range(0, len(words), 50_000):
                    some = words[at : at + 50_000]
                    possible.update(compress(some, bits[shape.places(lang, some)].all(0).tolist()))
                for source, count in [(source, c) for (of, source), c in held.items() if of == lang]:
                    kept = [w for w in count if w in possible]
                    if kept:
                        yield frame(lang, source, kept, list(map(count.__getitem__, kept)), [number.pop(w, 0) for w in kept])
            held.clear()
            docs.clear()

        def frame(lang: str, source: str, word: list[bytes], n: list[int], number: list[int]) -> pa.RecordBatch:
            behind = b"\0%d\0" % len(lang) + text_bytes(lang) + text_bytes(source)
            keys = pa.array([w + behind for w in word], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(number, pa.int64())], ["key", "n", "docs"])

        for batch in batches:
            for lang, source, text in _columns(batch):
                if (lang, source) not in met:
                    met.add((lang, source))
                    yield frame(lang, source, [b""], [0], [0])
                count, number = held.setdefault((lang, source), Counter()), docs.setdefault(lang, Counter())
                before = len(count)
                own: set[bytes] = set()
                for some in terms(text):
                    count.update(some)
                    own.update(some)
                number.update(own)
                size += len(count) - before
                if size > _HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    return run


def _parts(counts: DataFrame) -> DataFrame:
    """``lang, source, term`` of keys, which hold the term, the length of the language, and language and source; one string groups faster than three."""
    term, size = (F.split_part("key", F.lit("\0"), F.lit(i)) for i in (1, 2))
    rest = counts.select("*", term.alias("term"), size.cast("int").alias("_size")).withColumn("_rest", F.expr("substring(key, length(term) + length(_size) + 3)"))
    return rest.select(F.expr("left(_rest, _size)").alias("lang"), F.expr("substring(_rest, _size + 1)").alias("source"), F.nullif("term", F.lit("")).alias("term"), "n", "docs")


def _share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 kept))``; decimals, as counts of large corpora times ``SCALE`` leave 64 bits."""
    whole = lambda x: (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * (whole(n) + 2)
    return F.call_function("div", top, whole(total) + 2 * whole(kept)).cast("long") + 1


def _differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    docs: DataFrame, min_docs: int = 10, top_terms: int = 10, sketch_bits: int = 20, sketch_depth: int = 4, parts: int = 32,
    lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source the others of its language (part ``pair``, most different
    first) and its ``top_terms`` most overused terms (part ``term``).

    :param sketch_bits: ``2 ** sketch_bits`` counters in each of ``sketch_depth`` rows; more discard more.
    :param parts: the sources of a language are paired in so many tasks.
    """
    staged = Staged(docs.sparkSession, "divergence")
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), docs[text_col].alias("text"))
    shape = Sketch(sketch_bits, sketch_depth)
    reached = docs.sparkSession.sparkContext.broadcast(document_frequency_sketch(rows, shape, min_docs))

    counted = rows.mapInArrow(_counted(shape, reached), "key string, n long, docs long")
    counted = staged.write(_parts(counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))))
    found = counted.filter("term IS NOT NULL")
    kept = staged.write(found.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("lang_total"))
    held = found.drop("docs").join(kept.drop("docs"), ["lang", "term"])
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "lang_total")
    absent = F.when(F.col("kept") > 0, _share(F.lit(0), "total", "kept"))
    groups = staged.write(groups.withColumn("absent", absent))
    shares = held.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "kept"))
    shares = staged.write(shares.select("lang", "source", "term", "p", "absent", _share("of_lang", "lang_total", "kept").alias("q")))

    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _differ(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top_terms)
    pair = _pairs(shares, groups, parts).withColumn("rank", F.row_number().over(first))
    return pair.unionByName(over)


def _pairs(shares: DataFrame, groups: DataFrame, parts: int) -> DataFrame:
    """``lang, source, part, item, value`` for every ordered pair of sources of a language."""
    p, z, other_p, other_z = (F.col(c) for c in ("p", "absent", "other_p", "other_absent"))
    of_other = lambda df, *more: df.select("lang", F.col("source").alias("other"), *more)

    number = F.pmod(F.xxhash64("source"), F.lit(parts))
    left = groups.select("lang", "source", "absent", "kept", number.alias("part_of"))
    right = of_other(groups, z.alias("other_absent"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part_of"))
    pairs = left.join(right, ["lang", "part_of"]).filter("source <> other").drop("part_of")

    by_share = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    alone = pairs.filter("kept > 0").join(by_share, ["lang", "source"]).groupBy("lang", "source", "other")
    alone = alone.agg(F.sum(F.col("m") * (_differ(p, other_z) - _differ(z, other_z))).alias("alone"))

    partner = of_other(shares, "term", p.alias("other_p"), z.alias("other_absent"))
    both = shares.join(partner, ["lang", "term"]).filter("source < other").groupBy("lang", "source", "other")
    both = both.agg(F.sum(_differ(p, other_p) - _differ(p, other_z) - _differ(z, other_p)).alias("held"), F.count("*").alias("m"), F.first("absent").alias("absent"), F.first("other_absent").alias("other_absent"))
    both = both.select("lang", "source", "other", (F.col("held") + F.col("m") * _differ(z, other_z)).alias("both"))

    swap = lambda df, c: df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), c)
    more = alone.unionByName(swap(alone, "alone")).withColumnRenamed("alone", "more")
    more = more.unionByName(both.unionByName(swap(both, "both")).withColumnRenamed("both", "more"))
    more = more.groupBy("lang", "source", "other").agg(F.sum("more").alias("more"))
    none = F.coalesce(F.col("kept") * _differ(z, other_z), F.lit(0))
    summed = pairs.join(more, ["lang", "source", "other"], "left")
    return summed.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (none + F.coalesce("more", F.lit(0))).alias("value"))
