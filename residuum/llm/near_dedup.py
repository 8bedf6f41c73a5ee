"""Near-duplicate groups from bottom-k sketches of one hash function.

A document is the set of its word shingles, hashed once to 64 bits from sums
over the words' bytes and places; links are confirmed on sets of other 64-bit hashes. All hashes have one order: first by
how common they are (a class from a counting sketch of fixed size over the whole
corpus), then by the hash. A document retains its bottom ``k`` values, where ``k``
follows its size ``n``: ``n - ceil(t n) + 1`` for similarity ``t``. Two sets that are similar enough always share a retained value,
so the sketches lose no link; common shingles are retained only by documents
made of little else, so the inverted lists stay short.

1. Equal sets are merged by digest; one stands for all.
2. A short inverted list gives its pairs, a long one pairs each member with the
   first. Pairs must pass size and position bounds, and a bound from bucket counts
   of the sets.
3. The union of the two sketches bounds the difference of the sets; pairs within
   it are verified on full sets. Verified links form groups.
4. Long lists with the same first member are taken together. Their members that lie in
   different groups are compared in blocks (many members over many tasks); only
   pairs that pass the bounds of sizes and buckets leave the task.
5. The groups are the components of all verified links.

All bounds are lossless, so the result equals that of comparing all pairs. Null
and empty texts, and texts without words, have no shingles and stand alone. Rows
without an identifier, and rows that repeat one with another text, are documents of
their own: a group is named by the smallest identifier in it, by null if it has
none, and just one text of it is kept. Rows repeated entire are one document, of
which :func:`keep_one` leaves one row. Very long texts are hashed whole. Extra
columns are ignored by :func:`near_groups` and kept by :func:`keep_one`, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import Staged, keyed, one_of_each, releasing, slices, text_bytes, without
from residuum.llm.components import components
from residuum.llm.rolling import MULTIPLIER, mix

_PART = 4096  # counters in a row of the counting sketch
_BUCKETS = 512
_CLIP = 10_000  # documents after which counters are cut to 255, before any can overflow
_SHORT = 16  # a list of so many documents gives its pairs itself


_PIECE = 1 << 20  # bytes hashed at a time
_NEAR = 64  # places in a word whose values are in a table
_BLANK = re.compile(rb"[ \t\n\v\f\r]")
_WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _values(place: np.ndarray, byte: np.ndarray, lane: int) -> np.ndarray:
    """A pseudo-random number for each byte at its place in a word."""
    return mix((place.astype(np.uint64) << np.uint64(9) | byte.astype(np.uint64) << np.uint64(1) | np.uint64(lane)) * MULTIPLIER + MULTIPLIER)


_TABLES = [_values(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256), _NEAR), lane) for lane in range(2)]


def _sums(byte: np.ndarray, place: np.ndarray, begin: np.ndarray, lane: int) -> np.ndarray:
    far = np.flatnonzero(place >= _NEAR)
    values = _TABLES[lane][(np.minimum(place, _NEAR - 1) << 8) + byte]
    values[far] = _values(place[far], byte[far], lane)
    return np.add.reduceat(values, begin)


def _word_hashes(raw: bytes, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for every word of ``raw``, others in each lane, and the words' first bytes.

    A word's hash is the mixed sum of numbers that are random in byte and place, so it has no
    algebra by which texts of one pattern could collide, and the bytes of a word add up in any pieces.
    """
    hashes, firsts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + _PIECE) if at + _PIECE < len(raw) else None
        end = cut.start() if cut else len(raw)
        edge = np.diff(np.r_[np.int8(0), (~_WHITE[np.frombuffer(raw, np.uint8, end - at, at)]).astype(np.int8), np.int8(0)])
        starts, sizes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        if len(starts):
            total = np.zeros(len(starts), np.uint64)
            upto = np.cumsum(sizes)
            for b in range(0, int(upto[-1]), 2 * _PIECE):  # one turn, but for a word of more than a piece
                e = min(int(upto[-1]), b + 2 * _PIECE)
                low, high = np.searchsorted(upto, b, "right"), np.searchsorted(upto, e - 1, "right") + 1
                before = upto[low:high] - sizes[low:high]
                here = np.minimum(upto[low:high], e) - np.maximum(before, b)
                place = np.arange(b, e) - np.repeat(before, here)
                byte = np.frombuffer(raw, np.uint8)[at + np.repeat(starts[low:high], here) + place]
                total[low:high] += _sums(byte.astype(np.int64), place, np.cumsum(here) - here, lane)
            hashes.append(mix(total))
            firsts.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(firsts)


def shingle_sets(texts: list[str | None], size: int, limit: int = 500_000, lane: int = 0) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``size``-word shingles."""
    for begin, end in slices(texts, limit):
        raws = [text_bytes(t).lower() for t in texts[begin:end]]
        h, starts = _word_hashes(b" ".join(raws), lane)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
        joined = _chained(h, size)
        for b, e in zip(bounds[:-1], bounds[1:]):
            if e - b >= size:
                yield np.unique(joined[b : e - size + 1])
            else:  # too few words: all of them are one shingle
                yield _chained(h[b:e], e - b) if e > b else h[:0]


def _chained(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words in a row."""
    n = max(0, len(h) - size + 1)
    joined = h[:n].copy()
    for i in range(1, size):
        joined = mix(joined * MULTIPLIER + h[i : i + n])
    return mix(joined)


def shingles(text: str | None, size: int) -> np.ndarray:
    return next(shingle_sets([text], size))


def _survey(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """One row per document (``n``, ``digest``, bucket counts) and the parts of each task's counting sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, since = np.zeros(1 << bits, np.uint16), 0  # 255 stands for more
        names = ["doc_id", "own", "n", "digest", "buckets", "part", "counts"]
        empty = lambda n, kind: pa.nulls(n, kind)
        for batch in batches:
            ns, digests, buckets = [], [], []
            for s in shingle_sets(batch["text"].to_pylist(), size):
                np.add.at(counts, (s & np.uint64((1 << bits) - 1)).astype(np.int64), np.uint16(1))
                since += 1
                if since == _CLIP:
                    np.minimum(counts, 255, out=counts)
                    since = 0
                ns.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                held = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=_BUCKETS)
                buckets.append(np.minimum(held, 255).astype(np.uint8).tobytes())
            n = len(ns)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["own"], pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(buckets, pa.binary()),
                 empty(n, pa.int32()), empty(n, pa.binary())], names)
        some = 256  # parts in a batch
        for begin in range(0, len(counts) // _PART, some):
            held = {p: counts[p * _PART : (p + 1) * _PART] for p in range(begin, min(begin + some, len(counts) // _PART))}
            blocks = {p: np.minimum(c, 255).astype(np.uint8).tobytes() for p, c in held.items() if c.any()}  # what is common stays common
            n = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [empty(n, pa.int64()), empty(n, pa.int64()), empty(n, pa.int64()), empty(n, pa.binary()), empty(n, pa.binary()),
                 pa.array(list(blocks), pa.int32()), pa.array(list(blocks.values()), pa.binary())], names)

    return docs.mapInArrow(releasing(run), "doc_id long, own long, n long, digest binary, buckets binary, part int, counts binary")


def _classes(survey: DataFrame, bits: int) -> np.ndarray:
    """For each counter the class of its count: the number of its binary digits."""

    def kinds(part: int, total: np.ndarray) -> pa.RecordBatch:
        kind = np.ceil(np.log2(total.astype(float) + 1)).astype(np.uint8).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.binary())], ["part", "classes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(_PART, np.uint64)  # of one part, as they come in order
        for batch in batches:
            for part, block in zip(batch["part"].to_pylist(), batch["counts"].to_pylist()):
                if part != last:
                    if last is not None:
                        yield kinds(last, total)
                    last, total = part, np.zeros(_PART, np.uint64)
                total += np.frombuffer(block, np.uint8)
        if last is not None:
            yield kinds(last, total)

    parts = survey.filter("part IS NOT NULL").select("part", "counts").repartition("part").sortWithinPartitions("part")
    parts = parts.mapInArrow(releasing(add), "part int, classes binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in parts.collect():  # at most 2 ** bits bytes
        out[row["part"] * _PART : (row["part"] + 1) * _PART] = np.frombuffer(row["classes"], np.uint8)
    return out


def ordered(values: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The shingles in the order common to all documents, as positive 63-bit values."""
    kind = classes[(values & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((kind << np.uint64(57)) | (values >> np.uint64(7))).astype(np.int64)


def retained(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _near(na, nb, percent: int):
    """Sizes allow the similarity."""
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def _room(na, nb, pa_, pb, percent: int):
    """The positions of a shared value allow the overlap."""
    most = np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)
    return most * (100 + percent) >= percent * (na + nb)


def _list_rows(percent: int):
    """Of sorted postings: pairs that pass the bounds of size and position (kind 0), members of long lists (kind 1).

    A list of up to ``_SHORT`` documents gives its own pairs; of a longer one each
    member is paired with the first and listed under it.
    """

    def frame(kind: int, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def pairs(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = (x[1] != y[1]) & _near(x[2], y[2], percent)
        x, y = x[:, keep], y[:, keep]
        keep = _room(x[2], y[2], x[3], y[3], percent)
        if keep.any():
            yield frame(0, np.minimum(x[1], y[1])[keep], np.maximum(x[1], y[1])[keep])

    def short(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for gap in range(1, _SHORT):
            same = np.flatnonzero(rows[0, gap:] == rows[0, :-gap])
            if not len(same):
                return
            yield from pairs(rows[:, same], rows[:, same + gap])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), np.int64)  # the last list, while it is short
        hub = None  # the first row of the last list, once it is long
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch[c].to_numpy() for c in ("value", "doc_id", "n", "pos")])], 1)
            if not rows.shape[1]:
                continue
            begin = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
            size = np.diff(np.r_[begin, rows.shape[1]])
            first = rows[:, begin]
            long = size > _SHORT
            if hub is not None and hub[0] == rows[0, 0]:
                first[:, 0], long[0] = hub, True
            waits = not long[-1]
            held = rows[:, begin[-1] :] if waits else rows[:, :0]
            hub = None if waits else first[:, -1].copy()
            in_long = np.repeat(long, size)
            done = ~in_long
            done[begin[-1] :] = False
            yield from short(rows[:, done])
            if in_long.any():
                own = np.repeat(first, size, axis=1)[:, in_long]
                yield from pairs(own, rows[:, in_long])
                yield frame(1, own[1], rows[1, in_long])
        yield from short(held)

    return run


def _block_pairs(percent: int, step: int = 64):
    """Pairs of a block that lie in different groups and pass the bounds of sizes and buckets.

    A block has the members of two parts of a hub's lists (or of one); pairs are
    taken between the parts.
    """

    def compare(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(rows["n"], kind="stable")
        ids, root, n, part = (rows[c][order] for c in ("doc_id", "root", "n", "own"))
        counts = np.stack([np.frombuffer(rows["buckets"][i], np.uint8) for i in order]).astype(np.int16)
        apart = len(np.unique(part)) > 1
        names, number, size = np.unique(root, return_inverse=True, return_counts=True)
        small = np.flatnonzero(number != size.argmax())
        for at in range(0, len(small), step):
            left = small[at : at + step]
            low, high = np.searchsorted(n, [-(-percent * n[left[0]] // 100), 100 * n[left[-1]] // percent + 1])
            i, j = np.meshgrid(left, np.arange(low, high), indexing="ij")
            i, j = i.ravel(), j.ravel()
            keep = (number[i] != number[j]) & _near(n[i], n[j], percent)
            keep &= (number[j] == size.argmax()) | (ids[i] < ids[j])  # once if both are on the left side
            if apart:
                keep &= part[i] != part[j]
            i, j = i[keep], j[keep]
            for b in range(0, len(i), 20_000):
                x, y = i[b : b + 20_000], j[b : b + 20_000]
                gap = np.abs(counts[x] - counts[y]).sum(1, dtype=np.int64)
                near = gap * (100 + percent) <= (100 - percent) * (n[x] + n[y])
                if near.any():
                    x, y = ids[x[near]], ids[y[near]]
                    yield np.minimum(x, y), np.maximum(x, y)

    def emit(block: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {c: block[c].to_numpy() for c in ("doc_id", "root", "n", "own")}
        if (rows["root"] == rows["root"][0]).all():
            return
        rows["buckets"] = block["buckets"].to_pylist()
        for a, b in compare(rows):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            block = held["block"].to_numpy()
            if not len(block):
                continue
            begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for b, e in zip(begin[:-1], begin[1:]):
                yield from emit(held.slice(b, e - b))
            held = held.slice(begin[-1])
        if held is not None and held.num_rows:
            yield from emit(held)

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar: union of the sketches first, then the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist()):
                linked.append(similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    of = lambda c, s: sets.select(F.col("doc_id").alias(c), F.col("values").alias(s))
    return pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(releasing(run), "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Jaccard similarity of two ordered sets reaches ``percent`` per cent."""
    total = len(x) + len(y)
    if not len(x) or not len(y):
        return False
    a, b = x[: retained(len(x), percent)], y[: retained(len(y), percent)]
    upto = min(a[-1], b[-1])  # below this both sketches are complete
    a, b = a[: np.searchsorted(a, upto, "right")], b[: np.searchsorted(b, upto, "right")]
    shared = len(np.intersect1d(a, b, assume_unique=True))
    if (len(a) + len(b) - 2 * shared) * (100 + percent) > (100 - percent) * total:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (total - shared)


def _only(docs: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """Rows of ``docs`` in ``ids``; few ids are broadcast, many are joined by a shuffle."""
    few = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _groups(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    sketch_bits: int = 24,
    block_rows: int = 1024,
    broadcast_rows: int = 250_000,
) -> tuple[DataFrame, bool]:
    """``key, doc_id, n_shingles, component_id, kept`` of each row, and whether keys differ from identifiers anywhere."""
    spark = docs.sparkSession
    staged = Staged(spark, "near-dedup")
    rows, odd = keyed(docs, id_col, text_col, staged)

    survey = staged.write(_survey(rows, shingle_words, sketch_bits))
    classes = spark.sparkContext.broadcast(_classes(survey, sketch_bits))
    surveyed = survey.filter("part IS NULL").select("doc_id", "own", "n", "digest", "buckets")
    usable = surveyed.filter("n > 0")
    standing = usable.groupBy("digest").agg(F.min("doc_id").alias("standing"), F.count("*").alias("copies"))
    copies = staged.write(
        usable.select("doc_id", "digest").join(standing.filter("copies > 1"), "digest").filter("doc_id <> standing")
        .select("doc_id", "standing")
    )

    def keys(values: np.ndarray) -> np.ndarray:
        return ordered(values, classes.value)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, doc, n, pos = [], [], [], []
            found = shingle_sets(batch["text"].to_pylist(), shingle_words)
            for i, s in zip(batch["doc_id"].to_pylist(), map(keys, found)):
                k = retained(len(s), percent)
                value.append(s[:k])
                doc.append(np.full(k, i, np.int64))
                n.append(np.full(k, len(s), np.int64))
                pos.append(np.arange(k, dtype=np.int64))
            if value:
                arrays = [pa.array(np.concatenate(x)) for x in (value, doc, n, pos)]
                yield pa.RecordBatch.from_arrays(arrays, ["value", "doc_id", "n", "pos"])

    def checked_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch["text"].to_pylist(), shingle_words, lane=1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.binary())], ["doc_id", "values"])

    gone = copies.select("doc_id").distinct()
    few = gone.limit(broadcast_rows + 1).count() <= broadcast_rows
    singles = rows.drop("own").join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    lists = staged.write(
        singles.mapInArrow(releasing(postings), "value long, doc_id long, n long, pos long")
        .repartition("value")
        .sortWithinPartitions("value", "doc_id")
        .mapInArrow(releasing(_list_rows(percent)), "kind int, a long, b long")
    )

    sizes = usable.select("doc_id", "n", "buckets").dropDuplicates(["doc_id"])
    of = lambda c: sizes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("buckets").alias(f"k{c}"))
    first = lists.filter("kind = 0").select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    first = staged.write(first.mapInArrow(releasing(_within_buckets(percent)), "a long, b long"))

    def checked(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = staged.write(_only(rows.drop("own"), ids, broadcast_rows).mapInArrow(releasing(checked_sets), "doc_id long, values binary"))
        linked = staged.write(verify(pairs, sets, percent), batch_rows=500)
        staged.drop(sets)
        return linked

    links = checked(first)
    groups = components(links, staged)

    members = lists.filter("kind = 1").select(F.col("a").alias("hub"), F.col("b").alias("doc_id")).distinct()
    members = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    members = staged.write(members.withColumn("root", F.coalesce("root", "doc_id")))
    mixed = (
        members.groupBy("hub")
        .agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
        .filter("low < high")
        .select("hub", F.ceil(F.col("m") / block_rows).cast("int").alias("parts"))
    )
    blocks = (
        members.join(mixed, "hub")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("block", F.xxhash64("hub", F.least("own", "other"), F.greatest("own", "other")))
        .select("block", "doc_id", "root", "own")
        .join(sizes, "doc_id")
    )
    rest = staged.write(
        blocks.repartition("block")
        .sortWithinPartitions("block")
        .select("block", "doc_id", "root", "own", "n", "buckets")
        .mapInArrow(releasing(_block_pairs(percent)), "a long, b long")
        .distinct()
    )
    staged.drop(lists)
    staged.drop(members)
    if not rest.isEmpty():
        links = links.unionByName(checked(rest))
        groups = components(links, staged)

    where = groups.select(F.col("node").alias("standing"), "root")
    found = (
        surveyed.select("doc_id", "own", "n")
        .join(copies.dropDuplicates(["doc_id"]), "doc_id", "left")
        .withColumn("standing", F.coalesce("standing", "doc_id"))
        .join(where, "standing", "left")
        .select(F.col("doc_id").alias("key"), F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "standing").alias("root"))
    )
    if not odd:
        return found.withColumn("component_id", F.col("root")).withColumn("kept", F.col("key") == F.col("root")), False
    # of each group the smallest identifier, and of the rows that have it (or of all, if none has any) the smallest key
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    least = found.groupBy("root").agg(first).select("root", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("kept_key"))
    return found.join(least, "root").withColumn("kept", F.col("key") == F.col("kept_key")), True


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    :param shingle_words: words of a shingle, 5 unless given.
    :param percent: documents link from this Jaccard similarity, 80 unless given.
    :param sketch_bits: ``2 ** sketch_bits`` counters of the fixed counting sketch.
    :param block_rows: longer lists are compared in blocks of about this size.
    :param broadcast_rows: at most so many ids are broadcast.
    """
    return _groups(docs, **options)[0].select("doc_id", "n_shingles", "component_id", "kept")


def _within_buckets(percent: int):
    """Pairs whose bucket counts allow the similarity; counts of 255 stand for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ka, kb = (np.stack([np.frombuffer(x, np.uint8) for x in batch[c].to_pylist()]).astype(np.int16) for c in ("ka", "kb"))
            total = batch["na"].to_numpy() + batch["nb"].to_numpy()
            mask = pa.array(np.abs(ka - kb).sum(1) * (100 + percent) <= (100 - percent) * total)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each group, all columns as they were."""
    groups, odd = _groups(docs, id_col=id_col, text_col=text_col, **options)
    if not odd:
        gone = groups.filter("NOT kept").select("doc_id")
        return without(docs, gone, {"doc_id": docs[id_col].cast("long")})
    staged = Staged(docs.sparkSession, "near-dedup-rows")
    own = docs[id_col].cast("long")
    keys = {"name": F.coalesce(own.cast("string"), F.lit("none")), "hash": F.xxhash64(own, docs[text_col])}
    rows, _ = keyed(docs, id_col, text_col, staged)
    hashes = rows.select("doc_id", F.coalesce(F.col("own").cast("string"), F.lit("none")).alias("name"), F.xxhash64("own", "text").alias("hash"))
    hashes = hashes.groupBy(F.col("doc_id").alias("key")).agg(F.first("name").alias("name"), F.first("hash").alias("hash"), F.count("*").alias("n"))
    marks = staged.write(groups.select("key", "kept").distinct().join(hashes, "key"))
    kept = without(docs, marks.filter("NOT kept").select("name", "hash"), keys)
    return one_of_each(kept, marks.filter("kept AND n > 1").select("name", "hash"), keys)
