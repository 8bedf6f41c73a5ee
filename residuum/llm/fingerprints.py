"""SimHash fingerprints and all fingerprints within a Hamming radius, in built-in functions only.

Terms are pairs of neighbouring words (lower case, words between ASCII white space;
the last word also stands alone). Each distinct term has 128 hash bits and the
number of its occurrences as weight: a set bit votes for, an unset one against, with
that weight. A fingerprint has the bits with more votes for than against, as 32
hexadecimal digits; a text without words has none set. Equal texts have equal
fingerprints. The likeness of two fingerprints is the share of equal bits.

Votes are counted in lanes: a hash shifted by ``j`` and masked holds the bits ``j``,
``j + 16``, ``j + 32`` and ``j + 48`` in lanes of 16 bits, so 32 sums count all 128
bits. Texts are counted in pieces of ``_PIECE`` characters, which have too few terms
to overflow a lane, and the pieces of a text are added in lanes of 32 bits.

:func:`within` finds all fingerprints within a radius through permuted block tables: of
``radius + 2`` blocks at least two are equal, so each pair of blocks gives a table with
the two as key. A pair of fingerprints is taken from the first table that shows it.

:func:`edits` sets every document beside the next one in descending order of
identifiers. Rows are dealt to ranges of identifiers, and the first row of a range also
goes to the range before, so no task orders all rows. Rows without an identifier come
last, by hash of the text; rows with the same identifier follow by hash of the text.

Null text counts as empty. Very long texts are fingerprinted whole. Every row is a
document, repeated rows too. An empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residuum.llm.common import Staged, is_few

BITS = 128
_PIECE = 1 << 15  # characters, so at most 2 ** 14 words
_WHITE = r"[\x20\x09-\x0D]+"
_LANES16, _LANES32, _LOW32 = 0x0001000100010001, 0x0000FFFF0000FFFF, 0xFFFFFFFF
_UNNAMED = 8  # bits of the hash that deal out rows without an identifier


def _votes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, v0..v63``: votes for each bit of each text, two bits in a number; one row for equal keys."""
    text = F.coalesce("text", F.lit(""))
    long = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / _PIECE).cast("int")), lambda i: F.substring(text, i * _PIECE + 1, F.lit(_PIECE)))
    pieces = texts.select(*keys, F.posexplode(F.when(F.length(text) <= _PIECE, F.array(text)).otherwise(long)).alias("piece", "part"))
    bare = F.btrim(F.lower("part"), F.lit(" \t\n\v\f\r"))
    words = pieces.select(*keys, "piece", F.when(bare != "", F.split(bare, _WHITE)).alias("words"))
    following = F.slice("words", F.lit(2), F.size("words"))
    terms = words.select(*keys, "piece", F.inline_outer(F.arrays_zip(F.col("words").alias("word"), following.alias("after"))))
    first = terms.toDF(*keys, "piece", "word", "after").select(*keys, "piece", F.when(F.col("word").isNotNull(), F.xxhash64("word", "after")).alias("h0"))
    both = first.withColumn("h1", F.when(F.col("h0").isNotNull(), F.xxhash64("h0")))
    lanes = [F.sum(F.shiftright(f"h{h}", j).bitwiseAND(F.lit(_LANES16))).alias(f"s{16 * h + j}") for h in range(2) for j in range(16)]
    summed = both.groupBy(*keys, "piece").agg(F.count("h0").alias("n"), *lanes)
    halves = [(2 * i + k, F.shiftrightunsigned(f"s{i}", 16 * k).bitwiseAND(F.lit(_LANES32))) for i in range(32) for k in range(2)]
    return summed.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(half).alias(f"v{i}") for i, half in halves))


def _bits(h: int) -> Column:
    """The bits that hash number ``h`` won, as a number."""
    won = []
    for j in range(16):
        for lane in range(4):
            half = F.col(f"v{2 * (16 * h + j) + lane % 2}")
            votes = F.shiftrightunsigned(half, 32) if lane > 1 else half.bitwiseAND(F.lit(_LOW32))
            bit = 1 << (16 * lane + j)
            won.append(F.when(2 * votes > F.col("n"), F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0).cast("long")))
    while len(won) > 1:
        won = [a.bitwiseOR(b) for a, b in zip(won[::2], won[1::2])]
    return won[0]


def _printed(high: str, low: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(c)), 16, "0") for c in (high, low)))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Unequal bits of two fingerprints, each in two columns."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)])


def _likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return (F.lit(BITS) - distance(a, b)) / F.lit(float(BITS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, f0, f1`` of each row; ``f0`` and ``f1`` are the halves of the fingerprint as numbers."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = _votes(rows, ["row", "doc_id"]).select("doc_id", _bits(0).alias("f0"), _bits(1).alias("f1"))
    return found.select("doc_id", _printed("f0", "f1").alias("fingerprint"), "f0", "f1")


def _blocks(radius: int) -> list[tuple[str, int, int]]:
    """Half, first bit and width of each of at least ``radius + 2`` blocks."""
    each = -(-(radius + 2) // 2)
    if not 2 <= each <= 32:
        raise ValueError("the radius must lie between 0 and 62")
    edges = [64 * i // each for i in range(each + 1)]
    return [(half, b, e - b) for half in ("f0", "f1") for b, e in zip(edges, edges[1:])]


def within(queries: DataFrame, index: DataFrame, radius: int = 6, broadcast_rows: int = 50_000) -> DataFrame:
    """``q0, q1, f0, f1, distance``: for each distinct fingerprint ``f0, f1`` of ``queries`` all distinct ones of ``index`` within ``radius`` bits.

    ``q0, q1`` are the query's. Equal fingerprints are one, so groups of copies cost no more than one text.

    :param broadcast_rows: the tables of at most so many queries are broadcast; those of more meet the index by a shuffle.
    """
    blocks = _blocks(radius)
    value = lambda f, b, w: F.shiftrightunsigned(f, b).bitwiseAND(F.lit((1 << w) - 1))
    tables = F.array(*(
        F.struct(F.lit(i).alias("low"), F.lit(j).alias("high"), F.shiftleft(value(*blocks[i]), 32).bitwiseOR(value(*blocks[j])).alias("key"))
        for i, j in combinations(range(len(blocks)), 2)
    ))
    listed = lambda df: df.select("f0", "f1").distinct().select("f0", "f1", F.inline(tables))
    wanted = listed(queries).withColumnsRenamed({"f0": "q0", "f1": "q1"})
    # a row of a table is one of many of its fingerprint, which the sizes that Spark plans by do not show
    wanted = F.broadcast(wanted) if is_few(queries.select("f0", "f1").distinct(), broadcast_rows) else wanted.hint("merge")
    other = {"f0": "q0", "f1": "q1"}
    equal = [(value(f, b, w) == value(other[f], b, w)).cast("int") for f, b, w in blocks]
    before = reduce(lambda x, y: x + y, [F.when(F.col("high") > k, e).otherwise(0) for k, e in enumerate(equal)])
    found = wanted.join(listed(index), ["low", "high", "key"]).filter(before == 1)  # only ``low`` is equal before ``high``
    found = found.select("q0", "q1", "f0", "f1", distance(("q0", "q1"), ("f0", "f1")).alias("distance"))
    return found.filter(F.col("distance") <= radius)


def _range_of(cuts: list[int], doc_id: str) -> Column:
    """The number of ``cuts`` (descending) above the identifier, by a search in two steps."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    above = lambda values: F.size(F.filter(values, lambda c: c > F.col(doc_id)))
    longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    full = above(longs([g[0] for g in groups]))
    return F.when(full == 0, 0).otherwise((full - 1) * width + above(F.element_at(F.array(*map(longs, groups)), full)))


def edits(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``range, place, ghost, doc_id, n_chars, text, edited``: each text and itself with its last half replaced.

    The last ``floor(n_chars / 2)`` characters give way to as many from the start of the
    next document's text. ``place`` is the order within ``range``; a ghost is a copy of the
    first row of the next range behind a range's own rows.

    :param ranges: of identifiers, as many as shuffle partitions unless given.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)) or [F.lit(0.5)])
    seen = rows.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 10 * ranges))).alias("cuts"), F.count_if(F.col("doc_id").isNull()).alias("unnamed")).first()
    cuts = sorted(set(seen["cuts"] or []), reverse=True)

    unnamed = F.lit(len(cuts) + (1 << (_UNNAMED - 1))) - F.shiftright("hash", 64 - _UNNAMED)
    where = F.when(F.col("doc_id").isNull(), unnamed).otherwise(_range_of(cuts, "doc_id")).cast("long")
    dealt = rows.withColumn("hash", F.xxhash64("text")).withColumn("range", where)
    first = F.max(F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("hash")).alias("hash"))).alias("first")
    heads = dealt.groupBy("range").agg(first)  # a row for each range
    in_order = Window.orderBy("range")
    target = F.coalesce(F.lag("range").over(in_order), F.max("range").over(Window.partitionBy())).alias("target")
    heads = heads.select("range", F.col("first.doc_id").alias("head_id"), F.col("first.hash").alias("head_hash"), target)
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("head_hash").isNull() | (F.col("head_hash") == F.col("hash")))
    joined = dealt.join(F.broadcast(heads), "range")  # at most ``ranges + 2 ** _UNNAMED`` rows
    own, ghost = (F.struct(F.col(c).alias("range"), F.lit(g).alias("ghost")) for c, g in (("range", False), ("target", True)))
    placed = joined.select("doc_id", "hash", "text", F.inline(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))))

    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.desc("hash"))
    beside = placed.select("range", F.row_number().over(order).alias("place"), "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", F.lead("text").over(order).alias("next"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    return beside.select("range", "place", "ghost", "doc_id", "n_chars", "text", edited.alias("edited"))


def edited_fingerprints(docs: DataFrame, radius: int = 6, every: int = 100, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near`` of each row.

    ``n_near``: for the rows that are searched for, whose identifier ``every`` divides, how
    many other rows have a fingerprint within ``radius`` bits; null for the others.
    """
    staged = Staged(docs.sparkSession, "fingerprints")
    keys = ["range", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = edits(docs, ranges, id_col, text_col).withColumn("edited_sha256", F.sha2("edited", 256))
    own, other = (F.struct(F.lit(side).alias("side"), F.col(c).alias("text")) for side, c in ((0, "text"), (1, "edited")))
    sides = both.select(*keys, F.inline(F.when(F.col("ghost"), F.array(own)).otherwise(F.array(own, other))))
    found = _votes(sides, [*keys, "side"]).select(*keys, "side", _bits(0).alias("f0"), _bits(1).alias("f1"))
    of = lambda side, f, name: F.max(F.when(F.col("side") == side, F.col(f))).alias(name)
    beside = found.groupBy(*keys).agg(of(0, "f0", "f0"), of(0, "f1", "f1"), of(1, "f0", "e0"), of(1, "f1", "e1"))
    order = Window.partitionBy("range").orderBy("place")
    beside = beside.withColumns({"n0": F.lead("f0").over(order), "n1": F.lead("f1").over(order)}).filter("NOT ghost")
    marks = staged.write(beside.drop("range", "place", "ghost"))

    searched = F.pmod(F.col("doc_id"), F.lit(every)) == 0
    index = marks.groupBy("f0", "f1").agg(F.count("*").alias("copies"))
    pairs = within(marks.filter(searched), index, radius).join(index, ["f0", "f1"])
    number = pairs.groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg((F.sum("copies") - 1).alias("near"))
    return marks.join(number, ["f0", "f1"], "left").select(
        "doc_id", "n_chars", "edited_sha256",
        _printed("f0", "f1").alias("fingerprint"), _printed("e0", "e1").alias("edited_fingerprint"),
        _likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"), _likeness(("f0", "f1"), ("n0", "n1")).alias("near_next"),
        F.when(searched, F.col("near")).alias("n_near"),
    )
