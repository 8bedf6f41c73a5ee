"""Residue maps, coordinates, weights and the proximity score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.sources.staging import Stage


def usable_maps(maps: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """``structure, u1, pdb_chain, i, u, p``; residues of maps that qualify.

    Maps of fewer than five residues or with a negative structure residue go;
    structure residues mapped more than once lose all copies; with ``sites`` only
    proteins that have mutations stay.
    """
    kept = maps.filter((F.size("resmap") >= 5) & ~F.exists("resmap", lambda x: x["p"] < 0))
    if sites is not None:
        kept = kept.join(sites.select(F.col("uniprot").alias("u1")).distinct(), "u1", "left_semi")
    keys = ["structure", "u1", "u2", "pdb_chain", "resmap"]
    ordered = kept.select(*keys, F.array_sort(F.transform("resmap", lambda x: x["p"])).alias("_p"))
    again = ordered.select(*keys, F.array_distinct(F.filter("_p", lambda p, n: (n > 0) & (p == F.get(F.col("_p"), n - 1)))).alias("_again"))
    once = F.filter("resmap", lambda x: ~F.array_contains(F.col("_again"), x["p"]))  # few residues are mapped again
    rows = again.select("structure", "u1", "u2", "pdb_chain", F.posexplode(once).alias("i", "r"))
    return rows.select("structure", "u1", "u2", "pdb_chain", "i", F.col("r.u").alias("u"), F.col("r.p").alias("p"))


def site_weights(sites: DataFrame, weights: DataFrame | None = None, classes: list[str] = ["M"], ttype: str | None = None, values: bool = False) -> DataFrame:
    """``uniprot, site, weight, ttypes, samples``.

    ``weights`` holds ``ttype, sample, zlog_score`` (no ``ttype`` where samples are
    weighed over all types, as for modification sites); a sample without a row is an
    error, one with an undefined score weighs nothing. With ``values`` the given values are averaged over samples.
    """
    rows = sites.filter(F.col("site").isNotNull() & F.substring("mtype", 1, 1).isin(classes))
    if ttype:
        rows = rows.filter(F.col("ttype").startswith(ttype))
    people = F.collect_set(F.struct("sample", "ttype"))
    if values:
        total = F.sum("value") / F.greatest(F.lit(1), F.count_distinct("sample", "ttype"))
    elif weights is not None:
        keys = [c for c in ("ttype", "sample") if c in weights.columns]
        rows = rows.join(weights.select(*keys, "zlog_score", F.lit(True).alias("_has")), keys, "left")
        missing = F.raise_error(F.concat_ws(" ", F.lit("no weight for"), "ttype", "sample")).cast("double")
        total = F.sum(F.when(F.col("_has"), F.coalesce("zlog_score", F.lit(0.0))).otherwise(missing))
    else:
        total = F.count("*").cast("double")
    return rows.groupBy("uniprot", "site").agg(total.alias("weight"), F.collect_set("ttype").alias("ttypes"), people.alias("samples"))


def mutated(residues: DataFrame, weights: DataFrame, hill: tuple[float, float] | None = (2.0, 4.0)) -> DataFrame:
    """The mutated residues of each structure with their weights, through a Hill function unless None."""
    rows = residues.join(weights.select(F.col("uniprot").alias("u1"), F.col("site").alias("u"), "weight", "ttypes"), ["u1", "u"])
    value = C.hill(F.col("weight"), *hill) if hill else F.col("weight")
    return rows.select("structure", "i", value.alias("v"), "ttypes")


def residue_centroids(residues: DataFrame, atoms: DataFrame) -> DataFrame:
    """Centre and name of each mapped residue.

    A structure with a mapped residue that is absent, or of an unknown name, goes as a whole. Residues meet their
    atoms once; the rows are staged, as they are read for the structures to drop and for the rest.
    """
    chain = F.split(F.col("pdb_chain"), "-")
    rows = residues.withColumns({"pdb": F.get(chain, F.lit(0)), "chain": F.get(chain, F.lit(1))})
    centres = atoms.groupBy("pdb", "chain", F.col("resnum").alias("p")).agg(
        *(F.avg(c).alias(c) for c in "xyz"), F.min("resname").alias("resname")
    )
    known = F.col("resname").isin(*K.RESIDUE_LETTERS)
    joined = rows.join(centres, ["pdb", "chain", "p"], "left").select("structure", "i", "u", "p", "x", "y", "z", "resname")
    placed = Stage(rows.sparkSession, "centroids").write(joined)
    broken = placed.filter(F.col("resname").isNull() | ~known).select("structure").distinct()
    return placed.join(broken, "structure", "left_anti")


def least_atom_distance(residues: DataFrame, atoms: DataFrame, block: int = 2048, digits: int | None = None) -> DataFrame:
    """``structure, i, j, d2`` for ``i > j`` from the nearest atoms; with ``digits``, ``d2`` is rounded to as many, halves up.

    The residues of a structure are dealt into blocks of about ``block``, and two blocks are a tile,
    which spreads a large structure over tasks; the pairs of a tile leave it a slice at a time, as one
    row of arrays for each residue ``i``.
    """
    tiles = _atom_tiles(residues, atoms, block)
    lists = T.StructType().add("structure", residues.schema["structure"].dataType).add("i", T.LongType())
    lists = lists.add("j", T.ArrayType(T.LongType(), False)).add("d2", T.ArrayType(T.DoubleType(), False))
    found = tiles.mapInArrow(_least_distances(False, digits), lists)
    pairs = found.select("structure", "i", "j", F.posexplode("d2").alias("_at", "d2"))
    return pairs.select("structure", "i", F.get("j", F.col("_at")).alias("j"), F.nullif("d2", F.lit(_NOWHERE)).alias("d2"))


def nearest_before(residues: DataFrame, atoms: DataFrame, block: int = 1024, digits: int | None = None) -> DataFrame:
    """``structure, i, n, d2``: the number of residues ``j < i`` and the least distance to one of them.

    As :func:`least_atom_distance`, but a tile gives one row for each residue, no row for a pair.
    """
    tiles = _atom_tiles(residues, atoms, block)
    found = tiles.mapInArrow(_least_distances(True, digits), f"structure {dict(residues.dtypes)['structure']}, i long, n long, d2 double")
    return found.groupBy("structure", "i").agg(F.sum("n").alias("n"), F.min("d2").alias("d2"))


def _atom_tiles(residues: DataFrame, atoms: DataFrame, block: int) -> DataFrame:
    """``structure, a, b``: two blocks of residues with their atoms; ``b`` is null where a block meets itself."""
    chain = F.split(F.col("pdb_chain"), "-")
    rows = residues.withColumns({"pdb": F.get(chain, F.lit(0)), "chain": F.get(chain, F.lit(1))})
    rows = rows.join(atoms.withColumnRenamed("resnum", "p"), ["pdb", "chain", "p"])
    place = F.when(F.expr("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"), F.struct(*(F.col(c).cast("double").alias(c) for c in "xyz")))
    rows = rows.filter("structure IS NOT NULL").groupBy("structure", F.col("i").cast("long").alias("i")).agg(F.collect_list(place).alias("at"))
    bare = F.size("at") == 0  # no atom with a place, so no distance
    origin = F.array(F.struct(*(F.lit(0.0).alias(c) for c in "xyz")))
    return tiles(rows, "structure", "i", F.struct("i", F.when(bare, origin).otherwise(F.col("at")).alias("at"), bare.alias("bare")), block)


def tiles(rows: DataFrame, group: str, index: str, item: Column, block: int) -> DataFrame:
    """``group, a, b``: the items of a group in blocks of about ``block``, all pairs of blocks; ``b`` is null where a block meets itself."""
    number = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = rows.join(number, group).withColumn("_block", F.pmod(F.xxhash64(index), F.col("_blocks")).cast("int"))
    packed = dealt.groupBy(group, "_blocks", "_block").agg(F.collect_list(item).alias("a"))
    alone = packed.filter("_blocks = 1").select(group, "a", F.lit(None).cast(packed.schema["a"].dataType).alias("b"))
    several = packed.filter("_blocks > 1")
    left = several.select(group, "_block", "a", F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_other"))
    right = several.select(F.col(group).alias("_g"), F.col("_block").alias("_o"), F.col("a").alias("b"))
    met = left.join(right, (F.col(group) == F.col("_g")) & (F.col("_other") == F.col("_o")))
    # a tile is little data but much work, so its tasks are not to be merged by size
    met = met.repartition(max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), group, "_block", "_other")
    return alone.unionByName(met.select(group, "a", F.when(F.col("_block") != F.col("_other"), F.col("b")).alias("b")))


#: Stands in arrays for a distance that is null.
_NOWHERE = -1.0


class _Side:
    """A block of residues in order: numbers, which are bare, places of atoms by coordinate, atom and residue, greatest distance from the origin."""

    def __init__(self, items: pa.StructArray):
        i, lists = items.field("i").to_numpy(), items.field("at")
        starts, order = lists.offsets.to_numpy(), np.argsort(i)
        size = np.diff(starts)  # shorter residues repeat an atom
        at = (starts[:-1] + np.minimum(np.arange(size.max())[:, None], size - 1))[:, order]
        self.i, self.bare = i[order], items.field("bare").to_numpy(zero_copy_only=False)[order]
        self.xyz = np.stack([lists.values.field(c).to_numpy()[at] for c in "xyz"])
        with np.errstate(over="ignore", invalid="ignore"):
            self.square = (self.xyz**2).sum(0)
        self.reach = np.sqrt(self.square.max())


def _exact(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least squared distances of ``p`` and ``q`` (coordinate, atom, then any shapes that broadcast)."""
    least = None
    for x in p.swapaxes(0, 1):
        for y in q.swapaxes(0, 1):
            d2 = (x[0] - y[0]) ** 2
            for c in (1, 2):
                d = x[c] - y[c]
                d *= d
                d2 += d
            least = d2 if least is None else np.fmin(least, d2, out=least)
    return least


def _rounded(d2: np.ndarray, digits: int) -> np.ndarray:
    """As SQL rounds: the product to a whole number, halves up; what has no finite product stays."""
    y = d2 * 10.0**digits
    whole = np.floor(y)
    found = (whole + (y - whole >= 0.5)) / 10.0**digits
    return np.where(np.isfinite(found), found, d2)


def _least_distances(nearest: bool, digits: int | None = None, held: int = 64):
    """Least distances of the pairs of each tile, or the nearest earlier residue of each; ``held`` residues meet a block at a time."""

    def rounded(a: _Side, b: _Side, rows: slice, before: np.ndarray, slack: float) -> np.ndarray:
        """Of the pairs in ``before``, by a product of matrices; those that are too near to a half for its error are done again."""
        p, q = a.xyz[:, :, rows], b.xyz[:, :, : before.shape[1]]
        left = np.stack([*(-2 * p), a.square[:, rows], np.ones(p.shape[1:])], -1).reshape(-1, 5)
        right = np.stack([*q, np.ones(q.shape[1:]), b.square[:, : before.shape[1]]]).reshape(5, -1)
        y = (left @ right).reshape(*p.shape[1:], *q.shape[1:]).min((0, 2))[before]
        y *= 10.0**digits
        whole = np.floor(y + 0.5)
        y -= whole
        again = np.flatnonzero(np.abs(y, out=y) >= 0.5 - slack)
        whole /= 10.0**digits
        if len(again):
            row, column = (x[again] for x in np.nonzero(before))
            whole[again] = _rounded(_exact(p[:, :, row], q[:, :, column]), digits)
        return whole

    def of(a: _Side, b: _Side) -> Iterator[list[pa.Array]]:
        """Columns for the residues of ``a`` that come after some of ``b``."""
        upto, atoms = np.searchsorted(b.i, a.i), a.xyz.shape[1] * b.xyz.shape[1]
        # products err by less than 2 ** -48 of the square of both reaches; where that is much of the last digit, all pairs are done exactly
        slack = np.nan if digits is None else 2.0**-48 * (a.reach + b.reach) ** 2 * 10.0**digits
        quick = not nearest and slack < 0.01 and atoms <= 16 * held
        step = min(held, 16 * held // atoms) if quick else held  # a product has all pairs of atoms
        for s in range(0, len(a.i), step):
            rows = slice(s, s + step)
            n, bare = upto[rows], a.bare[rows]
            if not n[-1]:
                continue
            some, before, others = n > 0, np.arange(n[-1]) < n[:, None], b.bare[: n[-1]]
            d2 = rounded(a, b, rows, before, slack) if quick else _exact(a.xyz[:, :, rows, None], b.xyz[:, :, None, : n[-1]])
            if nearest:
                d2[~before | others] = np.nan
                none = bare | (np.cumsum(~others)[n - 1] == 0)
                least = np.fmin.reduce(d2, 1)[some]
                least = least if digits is None else _rounded(least, digits)
                yield [pa.array(a.i[rows][some]), pa.array(n[some], pa.int64()), pa.array(least, mask=none[some])]
                continue
            if not quick:
                d2 = d2[before] if digits is None else _rounded(d2[before], digits)
            if bare.any() or others.any():
                d2[(bare[:, None] | others)[before]] = _NOWHERE
            ends, j = pa.array(np.r_[0, np.cumsum(n[some])], pa.int32()), np.broadcast_to(b.i[: n[-1]], before.shape)[before]
            yield [pa.array(a.i[rows][some]), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (j, d2))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["structure", "i", "n" if nearest else "j", "d2"]
        for batch in batches:
            for name, *blocks in zip(*batch.columns):
                a, b = (_Side(x.values) if x.is_valid else None for x in blocks)
                for x, y in ((a, a),) if b is None else ((a, b), (b, a)):
                    for columns in of(x, y):
                        yield pa.RecordBatch.from_arrays([pa.repeat(name, len(columns[0])), *columns], names)

    return run


def residue_pairs(points: DataFrame, group: str, index: str, coordinates: list[str], carry: list[str] = []) -> DataFrame:
    """Pairs ``i > j`` inside one group with their squared distance."""
    a, b = points.alias("a"), points.alias("b")
    d2 = C.squared_distance([F.col(f"a.{c}") for c in coordinates], [F.col(f"b.{c}") for c in coordinates])
    joined = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{index}") > F.col(f"b.{index}")))
    return joined.select(
        F.col(f"a.{group}").alias(group), F.col(f"a.{index}").alias("i"), F.col(f"b.{index}").alias("j"), d2.alias("d2"),
        *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in carry for s in "ab"),
    )


def pair_sums(points: DataFrame, group: str, index: str, coordinates: list[str], weight: str | None, scales: tuple[float, ...] = K.SCALES, block: int = 512) -> DataFrame:
    """``group, n_pairs, s0, s1, ..``: sums over the pairs ``i > j`` of a group, of weights and kernels by scale.

    The points of a group are dealt into blocks of about ``block``, and two blocks are a tile, so a
    group of any size is spread over tasks, no pair is a row, and a point is copied once for each
    block of its group.
    """
    own = F.struct(F.col(index).cast("long").alias("i"), *(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(coordinates)), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    met = tiles(points, group, index, own, block)
    sums = [f"s{k}" for k in range(len(scales))]
    schema = f"`{group}` {dict(points.dtypes)[group]}, n_pairs long, " + ", ".join(f"{s} double" for s in sums)
    parts = met.mapInArrow(_tiles(len(coordinates), scales), schema)
    return parts.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("n_pairs", *sums))).filter("n_pairs > 0")


def _tiles(dimensions: int, scales: tuple[float, ...]):
    """Number of pairs and sums of each tile; a tile without a second side holds the pairs of its own points."""

    def sides(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
        flat, ends = column.values, column.offsets.to_numpy()
        i, w = (flat.field(c).to_numpy() for c in ("i", "w"))
        at = np.stack([flat.field(f"c{k}").to_numpy() for k in range(dimensions)])
        given = column.is_valid().to_numpy(zero_copy_only=False)
        return [(i[b:e], at[:, b:e], w[b:e]) if g else None for b, e, g in zip(ends, ends[1:], given)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(sides(batch["a"]), sides(batch["b"])):
                i, at, w = a
                j, other, v = b or a
                used = i[:, None] > j[None] if b is None else i[:, None] != j[None]
                d2 = ((at[:, :, None] - other[:, None, :]) ** 2).sum(0)
                both = w[:, None] * v[None] * used
                rows.append((int(used.sum()), *((both * np.exp(-d2 / (2 * s * s))).sum() for s in scales)))
            columns = list(zip(*rows)) if rows else [[]] * (len(scales) + 1)
            kinds = [pa.int64(), *[pa.float64()] * len(scales)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], [batch.schema.names[0], "n_pairs", *(f"s{k}" for k in range(len(scales)))])

    return run


def proximity(points: DataFrame, group: str, index: str, coordinates: list[str], weight: str, scales=K.SCALES) -> DataFrame:
    """The score of each group and scale; one pass over tiles of pairs for all scales."""
    wide = pair_sums(points, group, index, coordinates, weight, tuple(scales))
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("scale_idx"), F.lit(float(s)).alias("scale"), F.col(f"s{k}").alias("score")) for k, s in enumerate(scales))))
    return wide.select(group, long.alias("r")).select(group, "r.*")


def shared_type_factor(types_a: Column, types_b: Column, factor: float) -> Column:
    """Pairs that share no tumour type count ``factor`` only."""
    return F.lit(factor) + (1 - factor) * F.arrays_overlap(types_a, types_b).cast("double")


def unique_in_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")
