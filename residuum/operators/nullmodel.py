"""Permutation null models.

Two forms. The SQL form orders residues by a hash of group, replicate and
residue: any engine draws the same subsets, at the price of one row per residue
and replicate. The Arrow form draws blocks in NumPy with an adaptive stop; the
blocks of a structure are dealt over tasks (:mod:`residuum.operators.draws`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.operators.draws import Draws, Prepared, in_rounds, settled
from residuum.operators.spectra import with_channel
from residuum.sources.staging import Stage


def replicates(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("rep"))


def draw(residues: DataFrame, sizes: DataFrame, reps: DataFrame, group: str, index: str, weight: Column | None = None, salt: str = "draw") -> DataFrame:
    """``group, rep, i`` of ``k`` residues without replacement for each replicate.

    ``sizes`` holds ``group, k``. Weighted draws order by ``-ln(u) / w``, which is
    the law of successive weighted draws; a residue without weight is never drawn.
    """
    u = C.uniform(F.lit(salt), F.col(group), F.col("rep"), F.col(index))
    rows = residues.join(sizes, group).crossJoin(F.broadcast(reps))  # a stated number of replicates
    if weight is None:
        rows = rows.withColumn("_key", u)
    else:
        rows = rows.withColumn("_w", weight).filter("_w > 0").withColumn("_key", -F.ln(u) / F.col("_w"))
    order = Window.partitionBy(group, "rep").orderBy("_key", index)
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank <= k").drop("_key", "k")


def draw_in_strata(residues: DataFrame, sizes: DataFrame, reps: DataFrame, group: str, index: str, stratum: str = "stratum") -> DataFrame:
    """As :func:`draw`, but each stratum of a group keeps its own number of residues.

    ``sizes`` holds ``group, stratum, k``.
    """
    rows = residues.withColumn("unit", F.concat_ws("/", F.col(group).cast("string"), F.col(stratum).cast("string")))
    sized = sizes.select(F.concat_ws("/", F.col(group).cast("string"), F.col(stratum).cast("string")).alias("unit"), "k")
    return draw(rows, sized, reps, "unit", index).drop("unit")


def restricted(residues: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Only residues of the named kinds can be drawn."""
    return residues.filter(F.col("resname").isin(*names))


def exceedances(scores: DataFrame, observed: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """How many replicate scores reach the observed one, and the draws."""
    joined = scores.join(observed.withColumnRenamed("score", "observed"), keys)
    return joined.groupBy(*keys).agg(
        F.count_if(F.col("score") >= F.col("observed") - tolerance).alias("exceed"), F.count("*").alias("draws")
    )


def p_values(counts: DataFrame, keys: list[str], floor: bool = False) -> DataFrame:
    """P over all replicates, blocks and runs of a key."""
    total = counts.groupBy(*keys).agg(F.sum("exceed").alias("exceed"), F.sum("draws").alias("draws"))
    p = C.p_floor(F.col("exceed"), F.col("draws")) if floor else F.col("exceed") / F.col("draws")
    return total.withColumn("p", p)


# Null probabilities from coverage and spectra


def coverage_weights(positions: DataFrame, coverage: DataFrame) -> DataFrame:
    """``structure, i, weight`` from the genomic positions of residues, summing to 1.

    ``positions`` holds ``structure, i, chrn, pos``; residues without positions
    have null ones. A structure without any coverage is uniform.
    """
    rows = positions.join(coverage, ["chrn", "pos"], "left")
    mean = rows.groupBy("structure", "i").agg(F.greatest(F.lit(0.0), F.coalesce(F.avg("cov"), F.lit(0.0))).alias("c"))
    return _shares(mean)


def coverage_by_runs(spans: DataFrame, runs: DataFrame, width: int = 4096) -> DataFrame:
    """As :func:`coverage_weights`, from runs of positions and runs of equal coverage.

    ``spans`` holds ``structure, i, chrn, s, e`` (null where a residue has no positions), ``runs``
    ``chrn, start, end, cov``, both half-open. Two runs meet in the bins of ``width`` positions that both touch, and
    count in the first of them; a mean weighs coverage by the positions shared.
    """
    bins = lambda b, e: F.explode(F.sequence(F.floor(F.col(b) / width), F.floor((F.col(e) - 1) / width)))
    own = spans.filter("s < e").withColumn("_bin", bins("s", "e"))
    covered = runs.filter("start < end").withColumn("_bin", bins("start", "end"))
    met = own.join(covered, ["chrn", "_bin"]).filter(F.col("_bin") == F.floor(F.greatest("s", "start") / width))
    shared = F.least("e", "end") - F.greatest("s", "start")
    sums = met.filter(shared > 0).groupBy("structure", "i").agg(F.sum(shared * F.col("cov")).alias("_sum"), F.sum(shared).alias("_n"))
    every = spans.select("structure", "i").distinct().join(sums, ["structure", "i"], "left")
    mean = every.select("structure", "i", F.greatest(F.lit(0.0), F.coalesce(F.col("_sum") / F.col("_n"), F.lit(0.0))).alias("c"))
    return _shares(mean)


def _shares(mean: DataFrame) -> DataFrame:
    total = mean.groupBy("structure").agg(F.sum("c").alias("t"), F.count("*").alias("n"))
    share = F.when(F.col("t") > 0, F.col("c") / F.col("t")).otherwise(1 / F.col("n"))
    return mean.join(total, "structure").select("structure", "i", share.alias("weight"))


def runs_of_coverage(coverage: DataFrame, width: int = 4096) -> DataFrame:
    """``chrn, start, end, cov`` of a table of positions (from 1), in runs that end at bins of ``width`` at the latest."""
    at = coverage.select("chrn", (F.col("pos") - 1).alias("p"), "cov").withColumn("_bin", F.floor(F.col("p") / width))
    along = Window.partitionBy("chrn", "_bin", "cov").orderBy("p")
    island = at.withColumn("_run", F.col("p") - F.row_number().over(along))
    return island.groupBy("chrn", "_bin", "cov", "_run").agg(F.min("p").alias("start"), (F.max("p") + 1).alias("end")).select("chrn", "start", "end", "cov")


def exact_median(rows: DataFrame, keys: list[str], value: str, name: str, held: int = 1000, buckets: int = 256) -> DataFrame:
    """``keys, name``: the exact median of ``value``, nulls left out; no task holds more than ``held`` values of a key.

    Keys with more values are narrowed in rounds: the values between two bounds are counted in
    equal buckets, and the bounds of a rank become the least and greatest value of its bucket,
    until that is one value. Both middle ranks are followed.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).dropna(subset=["_v"])
    stage = Stage(rows.sparkSession, "median")
    bounds = [F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    large = stage.write(rows.groupBy(*keys).agg(*bounds).filter(F.col("_n") > held))
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.median("_v").alias(name))
    small = rows.join(large, keys, "left_anti").groupBy(*keys).agg(F.median("_v").alias(name))
    left = stage.write(rows.join(large.select(*keys), keys, "left_semi"))
    state = stage.write(large.select(*keys, F.posexplode(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))).alias("_which", "_rank"), "_low", "_high"))
    found = []
    while True:
        found.append(state.filter("_low = _high").select(*keys, "_low"))
        state = state.filter("_low < _high")
        if state.isEmpty():
            break
        place = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * buckets), F.lit(buckets - 1))
        inside = left.join(state, keys).filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        counts = inside.groupBy(*keys, "_which", "_rank", place.alias("_b")).agg(*bounds)
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_which").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        chosen = counts.withColumn("_upto", upto).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        state = stage.write(chosen.select(*keys, "_which", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_low", "_high"))
    middle = found[0]
    for more in found[1:]:
        middle = middle.unionByName(more)
    return small.unionByName(middle.groupBy(*keys).agg(F.avg("_low").alias(name)))


def codon_changes(spark: SparkSession) -> DataFrame:
    """``codon, k, to``: the changes of one base of a codon that make another amino acid; 576 rows at most."""
    rows = [
        (codon, k, to) for codon, aa in K.CODONS.items() for k in range(3) for to in K.BASES
        if to != codon[k] and K.CODONS[codon[:k] + to + codon[k + 1 :]] not in ("*", aa)
    ]
    return spark.createDataFrame(rows, "codon string, k int, to string")


def residue_channels(codons: DataFrame) -> DataFrame:
    """``structure, i, channel, mult`` of the amino-acid changes that one base can make.

    ``codons`` holds ``structure, i, strand, codon`` (as translated) and ``ctx``, the three
    genomic trinucleotides of the codon's bases in translated order. Stops are no change.
    """
    rows = codons.select("structure", "i", "strand", "codon", "ctx").join(F.broadcast(codon_changes(codons.sparkSession)), "codon")
    genomic = F.when(F.col("strand") == "+", F.col("to")).otherwise(F.translate("to", "acgt", "tgca"))
    rows = with_channel(rows.select("structure", "i", F.get("ctx", F.col("k")).alias("abc"), genomic.alias("new"))).dropna(subset=["channel"])
    return rows.groupBy("structure", "i", "channel").agg(F.count("*").alias("mult"))


def patient_probabilities(residues: DataFrame, channels: DataFrame, spectra: DataFrame, hits: DataFrame) -> DataFrame:
    """``structure, patient, i, q``.

    Only the patients in ``hits`` (``structure, patient, i``) are expanded over the
    structure's residues. A residue weighs the patient's counts over its channels,
    less one if mutated there.
    """
    people = hits.select("structure", "patient").distinct()
    reach = channels.join(people, "structure").join(spectra, ["patient", "channel"])
    mass = reach.groupBy("structure", "patient", "i").agg(F.sum(F.col("mult") * F.col("n")).alias("m"))
    grid = residues.select("structure", "i").join(people, "structure").join(mass, ["structure", "patient", "i"], "left")
    own = hits.select("structure", "patient", "i").distinct().withColumn("own", F.lit(1))
    grid = grid.join(own, ["structure", "patient", "i"], "left")
    grid = grid.withColumn("q", F.coalesce("m", F.lit(0)) - F.coalesce("own", F.lit(0)))
    total = grid.groupBy("structure", "patient").agg(F.sum("q").alias("t"), F.count("*").alias("n"))
    share = F.when(F.col("t") != 0, F.col("q") / F.col("t")).otherwise(1 / F.col("n"))
    return grid.join(total, ["structure", "patient"]).select("structure", "patient", "i", share.alias("q"))


def mutation_probabilities(hits: DataFrame, probabilities: DataFrame, coverage: DataFrame) -> DataFrame:
    """``structure, site, i, w``: the median over a site's patients, times coverage, normalised.

    A site with a negative or an all-zero vector has none.
    """
    rows = hits.select("structure", "patient", F.col("i").alias("site")).distinct().join(probabilities, ["structure", "patient"])
    mid = exact_median(rows, ["structure", "site", "i"], "q", "q")
    mid = mid.join(coverage, ["structure", "i"]).withColumn("w", F.col("q") * F.col("weight"))
    total = mid.groupBy("structure", "site").agg(F.sum("w").alias("t"), F.min("w").alias("low"))
    good = total.filter("t > 0 AND low >= 0").select("structure", "site", "t")
    return mid.join(good, ["structure", "site"]).select("structure", "site", "i", (F.col("w") / F.col("t")).alias("w"))


# Arrow form


def may_stop(exceed: np.ndarray, draws: int, threshold: float) -> bool:
    """The p-values are known well enough on every scale."""
    return bool((settled(exceed, draws) < threshold).all())


#: Structures of up to so many residues keep the kernels of all their pairs, and so many numbers are held at once in larger ones.
_DENSE, _HELD = 1000, 4_000_000


def _kernels(xyz: np.ndarray, scales: tuple[float, ...]) -> np.ndarray:
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    kernels = np.stack([np.tril(np.exp(-d2 / (2 * s * s)), -1) for s in scales])
    return (kernels + kernels.transpose(0, 2, 1)) / 2


def _score(kernels: np.ndarray, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Scores of draws ``index`` (draws x k) with ``values`` (draws x k), by scale."""
    out = np.empty((len(kernels), len(index)))
    for s, kernel in enumerate(kernels):
        block = kernel[index[:, :, None], index[:, None, :]]
        out[s] = np.einsum("bi,bij,bj->b", values, block, values)
    return out


def _score_apart(xyz: np.ndarray, scales: tuple[float, ...], index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """As :func:`_score`, from the coordinates and a tile of pairs at a time, so that memory does not grow with pairs."""
    draws, k = index.shape
    tile = max(1, min(k, _HELD // k))
    some = max(1, _HELD // (tile * k))
    out = np.zeros((len(scales), draws))
    for b in range(0, draws, some):
        at, v = xyz[index[b : b + some]], values[b : b + some]
        for i in range(0, k, tile):
            d2 = sum((at[:, i : i + tile, None, c] - at[:, None, :, c]) ** 2 for c in range(3))
            rows = np.arange(d2.shape[1])
            for s, scale in enumerate(scales):
                near = np.exp(-d2 / (2 * scale * scale))
                near[:, rows, rows + i] = 0
                out[s, b : b + some] += np.einsum("bi,bij,bj->b", v[:, i : i + tile], near, v) / 2
    return out


def _along(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Features of ``exp(-(x - y)^2 / (2 scale^2))`` on a line and their weights: products of two rows give the kernel to 1e-12.

    The kernel is interpolated at Chebyshev nodes; None if 64 of them are not enough.
    """
    middle, half = (x.max() + x.min()) / 2, max(x.max() - x.min(), 1e-9) / 2
    kernel = lambda a, b: np.exp(-(((a[:, None] - b[None]) * half) ** 2) / (2 * scale * scale))
    for n in (8, 12, 16, 20, 24, 28, 32, 40, 48, 64):
        nodes = np.cos(np.pi * (np.arange(n) + 0.5) / n)
        turn = np.polynomial.chebyshev.chebvander(nodes, n - 1) * np.where(np.arange(n) > 0, 2 / n, 1 / n)
        at = lambda t: np.polynomial.chebyshev.chebvander(t, n - 1) @ turn.T  # noqa: E731, B023
        grid = np.linspace(-1, 1, 4 * n + 1)
        inner = kernel(nodes, nodes)
        if np.abs(at(grid) @ inner @ at(grid).T - kernel(grid, grid)).max() < 2e-13:
            weight, turned = np.linalg.eigh(inner)
            kept = weight > 1e-15 * weight[-1]
            return at((x - middle) / half) @ (turned[:, kept] * np.sqrt(weight[kept])), weight[kept] / weight[-1]
    return None


def _separable(xyz: np.ndarray, scale: float, k: int) -> tuple[np.ndarray, ...] | None:
    """Features of the kernel along each axis, and which of x and y to multiply, if they are less work than the pairs of ``k`` residues."""
    along = [_along(xyz[:, c], scale) for c in range(3)]
    if any(a is None for a in along):
        return None
    (x, wx), (y, wy), (z, _) = along
    a, b = np.nonzero(np.outer(wx, wy) > 1e-15)
    if len(a) * (1 + z.shape[1] / 10) > 3 * k:
        return None
    return x, y, z, a, b


def _score_large(xyz: np.ndarray, scales: tuple[float, ...], k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """As :func:`_score` for many residues: sums over features, whose number does not grow with the draws, or over tiles of pairs."""
    known = {scale: _separable(xyz, scale, k) for scale in scales}
    apart = tuple(s for s in scales if known[s] is None)

    def score(index: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.empty((len(scales), len(index)))
        if apart:
            out[[s in apart for s in scales]] = _score_apart(xyz, apart, index, values)
        for n, scale in enumerate(scales):
            if known[scale] is not None:
                x, y, z, a, b = known[scale]
                flat = x[:, a] * y[:, b]
                for d, (at, v) in enumerate(zip(index, values)):
                    sums = flat[at].T @ (z[at] * v[:, None])
                    out[n, d] = (np.vdot(sums, sums) - v @ v) / 2
        return out

    return score


def _sampler(weights: np.ndarray | None, allowed: np.ndarray, k: int) -> Callable[[np.random.Generator, int], np.ndarray]:
    def sample(rng: np.random.Generator, n: int) -> np.ndarray:
        out, some = np.empty((n, k), allowed.dtype), max(1, _HELD // len(allowed))
        for b in range(0, n, some):  # the same numbers in any blocks
            keys = rng.random((min(some, n - b), len(allowed)))
            if weights is not None:
                with np.errstate(divide="ignore"):
                    keys = -np.log(keys) / weights[allowed]
            out[b : b + some] = np.sort(allowed[np.argpartition(keys, k - 1, axis=1)[:, :k]], axis=1)
        return out

    return sample


class Spots:
    """A residue for each mutation from its own distribution, the row of ``p`` that ``of`` has for it (its own number if not given)."""

    def __init__(self, p: np.ndarray, of: np.ndarray | None = None):
        self._of = np.arange(len(p)) if of is None else of
        self.k, self.size = len(self._of), p.shape[1]
        steps = np.cumsum(p, axis=1)
        self._steps = (steps / steps[:, -1:] + np.arange(len(p))[:, None]).ravel()

    def _at(self, rng: np.random.Generator, m: np.ndarray) -> np.ndarray:
        row = self._of[m]
        found = np.searchsorted(self._steps, row + rng.random(len(m)), "right") - row * self.size
        return np.clip(found, 0, self.size - 1)

    def draw(self, rng: np.random.Generator, n: int, tries: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """``n`` draws, and which of them are whole: mutations come in random order, and one that hits
        a taken residue draws again, up to ``tries`` times.
        """
        order = rng.permuted(np.broadcast_to(np.arange(self.k), (n, self.k)), axis=1)
        out, whole = np.zeros((n, self.k), np.int64), np.ones(n, bool)
        taken = np.zeros((n, self.size), bool)
        for m in order.T:
            todo = np.flatnonzero(whole)
            for _ in range(tries):
                at = self._at(rng, m[todo])
                free = ~taken[todo, at]
                done = todo[free]
                out[done, m[done]] = at[free]
                taken[done, at[free]] = True
                todo = todo[~free]
                if not len(todo):
                    break
            whole[todo] = False
        return out, whole


def whole_draws(some: Callable[[np.random.Generator, int], tuple[list[np.ndarray], np.ndarray]], rng: np.random.Generator, n: int, starts: int = 50) -> list[np.ndarray] | None:
    """``n`` draws that are whole; others start over, None after ``starts`` in vain."""
    out: list[np.ndarray] | None = None
    todo = np.arange(n)
    for _ in range(starts):
        tables, whole = some(rng, len(todo))
        if out is None:
            out = [np.empty((n, t.shape[1]), t.dtype) for t in tables]
        for o, t in zip(out, tables):
            o[todo[whole]] = t[whole]
        todo = todo[~whole]
        if not len(todo):
            return out
    return None


def _collision_free(rng: np.random.Generator, p: np.ndarray, n: int, of: np.ndarray | None = None) -> np.ndarray | None:
    """Residues of ``n`` draws without collisions, a bounded table at a time."""
    spots, parts, some = Spots(p, of), [], max(1, _HELD // p.shape[1])
    for at in range(0, n, some):
        drawn = whole_draws(lambda r, m: ((x := spots.draw(r, m))[:1], x[1]), rng, min(some, n - at))
        if drawn is None:
            return None
        parts.append(drawn[0])
    return np.concatenate(parts) if parts else np.empty((0, spots.k), np.int64)


def structure_test(points: DataFrame, group: str = "structure", names: tuple[str, ...] | None = None, options: Draws = Draws(), vectors: DataFrame | None = None) -> DataFrame:
    """``group, scale_idx, score, exceed, draws, status`` of each structure.

    ``points`` holds ``group, i, x, y, z, v`` (``v`` null where not mutated), and
    ``weight`` for weighted draws, ``resname`` for restricted ones. With
    ``vectors`` (``group, site, i, w``, or the form of :func:`distributions`) each mutation is drawn from its own
    distribution and keeps its weight; else weights are permuted. Status 1: the
    budget of draws or seconds ended before the stop rule; 2: no draw was possible. Seeds follow
    the structure's name and the block, so results do not depend on partitions or rounds.

    A task holds the residues of one structure, and its unlike distributions, and draws some of its blocks. The pairs of all
    residues are held only for a chain of common size; in larger ones pairs are made in tiles.
    """
    has_weight, by_site = "weight" in points.columns, vectors is not None

    def prepare(name: object, own: dict[str, pd.DataFrame]) -> Prepared:
        pdf = own["points"].sort_values("i").reset_index(drop=True)
        labels = [(s,) for s in range(len(options.scales))]
        impossible = lambda observed: (labels, observed, lambda rng, n: None)
        mutated = np.flatnonzero(pdf["v"].notna())
        k = len(mutated)
        if not k:
            return impossible(np.zeros(len(labels)))
        values = pdf["v"].to_numpy(float)[mutated]
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        if len(pdf) <= _DENSE:
            score = partial(_score, _kernels(xyz, options.scales))
        else:
            score = _score_large(xyz, options.scales, k)
        observed = score(mutated[None], values[None])[:, 0]
        allowed = np.flatnonzero(pdf["resname"].isin(names)) if names else np.arange(len(pdf))
        weights = pdf["weight"].to_numpy(float) if has_weight else None
        if weights is not None:
            allowed = allowed[weights[allowed] > 0]
        reached = lambda index, mass: (score(index, mass) >= observed[:, None] - 1e-12).sum(1)
        if by_site:
            p, of = own_distributions(own["vectors"], pdf["i"], pdf["i"].to_numpy()[mutated])
            if (p.sum(1) <= 0).any():
                return impossible(observed)

            def by_spectrum(rng: np.random.Generator, n: int) -> np.ndarray | None:
                index = _collision_free(rng, p, n, of)
                return None if index is None else reached(index, np.broadcast_to(values, index.shape))

            return labels, observed, by_spectrum
        if len(allowed) < k:
            return impossible(observed)
        draw_ = _sampler(weights, allowed, k)
        return labels, observed, lambda rng, n: reached(draw_(rng, n), rng.permuted(np.broadcast_to(values, (n, k)), axis=1))

    needed = [group, "i", "x", "y", "z", "v", *(["weight"] if has_weight else []), *(["resname"] if names else [])]
    tables = {"points": points.select(*needed)}
    if vectors is not None:
        tables["vectors"] = _fresh(distributions(vectors, [group])).join(_fresh(points.select(group)).distinct(), group, "left_semi")
    return in_rounds(tables, group, "scale_idx int", prepare, options)


def distributions(vectors: DataFrame, keys: list[str], index: str = "i") -> DataFrame:
    """``keys, sites, i, w`` of ``keys, site, index, w``: a row for each distribution, and the sites that share it.

    Tasks get arrays in place of a row for each site and residue, and a distribution of many sites once. Such a table
    is left as it is.
    """
    if "sites" in vectors.columns:
        return vectors.select(*keys, "sites", "i", "w")
    own = vectors.groupBy(*keys, "site").agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), "w"))).alias("_own"))
    return own.groupBy(*keys, "_own").agg(F.collect_list("site").alias("sites")).select(*keys, "sites", F.col("_own.i").alias("i"), F.col("_own.w").alias("w"))


def own_distributions(vectors: pd.DataFrame, residues: pd.Series, mutated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row over ``residues``, which are in order, of each distribution ``sites, i, w`` in use, and the row of each of ``mutated``.

    Mutated residues without a distribution share a row of zeros.
    """
    numbers, rows, of = residues.to_numpy(), [], np.full(len(mutated), -1)
    for sites, i, w in zip(vectors["sites"], vectors["i"], vectors["w"]):
        has = np.isin(mutated, sites)
        if has.any():
            of[has] = len(rows)
            i, w = np.asarray(i), np.asarray(w)
            at = np.searchsorted(numbers, i, "right") - 1
            known = (at >= 0) & (numbers[at] == i)
            rows.append(np.zeros(len(numbers)))
            rows[-1][at[known]] = w[known]
    if (of < 0).any():
        of[of < 0] = len(rows)
        rows.append(np.zeros(len(numbers)))
    return np.array(rows).reshape(len(rows), len(numbers)), of


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new ids, so that frames from one source can be grouped together."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def burial_groups(residues: DataFrame, column: str = "burial", cuts: tuple[float, float] = (0.33, 0.66)) -> DataFrame:
    """Strata of buried, middle and exposed residues, to be drawn within."""
    value = F.col(column)
    return residues.withColumn("stratum", F.when(value < cuts[0], 0).when(value < cuts[1], 1).otherwise(2))
