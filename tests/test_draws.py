"""Draws in blocks over rounds and tasks against plain loops and exact enumeration."""

import itertools
from dataclasses import replace
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from residuum.operators import interface, nullmodel
from residuum.operators.draws import Draws


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(6):
        xyz, hit = rng.normal(0, 9, (30, 3)), set(rng.choice(30, 4, replace=False).tolist())
        rows += [(f"s{s}", i, *map(float, xyz[i]), float(1 + i % 3) if i in hit else None) for i in range(30)]
    return spark.createDataFrame(rows, "structure string, i int, x double, y double, z double, v double")


def plain(points, options):
    """One block after the other, in one loop a structure."""
    out = {}
    rows = {}
    for r in points.collect():
        rows.setdefault(r.structure, []).append(r)
    for name, own in rows.items():
        own.sort(key=lambda r: r.i)
        xyz = np.array([[r.x, r.y, r.z] for r in own])
        hit = np.array([n for n, r in enumerate(own) if r.v is not None])
        values = np.array([own[n].v for n in hit])
        kernels = nullmodel._kernels(xyz, options.scales)
        observed = nullmodel._score(kernels, hit[None], values[None])[:, 0]
        draw = nullmodel._sampler(None, np.arange(len(own)), len(hit))
        exceed, done, status, block = np.zeros(len(options.scales), int), 0, 1, 0
        while done < options.max_draws:
            n = min(options.batch, options.max_draws - done)
            rng = np.random.default_rng([options.seed, crc32(name.encode()), block])
            scores = nullmodel._score(kernels, draw(rng, n), rng.permuted(np.broadcast_to(values, (n, len(hit))), axis=1))
            exceed += (scores >= observed[:, None] - 1e-12).sum(1)
            done, block = done + n, block + 1
            if nullmodel.may_stop(exceed, done, options.threshold):
                status = 0
                break
        out |= {(name, s): (exceed[s], done, status) for s in range(len(options.scales))}
    return out


@pytest.mark.parametrize("first_round, tasks", [(1, 256), (3, 2), (4, 1), (50, 7)])
def test_any_rounds_and_tasks_count_alike(spark, points, first_round, tasks):
    options = Draws(max_draws=2250, batch=100, first_round=first_round, tasks=tasks, scales=(3.0, 6.0, 10.0))
    got = nullmodel.structure_test(points, options=options).collect()
    expected = plain(points, options)
    assert {(r.structure, r.scale_idx): (r.exceed, r.draws, r.status) for r in got} == expected
    assert len(got) == len(expected) and len({d for _, d, _ in expected.values()}) > 1  # they stop at different blocks


def test_one_large_structure_is_dealt_over_tasks(spark):
    at = lambda k: (F.col("id") * k % 101).cast("double")
    rows = spark.range(20_000).select(F.lit("big").alias("structure"), F.col("id").alias("i"), at(3).alias("x"), at(7).alias("y"), at(11).alias("z"), F.when(F.col("id") % 2000 == 0, 1.0).alias("v"))
    options = Draws(max_draws=800, batch=100, threshold=0.0, first_round=8, scales=(6.0,))
    (row,) = nullmodel.structure_test(rows, options=options).collect()
    assert row.draws == 800 and row.status == 1
    alone = nullmodel.structure_test(rows, options=replace(options, tasks=1, first_round=1)).first()
    assert alone == row


def test_time_ends_a_structure_with_status_1(points):
    options = Draws(max_draws=100_000, batch=50, threshold=0.0, max_seconds=0.0)
    got = nullmodel.structure_test(points, options=options).collect()
    assert {r.status for r in got} == {1} and all(50 <= r.draws < 100_000 for r in got)


def test_failed_draws_close_a_structure(spark, points):
    sites = points.filter("v IS NOT NULL").select("structure", F.col("i").alias("site"))
    one = sites.select("structure", "site", F.lit(0).alias("i"), F.lit(1.0).alias("w"))  # all mutations have one residue in common
    got = nullmodel.structure_test(points, options=Draws(max_draws=300, batch=100), vectors=one).collect()
    assert {(r.status, r.draws, r.exceed) for r in got} == {(2, 0, 0)} and len(got) == 30
    none = nullmodel.structure_test(points, options=Draws(max_draws=300), vectors=one.limit(0)).collect()
    assert {r.status for r in none} == {2}
    assert nullmodel.structure_test(points.limit(0)).count() == 0


def _pair(spark, w, vectors):
    residues = spark.createDataFrame([("p", c, i, w[c].get(i)) for c in "AB" for i in range(3)], "pdb string, chain string, resnum int, w double")
    sides = [("p", "P", "A", "B", s, "AB"[s], i, True) for s, i in ((0, 0), (0, 1), (1, 2))]
    edges = spark.createDataFrame(sides, "pdb string, kind string, c1 string, c2 string, side int, chain string, resnum int, direct boolean")
    rows = [("p", c, m, i, x) for c, own in vectors.items() for m, xs in own.items() for i, x in enumerate(xs)]
    return residues, edges, spark.createDataFrame(rows, "pdb string, chain string, site int, resnum int, w double")


def _placements(own, masses):
    """Every placement of a chain's mutations with its chance; later mutations avoid earlier ones."""
    out = []
    orders = list(itertools.permutations(own))
    for order in orders:
        for at in itertools.permutations(range(3), len(order)):
            chance, taken = 1 / len(orders), 0.0
            for m, i in zip(order, at):
                free = 1 - sum(own[m][j] for j in at[: at.index(i)]) / sum(own[m])
                chance *= own[m][i] / sum(own[m]) / free if free > 1e-12 else 0.0
                taken += chance
            if chance:
                out.append((chance, {i: masses[m] for m, i in zip(order, at)}))
    return out


def test_spectra_of_two_chains_agree_with_enumeration(spark):
    """The three statistics of an interface from joint draws of both chains."""
    w = {"A": {0: 1.0, 2: 0.5}, "B": {1: 2.0}}
    vectors = {"A": {0: [0.2, 0.3, 0.5], 2: [0.6, 0.3, 0.1]}, "B": {1: [0.1, 0.5, 0.4]}}
    residues, edges, rows = _pair(spark, w, vectors)
    masks = {"A": {0, 1}, "B": {2}}
    mass = lambda c, placed: sum(m for i, m in placed.items() if i in masks[c])
    observed = {c: mass(c, w[c]) for c in "AB"}
    exact = {"side1": 0.0, "side2": 0.0, "total": 0.0}
    for p, a in _placements(vectors["A"], w["A"]):
        for q, b in _placements(vectors["B"], w["B"]):
            x, y = mass("A", a), mass("B", b)
            for name, reached in (("side1", x >= observed["A"]), ("side2", y >= observed["B"]), ("total", x + y >= observed["A"] + observed["B"])):
                exact[name] += p * q * reached
    n = 40_000
    got = interface.interface_test(residues, edges, Draws(max_draws=n, batch=5000, threshold=0.0), rows).collect()
    assert {r.statistic: r.mass for r in got} == {"side1": observed["A"], "side2": observed["B"], "total": observed["A"] + observed["B"]}
    for r in got:
        e = exact[r.statistic]
        assert r.draws == n and abs(r.exceed / n - e) <= 4 * (e * (1 - e) / n) ** 0.5 + 1e-9


def test_a_chain_without_room_rejects_the_replicate(spark):
    """Chain A's two mutations clash with certainty if both draw residue 0, and then all of B is drawn again, too."""
    stuck = {"A": {0: [1.0, 0.0, 0.0], 2: [1.0, 0.0, 0.0]}, "B": {1: [0.1, 0.5, 0.4]}}
    residues, edges, rows = _pair(spark, {"A": {0: 1.0, 2: 0.5}, "B": {1: 2.0}}, stuck)
    got = interface.interface_test(residues, edges, Draws(max_draws=100, batch=100), rows).collect()
    assert {(r.status, r.draws, r.p) for r in got} == {(2, 0, None)}
    rng = np.random.default_rng(0)
    calls = []

    def some(r, n):  # every second draw is whole
        calls.append(n)
        return [np.zeros((n, 1)), r.integers(1, 9, (n, 1))], np.arange(n) % 2 == 0

    first, other = nullmodel.whole_draws(some, rng, 8)
    assert calls[:3] == [8, 4, 2]
    assert (other > 0).all() and len(first) == 8
    assert nullmodel.whole_draws(lambda r, n: ([np.zeros((n, 1))], np.zeros(n, bool)), rng, 3) is None


@pytest.mark.parametrize("first_round", [1, 6])
def test_interface_counts_do_not_depend_on_rounds(spark, first_round):
    w = {"A": {0: 1.0, 2: 0.5}, "B": {1: 2.0}}
    vectors = {"A": {0: [0.2, 0.3, 0.5], 2: [0.6, 0.3, 0.1]}, "B": {1: [0.1, 0.5, 0.4]}}
    residues, edges, rows = _pair(spark, w, vectors)
    base = Draws(max_draws=3000, batch=250, first_round=2, tasks=1)
    for v in (None, rows):
        one = interface.interface_test(residues, edges, base, v).collect()
        more = interface.interface_test(residues, edges, replace(base, first_round=first_round, tasks=5), v).collect()
        assert sorted(one) == sorted(more) and len(one) == 3


def test_sites_that_draw_alike_share_one_distribution(spark, points):
    """A row for a distribution, not for each site and residue; both forms of the table draw the same."""
    w = 1 / (1 + F.abs("x"))
    sites = points.filter("v IS NOT NULL").select("structure", F.col("i").alias("site"))
    rows = sites.join(points.select("structure", "i", w.alias("w")), "structure")
    packed = nullmodel.distributions(rows, ["structure"])
    assert sorted((r.structure, len(r.sites), len(r.i)) for r in packed.collect()) == [(f"s{s}", 4, 30) for s in range(6)]
    options = Draws(max_draws=300, batch=100)
    assert sorted(nullmodel.structure_test(points, options=options, vectors=rows).collect()) == sorted(nullmodel.structure_test(points, options=options, vectors=packed).collect())
    unlike = rows.withColumn("w", F.col("w") * (F.col("site") % 2 + 1) + F.when(F.col("i") == F.col("site"), 1.0).otherwise(0.0))
    p, of = nullmodel.own_distributions(nullmodel.distributions(unlike, ["structure"]).filter("structure = 's0'").toPandas(), points.filter("structure = 's0'").toPandas()["i"], np.array([r.site for r in sites.filter("structure = 's0'").collect()]))
    plain_rows = {(r.site, r.i): r.w for r in unlike.filter("structure = 's0'").collect()}
    assert p.shape == (4, 30) and sorted(of) == [0, 1, 2, 3]
    for site, row in zip([r.site for r in sites.filter("structure = 's0'").collect()], of):
        assert [plain_rows[site, i] for i in range(30)] == p[row].tolist()


def test_scores_of_many_residues_from_features():
    """Sums over features are those over all pairs, near and far scales, and pairs are left only where they are less work."""
    rng = np.random.default_rng(2)
    xyz = rng.normal(0, 2.5, (3000, 3)) * [1, 2, 0]
    xyz[:, 2] = 7.0
    index = np.sort(np.array([rng.permutation(3000)[:900] for _ in range(3)]), axis=1)
    values, scales = rng.random((3, 900)), (0.01, 3.0, 6.0, 10.0)
    assert [nullmodel._separable(xyz, s, 900) is None for s in scales] == [True, False, False, False]
    assert nullmodel._separable(xyz, 3.0, 5) is None
    got = nullmodel._score_large(xyz, scales, 900)(index, values)
    assert np.allclose(got, nullmodel._score_apart(xyz, scales, index, values), rtol=1e-11, atol=0)
