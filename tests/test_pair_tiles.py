"""Sums over the pairs of a group by tiles, against all pairs at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from residuum.operators import structure


def _rows(rng, sizes):
    return [(g, i, *map(float, rng.normal(0, 5, 3)), float(rng.integers(1, 4))) for g, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("block", [4, 37, 512])
def test_tiles_equal_all_pairs(spark, block):
    rows = _rows(np.random.default_rng(0), {"one": 1, "two": 2, "some": 36, "many": 180})
    rows += [("many", 3, 0.0, 0.0, 0.0, 1.0), (None, 1, 0.0, 0.0, 0.0, 1.0)]  # an index twice is no pair of its own
    frame = spark.createDataFrame(rows, "g string, i int, x double, y double, z double, w double").repartition(3)
    got = {r.g: r for r in structure.pair_sums(frame, "g", "i", ["x", "y", "z"], "w", (3.0, 8.0), block).collect()}
    assert set(got) == {"two", "some", "many"}
    for g, r in got.items():
        own = [x for x in rows if x[0] == g]
        pairs = [(a, b) for a in own for b in own if a[1] > b[1]]
        d2 = np.array([sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5])) for a, b in pairs])
        w = np.array([a[5] * b[5] for a, b in pairs])
        assert r.n_pairs == len(pairs)
        for s, have in ((3.0, r.s0), (8.0, r.s1)):
            assert have == pytest.approx((w * np.exp(-d2 / (2 * s * s))).sum())


def test_one_group_is_spread_over_tasks(spark):
    at = lambda k: (F.col("id") * k % 997).cast("double")
    points = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("i"), at(3).alias("x"), at(7).alias("y"), at(11).alias("z"))
    found = structure.pair_sums(points, "g", "i", ["x", "y", "z"], None, (6.0,))
    (row,) = found.collect()
    assert row.n_pairs == 20_000 * 19_999 // 2
    sizes = points.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(40))).groupBy("b").count().agg(F.max("count"), F.min("count")).first()
    assert sizes[0] < 2 * 512 and sizes[1] > 256  # the blocks are even, so tiles are


def test_no_points(spark):
    frame = spark.createDataFrame([], "g string, i int, x double, y double, z double")
    assert structure.pair_sums(frame, "g", "i", ["x", "y", "z"], None).collect() == []
