"""Cases where queries once did less than the whole job."""

import itertools

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from residuum.operators.ranges import in_ranges
from residuum.operators import interface, nullmodel, spectra
from residuum.plans import registry


def test_context_of_whole_texts(spark, tmp_path):
    """Every document, position and kind of character is reached, beyond the first chunk too."""
    texts = {7: "ab", 900: "Été 1\n" * 3, 901: "x" * 9000 + "Yz9", 1203: "q" * 5000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(i, i * 3 % 11, i % 7) for i in range(6000)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    expected, places = {}, set()
    for order, part, line in lines:
        doc = 7 + order % 1197
        if len(texts.get(doc, "")) >= 3:
            at = (order * 7919 + part * 104729 + line) % (len(texts[doc]) - 2)
            places.add((doc, at))
            key = doc, texts[doc][at : at + 3].lower()
            expected[key] = expected.get(key, 0) + 1
    got = registry.queries()["genome_context_whole"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.abc): r.n for r in got} == expected
    assert {doc for doc, _ in places} == {900, 901, 1203} and max(at for _, at in places) > 4096


def test_least_distances_of_every_label(spark, tmp_path):
    rows = [(n, n % 3 if n else None, [float((n * 7 + k * k) % 23) for k in range(12)]) for n in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    atoms = lambda v: [v[k : k + 3] for k in range(0, 12, 3)]
    apart = lambda a, b: min(sum((x - y) ** 2 for x, y in zip(p, q)) for p in atoms(a) for q in atoms(b))
    expected = {(g, i, j): apart(v, w) for i, g, v in rows for j, h, w in rows if g is not None and g == h and i > j}
    got = registry.queries()["min_atom_distance_all"](spark, str(tmp_path)).collect()
    assert {(r.label, r.i, r.j): r.d2 for r in got} == expected
    assert len(got) == len(expected) and {r.label for r in got} == {0, 1, 2}


def test_no_task_ranks_a_whole_group(spark):
    """Ranks of many equal counts are exact, and no range holds more than a few hundredths of them."""
    rows = spark.range(20000).select(
        F.when(F.col("id") % 7 == 0, "b").otherwise("a").alias("ttype"), F.format_string("s%d", "id").alias("sample"),
        F.when(F.col("id") % 10 == 0, F.col("id") % 50).otherwise(1).alias("mut_count"),
    ).filter("mut_count > 0")
    for keys in (["ttype"], []):
        order = [*keys, "mut_count", "sample"]
        largest = in_ranges(rows, order).groupBy(*keys, "_b").count().agg(F.max("count")).first()[0]
        assert largest < rows.count() / 20
        got = spectra.frequency_weights(rows, keys[0] if keys else None)
        w = Window.partitionBy(*keys)
        rank = (F.row_number().over(w.orderBy("mut_count", "sample")) - 1) / F.count("*").over(w)
        wrong = got.join(rows.withColumn("want", rank), "sample").filter("rank_score != want")
        assert got.count() == rows.count() and wrong.count() == 0


def test_tiles_of_pairs_score_like_dense_kernels(monkeypatch):
    rng = np.random.default_rng(1)
    xyz, scales = rng.normal(size=(60, 3)) * 5, (3.0, 6.0, 10.0)
    index = np.stack([rng.permutation(60)[:17] for _ in range(23)])
    values = rng.random(index.shape)
    want = nullmodel._score(nullmodel._kernels(xyz, scales), index, values)
    draw = lambda w: nullmodel._sampler(w, np.arange(60), 17)(np.random.default_rng(2), 23)
    drawn = [draw(None), draw(rng.random(60))]
    for held in (1, 40, 500, 4_000_000):
        monkeypatch.setattr(nullmodel, "_HELD", held)
        np.testing.assert_allclose(nullmodel._score_apart(xyz, scales, index, values), want, rtol=1e-12)
        np.testing.assert_array_equal(draw(None), drawn[0])


def test_large_structure_needs_no_table_of_all_pairs(spark):
    """30,000 residues: all pairs would take 21 GB of differences."""
    at = lambda k: (F.col("id") * k % 101).cast("double")
    rows = spark.range(30000).select(F.lit("big").alias("structure"), F.col("id").alias("i"), at(3).alias("x"), at(7).alias("y"), at(11).alias("z"),
                                     F.when(F.col("id") % 1000 == 0, F.col("id") % 5 + 1.0).alias("v"))
    got = nullmodel.structure_test(rows, options=nullmodel.Draws(max_draws=200, batch=100)).collect()
    assert len(got) == len(nullmodel.Draws().scales) and all(r.draws > 0 and r.score > 0 for r in got)


def test_weighted_interface_draws_shuffle_masses(spark):
    """Heavy residues are drawn first, but the first mutation's mass is not theirs."""
    weights, masses = [8.0, 1.0, 1.0, 1.0], {0: 5.0, 1: 1.0}
    residues = spark.createDataFrame([("s", "A", i, masses.get(i), w) for i, w in enumerate(weights)], "pdb string, chain string, resnum int, w double, weight double")
    edges = spark.createDataFrame([("s", "L", "A", "x", 0, "A", 0, True)], "pdb string, kind string, c1 string, c2 string, side int, chain string, resnum int, direct boolean")
    row = interface.interface_test(residues, edges, nullmodel.Draws(max_draws=40_000, batch=10_000, threshold=0.0)).first()
    total, exact = sum(weights), 0.0  # mass 5 or more at the heavy residue
    for first in range(4):
        for second in range(4):
            if first != second and 0 in (first, second):
                exact += weights[first] / total * weights[second] / (total - weights[first]) / 2
    assert row.mass == 5 and row.draws == 40_000
    assert abs(row.exceed / row.draws - exact) < 4 * (exact * (1 - exact) / row.draws) ** 0.5


def test_structure_test_agrees_with_enumeration(spark):
    """All subsets and orders of the weights of a small structure, uniform and weighted."""
    rng = np.random.default_rng(3)
    xyz, values, weights = rng.normal(size=(7, 3)) * 4, {1: 1.0, 2: 0.4, 5: 0.7}, [1.0, 2.0, 0.5, 1.5, 3.0, 1.0, 0.2]
    kernel = np.exp(-((xyz[:, None] - xyz[None]) ** 2).sum(-1) / 72)
    score = lambda at, v: sum(v[a] * v[b] * kernel[at[a], at[b]] for a in range(3) for b in range(a))
    observed = score(list(values), list(values.values()))
    for weighted in (False, True):
        exact = 0.0
        for drawn in itertools.permutations(range(7), 3):
            p, left = 1.0, sum(weights)
            for i in drawn:
                p *= weights[i] / left if weighted else 1 / (7 - drawn.index(i))
                left -= weights[i]
            orders = list(itertools.permutations(values.values()))
            exact += p * sum(score(drawn, v) >= observed - 1e-12 for v in orders) / len(orders)
        rows = [("s", i, *map(float, xyz[i]), values.get(i), weights[i]) for i in range(7)]
        points = spark.createDataFrame(rows, "structure string, i int, x double, y double, z double, v double, weight double")
        points = points if weighted else points.drop("weight")
        got = nullmodel.structure_test(points, options=nullmodel.Draws(max_draws=40_000, threshold=0.0, scales=(6.0,))).first()
        assert got.draws == 40_000 and abs(got.exceed / 40_000 - exact) < 4 * (exact * (1 - exact) / 40_000) ** 0.5


def test_spectrum_draws_agree_with_enumeration(spark):
    """Each mutation from its own distribution, none twice."""
    xyz = np.array([[0.0, 0, 0], [3, 0, 0], [9, 0, 0], [9, 4, 0]])
    own = {0: [0.1, 0.2, 0.3, 0.4], 1: [0.25, 0.25, 0.4, 0.1]}
    kernel = np.exp(-((xyz[:, None] - xyz[None]) ** 2).sum(-1) / 72)
    exact = total = 0.0
    for order in ((0, 1), (1, 0)):  # mutations are placed in a random order; the later one avoids the earlier
        for a, b in itertools.permutations(range(4), 2):
            p, q = own[order[0]][a], own[order[1]][b] / (1 - own[order[1]][a])
            total += p * q / 2
            exact += p * q / 2 * (kernel[a, b] >= kernel[0, 1] - 1e-12)
    assert abs(total - 1) < 1e-9
    points = spark.createDataFrame([("s", i, *map(float, x), 1.0 if i < 2 else None) for i, x in enumerate(xyz)], "structure string, i int, x double, y double, z double, v double")
    vectors = spark.createDataFrame([("s", m, i, w) for m, ws in own.items() for i, w in enumerate(ws)], "structure string, site int, i int, w double")
    got = nullmodel.structure_test(points, options=nullmodel.Draws(max_draws=4000, threshold=0.0, scales=(6.0,)), vectors=vectors).first()
    assert abs(got.exceed / got.draws - exact) < 4 * (exact * (1 - exact) / got.draws) ** 0.5
