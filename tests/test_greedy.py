"""Greedy steps on tables against loops over rows in order."""

import random

import pytest
from pyspark.sql import functions as F
from residuum.operators import greedy, interface, summarize
from residuum.sources.staging import Stage


@pytest.mark.parametrize("seed", range(3))
def test_dropped_rows_are_those_of_a_loop(spark, seed):
    rnd = random.Random(seed)
    links = {(i, rnd.randrange(i)) for i in range(1, 200) for _ in range(rnd.randint(0, 3))} | {(i, i - 1) for i in range(100, 130)}
    kept = []
    for i in range(200):
        if not any((i, k) in links for k in kept):
            kept.append(i)
    frame = spark.createDataFrame(sorted(links), "item long, earlier long")
    got = greedy.dropped(frame, Stage(spark, "test")).collect()
    assert sorted(r["item"] for r in got) == sorted(set(range(200)) - set(kept))


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 470)]
    root = {}
    for n in {x for pair in links for x in pair}:
        root[n] = n
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in greedy.components(frame, Stage(spark, "test")).collect()}
    assert got == {n: r for n, r in root.items() if sum(x == r for x in root.values()) > 1}


def structures(rows, similar=0.9, share=0.5, apart=0.1):
    """``key: (cluster, kept)`` of one protein, by the rule."""
    shared = lambda a, b: max(0, min(a[2], b[2]) - max(a[1], b[1]))
    size = lambda a: a[2] - a[1]

    def near(a, b):
        union = size(a) + size(b) - shared(a, b)
        return union > 0 and shared(a, b) / union > similar

    clusters, chosen = [], []
    for r in sorted(rows, key=lambda r: (-size(r), r[0])):
        home = next((c for c in clusters if sum(near(r, m) for m in c) / len(c) >= share), None)
        clusters.append([r]) if home is None else home.append(r)
    out = {}
    for n, members in enumerate(clusters):
        first = min(members, key=lambda m: (m[3], m[0]))
        if all(not min(size(first), size(c)) or shared(first, c) / min(size(first), size(c)) <= apart for c in chosen):
            chosen.append(first)
        out |= {m[0]: n for m in members}
    return {k: (n, any(k == c[0] for c in chosen)) for k, n in out.items()}


@pytest.mark.parametrize("seed, crowd", [(0, 60), (1, 300), (2, 25)])
def test_representatives_equal_the_rule(spark, seed, crowd):
    rnd = random.Random(seed)
    rows = []
    for protein in ("P", "Q", "R"):
        for i in range(crowd if protein != "R" else 1):
            start = rnd.randrange(200)
            rows.append((protein, f"k{i:04d}", start, start + rnd.choice([0, 9, 30, 31, 32, 60, 61, 63, 66, 300]), round(rnd.random(), 2)))
    frame = spark.createDataFrame(rows, "uniprot string, key string, start int, end int, p double").repartition(4)
    got = {(r.uniprot, r.key): (r.cluster, r.kept) for r in summarize.representatives(frame).collect()}
    expected = {(u, k): v for u in ("P", "Q", "R") for k, v in structures([r[1:] for r in rows if r[0] == u]).items()}
    assert got == expected


def test_equal_ranges_of_one_protein(spark):
    frame = spark.range(3000).select(F.lit("P").alias("uniprot"), F.format_string("%05d", "id").alias("key"), (F.col("id") % 3 * 1000).cast("int").alias("start"), (F.col("id") % 3 * 1000 + 100).cast("int").alias("end"), (F.col("id") / 3000).alias("p"))
    got = summarize.representatives(frame).collect()
    assert len(got) == 3000 and sorted((r.cluster, r.key) for r in got if r.kept) == [(0, "00000"), (1, "00001"), (2, "00002")]
    assert summarize.representatives(frame.limit(0)).count() == 0


def nested(rows, share=0.8):
    homes = []
    for r in sorted(rows, key=lambda r: (-len(set(r[3])), r[0])):
        own = set(r[3])
        if own:
            home = next((h for h in homes if len(own & set(h[0][3])) >= share * len(own)), None)
            homes.append([r]) if home is None else home.append(r)
    return {h[0][0]: (sorted({r[1] for r in h}), sorted({r[2] for r in h})) for h in homes}


SCHEMA = "partner_kind string, uniprot string, key string, pdb string, ligand string, residues array<int>, p double"


@pytest.mark.parametrize("seed, size", [(0, 9), (1, 4), (2, 16)])
def test_nested_interfaces_equal_the_rule(spark, seed, size):
    rnd = random.Random(seed)
    rows = {}
    for protein in ("P", "Q"):
        rows[protein] = [(f"k{i:03d}", f"{i % 9}abc", f"L{i % 4}", rnd.sample(range(24), rnd.randint(0, size)) * (1 + i % 2), i / 10) for i in range(150)]
    frame = spark.createDataFrame([(kind, u, *r) for kind in "LD" for u, own in rows.items() for r in own], SCHEMA).repartition(3)
    got = {(r.partner_kind, r.uniprot, r.key): (r.pdbs, r.ligands) for r in interface.merge_nested(frame).collect()}
    assert got == {(kind, u, k): v for kind in "LD" for u, own in rows.items() for k, v in nested(own).items()}


def test_many_interfaces_of_one_protein(spark):
    """100,000 interfaces: 2,000 windows of residues in nested copies of five sizes, ten times each."""
    i = F.col("id")
    size = 12 - 2 * (i % 5)
    begin = (i / 50).cast("int") * 20 + F.when(i % 2 == 0, 0).otherwise(1)
    rows = spark.range(100_000).select(
        F.lit("L").alias("partner_kind"), F.lit("P").alias("uniprot"), F.format_string("%06d", "id").alias("key"), F.format_string("s%d", i % 7).alias("pdb"), F.format_string("x%d", i % 3).alias("ligand"),
        F.transform(F.sequence(begin, begin + size.cast("int") - 1), lambda x: x.cast("int")).alias("residues"), F.lit(0.5).alias("p"),
    )
    got = {r.key: (r.pdbs, r.ligands) for r in interface.merge_nested(rows).collect()}
    some = rows.filter("id < 500 or id >= 99500").collect()
    expected = nested([(r.key, r.pdb, r.ligand, r.residues) for r in some])
    assert {k: v for k, v in got.items() if k < "000500" or k >= "099500"} == expected
    assert len(got) == len(expected) * 100


def test_equal_p_values_are_split(spark):
    frame = spark.range(5000).select(F.col("id").alias("key"), F.when(F.col("id") % 10 < 9, 0.01).otherwise(F.col("id") / 5000).alias("p"))
    got = {r.key: r.q for r in summarize.bh_fdr(frame, "p", "key").collect()}
    ranked = sorted((r.p, r.key) for r in frame.collect())
    q, low = {}, 1.0
    for i in range(len(ranked), 0, -1):
        low = min(low, ranked[i - 1][0] * len(ranked) / i)
        q[ranked[i - 1][1]] = low
    assert all(got[k] == pytest.approx(x) for k, x in q.items()) and len(got) == 5000
