import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.config import TestSettings
from residuum.operators import interface, nullmodel, spectra, structure, summarize

TestSettings.__test__ = False


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(12):
        xyz = rng.normal(0, 12, (40, 3))
        hit = set(np.argsort((xyz**2).sum(1))[:5]) if s == 0 else set(rng.choice(40, 5, replace=False))
        rows += [(f"s{s}", i, *map(float, xyz[i]), float(rng.integers(1, 4)) if i in hit else None, "LYS" if i % 2 else "SER") for i in range(40)]
    return spark.createDataFrame(rows, "structure string, i int, x double, y double, z double, v double, resname string")


def test_score_equals_pairs_and_clusters_stand_out(points):
    tested = nullmodel.structure_test(points, options=nullmodel.Draws(max_draws=3000)).collect()
    pairs = structure.proximity(points.filter("v IS NOT NULL"), "structure", "i", ["x", "y", "z"], "v").collect()
    expected = {(r.structure, r.scale_idx): r.score for r in pairs}
    assert all(r.score == pytest.approx(expected[r.structure, r.scale_idx]) for r in tested)
    p = {r.structure: r.exceed / r.draws for r in tested if r.scale_idx == 3}
    assert p["s0"] < 0.01 and 0.1 < np.mean([v for k, v in p.items() if k != "s0"]) < 0.9


def test_results_do_not_depend_on_partitions(points):
    run = lambda f: sorted(map(tuple, nullmodel.structure_test(f, options=nullmodel.Draws(max_draws=500, batch=250)).collect()))
    assert run(points) == run(points.repartition(5, "i"))


def test_restricted_and_impossible_draws(points):
    few = nullmodel.structure_test(points.filter("v IS NOT NULL OR i < 2"), names=("XXX",), options=nullmodel.Draws(max_draws=100))
    assert {r.status for r in few.collect()} == {2}
    some = nullmodel.structure_test(points, names=("LYS",), options=nullmodel.Draws(max_draws=200))
    assert {r.draws for r in some.collect()} == {200}


def test_weighted_draws_follow_weights(spark):
    rows = spark.createDataFrame([("g", i, float(w)) for i, w in enumerate([1, 2, 4, 0])], "g string, i int, w double")
    sizes = spark.createDataFrame([("g", 1)], "g string, k int")
    drawn = nullmodel.draw(rows, sizes, nullmodel.replicates(spark, 3000), "g", "i", F.col("w"))
    share = {r.i: r["count"] / 3000 for r in drawn.groupBy("i").count().collect()}
    assert set(share) == {0, 1, 2} and share[2] == pytest.approx(4 / 7, abs=0.03)


def test_collision_free_draws():
    rng = np.random.default_rng(1)
    p = np.array([[0.5, 0.5, 0, 0], [0.5, 0.25, 0.25, 0], [0.0, 0, 0.5, 0.5]])
    drawn = nullmodel._collision_free(rng, p, 500)
    assert all(len(set(row)) == 3 for row in drawn.tolist()) and set(drawn[:, 2]) == {2, 3}
    assert nullmodel._collision_free(rng, np.array([[1.0, 0], [1.0, 0]]), 1) is None


def test_stop_rule():
    assert not nullmodel.may_stop(np.array([17]), 1000, 0.05271) and nullmodel.may_stop(np.array([18]), 1000, 0.05271)


def test_bh_matches_numpy(spark):
    rng = np.random.default_rng(2)
    p = np.round(np.r_[rng.random(300), rng.random(60) / 500, [0, 1, 1]], 4)
    frame = spark.createDataFrame(list(enumerate(p.tolist())), "key int, p double")
    got = {r.key: r.q for r in summarize.bh_fdr(frame, "p", "key").collect()}
    order = np.lexsort((np.arange(len(p)), p))
    ranked = p[order] * len(p) / np.arange(1, len(p) + 1)
    q = np.minimum(1, np.minimum.accumulate(ranked[::-1])[::-1])
    assert all(got[k] == pytest.approx(x) for k, x in zip(order.tolist(), q))
    assert all(got[k] >= x - 1e-12 for k, x in enumerate(p))


def test_representatives(spark):
    rows = [("P", "a", 0, 100, 0.5), ("P", "b", 0, 99, 0.1), ("P", "c", 95, 140, 0.2), ("P", "d", 60, 110, 0.01), ("P", "e", 7, 7, 0.3)]
    frame = spark.createDataFrame(rows, "uniprot string, key string, start int, end int, p double")
    got = {r.key: (r.cluster, r.kept) for r in summarize.representatives(frame).collect()}
    assert got["a"][0] == got["b"][0] and got["b"][1] and not got["a"][1]
    assert not got["d"][1] and got["c"][1] and got["e"][1]


def test_nested_interfaces(spark):
    rows = [("L", "P", "1", "1abc", "X", [1, 2, 3, 4, 5], 0.2), ("L", "P", "2", "2abc", "Y", [1, 2, 3, 4], 0.1), ("L", "P", "3", "3abc", "Z", [4, 5, 6, 7], 0.3), ("L", "P", "4", "4abc", "Z", [], 0.3)]
    frame = spark.createDataFrame(rows, "partner_kind string, uniprot string, key string, pdb string, ligand string, residues array<int>, p double")
    got = {r.key: (r.pdbs, r.ligands) for r in interface.merge_nested(frame).collect()}
    assert got == {"1": (["1abc", "2abc"], ["X", "Y"]), "3": (["3abc"], ["Z"])}
    named = interface.ligand_names(interface.merge_nested(frame), spark.createDataFrame([("X", "water")], "id string, name string"))
    assert {r.key: r.ligand_names for r in named.collect()} == {"1": "water; Y", "3": "Z"}


def test_maps_and_weights(spark):
    pairs = lambda *p: [{"u": u, "p": q} for u, q in p]
    rows = [("a", "P", pairs((1, 1), (2, 2), (3, 3), (4, 4))), ("b", "P", pairs((1, 1), (2, 2), (3, 3), (4, 4), (5, -1))), ("c", "P", pairs((1, 1), (2, 2), (3, 3), (4, 3), (5, 5))), ("d", "Q", pairs((1, 1), (2, 2), (3, 3), (4, 4), (5, 5)))]
    maps = spark.createDataFrame(rows, "structure string, u1 string, resmap array<struct<u:int,p:int>>").withColumns({"u2": F.col("u1"), "pdb_chain": F.lit("1abc-A")})
    sites = spark.createDataFrame([("t", "s", "P", 1, "M", 2.0), ("t", "s", "P", 1, "M", 4.0), ("tx", "r", "P", 1, "M", 1.0), ("t", "s", "P", None, "M", 1.0), ("t", "s", "P", 2, "S", 1.0)], "ttype string, sample string, uniprot string, site int, mtype string, value double")
    kept = structure.usable_maps(maps, sites)
    assert [(r.structure, r.u) for r in kept.orderBy("u").collect()] == [("c", 1), ("c", 2), ("c", 5)]
    assert structure.site_weights(sites).first().weight == 3
    assert structure.site_weights(sites, values=True).first().weight == 3.5
    assert structure.site_weights(sites, ttype="tx").first().weight == 1
    weights = spark.createDataFrame([("t", "s", 0.5), ("tx", "r", 1.0)], "ttype string, sample string, zlog_score double")
    assert structure.site_weights(sites, weights).first().weight == 2.0
    with pytest.raises(Exception, match="no weight for"):
        structure.site_weights(sites, weights.limit(1)).collect()
    assert structure.mutated(kept, structure.site_weights(sites)).first().v == pytest.approx(81 / 97)


def test_centroids_drop_unknown_structures(spark):
    residues = spark.createDataFrame([("a", "1abc-A", 0, 1, 1), ("a", "1abc-A", 1, 2, 2), ("b", "1abc-B", 0, 1, 1)], "structure string, pdb_chain string, i int, u int, p int")
    atoms = spark.createDataFrame([("1abc", "A", 1, "ALA", 0.0, 0.0, 0.0), ("1abc", "A", 1, "ALA", 2.0, 0.0, 0.0), ("1abc", "A", 2, "GLY", 0.0, 0.0, 0.0), ("1abc", "B", 1, "???", 0.0, 0.0, 0.0)], "pdb string, chain string, resnum int, resname string, x double, y double, z double")
    got = structure.residue_centroids(residues, atoms)
    assert [(r.structure, r.i, r.x) for r in got.orderBy("i").collect()] == [("a", 0, 1.0), ("a", 1, 0.0)]


def test_coverage_weights(spark):
    positions = spark.createDataFrame([("s", 0, 1, 10), ("s", 0, 1, 11), ("s", 1, 1, 12), ("s", 2, None, None), ("z", 0, 2, 1), ("z", 1, 2, 2)], "structure string, i int, chrn int, pos long")
    coverage = spark.createDataFrame([(1, 10, 2.0), (1, 11, 4.0), (1, 12, -5.0)], "chrn int, pos long, cov double")
    got = {(r.structure, r.i): r.weight for r in nullmodel.coverage_weights(positions, coverage).collect()}
    assert got == {("s", 0): 1.0, ("s", 1): 0.0, ("s", 2): 0.0, ("z", 0): 0.5, ("z", 1): 0.5}


def test_reachable_channels(spark):
    codons = spark.createDataFrame([("s", 0, "+", "atg", ["aat", "atg", "tga"])], "structure string, i int, strand string, codon string, ctx array<string>")
    rows = nullmodel.residue_channels(codons).collect()
    assert sum(r.mult for r in rows) == 9  # every change of atg alters the amino acid, none makes a stop


def test_interface_masses(spark):
    residues = spark.createDataFrame([("p", c, i, float(i), 0.0, 0.0, 1.0 if i < 3 else None) for c in "AB" for i in range(30)], "pdb string, chain string, resnum int, x double, y double, z double, w double")
    contacts = spark.createDataFrame([("p", "P", "A", "B", s, i) for s in (0, 1) for i in (0, 1)], "pdb string, kind string, c1 string, c2 string, side int, resnum int")
    edges = interface.with_band(contacts, residues, 1.0)
    assert sorted((r.chain, r.resnum, r.direct) for r in edges.collect()) == [(c, i, i < 2) for c in "AB" for i in (0, 1, 2)]
    tested = interface.interface_test(residues.select("pdb", "chain", "resnum", "w"), edges, nullmodel.Draws(max_draws=2000, batch=1000)).collect()
    assert {r.statistic: r.mass for r in tested} == {"side1": 3.0, "side2": 3.0, "total": 6.0}
    assert all(0 < r.p < 0.02 for r in tested)
    assert interface.interface_mass(edges, residues.filter("w IS NOT NULL").select("pdb", "chain", "resnum", "w")).first().mass == 6.0


def test_chain_maps_and_mutations(spark):
    pairs = lambda n, shift: [{"u": u, "p": u + shift} for u in range(1, n)]
    maps = spark.createDataFrame(
        [("P", "-", "1abc-A", "-", pairs(4, 10), 1), ("P", "Q", "1abc-A", "pdb_identity:90", pairs(6, 20), 2), ("P", "Q", "1abc-B", "pdb_identity:90", pairs(3, 0), 3)],
        "u1 string, u2 string, pdb_chain string, attrs string, resmap array<struct<u:int,p:int>>, line int",
    )
    fixed = spark.createDataFrame([("1abc-B", "P", 1)], "pdb_chain string, u1 string, first int")
    assert [r.line for r in interface.chosen_maps(maps).collect()] == [1]
    assert [r.line for r in interface.chosen_maps(maps, fixed).collect()] == [3]
    residues = interface.chain_residues(maps)
    sites = spark.createDataFrame([("T-x", "s", "P", 2), ("T", "s", "P", 2), ("T", "r", "P", None)], "ttype string, sample string, uniprot string, site int")
    weights = spark.createDataFrame([("T", "s", 0.25)], "ttype string, sample string, zlog_score double")
    muts = interface.chain_mutations(residues, sites, weights)
    assert sorted(map(tuple, muts.collect())) == [("1abc", "A", 22, 0.5), ("1abc", "B", 2, 0.5)]
    assert interface.chain_mutations(residues, sites).filter("chain = 'A'").first().w == 2.0
    edges = spark.createDataFrame([("1abc", "P", "A", "B", 0, "A", 22), ("1abc", "P", "A", "B", 1, "B", 2)], "pdb string, kind string, c1 string, c2 string, side int, chain string, resnum int")
    row = interface.mass_lists(edges, muts).first()
    assert (row.masses1, row.masses2) == ("22_0.50", "2_0.50")


def test_listed_mass(spark):
    assert spark.range(1).select(interface.listed_mass(F.lit("3_1.50;7_0.25")).alias("m")).first().m == 1.75


def test_annotation(spark):
    meta = spark.createDataFrame([("P", "ABC DEF", [5, 7], 10), ("Q", "", [5], 20)], "accession string, gene_names string, entrez array<int>, length int")
    genes = spark.createDataFrame([(5, "five"), (7, "seven")], "entrez_id int, symbol string")
    rows = spark.createDataFrame([("P", 3), ("Q", 3), ("R", 3)], "u1 string, n_samples int")
    got = {r.u1: (r.gene, r.symbol) for r in summarize.annotate(rows, meta, genes).collect()}
    assert got == {"P": ("ABC", "seven"), "R": ("NA", None)}
    assert summarize.gene_symbols(meta, genes, first=True).filter("accession = 'P'").first().symbol == "five"


def test_summary(spark):
    coverage = spark.createDataFrame([(1, "P", 0, 100, 3, 4), (2, "P", 0, 98, 3, 4), (3, "Q", 0, 50, 3, 4)], "structure long, u1 string, start int, end int, n_sites long, n_samples long")
    results = spark.createDataFrame([(s, 2, e, 100, 0) for s, e in ((1, 9), (2, 1), (3, 50), (3, 20))], "structure long, scale_idx int, exceed long, draws long, status int")
    meta = spark.createDataFrame([("P", "ABC", [5], 10)], "accession string, gene_names string, entrez array<int>, length int")
    genes = spark.createDataFrame([(5, "five")], "entrez_id int, symbol string")
    got = [(r.structure, r.p, r.q_full, r.q_restricted) for r in summarize.summarize(results, coverage, meta, genes).collect()]
    assert got == [(2, 0.01, 0.02, 0.01), (3, 0.35, 0.35, -1.0)]


def test_rank_weights(spark):
    counts = spark.createDataFrame([("t", s, n) for s, n in (("a", 5), ("b", 5), ("c", 1), ("d", 900))], "ttype string, sample string, mut_count long")
    got = {r.sample: r.rank_score for r in spectra.frequency_weights(counts).collect()}
    assert got == {"c": 0.0, "a": 0.25, "b": 0.5, "d": 0.75}


def test_settings():
    assert TestSettings.from_json('{"scales": [3, 6], "ttype": "A"}').scales == (3, 6)
    for bad in ('{"sampler": "x"}', '{"sampler": "lysine"}', '{"other": 1}', '{"max_draws": 0}'):
        with pytest.raises(ValueError):
            TestSettings.from_json(bad)


def test_maps_that_share_a_line_are_judged_alone(spark):
    """Maps of two proteins have the chain's name and line in common: only the larger ones count."""
    pairs = lambda n, shift: [{"u": u, "p": u + shift} for u in range(n)]
    rows = [("P", pairs(3, 0), 80.0), ("Q", pairs(5, 10), 40.0), ("R", pairs(5, 20), 60.0)]
    maps = spark.createDataFrame([(u, "1abc-A", m, 7, x) for u, m, x in rows], "u1 string, pdb_chain string, resmap array<struct<u:int,p:int>>, line int, identity double")
    assert sorted(r.u1 for r in interface.largest_map(maps).collect()) == ["Q", "R"]
    assert [r.u1 for r in interface.best_map(maps).collect()] == ["R"]
    assert {r.uniprot for r in interface.chain_residues(maps).collect()} == {"Q", "R"}


def test_centres_meet_atoms_once(spark):
    """Residues and atoms are joined once; rows without a structure stay, broken or not, and repeated rows stay repeated."""
    residues = [("s1", "a-A", 1, 11, 1), ("s1", "a-A", 2, 12, 2), ("s2", "a-A", 1, 11, 1), ("s2", "a-A", 3, 13, 3), ("s3", "b-A", 1, 11, 1), ("s3", "b-A", 1, 11, 1), ("s4", "b-A", 1, 11, None), ("s5", None, 1, 11, 1), ("s6", "c", 1, 11, 1), ("s7", "b-B", 1, 11, 1)]
    residues += [(None, "a-A", 1, 11, 1), (None, "a-A", 9, 19, 9), (None, "a-A", 3, 13, 3), ("", "b-A", 2, 12, 2)]
    atoms = [("a", "A", 1, "GLY", 1.0), ("a", "A", 1, "???", 3.0), ("a", "A", 2, "ALA", 5.0), ("a", "A", 3, "GLY", 7.0), ("a", "A", 3, "???", 9.0), ("b", "A", 1, "GLY", None), ("b", "A", 2, "MSE", 2.0), ("b", "A", 2, None, 4.0), ("b", "B", 1, None, 1.0), (None, "A", 1, "GLY", 1.0), ("b", "A", None, "GLY", 1.0)]
    frame = spark.createDataFrame([(*r, 0.0, 0.0) for r in atoms], "pdb string, chain string, resnum int, resname string, x double, y double, z double")
    found = structure.residue_centroids(spark.createDataFrame(residues, "structure string, pdb_chain string, i int, u int, p int"), frame)
    assert found.columns == ["structure", "i", "u", "p", "x", "y", "z", "resname"]
    centres = {}
    for pdb, chain, p, name, x in atoms:
        centres.setdefault((f"{pdb}-{chain}", p), []).append((x, name))

    def centre(r):
        own = centres.get((r[1], r[4]), []) if r[4] is not None else []
        xs, names = [x for x, _ in own if x is not None], [n for _, n in own if n is not None]
        return sum(xs) / len(xs) if xs else None, min(names) if names else None

    broken = {r[0] for r in residues if centre(r)[1] not in ("GLY", "ALA", "MSE")} - {None}
    expected = [(r[0], r[2], *centre(r)) for r in residues if r[0] not in broken]
    got = [tuple(r) for r in found.select("structure", "i", "x", "resname").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and ("s3", 1, None, "GLY") in got and (None, 9, None, None) in got
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # only that with the broken structures
