"""The interface tools from files to all tables on a small world."""

import itertools
import random

import pytest
from residuum import cli
from residuum.functions import constants as K
from residuum.operators import interface, interface_tables
from residuum.sources import writers

from .test_cli import world


def faces(spark, d):
    """Structures 1abc (native chains of P1 and P2) and 2abc (alignments of P1 and P3), with contacts and ligands."""
    names = {v: k for k, v in reversed(list(K.RESIDUE_LETTERS.items()))}
    for pdb, chains in (("1abc", "AB"), ("2abc", "AC")):
        lines = [f"ATOM  {n:5d}  CA  {names['G']} {c}{i:4d}    {3.8 * i:8.3f}{10.0 * (c != 'A'):8.3f}{0:8.3f}  1.00  0.00" for n, (c, i) in enumerate(itertools.product(chains, range(1, 41)))]
        (d / f"pdb{pdb}.ent").write_text("\n".join(lines) + "\n")
    whole = " ".join(f"{i}:{i}" for i in range(1, 41))
    (d / "faces.tsv").write_text(f"P1\t-\t1abc-A\t-\t{whole}\nP2\t-\t1abc-B\t-\t{whole}\nP1\tQ1\t2abc-A\tpdb_identity:95\t{whole}\nP3\tQ3\t2abc-C\tx:1 pdb_identity:90\t{whole}\nP4\tQ4\t1abc-B\tpdb_identity:85\t{whole}\n")
    rows = [("1abc", "P", "A", "B", s, i) for s in (0, 1) for i in range(1, 9)] + [("2abc", "P", "A", "C", s, i) for s in (0, 1) for i in range(20, 26)]
    rows += [("1abc", "L", "A", "A_1_ATP", 0, i) for i in range(1, 7)] + [("1abc", "L", "A", "A_2_ADP", 0, i) for i in range(1, 6)] + [("1abc", "L", "A", "A_3_SO4", 0, 30), ("1abc", "D", "B", "B_0_DNA", 0, 4)]
    (d / "contacts.tsv").write_text("pdb\tkind\tc1\tc2\tside\tresnum\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    (d / "complexes.tsv").write_text("#complexes\t\t\nid\tname\tmembers\nc1\tx\tE1,E3\n")
    (d / "entries.tsv").write_text("E1\tP1\nE3\tP3\n")
    sites = [("T", f"s{k}", "na", u, f"p.G{i}A", i, "M", None) for u, hot in (("P1", (2, 4, 6)), ("P2", (3, 30)), ("P3", (22, 39))) for k, i in enumerate(hot * 2)]
    frame = spark.createDataFrame(sites, "ttype string, sample string, filler string, uniprot string, change string, site int, mtype string, value double")
    writers.by_protein(frame, f"{d}/sites")
    (d / "meta.tsv").write_text("accession\tgene_names\tentrez\tlength\nP1\tABC X\t5\t40\nP2\tDEF\t6\t41\nP3\tGHI;\t7\t42\n")
    (d / "genes_listed.tsv").write_text("EntrezGeneID\tGeneSymbol\n5\tABC\n")
    (d / "ligands.tsv").write_text("ATP\tx\ttriphosphate\n")


def table(spark, path):
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def test_select_test_summarize(spark, tmp_path):
    d = tmp_path
    faces(spark, d)
    run = lambda *a: cli.STEPS[a[0]](spark, cli.parser().parse_args(list(a)))
    run("select", "--maps", f"{d}/faces.tsv", "--contacts", f"{d}/contacts.tsv", "--complexes", f"{d}/complexes.tsv", "--entries", f"{d}/entries.tsv", "--out", f"{d}/lists")
    lines = {n: sorted(r.value for r in spark.read.text(f"{d}/lists/{n}").collect()) for n in ("native", "interlogs", "highIdentity", "POhighIdentity")}
    assert lines == {"native": ["1abc"], "interlogs": ["2abc A:P1:1_C:P3:1"], "highIdentity": ["1abc A:P1:1_B:P4:1"], "POhighIdentity": []}
    common = ["--maps", f"{d}/faces.tsv", "--contacts", f"{d}/contacts.tsv", "--sites", f"{d}/sites", "--atoms", f"{d}/*.ent", "--out", f"{d}/faces", "--max-draws", "2000", "--reach", "4"]
    for k, name in enumerate(("native", "interlogs", "native")):
        run("interface-test", "--list", f"{d}/lists/{name}", *common, "--run", str(k % 2))  # the last replaces the first
    rows = spark.read.parquet(f"{d}/faces")
    assert rows.columns[:30] == interface_tables.WIDE
    got = {(r.pdb, r.kind, r.c2): r for r in rows.collect()}
    assert set(got) == {("1abc", "P", "B"), ("2abc", "P", "C"), ("1abc", "L", "A_1_ATP"), ("1abc", "L", "A_2_ADP"), ("1abc", "L", "A_3_SO4"), ("1abc", "D", "B_0_DNA")}
    one = got["1abc", "P", "B"]
    assert (one.u1, one.u2, one.mass1, one.mass2, one.mass, one.mapped1, one.iface1) == ("P1", "P2", 6.0, 2.0, 8.0, 40, 8)
    assert one.residues1 == ";".join(map(str, range(1, 10))) and one.direct1 == ";".join(map(str, range(1, 9))) and one.masses1 == "2_2.00;4_2.00;6_2.00"
    # all of P1's three residues among the nine of the interface, one of P2's two
    expected = 9 * 8 * 7 / (40 * 39 * 38)
    assert one.p1 == pytest.approx(expected, abs=4 * (expected / 2000) ** 0.5 + 1 / 2000)
    outside = 31 * 30 / (40 * 39)
    assert one.p2 == pytest.approx(1 - outside, abs=0.05)
    assert got["2abc", "P", "C"].mass1 == 0.0 and got["2abc", "P", "C"].p1 == 1.0

    run("interface-summarize", "--results", f"{d}/faces", "--maps", f"{d}/faces.tsv", "--metadata", f"{d}/meta.tsv", "--genes", f"{d}/genes_listed.tsv", "--ligands", f"{d}/ligands.tsv", "--out", f"{d}/tables")
    pairs = {(r.u1, r.u2): r for r in table(spark, f"{d}/tables/PPI").collect()}
    assert set(pairs) == {("P1", "P2"), ("P1", "P3")}
    first, second = (float(pairs[k].p) for k in (("P1", "P2"), ("P1", "P3")))
    assert float(pairs["P1", "P2"].q) == pytest.approx(min(2 * first, second)) and float(pairs["P1", "P2"].q_restricted) == pytest.approx(min(2 * first, second))
    assert (pairs["P1", "P2"].gene1, pairs["P1", "P2"].list1, pairs["P1", "P2"].length2, pairs["P1", "P3"].identity2, pairs["P1", "P3"].gene2) == ("ABC", "ABC", "41", "90.0", "GHI")
    proteins = {r.uniprot: r for r in table(spark, f"{d}/tables/PPI_perProtein").collect()}
    assert set(proteins) == {"P1", "P2", "P3"} and float(proteins["P1"].p) == pytest.approx(one.p1)
    assert float(proteins["P1"].q_restricted) == pytest.approx(one.p1) and float(proteins["P2"].q_restricted) == -1
    ligands = table(spark, f"{d}/tables/PLI").collect()
    assert [(r.u1, r.c2, r.ligands, r.gene2, r.gene1) for r in ligands] == [("P1", "A_1_ATP", "ADP,ATP", "ADP; triphosphate", "ABC")]  # the smaller one is merged, the solvent gone
    assert [(r.u1, r.u2, r.q_restricted) for r in table(spark, f"{d}/tables/PdI").collect()] == [("P2", "DNA", "-1.0")]
    assert table(spark, f"{d}/tables/PRI").count() == 0


def test_samplers_of_interfaces(spark, tmp_path):
    """Coverage and spectra of one chain's protein, from files."""
    d = tmp_path
    world(d)
    run = lambda *a: cli.STEPS[a[0]](spark, cli.parser().parse_args(list(a)))
    run("prep", "--mutations", f"{d}/muts.tsv", "--gene-map", f"{d}/genes.tsv", "--genome", f"{d}/genome.fa", "--proteins", f"{d}/proteins.fa", "--out", f"{d}/prep")
    dropped = {r.step: (r.n, r.dropped) for r in table(spark, f"{d}/prep/dropped/sites").collect()}
    assert dropped["mutations"] == ("12", None) and dropped["same amino acid"] == ("12", "0") and list(dropped) == ["mutations", "single bases", "in exons", "whole codons", "known proteins", "same amino acid"]
    (d / "list").write_text("1abc\n")
    (d / "contacts.tsv").write_text("pdb\tkind\tc1\tc2\tside\tresnum\n" + "".join(f"1abc\tL\tA\tA_1_ATP\t0\t{i}\n" for i in range(1, 16)))
    (d / "runs.tsv").write_text("chrn\tstart\tend\tcov\n1\t0\t60\t5\n1\t60\t200\t1\n")
    common = ["--list", f"{d}/list", "--maps", f"{d}/maps.tsv", "--contacts", f"{d}/contacts.tsv", "--sites", f"{d}/prep/sites", "--weights", f"{d}/prep/weights", "--atoms", f"{d}/pdb1abc.ent", "--max-draws", "2000", "--reach", "0.1"]
    genes = ["--gene-map", f"{d}/genes.tsv", "--coverage", f"{d}/runs.tsv", "--coverage-format", "runs"]
    spectrum = ["--genome", f"{d}/genome.fa", "--proteins", f"{d}/proteins.fa", "--spectra", f"{d}/prep/spectra"]
    run("interface-test", *common, "--out", f"{d}/uniform")
    run("interface-test", *common, *genes, "--sampler", "coverage", "--out", f"{d}/coverage")
    run("interface-test", *common, *genes, *spectrum, "--sampler", "spectrum", "--out", f"{d}/spectrum")
    p = {n: spark.read.parquet(f"{d}/{n}").first() for n in ("uniform", "coverage", "spectrum")}
    assert {r.mass for r in p.values()} == {p["uniform"].mass} and p["uniform"].mass > 0
    assert p["coverage"].p > p["uniform"].p  # the interface lies where coverage is five times that of the rest
    assert 0 < p["spectrum"].p <= 1
    with pytest.raises(SystemExit):
        run("interface-test", *common, "--sampler", "spectrum", "--out", f"{d}/none")


def test_atoms_are_listed_in_few_cubes(spark):
    """Contacts of atoms on and beside the borders of cubes equal all pairs; an atom no longer has 27 places."""
    rng = random.Random(3)
    rows = [("p", "ABC"[n % 3], n, *(rng.choice((0.0, 1.0, 4.0, 15.9, 16.0, -4.0, -16.0)) + rng.choice((0.0, 0.5)) for _ in "xyz")) for n in range(150)]
    atoms = spark.createDataFrame(rows, "pdb string, chain string, resnum int, x double, y double, z double")
    met = [(a, b) for a in rows for b in rows if a[1] < b[1] and sum((p - q) ** 2 for p, q in zip(a[3:], b[3:])) <= 16]
    found = interface.atom_contacts(atoms)
    assert {tuple(r) for r in found.collect()} == {("p", "P", a[1], b[1], s, (a, b)[s][2]) for a, b in met for s in (0, 1)}
    listed = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "inline" in x]
    assert len(listed) == 1  # the two sides of a contact; places are no list of 27


def test_places_of_atoms_are_shuffled_once(spark):
    """Both sides of the join with cubes are one exchange; odd rows and rows at the ends of cubes give the pairs of loops."""
    rng = random.Random(9)
    edge = lambda: rng.choice((0.0, 18.0, -18.0, 36.0, -0.0, 14.0)) + rng.choice((0.0, 4.0, -4.0, 3.9999999, 1e-9, -1e-9, 0.5))
    rows = [(rng.choice("pq"), rng.choice(("A", "B", "C")), n % 90, edge(), edge(), edge()) for n in range(240)]
    rows += rows[:40]  # repeated
    rows += [("p", "A", 200, x, 0.0, 0.0) for x in (float("nan"), float("inf"), float("-inf"), 1e300, -1e18, None)]
    rows += [("p", "B", 201, x, 0.0, 0.0) for x in (float("nan"), float("inf"), float("-inf"), 1e300, -1e18, None)]
    rows += [(None, "A", 300, 0.0, 0.0, 0.0), (None, "B", 301, 0.0, 0.0, 0.0), ("p", None, 302, 0.0, 0.0, 0.0), ("q", "A", None, 0.0, 0.0, 0.0), ("q", "", 303, 0.0, 0.0, 0.0), ("", "A", 304, 5.0, 5.0, 5.0), ("", "B", 305, 5.0, 5.0, 5.0)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[3:], b[3:]))
    able = [r for r in rows if None not in r[:2] and None not in r[3:]]
    met = [(a, b) for a in able for b in able if a[0] == b[0] and a[1] < b[1] and abs(a[3] - b[3]) <= 4 and far(a, b) <= 16]
    atoms = spark.createDataFrame(rows, "pdb string, chain string, resnum int, x double, y double, z double")
    found = interface.atom_contacts(atoms)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a[0], "P", a[1], b[1], s, (a, b)[s][2]) for a, b in met for s in (0, 1)}
    assert {200, 201, None, 303, 304} <= {r[5] for r in got} and not {300, 301, 302} & {r[5] for r in got}
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
