"""Least distances between residues by tiles, against all pairs of atoms at once."""

import duckdb
import numpy as np
import pytest

from residuum.operators import structure
from residuum.plans import registry


@pytest.mark.parametrize("block", [1000, 7])
def test_tiles_equal_all_pairs(spark, block):
    """Residues of one to three atoms, one of them without a place, in blocks that meet themselves and each other."""
    rng = np.random.default_rng(4)
    atoms = [(s, "A", i * 3, "ALA", *map(float, rng.normal(size=3))) for s, n in (("p", 40), ("q", 1), ("r", 9)) for i in range(n) for _ in range(1 + i % 3)]
    atoms.append(("p", "A", 6, "ALA", None, 0.0, 0.0))
    residues = spark.createDataFrame(sorted({(s, f"{s}-A", r, r) for s, _, r, *_ in atoms}), "structure string, pdb_chain string, p int, i int")
    frame = spark.createDataFrame(atoms, "pdb string, chain string, resnum int, resname string, x double, y double, z double")
    at = {}
    for s, _, r, _, *xyz in atoms:
        if None not in xyz:
            at.setdefault((s, r), []).append(xyz)
    want = {(s, i, j): min(sum((a - b) ** 2 for a, b in zip(p, q)) for p in at[s, i] for q in at[s, j]) for s, i in at for t, j in at if s == t and i > j}
    got = {(r.structure, r.i, r.j): r.d2 for r in structure.least_atom_distance(residues, frame, block).collect()}
    assert got == pytest.approx(want)
    near = structure.nearest_before(residues, frame, block).collect()
    assert {(r.structure, r.i): r.n for r in near} == {(s, i): sum(a == s and b == i for a, b, _ in want) for s, i, _ in want}
    assert {(r.structure, r.i): r.d2 for r in near} == pytest.approx({(s, i): min(d for (a, b, _), d in want.items() if (a, b) == (s, i)) for s, i, _ in want})


def test_distances_make_no_row_for_a_pair(spark):
    """The nearest residue before each of 6,000: no step of the plan joins residues with residues."""
    rows = [("s", "s-A", i, i) for i in range(6000)]
    residues = spark.createDataFrame(rows, "structure string, pdb_chain string, p int, i int")
    atoms = residues.selectExpr("'s' AS pdb", "'A' AS chain", "p AS resnum", "'ALA' AS resname", "cast(i AS double) AS x", "0D AS y", "0D AS z")
    found = structure.nearest_before(residues, atoms)
    assert found.filter("n = i AND d2 = 1").count() == 5999 == found.count()


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_pairs_equal_sql_to_the_last_bit(spark, tmp_path, scale):
    """Halves at the sixth digit, places that are null, NaN or far away: as the SQL has them, near the origin and where products are too coarse."""
    rng = np.random.default_rng(6)
    near = lambda n: rng.integers(0, 40, 12) * 0.0005 if n % 2 else np.float32(0.3) + rng.integers(0, 4, 12) / 16
    rows = [(n, n % 2, (near(n) * scale).tolist()) for n in range(300)]
    odd = [[None] * 12, [0.5, None, 0.5] * 4, [float("nan")] * 12, [1.0, 2.0, 3.0] + [float("nan")] * 9, [1e18] * 12, [float("inf")] * 12, [0.25] * 4, None]
    rows += [(1000 + n, 2, v) for n, v in enumerate(odd)] + [(2000 + n, 2, [n / 8] * 12) for n in range(9)] + [(2004, 2, [9.0] * 12), (None, 2, [0.0] * 12), (5, None, [0.0] * 12)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("min_atom_distance_all", "min_atom_distance"):
        want = sorted(repr(r) for r in con.execute(registry.oracle_sql()[name]).fetchall())
        assert sorted(repr(tuple(r)) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == want
        assert any("nan" in r for r in want) and any("None" in r for r in want)


def test_a_residue_leaves_python_as_a_row_of_arrays(spark):
    """Pairs are not handed over one by one: a row for each residue and block that it comes after, in both roundings."""
    rows = [("s", "s-A", i, i) for i in range(500)]
    residues = spark.createDataFrame(rows, "structure string, pdb_chain string, p int, i int")
    atoms = residues.selectExpr("'s' AS pdb", "'A' AS chain", "p AS resnum", "'ALA' AS resname", "cast(i AS double) AS x", "0D AS y", "0D AS z")
    batches = structure._atom_tiles(residues, atoms, 100).toArrow().to_batches()
    out = list(structure._least_distances(False)(iter(batches)))
    assert sum(b.num_rows for b in out) <= 500 * 5
    assert sum(len(b.column(3).flatten()) for b in out) == 500 * 499 // 2
    for digits in (None, 6):
        assert structure.least_atom_distance(residues, atoms, 100, digits).filter("d2 = (i - j) * (i - j)").count() == 500 * 499 // 2


def test_halves_are_rounded_by_exact_distances(spark):
    """Places of a grid off the origin: products err, distances are exact, and a quarter of them are halves at the sixth digit."""
    places = [(0.3 + a / 16, 0.3 + b / 16, 0.3 + c / 16) for a in range(4) for b in range(4) for c in range(4)]
    residues = spark.createDataFrame([("s", "s-A", i, i) for i in range(64)], "structure string, pdb_chain string, p int, i int")
    atoms = spark.createDataFrame([("s", "A", i, "ALA", *p) for i, p in enumerate(places)], "pdb string, chain string, resnum int, resname string, x double, y double, z double")
    sixteenths = lambda i, j: sum((i // k % 4 - j // k % 4) ** 2 for k in (1, 4, 16))
    want = {(i, j): np.floor(sixteenths(i, j) / 256 * 1e6 + 0.5) / 1e6 for i in range(64) for j in range(i)}
    assert {(r.i, r.j): r.d2 for r in structure.least_atom_distance(residues, atoms, digits=6).collect()} == want
