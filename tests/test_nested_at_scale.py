from residuum.operators import interface


def test_interfaces_are_read_once_and_equal_ones_share_a_home(spark):
    seen = spark.sparkContext.accumulator(0)
    sets = {"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 4, 5], "c": [5, 4, 3, 2, 2], "d": [9], "e": [], "f": [9]}
    rows = [("L", u, u + k, f"{k}-{u}", f"x{len(set(r))}", r) for u in ("U1", "U2") for k, r in sets.items()] + [("L", None, "n", "n", "x", [1])]

    def passed(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    schema = "partner_kind string, uniprot string, key string, pdb string, ligand string, residues array<int>"
    merged = interface.merge_nested(spark.createDataFrame(rows, schema).mapInPandas(passed, schema))
    got = {(r.uniprot, r.key): (r.pdbs, r.ligands, list(r.residues)) for r in merged.collect()}
    expected = {}
    for u in ("U1", "U2"):
        expected[u, u + "a"] = ([f"a-{u}", f"b-{u}", f"c-{u}"], ["x4", "x5"], sets["a"])
        expected[u, u + "d"] = ([f"d-{u}", f"f-{u}"], ["x1"], sets["d"])
    assert got == expected
    assert seen.value == len(rows)
