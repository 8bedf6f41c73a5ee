"""Sources that open only what is asked for, runs of coverage, medians in rounds, runs that can be repeated."""

import gzip
import random
import statistics

import pytest
from pyspark.sql import functions as F
from residuum.operators import mapping, nullmodel
from residuum.sources import readers, writers
from residuum.sources.structure_files import missing, structure_lines
from residuum.sources.twobit import _touching

from .test_mapping import two_bit


@pytest.fixture
def genome(spark, tmp_path):
    rnd = random.Random(2)
    sequences = {f"chr{c}": "".join(rnd.choice("ACGTacgtNN") for _ in range(997 + c)) for c in range(1, 5)}
    (tmp_path / "g.2bit").write_bytes(two_bit(sequences))
    yield sequences, lambda path: readers.two_bit(spark, path, 100, 4)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_filters_decide_which_chunks_are_read(spark, tmp_path, genome, scheme):
    sequences, load = genome
    path = f"{scheme}{tmp_path}/g.2bit"
    whole = load(path)
    assert {(r.chrom, r.chunk_id): r.seq for r in whole.collect()} == {(c, k): s[100 * k : 100 * k + 102] for c, s in sequences.items() for k in range(-(-len(s) // 100))}
    assert whole.rdd.getNumPartitions() == 4 * 3  # ten or eleven chunks, four a task
    three = load(path).filter("chrom = 'chr2' AND chunk_id IN (1, 5, 9)")
    assert three.rdd.getNumPartitions() == 3
    assert {(r.chrom, r.chunk_id): r.seq for r in three.collect()} == {("chr2", k): sequences["chr2"][100 * k : 100 * k + 102] for k in (1, 5, 9)}
    some = load(path).filter("chrom IN ('chr1', 'chr4', 'none') AND chunk_id >= 2 AND chunk_id < 6 AND seq LIKE '%'")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 8
    assert load(path).filter("chrom = 'none'").count() == 0
    assert load(path).filter("chunk_id > 90").count() == 0


def test_blocks_of_a_chunk_are_found_by_search():
    rnd = random.Random(0)
    starts, sizes, at = [], [], 0
    for _ in range(200):
        at += rnd.randint(1, 30)
        starts.append(at)
        sizes.append(rnd.randint(1, 40))
        at += sizes[-1]
    for begin in range(0, at, 37):
        want = [(s, n) for s, n in zip(starts, sizes) if s < begin + 50 and s + n > begin]
        assert list(_touching(tuple(starts), tuple(sizes), begin, begin + 50)) == want
    assert list(_touching((), (), 0, 9)) == []


def test_structures_are_opened_by_id(spark, tmp_path):
    atom = "ATOM  {:5d}  CA  GLY A{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00"
    for name in ("1abc", "2abx", "9zzz"):
        (tmp_path / name[1:3]).mkdir(exist_ok=True)
        text = "COMPND    MOL_ID: 1;\nCOMPND   2 CHAIN: A;\nCOMPND   3 FRAGMENT: OF " + name.upper() + ";\n" + "\n".join(atom.format(i, i, i, 0, 0) for i in range(1, 4)) + "\n"
        with gzip.open(tmp_path / name[1:3] / f"pdb{name}.ent.gz", "wt") as f:
            f.write(text)
    (tmp_path / "zz" / "pdb9zzz.ent.gz").write_bytes(b"not compressed: never opened")
    ids = spark.createDataFrame([("1abc",), ("2abx",), ("1abc",), ("7nop",), (None,)], "pdb string")
    lines = structure_lines(ids, f"file://{tmp_path}")
    assert [r.pdb for r in missing(lines).collect()] == ["7nop"]
    assert sorted((r.pdb, r.n) for r in lines.filter("n IS NOT NULL").collect()) == [(p, n) for p in ("1abc", "2abx") for n in range(6)]
    found = readers.atoms(spark, str(tmp_path), ids=ids)
    assert sorted((r.pdb, r.resnum, r.x) for r in found.collect()) == [(p, i, float(i)) for p in ("1abc", "2abx") for i in (1, 2, 3)]
    assert sorted((r.pdb, r.chain, r.fragment) for r in readers.fragments(spark, str(tmp_path), ids=ids).collect()) == [("1abc", "A", "OF 1ABC"), ("2abx", "A", "OF 2ABX")]


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    rows = lambda e: spark.createDataFrame([("s", 2, e, 100, 0)], "structure string, scale_idx int, exceed long, draws long, status int")
    path = str(tmp_path / "results")
    for e, run in ((5, "a"), (7, "b"), (5, "a"), (9, "a")):
        writers.append_results(rows(e), path, run)
    (row,) = nullmodel.p_values(spark.read.parquet(path), ["structure"]).collect()
    assert (row.exceed, row.draws) == (16, 200)


def test_keys_from_file_names(spark, tmp_path):
    (tmp_path / "3_P1_Q1_1abc-A_17.txt").write_text("1/10 2/10 3/10\n#0\n4/20 5/20 6/20\n#1\n")
    (tmp_path / "notes.txt").write_text("1/10\n#0\n")
    got = sorted(tuple(r) for r in readers.result_files(spark, str(tmp_path)).collect())
    assert got == [("P1", "Q1", "1abc-A", 17, run, k, run, e, (run + 1) * 10) for run, es in enumerate([(1, 2, 3), (4, 5, 6)]) for k, e in enumerate(es)]


@pytest.mark.parametrize("width", [3, 64])
def test_runs_of_coverage_equal_positions(spark, width):
    rnd = random.Random(width)
    exons = lambda *x: [{"s": s, "e": e} for s, e in x]
    block = lambda aa, phase: {"a0": {"aa": aa, "phase": phase}, "a1": {"aa": 0, "phase": 0}}
    genes = spark.createDataFrame(
        [("chr1", exons((10, 21), (40, 53)), "+", "P", [block(0, 0), block(3, 2)], [12, 44, 45], 1), ("chr2", exons((5, 9), (30, 60)), "-", "Q", [block(10, 0), block(0, 0)], [], 2)],
        "chrom string, exons array<struct<s:long,e:long>>, strand string, uniprot string, blocks array<struct<a0:struct<aa:int,phase:int>,a1:struct<aa:int,phase:int>>>, excluded array<long>, gene long",
    )
    positions, spans = mapping.residue_positions(genes), mapping.residue_spans(genes)
    flat = sorted((r.uniprot, r.site, r.chrom, p + 1) for r in spans.collect() for p in range(r.s, r.e))
    assert flat == sorted((r.uniprot, r.site, r.chrom, r.pos) for r in positions.collect())
    cov = [(c, p, float(rnd.choice([0, 3, 3, 7, -1]))) for c in (1, 2) for p in range(1, 70) if rnd.random() < 0.8]
    coverage = spark.createDataFrame(cov, "chrn int, pos long, cov double")
    runs = nullmodel.runs_of_coverage(coverage, 16)
    assert sorted((r.chrn, p + 1, r["cov"]) for r in runs.collect() for p in range(r.start, r.end)) == sorted(cov)
    number = F.substring("chrom", 4, 1).cast("int").alias("chrn")
    by_position = nullmodel.coverage_weights(positions.select(F.col("uniprot").alias("structure"), F.col("site").alias("i"), number, "pos"), coverage)
    by_run = nullmodel.coverage_by_runs(spans.select(F.col("uniprot").alias("structure"), F.col("site").alias("i"), number, "s", "e"), runs, width)
    a, b = ({(r.structure, r.i): r.weight for r in df.collect()} for df in (by_position, by_run))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("held, buckets", [(1000, 256), (10, 4), (1, 256)])
def test_medians_in_rounds(spark, held, buckets):
    rnd = random.Random(3)
    values = {"even": [rnd.random() for _ in range(300)], "odd": [rnd.gauss(0, 1e-9) for _ in range(301)], "ties": [0.5] * 90 + [1.0] * 90 + [2.0], "far": [10.0 ** rnd.randint(-300, 300) for _ in range(200)], "one": [4.0], "few": [1.0, 2.0], "equal": [7.0] * 500}
    rows = [(k, "x", v) for k, vs in values.items() for v in vs] + [("even", "x", None)]
    frame = spark.createDataFrame(rows, "k string, l string, v double").repartition(5)
    got = {r.k: r.m for r in nullmodel.exact_median(frame, ["k", "l"], "v", "m", held, buckets).collect()}
    assert got == {k: statistics.median(vs) for k, vs in values.items()}
