"""The three tools end to end on a small world."""

import random

import pytest

from residuum import cli
from residuum.functions import constants as K
from residuum.sources import readers, writers


def world(d):
    rnd = random.Random(1)
    codons = [c for c, a in K.CODONS.items() if a != "*"]
    coding = "".join(rnd.choice(codons) for _ in range(40))
    protein = "".join(K.CODONS[coding[i : i + 3]] for i in range(0, 120, 3))
    (d / "genome.fa").write_text(f">chr1\n{'a' * 10}{coding}{'t' * 10}\n")
    (d / "proteins.fa").write_text(f">sp|P1|x\n{protein}\n")
    (d / "genes.tsv").write_text("chr1\t10\t130\t10-130\t+\tP1\t0.0-40.0\t\n")
    names = {v: k for k, v in reversed(list(K.RESIDUE_LETTERS.items()))}
    lines = []
    for i, letter in enumerate(protein):
        x, y, z = (rnd.uniform(-25, 25) for _ in range(3)) if i not in (4, 14, 24) else (1.0 * i / 10, 0.0, 0.0)
        lines.append(f"ATOM  {i + 1:5d}  CA  {names[letter]} A{i + 1:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           C")
    (d / "pdb1abc.ent").write_text("\n".join(lines) + "\n")
    (d / "maps.tsv").write_text("P1\tP1\t1abc-A\t-\t" + " ".join(f"{i}:{i}" for i in range(1, 41)) + "\n")
    rows = ["Chromosome\tStart_position\tReference_Allele\tTumor_Seq_Allele2\tTumor_Sample_Barcode\tttype\tVariant_Type\tVariant_Classification"]
    for s in range(12):
        site = (4, 14, 24)[s % 3]
        pos = 10 + 3 * site + s % 2
        ref = coding[3 * site + s % 2]
        new = next(b for b in "acgt" if b != ref and K.CODONS[coding[3 * site : 3 * site + s % 2] + b + coding[3 * site + s % 2 + 1 : 3 * site + 3]] not in ("*", protein[site]))
        rows.append(f"1\t{pos + 1}\t{ref.upper()}\t{new.upper()}\ts{s}\tT\tSNP\tMissense_Mutation")
    (d / "muts.tsv").write_text("\n".join(rows) + "\n")
    (d / "meta.tsv").write_text("accession\tgene_names\tentrez\tlength\nP1\tABC\t5\t40\n")
    (d / "genes_listed.tsv").write_text("EntrezGeneID\tGeneSymbol\n5\tABC\n")


def test_prep_test_summarize(spark, tmp_path):
    d = tmp_path
    world(d)
    run = lambda *a: {"prep": cli.prep, "test": cli.test, "summarize": cli.summary}[a[0]](spark, cli.parser().parse_args(list(a)))
    run("prep", "--mutations", f"{d}/muts.tsv", "--gene-map", f"{d}/genes.tsv", "--genome", f"{d}/genome.fa", "--proteins", f"{d}/proteins.fa", "--out", f"{d}/prep")
    assert spark.read.parquet(f"{d}/prep/sites").filter("mtype = 'M'").count() == 12
    assert readers.spectra(spark, f"{d}/prep/spectra").select("patient").distinct().count() == 12
    assert readers.spectra(spark, f"{d}/prep/spectra").filter("n > 0").count() == 12
    changes = spark.read.option("sep", "\t").option("header", True).csv(f"{d}/prep/mapped")
    assert changes.count() == 12 and all(r.uniprot_change.startswith("P1:") for r in changes.collect())
    for k in "12":
        run("test", "--sites", f"{d}/prep/sites", "--maps", f"{d}/maps.tsv", "--atoms", f"{d}/pdb1abc.ent", "--out", f"{d}/results", "--max-draws", "1000", "--run", k, "--seed", k, "--weights", f"{d}/prep/weights")
    results = spark.read.parquet(f"{d}/results")
    assert results.count() == 10 and results.filter("scale_idx = 2").groupBy().sum("draws").first()[0] == 2000
    run("summarize", "--results", f"{d}/results", "--sites", f"{d}/prep/sites", "--maps", f"{d}/maps.tsv", "--metadata", f"{d}/meta.tsv", "--genes", f"{d}/genes_listed.tsv", "--out", f"{d}/summary")
    table = readers.summary(spark, f"{d}/summary")
    row = readers.summary_row(table, "ABC").first()
    assert table.columns == writers.SUMMARY_COLUMNS
    assert (row.NSITES, row.SITES, row.UNIPROT_ID, row.UNIPROT_SEQ_LENGTH, row.PDB_FRAGMENT) == (3, "5+15+25", "P1", 40, "NA")
    assert row.P < 0.05 and row.IN_CANCER_GENE_LISTS and row.PERCENT_IDENTITY == 100 and row["PDBID-CHAIN"] == "1abc-A"


def test_samplers_end_to_end(spark, tmp_path):
    """From files to the table of sixteen columns, by sequencing coverage and by spectra."""
    d = tmp_path
    world(d)
    run = lambda *a: {"prep": cli.prep, "test": cli.test, "summarize": cli.summary}[a[0]](spark, cli.parser().parse_args(list(a)))
    run("prep", "--mutations", f"{d}/muts.tsv", "--gene-map", f"{d}/genes.tsv", "--genome", f"{d}/genome.fa", "--proteins", f"{d}/proteins.fa", "--out", f"{d}/prep")
    (d / "cov.tsv").write_text("chrn\tpos\tcov\n" + "".join(f"1\t{p}\t{5 + p % 3}\n" for p in range(11, 131)))
    common = ["--sites", f"{d}/prep/sites", "--maps", f"{d}/maps.tsv", "--atoms", f"{d}/pdb1abc.ent", "--max-draws", "1000", "--gene-map", f"{d}/genes.tsv", "--hill", "2,3"]
    run("test", *common, "--sampler", "coverage", "--coverage", f"{d}/cov.tsv", "--out", f"{d}/coverage")
    run("test", *common, "--sampler", "spectrum", "--coverage", f"{d}/cov.tsv", "--genome", f"{d}/genome.fa", "--proteins", f"{d}/proteins.fa", "--spectra", f"{d}/prep/spectra", "--out", f"{d}/spectrum")
    run("test", *common, "--no-sample-weights", "--weights", f"{d}/prep/weights", "--max-seconds", "0", "--out", f"{d}/short")
    assert {r.draws for r in spark.read.parquet(f"{d}/short").collect()} == {1000}
    for name in ("coverage", "spectrum"):
        rows = spark.read.parquet(f"{d}/{name}")
        assert rows.count() == 5 and rows.filter("status < 2 AND draws > 0").count() == 5
        run("summarize", "--results", f"{d}/{name}", "--sites", f"{d}/prep/sites", "--maps", f"{d}/maps.tsv", "--metadata", f"{d}/meta.tsv", "--genes", f"{d}/genes_listed.tsv", "--out", f"{d}/summary-{name}", "--atoms", f"{d}/pdb1abc.ent")
        row = readers.summary(spark, f"{d}/summary-{name}").first()
        assert row.GENE_NAMES == "ABC" and 0 <= row.P < 0.2
    with pytest.raises(SystemExit):
        run("test", *common, "--sampler", "spectrum", "--out", f"{d}/none")


def test_prep_of_modification_sites(spark, tmp_path):
    (tmp_path / "ptm.tsv").write_text("patient\tuniprot_id\tsite_position\tgeneSymbol\tvariableSites\tvalue\tmtype\tttype\n" + "".join(f"p{i % 3}\tP1\t{i}\tG\tS{i}\t{int(i > 2)}\tA\tT\n" for i in range(9)))
    cli.prep(spark, cli.parser().parse_args(["prep", "--ptm", f"{tmp_path}/ptm.tsv", "--out", f"{tmp_path}/out"]))
    assert spark.read.parquet(f"{tmp_path}/out/sites").count() == 6 and spark.read.parquet(f"{tmp_path}/out/weights").count() == 3
    world(tmp_path)
    cli.test(spark, cli.parser().parse_args(["test", "--sites", f"{tmp_path}/out/sites", "--weights", f"{tmp_path}/out/weights", "--classes", "A", "--maps", f"{tmp_path}/maps.tsv", "--atoms", f"{tmp_path}/pdb1abc.ent", "--out", f"{tmp_path}/tested", "--max-draws", "100"]))
    assert spark.read.parquet(f"{tmp_path}/tested").count() == 5
