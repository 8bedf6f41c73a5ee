import random

import pytest
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.operators import mapping, spectra
from residuum.sources import readers, writers

# chr1, 0-based: two exons that split a codon; the same bases on the other strand give another protein.
GENOME = "tt" + "atggcta" + "ggggg" + "aagactgac" + "ttttt"
EXONS = [(2, 9), (14, 23)]
CODING = GENOME[2:9] + GENOME[14:23]  # 16 bases; 15 of them make five codons


def translate(bases):
    return "".join(K.CODONS[bases[i : i + 3]] for i in range(0, len(bases) - 2, 3))


def turned(bases):
    return bases[::-1].translate(str.maketrans("acgt", "tgca"))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("inputs")
    (d / "genome.fa").write_text(f">chr1 test\n{GENOME[:11].upper()}\n{GENOME[11:]}\n>chr2\nacgt\n")
    back = turned(CODING)
    (d / "proteins.fa").write_text(f">sp|PLUS|x\n{translate(CODING)[:2]}\n{translate(CODING)[2:]}\n>sp|MINUS|y\n{translate(back)}\n")
    (d / "genes.tsv").write_text(
        "chr1\t2\t23\t2-9,14-23\t+\tPLUS\t0.0-2.1,2.1-5.1\t\n" "chr1\t2\t23\t2-9,14-23\t-\tMINUS\t3.0-5.1,0.0-3.0\t16\n"
    )
    return d


def reference(pos, new, strand):
    """Codon of a base found by spelling out the whole transcript."""
    places = [p for s, e in EXONS for p in range(s, e)]
    order = places if strand == "+" else places[::-1]
    if pos - 1 not in order:
        return None
    at = order.index(pos - 1)
    base = (lambda p: GENOME[p]) if strand == "+" else (lambda p: turned(GENOME[p]))
    three = order[at - at % 3 : at - at % 3 + 3]
    if len(three) < 3:
        return None
    old = "".join(map(base, three))
    alt = "".join((new if strand == "+" else turned(new)) if p == pos - 1 else base(p) for p in three)
    return at // 3 + 1, K.CODONS[old], K.CODONS[alt]


def test_every_base_of_both_strands(spark, files):
    rows = [("1", p, GENOME[p - 1].upper(), n.upper(), "s", "t", "SNP", "Silent") for p in range(1, len(GENOME) + 1) for n in "acgt" if n != GENOME[p - 1]]
    rows += [("1", 5, "-", "A", "s", "t", "INS", "Silent"), ("1", 5, "AC", "AG", "s", "t", "DNP", "Silent")]
    muts = spark.createDataFrame(rows, readers.MUTATIONS)
    genes, genome = readers.gene_map(spark, str(files / "genes.tsv")), readers.genome(spark, str(files / "genome.fa"), 8)
    proteins = readers.proteins(spark, str(files / "proteins.fa"))
    assert {r.uniprot: r.seq for r in proteins.collect()} == {"PLUS": translate(CODING), "MINUS": translate(turned(CODING))}
    found = mapping.to_residues(muts, genes, genome, proteins, chunk=8, width=4)
    got = {(r.pos, r.Tumor_Seq_Allele2.lower(), r.uniprot): (r.site, r.aa_ref, r.aa_alt) for r in found.collect()}
    expected = {}
    for p in range(1, len(GENOME) + 1):
        for n in "acgt":
            for strand, name in (("+", "PLUS"), ("-", "MINUS")):
                hit = reference(p, n, strand)
                excluded = name == "MINUS" and p - 1 == 16
                if n != GENOME[p - 1] and hit and not excluded:
                    expected[p, n, name] = hit
    # Bases of the first and last exon whose codon lies whole in known exons.
    assert got == expected


def test_sites_and_spectra(spark, files):
    mapped = spark.createDataFrame([("s", "t", "P", "A", 3, "A"), ("s", "t", "P", "A", 3, "*"), ("s", "t", "P", "A", 4, "V")], "sample string, ttype string, uniprot string, aa_ref string, site int, aa_alt string")
    assert [r.mtype for r in mapping.site_rows(mapped).orderBy("site", "change").collect()] == ["N", "S", "M"]
    assert mapping.site_rows(mapped, ["M"]).first().change == "p.A4V"
    genome = readers.genome(spark, str(files / "genome.fa"), 8)
    muts = spark.createDataFrame([("1", 10, GENOME[9].upper(), "A", "p", "t", "SNP", "Silent"), ("1", 11, "T", "A", "p", "t", "SNP", "Silent")], readers.MUTATIONS)
    wide = spectra.spectrum_pivot(spectra.channel_counts(muts, genome, 8)).first().asDict()
    assert sum(v for k, v in wide.items() if k not in ("patient", "ttype")) == 1


def test_coding_classes(spark):
    frame = spark.createDataFrame([("Silent",), ("Intron",)], "Variant_Classification string")
    assert spectra.coding(frame).count() == 1
    with pytest.raises(Exception, match="unknown class"):
        spectra.coding(spark.createDataFrame([("New_Class",)], "Variant_Classification string")).collect()


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "maps.tsv").write_text("P1\tP1\t1abc-A\t-\t1:1 2:2 3:3 4:4 5:5\nP2\tQ\t1abc-B\tpdb_identity:90.5\t1:-1 2:2\n")
    maps = readers.residue_maps(spark, str(tmp_path / "maps.tsv"))
    assert {r.u1: (r.identity, len(r.resmap)) for r in maps.collect()} == {"P1": (100.0, 5), "P2": (90.5, 2)}
    line = "ATOM      1  CA  ALA A   7      11.104   6.134  -6.504  1.00  0.00           C"
    (tmp_path / "pdb1abc.ent").write_text(f"HEADER\nCOMPND    MOL_ID: 1;\nCOMPND   2 MOLECULE: X;\nCOMPND   3 CHAIN: A, B;\nCOMPND   4 FRAGMENT: KINASE;\n{line}\n")
    atom = readers.atoms(spark, str(tmp_path / "pdb1abc.ent")).first()
    assert (atom.pdb, atom.chain, atom.resnum, atom.resname, atom.x, atom.z) == ("1abc", "A", 7, "ALA", 11.104, -6.504)
    assert readers.atoms(spark, str(tmp_path / "pdb1abc.ent"), ["B"]).count() == 0
    assert {(r.chain, r.fragment) for r in readers.fragments(spark, str(tmp_path / "pdb1abc.ent")).collect()} == {("A", "KINASE"), ("B", "KINASE")}
    (tmp_path / "ptm.tsv").write_text("patient\tvalue\n1\t2\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.ptm_sites(spark, str(tmp_path / "ptm.tsv"))
    (tmp_path / "list.txt").write_text("1abc\n2xyz B:P2:15_A:P1:3\n".replace("_", " "))
    assert {r.name for r in readers.structure_list(spark, str(tmp_path / "list.txt")).collect()} == {"1abc", "2xyz_A_P1_3_B_P2_15"}
    (tmp_path / "results.tsv").write_text("P\tP\t1abc-A\t1\t3/100 4/100\t0\nP\tP\t1abc-A\t1\t1/100 0/100\t1\n")
    assert readers.results(spark, str(tmp_path / "results.tsv")).groupBy("scale_idx").sum("exceed", "draws").orderBy("scale_idx").collect()[0][1:] == (4, 200)
    sites = spark.createDataFrame([("t", "s", "na", "P1", "p.A1V", 1, "M", None)], readers.SITES)
    writers.by_protein(sites, str(tmp_path / "sites"))
    assert spark.read.parquet(str(tmp_path / "sites")).filter("uniprot = 'P1'").count() == 1
    for run in "12":
        writers.append_results(sites.select("site"), str(tmp_path / "runs"), run)
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    (tmp_path / "meta.tsv").write_text("accession\tgene_names\tentrez\tlength\nP1\tABC DEF\t5; 7\t100\n")
    row = readers.gene_metadata(spark, str(tmp_path / "meta.tsv"), {"P1": 641}).first()
    assert row.entrez == [5, 7] and row.length == 641


def test_positions_and_codons_invert_the_mapping(spark, files):
    genes, genome = readers.gene_map(spark, str(files / "genes.tsv")), readers.genome(spark, str(files / "genome.fa"), 8)
    proteins = readers.proteins(spark, str(files / "proteins.fa"))
    positions = mapping.residue_positions(genes)
    for r in positions.collect():
        found = reference(r.pos, "a", r.strand)
        assert found is None or found[0] == r.site
    codons = {(r.uniprot, r.site): r for r in mapping.residue_codons(positions, genome, proteins, 8).collect()}
    assert {k[1] for k in codons if k[0] == "PLUS"} == {1, 2, 3, 4, 5}
    for (name, site), r in codons.items():
        coding = CODING if name == "PLUS" else turned(CODING)
        assert r.codon == coding[3 * site - 3 : 3 * site] and all(len(x) == 3 for x in r.ctx)
    assert mapping.first_gene(positions).select("gene").distinct().count() == 2


def two_bit(sequences):
    """A file as the format's description has it."""
    import struct

    head, records = struct.pack("<4I", 0x1A412743, 0, len(sequences), 0), []
    at = 16 + sum(5 + len(n) for n in sequences)
    for name, seq in sequences.items():
        def runs(test):
            marks = [test(c) for c in seq] + [False]
            starts = [i for i in range(len(seq)) if marks[i] and (i == 0 or not marks[i - 1])]
            sizes = [next(k for k in range(i, len(marks)) if not marks[k]) - i for i in starts]
            return struct.pack(f"<I{2 * len(starts)}I", len(starts), *starts, *sizes)

        codes = ["TCAG".index(c.upper()) if c.upper() in "TCAG" else 0 for c in seq] + [0] * (-len(seq) % 4)
        packed = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(codes), 4))
        record = struct.pack("<I", len(seq)) + runs(lambda c: c in "Nn") + runs(str.islower) + struct.pack("<I", 0) + packed
        head += bytes([len(name)]) + name.encode() + struct.pack("<I", at)
        records.append(record)
        at += len(record)
    return head + b"".join(records)


def test_two_bit_source(spark, tmp_path):
    from residuum.sources.twobit import TwoBit

    sequences = {"chr1": "ACGTNNNNacgtTTGCA", "chrM": "ggA"}
    (tmp_path / "g.2bit").write_bytes(two_bit(sequences))
    spark.dataSource.register(TwoBit)
    rows = spark.read.format("twobit").option("chunk", 5).option("per_task", 2).load(str(tmp_path / "g.2bit")).collect()
    got = {(r.chrom, r.chunk_id): r.seq for r in rows}
    assert got == {(n, k): s[5 * k : 5 * k + 7] for n, s in sequences.items() for k in range(-(-len(s) // 5))}


def test_genome_over_many_splits(spark, tmp_path):
    """Records that begin and end anywhere in the splits of a file, short lines and empty ones."""
    rnd = random.Random(6)
    bases = lambda n: "".join(rnd.choice("ACGTacgtN") for _ in range(n))
    records, text = {}, ""
    for k, size in enumerate([0, 1, 61, 5000, 12000, 3]):
        seq = bases(size)
        records[f"c{k}"] = seq
        text += f">c{k} and more\n"
        at = 0
        while at < size:
            n = rnd.choice([60, 60, 60, 7, 1])
            text += seq[at : at + n] + ("\r\n" if k == 3 else "\n") + ("\n" if rnd.random() < 0.02 else "")
            at += n
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">other\n" + "ACGT" * 50 + "\n")
    records["other"] = "ACGT" * 50
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {(r.chrom, r.chunk_id): r.seq for r in readers.genome(spark, str(tmp_path), 256).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = {(c, k): s[k * 256 : k * 256 + 258] for c, s in records.items() for k in range((len(s) + 255) // 256)}
    assert got == wanted


def test_positions_meet_pieces_of_chunks(spark):
    """Bases at every place of two chunks; no joined row holds a chunk, and none is read beyond the end."""
    text = "".join("ACGT"[(n * 7 + n // 5) % 4] for n in range(300))
    genome = spark.createDataFrame([("c", 0, text[:258]), ("c", 1, text[256:])], "chrom string, chunk_id int, seq string")
    at = spark.range(-1, 310).selectExpr("'c' AS chrom", "id AS at")
    found = mapping.context(at, genome, F.col("at"), 3, "abc", 256)
    assert {r.at: r.abc for r in found.collect()} == {n: text[n : n + 3].lower() for n in range(310)}
    assert "_piece" in found._jdf.queryExecution().optimizedPlan().toString()


def test_channels_of_the_table_equal_the_expression(spark):
    rows = spark.createDataFrame([(a + b + c, n) for a in "acgtn" for b in "acgtn" for c in "acgtn" for n in "acgtn"] + [("", "a"), (None, "a"), ("aca", None)], "abc string, new string")
    found = spectra.with_channel(rows).withColumn("want", C.channel_index(F.col("abc"), F.col("new"))).collect()
    assert len(found) == 628 and all(r.channel == r.want for r in found) and sum(r.channel is not None for r in found) == 192
