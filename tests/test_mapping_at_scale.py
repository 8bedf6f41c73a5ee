import random
import re

from residuum.functions import constants as K
from residuum.operators import mapping
from residuum.operators.tally import Tally
from residuum.sources import readers

RNG = random.Random(3)
GENOME = "".join(RNG.choice("acgt") for _ in range(1500))
EXONS = [(5, 705), (800, 830), (900, 1401)]
PLACES = [p for s, e in EXONS for p in range(s, e)]


def turned(bases):
    return bases[::-1].translate(str.maketrans("acgt", "tgca"))


def coding(strand):
    bases = "".join(GENOME[p] for p in PLACES)
    return bases if strand == "+" else turned(bases)


def translate(bases):
    return "".join(K.CODONS[bases[i : i + 3]] for i in range(0, len(bases) - 2, 3))


def gene_line(name, strand):
    order = PLACES if strand == "+" else PLACES[::-1]
    ends = [sorted((order.index(s), order.index(e - 1))) for s, e in EXONS]
    blocks = ",".join(f"{i // 3}.{i % 3}-{j // 3}.{j % 3}" for i, j in ends)
    return f"chr1\t5\t1401\t{','.join(f'{s}-{e}' for s, e in EXONS)}\t{strand}\t{name}\t{blocks}\t\n"


def write(d):
    head = [f.strip().split(" ")[0] for f in readers.MUTATIONS.split(",")]
    rows = [("1", p + 1, GENOME[p].upper(), n.upper(), "s", "t", "SNP", "Silent") for p in range(len(GENOME)) for n in "acgt" if n != GENOME[p]]
    (d / "muts.tsv").write_text("\n".join("\t".join(map(str, r)) for r in [head, *rows]) + "\n")
    (d / "genes.tsv").write_text(gene_line("PLUS", "+") + gene_line("MINUS", "-"))
    (d / "genome.fa").write_text(">chr1\n" + "\n".join(GENOME[i : i + 70] for i in range(0, len(GENOME), 70)) + "\n")
    two = f">sp|PLUS|x\n{translate(coding('+'))}\n"
    (d / "proteins.fa").write_text(two + two + f">sp|MINUS|y\n{translate(coding('-'))}\n")  # one protein is listed twice


def mapped(spark, d, tally=None):
    return mapping.to_residues(
        readers.mutations(spark, str(d / "muts.tsv")), readers.gene_map(spark, str(d / "genes.tsv")),
        readers.genome(spark, str(d / "genome.fa"), 100), readers.proteins(spark, str(d / "proteins.fa")), 100, tally=tally,
    )


def test_mutations_are_read_once(spark, tmp_path):
    write(tmp_path)
    plan = mapped(spark, tmp_path)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*Tumor_Sample_Barcode", plan)) == 1


def test_exons_longer_than_a_piece(spark, tmp_path):
    write(tmp_path)
    tally = Tally()
    got = sorted((r.uniprot, r.pos, r.Tumor_Seq_Allele2.lower(), r.site, r.aa_ref, r.aa_alt) for r in mapped(spark, tmp_path, tally).collect())
    expected = []
    for name, strand, copies in (("PLUS", "+", 2), ("MINUS", "-", 1)):
        bases = coding(strand)
        for i, p in enumerate(PLACES if strand == "+" else PLACES[::-1]):
            three = bases[i - i % 3 : i - i % 3 + 3]
            for n in set("acgt") - {GENOME[p]}:
                made = n if strand == "+" else turned(n)
                if len(three) == 3:
                    alt = three[: i % 3] + made + three[i % 3 + 1 :]
                    expected += copies * [(name, p + 1, n, i // 3 + 1, K.CODONS[three], K.CODONS[alt])]
    assert got == sorted(expected)
    # a protein listed twice gives its rows twice, but a mutation is in its exon once
    counts, whole = tally.counts(), len(PLACES) // 3 * 3 * 3
    assert [counts[s] for s in ("mutations", "single bases", "in exons")] == [4500, 4500, 2 * 3 * len(PLACES)]
    assert [counts[s] for s in ("whole codons", "known proteins", "same amino acid")] == [2 * whole, 3 * whole, len(expected)]
