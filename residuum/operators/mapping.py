"""Genomic mutations to protein residues."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.operators.tally import Tally, counted


def snps(muts: DataFrame) -> DataFrame:
    """both alleles are one base."""
    one = lambda c: (F.col(c) != "-") & (F.length(c) <= 1)
    return muts.filter(one("Reference_Allele") & one("Tumor_Seq_Allele2"))


def binned_join(
    points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int
) -> DataFrame:
    """Inner join of positions with half-open ranges, equal ``keys`` and ``start <= at < end``.

    Ranges are listed in every bin of ``width`` positions that they touch, so the
    join has an equality that Spark can hash, and one crowded key is spread over
    its bins.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    listed = ranges.filter(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
    placed = points.withColumn("_bin", F.floor(F.col(at) / width))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return placed.join(listed, [*keys, "_bin"]).filter(inside).drop("_bin")


def context(muts: DataFrame, genome: DataFrame, at: Column, length: int, name: str, chunk: int) -> DataFrame:
    """Lower-case bases from 0-based ``at`` on; chunks overlap by two bases, so up to three never span more.

    Positions meet pieces of a chunk, not the whole chunk: a character of a long text is found by counting from its
    start, and filters on what is made of the bases repeat that for each mention.
    """
    step = max(64, chunk // 64)
    each = -(-chunk // step)  # pieces of a chunk; beyond the end of the chromosome they are empty
    number = F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("_n")
    cut = genome.select("chrom", F.col("chunk_id").cast("long").alias("_chunk"), "seq", number)
    cut = cut.select("chrom", (F.col("_chunk") * each + F.col("_n")).alias("_piece"), F.substring(F.col("seq"), F.col("_n") * step + 1, F.lit(step + 2)).alias("_seq"))
    inside = F.pmod(at, F.lit(chunk))
    muts = muts.withColumn("_piece", F.floor(at / chunk) * each + F.floor(inside / step))  # one number, by which rows are sorted first
    bases = F.lower(F.substring(F.col("_seq"), (inside % step + 1).cast("int"), F.lit(length)))
    return muts.join(cut, ["_piece", "chrom"]).withColumn(name, bases).drop("_seq", "_piece")


def to_residues(
    muts: DataFrame, genes: DataFrame, genome: DataFrame, proteins: DataFrame, chunk: int = 65536, width: int = 65536, tally: Tally | None = None
) -> DataFrame:
    """One row per mutation and protein residue.

    A mutation falls into the first exon of each gene that holds it. Its codon is
    read in genomic order; bases beyond the exon come from the exon
    next to it, and a codon that would reach past the first or last exon is
    dropped. So is one whose amino acid is not the protein's. Bases and amino acids are joined to
    pieces of exons, so a mutation is read and moved once. ``tally`` counts the rows that
    reach each step.
    """
    muts = muts.select("Tumor_Sample_Barcode", "ttype", "Chromosome", "Start_position", "Reference_Allele", "Tumor_Seq_Allele2")
    muts = counted(tally, snps(counted(tally, muts, "mutations")), "single bases").withColumn("chrom", C.chromosome_name(F.col("Chromosome"))).withColumn("p0", F.col("Start_position") - 1)
    step = min(width, _PIECE)
    inside = F.col("p0").between(F.col("lo"), F.col("hi") - 1) & ~F.array_contains("excluded", F.col("p0"))
    first = (F.size("earlier") == 0) | ~F.exists("earlier", lambda x: (F.col("p0") >= x["s"]) & (F.col("p0") < x["e"]))
    placed = muts.withColumn("_bin", F.floor(F.col("p0") / step))
    hit = placed.join(_exon_pieces(genes, genome, proteins, chunk, step), ["_bin", "chrom"]).filter(inside & first)

    at = F.col("c0") + F.when(F.col("plus"), F.col("p0")).otherwise(-F.col("p0"))  # number of the coding base
    hit = hit.withColumn("at", at).withColumn("aa0", F.floor(F.col("at") / 3)).withColumn("r", (F.col("at") - 3 * F.col("aa0")).cast("int"))
    hit = hit.withColumn("r", F.when(F.col("plus"), F.col("r")).otherwise(2 - F.col("r"))).withColumn("b0", F.col("p0") - F.col("r"))
    whole = (F.col("b0") >= F.col("from")) & (F.col("b0") + 2 < F.col("upto"))
    codon = F.substring(F.col("bases"), (F.col("b0") - F.col("from") + 1).cast("int"), F.lit(3))
    letter = F.when(F.col("aa0") >= F.col("a0"), F.substring(F.col("letters"), (F.col("aa0") - F.col("a0") + 1).cast("int"), F.lit(1)))
    hit = hit.select(
        "Tumor_Sample_Barcode", "ttype", "chrom", "p0", "Reference_Allele", "Tumor_Seq_Allele2", "uniprot", "plus", "aa0", "r", whole.alias("whole"),
        F.when(whole, codon).alias("codon"), letter.alias("letter"), "copy", F.col("letters").isNotNull().alias("known"),
    )
    hit = counted(tally, hit, "in exons", F.col("copy") == 0)
    hit = counted(tally, hit.filter("whole"), "whole codons", F.col("copy") == 0)
    hit = counted(tally, hit.filter(F.col("known") & ~F.contains("codon", F.lit(_ABSENT))), "known proteins")
    found = (
        hit.withColumn("new", F.lower("Tumor_Seq_Allele2"))
        .join(F.broadcast(_changed(hit.sparkSession)), ["plus", "codon", "r", "new"])
        .filter("aa_ref = letter")
        .select(
            F.col("Tumor_Sample_Barcode").alias("sample"), "ttype", "chrom", (F.col("p0") + 1).alias("pos"),
            "Reference_Allele", "Tumor_Seq_Allele2", "uniprot", "aa_ref", (F.col("aa0") + 1).cast("int").alias("site"), "aa_alt",
        )
    )
    return counted(tally, found, "same amino acid")


_PIECE = 256  # bases of an exon or of the genome in a row
_ABSENT = "?"  # a base whose chunk the genome does not have


def _exon_pieces(genes: DataFrame, genome: DataFrame, proteins: DataFrame, chunk: int, step: int) -> DataFrame:
    """``chrom, _bin, uniprot, plus, c0, lo, hi, from, upto, bases, a0, letters, copy, excluded, earlier``: exons in bins of ``step`` positions.

    A mutation meets all that it needs in one row: ``bases`` are those from ``from`` to ``upto``, two more than the
    piece on both sides, beyond the exon's ends from the exon next to it if there is one; ``letters`` are
    the amino acids from ``a0`` on, null without a protein; of several proteins of a name each has its row and ``copy``. The coding base at ``p0`` has the number ``c0 + p0``, or
    ``c0 - p0`` on the other strand. ``earlier`` lists exons before that overlap this one.
    """
    cut = genes.select("chrom", "uniprot", "strand", "exons", "blocks", "excluded", F.posexplode("exons").alias("k", "exon"))
    s, e, k = F.col("exon.s"), F.col("exon.e"), F.col("k")
    begin, before, after = F.get("blocks", k)["a0"], F.get("exons", k - 1)["e"], F.get("exons", k + 1)["s"]
    plus, code = F.col("strand") == "+", 3 * begin["aa"] + begin["phase"]
    overlapping = F.filter(F.slice("exons", F.lit(1), k), lambda x: (x["s"] < e) & (x["e"] > s))
    cut = cut.filter(e > s).select(
        "chrom", "uniprot", F.coalesce(plus, F.lit(False)).alias("plus"), s.alias("s"), e.alias("e"), before.alias("before"), after.alias("after"),
        F.when(plus, code - s).otherwise(code + e - 1).alias("c0"), "excluded", overlapping.alias("earlier"), F.explode(F.sequence(F.floor(s / step), F.floor((e - 1) / step))).alias("_bin"),
    )
    lo, hi = F.greatest("s", F.col("_bin") * step), F.least("e", (F.col("_bin") + 1) * step)
    cut = cut.withColumns({"lo": lo, "hi": hi, "excluded": F.filter("excluded", lambda p: (p >= lo) & (p < hi))})
    start = F.when(F.col("before").isNull(), F.greatest("s", F.col("lo") - 2)).otherwise(F.col("lo") - 2)
    end = F.when(F.col("after").isNull(), F.least("e", F.col("hi") + 2)).otherwise(F.col("hi") + 2)
    cut = cut.withColumns({"from": start, "upto": end, "piece": F.monotonically_increasing_id()})

    run = lambda b, x: F.struct(b.alias("b"), x.alias("x"))
    left = run(F.col("before") - F.col("s") + F.col("from"), F.col("before"))
    right = run(F.col("after"), F.col("after") + F.col("upto") - F.col("e"))
    runs = F.filter(F.array(left, run(F.greatest("from", "s"), F.least("upto", "e")), right), lambda x: x["b"] < x["x"])
    runs = cut.select(F.struct(*cut.columns).alias("piece"), F.posexplode(runs).alias("n", "run")).select("piece.chrom", "piece", "n", F.col("run.b").alias("b"), F.col("run.x").alias("x"))
    text = _bases_of_runs(runs, genome, chunk).groupBy("piece.piece").agg(F.first("piece").alias("p"), F.array_sort(F.collect_list(F.struct("n", "b", "bases"))).alias("t"))
    found = text.select("p.*", F.array_join(F.transform("t", lambda x: x["bases"]), "").alias("bases")).drop("piece", "before", "after")

    known = proteins.groupBy("uniprot").agg(F.collect_list(F.coalesce("seq", F.lit(""))).alias("seqs"))
    ends = [F.col("c0") + F.when(F.col("plus"), p).otherwise(-p) for p in (F.col("lo"), F.col("hi") - 1)]
    found = found.join(known, "uniprot", "left").withColumn("a0", F.greatest(F.floor(F.least(*ends) / 3), F.lit(0)))
    count = (F.floor(F.greatest(*ends) / 3) - F.col("a0") + 1).cast("int")
    found = found.select("*", F.posexplode_outer("seqs").alias("copy", "_seq")).withColumn("copy", F.coalesce("copy", F.lit(0)))
    letters = F.substring(F.col("_seq"), (F.col("a0") + 1).cast("int"), count)
    return found.withColumn("letters", F.when(F.col("_seq").isNotNull(), F.coalesce(letters, F.lit("")))).drop("seqs", "_seq", "s", "e")


def _bases_of_runs(runs: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """``runs`` of positions ``b`` to ``x`` on ``chrom``, cut where the genome's pieces end, with their lower-case ``bases``.

    Bases after the end of a chromosome are blanks.
    """
    step = min(chunk, _PIECE)
    number = F.explode(F.sequence(F.lit(0), F.lit(-(-chunk // step) - 1))).alias("_piece")
    cut = genome.select("chrom", F.col("chunk_id").cast("long").alias("_chunk"), "seq", number)
    cut = cut.select("chrom", "_chunk", "_piece", F.substring(F.col("seq"), F.col("_piece") * step + 1, F.lit(step)).alias("_seq"))
    b, x = F.col("b"), F.col("x")

    def split(df: DataFrame, name: str, zero: Column, size: int) -> DataFrame:
        df = df.withColumn(name, F.explode(F.sequence(F.floor((b - zero) / size), F.floor((x - 1 - zero) / size))))
        low = zero + F.col(name) * size
        return df.withColumns({"b": F.greatest(b, low), "x": F.least(x, low + size)})

    runs = split(split(runs, "_chunk", F.lit(0).cast("long"), chunk), "_piece", F.col("_chunk") * chunk, step).withColumn("_piece", F.col("_piece").cast("int"))
    n = (x - b).cast("int")
    own = F.rpad(F.lower(F.substring(F.col("_seq"), (b - F.col("_chunk") * chunk - F.col("_piece") * step + 1).cast("int"), n)), n, F.lit(" "))
    found = runs.join(cut, ["chrom", "_chunk", "_piece"], "left")
    return found.withColumn("bases", F.coalesce(own, F.repeat(F.lit(_ABSENT), n))).drop("_seq", "_chunk", "_piece")


def _changed(spark: SparkSession) -> DataFrame:
    """``plus, codon, r, new, aa_ref, aa_alt``: amino acids of a genomic codon before and after base ``r`` is ``new``; 1,536 rows."""
    rows, turn = [], str.maketrans("acgt", "tgca")
    for codon, r, new in product(K.CODONS, range(3), K.BASES):
        after = codon[:r] + new + codon[r + 1 :]
        rows.append((True, codon, r, new, K.CODONS[codon], K.CODONS[after]))
        rows.append((False, codon, r, new, *(K.CODONS[c[::-1].translate(turn)] for c in (codon, after))))
    return spark.createDataFrame(rows, "plus boolean, codon string, r int, new string, aa_ref string, aa_alt string")


def changes_by_mutation(mapped: DataFrame) -> DataFrame:
    """One row per mutation with all its protein changes, in the order of proteins."""
    keys = ["sample", "ttype", "chrom", "pos", "Reference_Allele", "Tumor_Seq_Allele2"]
    changes = F.array_sort(F.collect_set(F.struct("uniprot", "site", "aa_ref", "aa_alt")))
    return mapped.groupBy(*keys).agg(changes.alias("uniprot_changes"))


def site_rows(mapped: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Rows of the per-protein table, of all classes unless some are named."""
    kind = C.mutation_class(F.col("aa_ref"), F.col("aa_alt"))
    rows = mapped.select(
        "ttype", "sample", F.lit("na").alias("filler"), "uniprot",
        F.concat(F.lit("p."), "aa_ref", F.col("site").cast("string"), "aa_alt").alias("change"), "site", kind.alias("mtype"),
        F.lit(None).cast("double").alias("value"),
    )
    return rows.filter(F.col("mtype").isin(classes)) if classes else rows


def ptm_rows(ptm: DataFrame) -> DataFrame:
    """observed modification sites as rows of the per-protein table."""
    return ptm.filter("value = 1").select(
        "ttype", F.col("patient").alias("sample"), F.lit("na").alias("filler"), F.col("uniprot_id").alias("uniprot"),
        F.concat(F.lit("p."), F.col("site_position").cast("string")).alias("change"), F.col("site_position").alias("site"), "mtype",
        F.col("value").cast("double").alias("value"),
    )


def residue_positions(genes: DataFrame) -> DataFrame:
    """``uniprot, gene, chrom, strand, site, pos``: every coding base (1-based) and its residue.

    The same arithmetic as in :func:`to_residues`, for all bases of all exons;
    excluded positions are left out.
    """
    cut = genes.select("uniprot", "gene", "chrom", "strand", "blocks", "excluded", F.posexplode("exons").alias("k", "exon"))
    cut = cut.withColumn("p0", F.explode(F.sequence(F.col("exon.s"), F.col("exon.e") - 1)))
    cut = cut.filter(~F.array_contains("excluded", F.col("p0")))
    off = F.when(F.col("strand") == "+", F.col("p0") - F.col("exon.s")).otherwise(F.col("exon.e") - F.col("p0") - 1)
    begin = F.get("blocks", F.col("k"))["a0"]
    site = begin["aa"] + F.floor(off / 3) + F.floor((begin["phase"] + off % 3) / 3) + 1
    return cut.select("uniprot", "gene", "chrom", "strand", site.cast("int").alias("site"), (F.col("p0") + 1).alias("pos"))


def residue_spans(genes: DataFrame) -> DataFrame:
    """``uniprot, gene, chrom, site, s, e``: the coding bases of every residue as half-open runs of positions from 0.

    As :func:`residue_positions`, but a row for each run of a residue in an exon, not for each base.
    """
    cut = genes.select("uniprot", "gene", "chrom", "strand", "blocks", "excluded", F.posexplode("exons").alias("k", "exon"))
    begin = F.get("blocks", F.col("k"))["a0"]
    cut = cut.select("uniprot", "gene", "chrom", "strand", "excluded", F.col("exon.s").alias("b"), F.col("exon.e").alias("x"), begin["aa"].alias("aa"), begin["phase"].alias("phase")).filter("x > b")
    size = F.col("x") - F.col("b")
    cut = cut.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("phase") + size - 1) / 3))))
    low, high = F.greatest(3 * F.col("r") - F.col("phase"), F.lit(0)), F.least(3 * F.col("r") + 3 - F.col("phase"), size)
    plus = F.col("strand") == "+"
    cut = cut.withColumns({"s": F.when(plus, F.col("b") + low).otherwise(F.col("x") - high), "e": F.when(plus, F.col("b") + high).otherwise(F.col("x") - low)})
    inside = F.array_sort(F.filter("excluded", lambda p: (p >= F.col("s")) & (p < F.col("e"))))
    pieces = F.arrays_zip(F.concat(F.array("s"), F.transform(inside, lambda p: p + 1)).alias("s"), F.concat(inside, F.array("e")).alias("e"))
    cut = cut.select("uniprot", "gene", "chrom", (F.col("aa") + F.col("r") + 1).cast("int").alias("site"), F.inline(pieces).alias("s", "e"))
    return cut.filter("s < e")


def residue_codons(positions: DataFrame, genome: DataFrame, proteins: DataFrame, chunk: int = 65536) -> DataFrame:
    """``uniprot, gene, site, strand, codon, ctx`` of residues with three bases that translate to the protein's.

    ``ctx`` holds the genomic trinucleotides around the codon's bases, both in
    the order of translation.
    """
    rows = context(positions, genome, F.col("pos") - 2, 3, "abc", chunk)
    found = rows.groupBy("uniprot", "gene", "site", "strand").agg(F.array_sort(F.collect_list(F.struct("pos", "abc"))).alias("b"))
    plus = F.col("strand") == "+"
    found = found.filter(F.size("b") == 3).withColumn("b", F.when(plus, F.col("b")).otherwise(F.reverse("b")))
    middle = F.array_join(F.transform("b", lambda x: F.substring(x["abc"], 2, 1)), "")
    codon = F.when(plus, middle).otherwise(F.translate(middle, "acgt", "tgca"))
    found = found.withColumns({"codon": codon, "ctx": F.transform("b", lambda x: x["abc"])}).join(proteins, "uniprot")
    right = C.translate_codon(F.col("codon")) == F.substring(F.col("seq"), F.col("site"), F.lit(1))
    return found.filter(right).select("uniprot", "gene", "site", "strand", "codon", "ctx")


def first_gene(rows: DataFrame) -> DataFrame:
    """Rows of one gene model per protein, the one that starts first on its chromosome."""
    order = rows.groupBy("uniprot", "gene").agg(F.min(F.struct("chrom", "pos")).alias("at"))
    chosen = order.groupBy("uniprot").agg(F.min_by("gene", F.struct("at", "gene")).alias("gene"))
    return rows.join(chosen, ["uniprot", "gene"], "left_semi")
