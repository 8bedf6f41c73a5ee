"""Queries from files to results, one or more for each step of the tools, with equivalent SQL.

The benchmark tables are written in the formats of the library's sources and read
by its readers; ``part`` gives genes of two exons on both strands, ``lineitem``
their mutations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.operators import interface, mapping, nullmodel, spectra, structure, summarize
from residuum.operators.tally import Tally
from residuum.plans import files
from residuum.plans import tables as T
from residuum.plans.registry import query
from residuum.sources import readers, writers
from residuum.sources.structure_files import structure_lines

# Genes, genome and proteins

_CHROMS = 5


def _base(p, c):
    return F.substring(F.lit("ACGT"), ((p * 7 + F.floor(p / 5) + F.floor(p / 11) + c * 3) % 4 + 1).cast("int"), F.lit(1))


def _genes(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("p_partkey")
    rows = T.table(spark, d, "part").select(
        g.alias("g"), (g % _CHROMS + 1).alias("c"), (g * 100 + 100).alias("b"), (10 + g % 7).alias("a1"), (12 + g % 5).alias("a2"), (20 + g % 11).alias("gap"), (g % 2 == 0).alias("plus")
    )
    return rows.withColumns({"s1": F.col("b") + F.col("a1") + F.col("gap"), "e0": F.col("b") + F.col("a1")}).withColumn("e1", F.col("s1") + F.col("a2"))


_BASE = "substr('ACGT', (({p}) * 7 + ({p}) // 5 + ({p}) // 11 + c * 3) % 4 + 1, 1)"
_GENES = f"""genes AS (SELECT p_partkey AS g, p_partkey % {_CHROMS} + 1 AS c, p_partkey * 100 + 100 AS b, 10 + p_partkey % 7 AS a1, 12 + p_partkey % 5 AS a2,
  20 + p_partkey % 11 AS gap, p_partkey % 2 = 0 AS plus FROM part),
pos AS (SELECT *, unnest(list_concat(range(b, b + a1), range(b + a1 + gap, b + a1 + gap + a2))) AS p FROM genes),
coding AS (SELECT *, CASE WHEN plus THEN row_number() OVER (PARTITION BY g ORDER BY p) ELSE row_number() OVER (PARTITION BY g ORDER BY p DESC) END - 1 AS idx,
  {_BASE.format(p="p")} AS base, g % 10 = 3 AND p = b + 4 AS excluded FROM pos),
tr AS (SELECT *, idx // 3 AS k, CASE WHEN plus THEN base ELSE translate(base, 'ACGT', 'TGCA') END AS tb FROM coding),
code AS (SELECT * FROM (VALUES {", ".join(f"('{c.upper()}', '{a}')" for c, a in K.CODONS.items())}) t(codon, aa)),
codons AS (SELECT g, k, string_agg(tb, '' ORDER BY idx) AS codon, bool_or(excluded) AS cut FROM tr GROUP BY 1, 2 HAVING count(*) = 3),
residues AS (SELECT g, k, codon, cut, aa, CASE WHEN g % 4 = 0 AND k = 2 THEN 'X' ELSE aa END AS seen FROM codons JOIN code USING (codon))"""


def _protein(genes: DataFrame) -> DataFrame:
    """``uniprot, seq`` as the genes give it, but for an odd residue in some."""
    span = F.concat(F.sequence(F.col("b"), F.col("e0") - 1), F.sequence(F.col("s1"), F.col("e1") - 1))
    forward = F.array_join(F.transform(span, lambda p: _base(p, F.col("c"))), "")
    coding = F.when(F.col("plus"), forward).otherwise(F.translate(F.reverse(forward), "ACGT", "TGCA"))
    rows = genes.withColumn("coding", coding)
    n = F.floor(F.length("coding") / 3).cast("int")
    aa = lambda k: C.translate_codon(F.substring(F.col("coding"), k * 3 + 1, F.lit(3)))
    odd = lambda k: F.when((F.col("g") % 4 == 0) & (k == 2), "X").otherwise(aa(k))
    seq = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), odd), "")
    return rows.select("g", F.concat(F.lit("U"), F.col("g").cast("string")).alias("uniprot"), seq.alias("seq"))


def _protein_file(spark: SparkSession, d: str) -> str:
    rows = _protein(_genes(spark, d).repartition(32, "g"))  # the table of genes is small, their sequences take time
    half = F.floor(F.length("seq") / 2).cast("int")
    text = F.concat(F.lit(">sp|"), "uniprot", F.lit("|name\n"), F.substring("seq", F.lit(1), half), F.lit("\n"), F.substring("seq", half + 1, F.length("seq")))
    path = files.new_path(spark, "proteins")
    rows.select(text.alias("value")).write.text(path)
    return path


def _genome_file(spark: SparkSession, d: str) -> str:
    """Chromosomes in lines of 1000 bases, each line a row."""
    size = T.table(spark, d, "part").agg(((F.max("p_partkey") + 2) / 10).cast("long").alias("rows"))
    rows = spark.range(1, _CHROMS + 1).select(F.col("id").alias("c")).crossJoin(F.broadcast(size))  # one row
    rows = rows.select("c", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("rows"))).alias("r"))
    period = {c: "".join("ACGT"[(p * 7 + p // 5 + p // 11 + c * 3) % 4] for p in range(220)) * 6 for c in range(1, _CHROMS + 1)}  # bases repeat after 220
    bases = F.substring(F.element_at(C.literal_map(period), F.col("c").cast("int")), (F.col("r") * 1000 % 220 + 1).cast("int"), F.lit(1000))
    line = F.when(F.col("r") < 0, F.concat(F.lit(">chr"), F.col("c").cast("string"), F.lit(" made"))).otherwise(bases)
    path = files.new_path(spark, "genome")
    ordered = rows.repartition(8 * _CHROMS, "c").sortWithinPartitions("c", "r").select("c", line.alias("value"))
    ordered.write.partitionBy("c").text(path)
    return path


def _gene_file(spark: SparkSession, d: str) -> str:
    g = _genes(spark, d)
    first = F.when(F.col("plus"), F.lit(0)).otherwise(F.col("a2"))  # coding bases before the first exon's first translated one
    second = F.when(F.col("plus"), F.col("a1")).otherwise(F.lit(0))
    text = lambda i: F.concat(F.floor(i / 3).cast("string"), F.lit("."), (i % 3).cast("string"))
    block = lambda i, n: F.concat(text(i), F.lit("-"), text(i + n - 1))
    join = lambda *x: F.concat_ws("-", *(y.cast("string") for y in x))
    return files.lines(
        spark, g, "genes", F.concat(F.lit("chr"), F.col("c").cast("string")), F.col("b"), F.col("e1"),
        F.concat_ws(",", join(F.col("b"), F.col("e0")), join(F.col("s1"), F.col("e1"))), F.when(F.col("plus"), "+").otherwise("-"),
        F.concat(F.lit("U"), F.col("g").cast("string")), F.concat_ws(",", block(first, F.col("a1")), block(second, F.col("a2"))),
        F.when(F.col("g") % 10 == 3, (F.col("b") + 4).cast("string")).otherwise(F.lit("")),
    )


_CLASSES = ("Missense_Mutation", "Silent", "Intron", "Nonsense", "IGR")


def _mutation_file(spark: SparkSession, d: str) -> str:
    items = T.table(spark, d, "lineitem").join(_genes(spark, d), F.col("l_partkey") == F.col("g"))
    p = F.col("b") + (F.col("l_orderkey") * 13 + F.col("l_linenumber") * 5) % (F.col("e1") - F.col("b"))
    letter = lambda n: F.substring(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))
    rows = items.withColumn("p", p).select(
        F.col("c").alias("Chromosome"), (F.col("p") + 1).alias("Start_position"),
        F.when(F.col("l_linenumber") == 6, "N").otherwise(_base(F.col("p"), F.col("c"))).alias("Reference_Allele"),
        F.when(F.col("l_linenumber") == 7, "-").otherwise(letter(F.col("l_suppkey"))).alias("Tumor_Seq_Allele2"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 50).cast("string")).alias("Tumor_Sample_Barcode"),
        F.concat(F.lit("T"), (F.col("l_suppkey") % 3).cast("string")).alias("ttype"),
        F.when(F.col("l_linenumber") == 7, "DEL").otherwise("SNP").alias("Variant_Type"),
        F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("l_orderkey") % 5 + 1).cast("int")).alias("Variant_Classification"),
    )
    path = files.new_path(spark, "mutations")
    writers.tsv(rows, path)
    return path


_MUTS = f"""muts AS (SELECT g, c, b, plus, b + (l_orderkey * 13 + l_linenumber * 5) % (a1 + gap + a2) AS p, l_linenumber AS line, 'S' || l_suppkey % 50 AS sample,
  'T' || l_suppkey % 3 AS ttype, CASE WHEN l_linenumber = 7 THEN '-' ELSE substr('ACGT', l_suppkey % 4 + 1, 1) END AS alt, l_orderkey % 5 + 1 AS class
  FROM lineitem JOIN genes ON l_partkey = g)"""
_MAPPED = f"""{_GENES}, {_MUTS}, mapped AS (SELECT m.g, m.sample, m.ttype, m.c, m.p + 1 AS pos, CASE WHEN line = 6 THEN 'N' ELSE t.base END AS ref, m.alt, r.k + 1 AS site, r.aa AS aa_ref, n.aa AS aa_alt
  FROM muts m JOIN tr t ON m.g = t.g AND m.p = t.p AND NOT t.excluded JOIN residues r ON r.g = m.g AND r.k = t.k AND r.aa = r.seen
  JOIN code n ON n.codon = substr(r.codon, 1, t.idx % 3) || CASE WHEN m.plus THEN m.alt ELSE translate(m.alt, 'ACGT', 'TGCA') END || substr(r.codon, t.idx % 3 + 2) WHERE m.alt <> '-')"""


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return mapping.to_residues(
        readers.mutations(spark, _mutation_file(spark, d)), readers.gene_map(spark, _gene_file(spark, d)),
        readers.genome(spark, _genome_file(spark, d), 4096), readers.proteins(spark, _protein_file(spark, d)), 4096, 512,
    )


@query(f"""WITH size AS (SELECT ((max(p_partkey) + 2) // 10 + 1) * 1000 AS size FROM part),
k AS (SELECT c, k, unnest(range(k * 4096, least(k * 4096 + 4098, size))) AS p FROM size, range(1, {_CHROMS + 1}) t(c), LATERAL (SELECT unnest(range((size - 1) // 4096 + 1)) AS k))
SELECT 'chr' || c AS chrom, k AS chunk_id, md5(string_agg({_BASE.format(p="p")}, '' ORDER BY p)) AS digest, count(*) AS n FROM k GROUP BY c, k""")
def genome_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A genome file in overlapping chunks."""
    chunks = readers.genome(spark, _genome_file(spark, d), 4096)
    return chunks.select("chrom", "chunk_id", F.md5("seq").alias("digest"), F.length("seq").cast("long").alias("n"))


@query(f"WITH {_GENES} SELECT 'U' || g AS uniprot, string_agg(seen, '' ORDER BY k) AS seq FROM residues GROUP BY g")
def protein_sequences(spark: SparkSession, d: str) -> DataFrame:
    return readers.proteins(spark, _protein_file(spark, d))


@query(f"""WITH {_GENES}, x AS (SELECT *, (p >= b + a1)::INT AS exon FROM coding)
SELECT 'chr' || c AS chrom, 'U' || g AS uniprot, CASE WHEN plus THEN '+' ELSE '-' END AS strand, exon, min(p) AS s, max(p) + 1 AS e, min(idx) // 3 AS aa, min(idx) % 3 AS phase,
  max(idx) // 3 AS last_aa, count(*) FILTER (excluded) AS n_excluded FROM x GROUP BY c, g, plus, exon""")
def gene_models(spark: SparkSession, d: str) -> DataFrame:
    """Exons and protein blocks of a gene map."""
    genes = readers.gene_map(spark, _gene_file(spark, d))
    rows = genes.select("chrom", "uniprot", "strand", "excluded", F.posexplode(F.arrays_zip("exons", "blocks")).alias("exon", "r"))
    inside = F.size(F.filter("excluded", lambda p: (p >= F.col("r.exons.s")) & (p < F.col("r.exons.e"))))
    block = F.col("r.blocks")
    return rows.select(
        "chrom", "uniprot", "strand", "exon", F.col("r.exons.s").alias("s"), F.col("r.exons.e").alias("e"), block["a0"]["aa"].cast("long").alias("aa"),
        block["a0"]["phase"].cast("long").alias("phase"), block["a1"]["aa"].cast("long").alias("last_aa"), inside.cast("long").alias("n_excluded"),
    )


@query(f"""WITH {_MAPPED} SELECT sample, ttype, 'chr' || c AS chrom, pos, ref, alt, 'U' || g AS uniprot, aa_ref, site, aa_alt, count(*) AS n FROM mapped GROUP BY ALL""")
def map_mutations(spark: SparkSession, d: str) -> DataFrame:
    """Mutations to residues through codons split over exons, on both strands."""
    return _mapped(spark, d).groupBy(
        "sample", "ttype", "chrom", "pos", F.col("Reference_Allele").alias("ref"), F.col("Tumor_Seq_Allele2").alias("alt"), "uniprot", "aa_ref", F.col("site").cast("long").alias("site"), "aa_alt"
    ).agg(F.count("*").alias("n"))


@query(f"""WITH {_MAPPED} SELECT sample, ttype, 'chr' || c AS chrom, pos, ref, alt, string_agg(DISTINCT 'U' || g || ':' || aa_ref || site || aa_alt, '; ') AS changes FROM mapped GROUP BY ALL""")
def mapped_changes(spark: SparkSession, d: str) -> DataFrame:
    """The table of mapped mutations, written and read again."""
    path = files.new_path(spark, "mapped")
    writers.mapped(mapping.changes_by_mutation(_mapped(spark, d)), path)
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select("sample", "ttype", "chrom", F.col("pos").cast("long").alias("pos"), F.col("Reference_Allele").alias("ref"), F.col("Tumor_Seq_Allele2").alias("alt"), F.col("uniprot_change").alias("changes"))


@query(f"""WITH {_MAPPED} SELECT ttype, 'U' || g AS uniprot, 'p.' || aa_ref || site || aa_alt AS change, site, CASE WHEN aa_alt = '*' THEN 'N' ELSE 'M' END AS mtype, count(*) AS n, count(DISTINCT sample) AS samples
FROM mapped WHERE aa_alt <> aa_ref OR aa_alt = '*' GROUP BY ALL""")
def sites_by_protein(spark: SparkSession, d: str) -> DataFrame:
    """Missense and nonsense sites, partitioned by protein and read again."""
    path = files.new_path(spark, "sites")
    writers.by_protein(mapping.site_rows(_mapped(spark, d), ["M", "N"]), path)
    rows = readers.protein_sites(spark, path)
    return rows.groupBy("ttype", "uniprot", "change", F.col("site").cast("long").alias("site"), "mtype").agg(F.count("*").alias("n"), F.count_distinct("sample").alias("samples"))


@query(f"WITH {_MAPPED} SELECT ttype, sample, 'U' || g AS uniprot, site, count(*) AS n FROM mapped WHERE aa_alt <> aa_ref AND aa_alt <> '*' GROUP BY ALL")
def site_lines(spark: SparkSession, d: str) -> DataFrame:
    """The headless table of one protein's mutations."""
    rows = mapping.site_rows(_mapped(spark, d), ["M"])
    path = files.lines(spark, rows, "site-lines", *(F.col(c) for c in ("ttype", "sample", "filler", "uniprot", "change", "site", "mtype")))
    return readers.sites(spark, path).groupBy("ttype", "sample", "uniprot", F.col("site").cast("long").alias("site")).agg(F.count("*").alias("n"))


_CLASS_SQL = "(VALUES " + ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(_CLASSES)) + ") k(class, name)"


@query(f"""WITH {_GENES}, {_MUTS} SELECT name AS class, ttype, count(*) AS n, count(DISTINCT sample) AS samples FROM muts JOIN {_CLASS_SQL} USING (class)
WHERE name NOT IN ('Intron', 'IGR') AND alt <> '-' GROUP BY ALL""")
def coding_snps(spark: SparkSession, d: str) -> DataFrame:
    rows = mapping.snps(spectra.coding(readers.mutations(spark, _mutation_file(spark, d))))
    return rows.groupBy(F.col("Variant_Classification").alias("class"), "ttype").agg(F.count("*").alias("n"), F.count_distinct("Tumor_Sample_Barcode").alias("samples"))


# Spectra and null probabilities


def _channel(a: str, m: str, b: str, n: str) -> str:
    """SQL of a channel's number from the bases around, the middle one and the new one."""
    f = lambda x: f"CASE WHEN {m} IN ('G', 'T') THEN translate({x}, 'ACGT', 'TGCA') ELSE {x} END"
    first = f"CASE WHEN {m} IN ('G', 'T') THEN translate({b}, 'ACGT', 'TGCA') ELSE {a} END"
    last = f"CASE WHEN {m} IN ('G', 'T') THEN translate({a}, 'ACGT', 'TGCA') ELSE {b} END"
    at = lambda x: f"(instr('ACGT', {x}) - 1)"
    mid, new = f"({f(m)})", f"({f(n)})"
    return f"(24 * {at(f'({first})')} + 6 * {at(f'({last})')} + 3 * ({mid} = 'C')::INT + {at(new)} - ({at(new)} > {at(mid)})::INT)"


_CHANNELS = f"""ch AS (SELECT sample AS patient, ttype, {_channel(_BASE.format(p="p - 1"), _BASE.format(p="p"), _BASE.format(p="p + 1"), "alt")} AS channel
  FROM muts WHERE alt <> '-' AND line <> 6 AND alt <> {_BASE.format(p="p")})"""


def _spectrum(spark: SparkSession, d: str) -> DataFrame:
    muts = readers.mutations(spark, _mutation_file(spark, d))
    return spectra.channel_counts(muts, readers.genome(spark, _genome_file(spark, d), 4096), 4096)


@query(f"WITH {_GENES}, {_MUTS}, {_CHANNELS} SELECT patient, ttype, channel, count(*) AS n FROM ch GROUP BY ALL")
def mutation_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channels of the mutations from the bases around them."""
    rows = _spectrum(spark, d).dropna(subset=["channel"])
    return rows.groupBy("patient", "ttype", F.col("channel").cast("long").alias("channel")).agg(F.count("*").alias("n"))


@query(f"WITH {_GENES}, {_MUTS}, {_CHANNELS} SELECT patient, ttype, channel, count(*) AS n FROM ch GROUP BY ALL")
def spectra_file(spark: SparkSession, d: str) -> DataFrame:
    """The table of spectra, written and read in long form."""
    path = files.new_path(spark, "spectra")
    writers.tsv(spectra.spectrum_pivot(_spectrum(spark, d)), path)
    return readers.spectra(spark, path).filter("n > 0").select("patient", "ttype", F.col("channel").cast("long").alias("channel"), "n")


@query(f"WITH {_GENES} SELECT 'U' || g AS uniprot, 'chr' || c AS chrom, idx // 3 + 1 AS site, p + 1 AS pos FROM coding WHERE NOT excluded")
def residue_positions(spark: SparkSession, d: str) -> DataFrame:
    """The genomic positions of all residues."""
    rows = mapping.residue_positions(readers.gene_map(spark, _gene_file(spark, d)))
    return rows.select("uniprot", "chrom", F.col("site").cast("long").alias("site"), "pos")


def _codons(spark: SparkSession, d: str) -> DataFrame:
    genes = readers.gene_map(spark, _gene_file(spark, d))
    positions = mapping.first_gene(mapping.residue_positions(genes))
    return mapping.residue_codons(positions, readers.genome(spark, _genome_file(spark, d), 4096), readers.proteins(spark, _protein_file(spark, d)), 4096)


@query(f"WITH {_GENES} SELECT 'U' || g AS uniprot, k + 1 AS site, lower(codon) AS codon FROM residues WHERE aa = seen AND NOT cut")
def residue_codons(spark: SparkSession, d: str) -> DataFrame:
    return _codons(spark, d).select("uniprot", F.col("site").cast("long").alias("site"), "codon")


_STEPS = f"""steps AS (SELECT r.g, r.k, r.aa, t.base, n.x AS new, c.aa AS made, {_channel(_BASE.format(p="p - 1"), "base", _BASE.format(p="p + 1"), "n.x")} AS channel
  FROM residues r JOIN tr t ON r.g = t.g AND r.k = t.k, (VALUES ('A'), ('C'), ('G'), ('T')) n(x),
  LATERAL (SELECT aa FROM code WHERE code.codon = substr(r.codon, 1, idx % 3) || CASE WHEN plus THEN n.x ELSE translate(n.x, 'ACGT', 'TGCA') END || substr(r.codon, idx % 3 + 2)) c
  WHERE r.aa = r.seen AND NOT r.cut AND n.x <> base AND c.aa <> '*' AND c.aa <> r.aa)"""


@query(f"WITH {_GENES}, {_STEPS.replace('c * 3', 't.c * 3')} SELECT 'U' || g AS structure, k + 1 AS i, channel, count(*) AS mult FROM steps GROUP BY ALL")
def residue_channels(spark: SparkSession, d: str) -> DataFrame:
    """The channels of all changes of amino acids that one base can make."""
    rows = _codons(spark, d).select(F.col("uniprot").alias("structure"), F.col("site").alias("i"), "strand", "codon", "ctx")
    found = nullmodel.residue_channels(rows)
    return found.select("structure", F.col("i").cast("long").alias("i"), F.col("channel").cast("long").alias("channel"), "mult")


@query(f"""WITH {_GENES}, cov AS (SELECT c, p, (p % 17)::DOUBLE AS cov FROM coding WHERE p % 3 <> 0 AND g % 6 <> 5), m AS (SELECT g, idx // 3 + 1 AS i, coalesce(avg(cov), 0) AS v
  FROM coding LEFT JOIN cov USING (c, p) WHERE NOT excluded GROUP BY 1, 2)
SELECT 'U' || g AS structure, i, round(CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 1e0 / count(*) OVER w END, 9) AS weight FROM m WINDOW w AS (PARTITION BY g)""")
def coverage_weights(spark: SparkSession, d: str) -> DataFrame:
    """Draw weights of residues from a table of sequencing coverage."""
    g = _genes(spark, d).filter("g % 6 <> 5")
    spot = F.explode(F.concat(F.sequence(F.col("b"), F.col("e0") - 1), F.sequence(F.col("s1"), F.col("e1") - 1))).alias("p")
    rows = g.select("c", spot).filter("p % 3 <> 0").select(F.col("c").alias("chrn"), (F.col("p") + 1).alias("pos"), (F.col("p") % 17).alias("cov"))
    path = files.new_path(spark, "coverage")
    writers.tsv(rows, path)
    at = mapping.residue_positions(readers.gene_map(spark, _gene_file(spark, d)))
    at = at.select(F.col("uniprot").alias("structure"), F.col("site").alias("i"), C.chromosome_number(F.col("chrom")).alias("chrn"), "pos")
    found = nullmodel.coverage_weights(at, readers.coverage(spark, path))
    return found.select("structure", F.col("i").cast("long").alias("i"), F.round("weight", 9).alias("weight"))


# Weights, structures and samples


@query("""WITH c AS (SELECT c_mktsegment AS t, c_custkey AS s, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT t AS ttype, s::VARCHAR AS sample, n, round((row_number() OVER (PARTITION BY t ORDER BY n, s) - 1) / (count(*) OVER (PARTITION BY t))::DOUBLE, 6) AS rank_score FROM c""")
def weights_file(spark: SparkSession, d: str) -> DataFrame:
    """Sample weights, written with the header of their format and read again."""
    found = spectra.frequency_weights(spectra.sample_counts(T.order_counts(spark, d)))
    path = files.new_path(spark, "weights")
    names = zip(("ttype", "sample", "mut_count", "rank_score", "zlog_score"), ("TTYPE", "SAMPLE", "MUT_COUNT", "TTYPE_RANK_SCORE", "ZLOG_SCORE"))
    writers.tsv(found.select(*(F.col(a).alias(b) for a, b in names)), path)
    rows = readers.weights(spark, path)
    return rows.select(F.col("TTYPE").alias("ttype"), F.col("SAMPLE").alias("sample"), F.col("MUT_COUNT").alias("n"), F.round("TTYPE_RANK_SCORE", 6).alias("rank_score"))


def _order_sites(spark: SparkSession, d: str) -> DataFrame:
    """``ttype, sample, uniprot, site, mtype, value`` of order lines."""
    rows = T.table(spark, d, "lineitem").join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.element_at(F.array(*map(F.lit, ("M", "S", "N", "MI"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return rows.select(
        F.col("c_mktsegment").alias("ttype"), F.col("c_custkey").alias("sample"), F.col("l_suppkey").cast("string").alias("uniprot"),
        F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey") % 40).cast("int").alias("site"), kind.alias("mtype"), F.col("l_discount").alias("value"),
    )


_SITES = """sites AS (SELECT c_mktsegment AS ttype, c_custkey AS sample, l_suppkey::VARCHAR AS uniprot, l_partkey % 40 AS site, l_discount AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linenumber % 4 IN (0, 3) AND l_partkey % 9 <> 0)"""


@query(f"WITH {_SITES} SELECT uniprot, site, count(*) AS n, count(DISTINCT ttype) AS ttypes, count(DISTINCT (sample, ttype)) AS samples FROM sites WHERE ttype LIKE 'A%' OR ttype LIKE 'M%' GROUP BY ALL")
def site_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sites of missense mutations of some types, unweighted; classes go by their first letter."""
    found = structure.site_weights(_order_sites(spark, d).filter("ttype LIKE 'A%' OR ttype LIKE 'M%'"))
    return found.select("uniprot", F.col("site").cast("long").alias("site"), F.col("weight").cast("long").alias("n"), F.size("ttypes").cast("long").alias("ttypes"), F.size("samples").cast("long").alias("samples"))


@query(f"WITH {_SITES} SELECT uniprot, site, count(*) AS n FROM sites WHERE ttype LIKE 'BUILD%' GROUP BY ALL")
def sites_of_type(spark: SparkSession, d: str) -> DataFrame:
    """One type by its prefix."""
    found = structure.site_weights(_order_sites(spark, d), ttype="BUILD")
    return found.select("uniprot", F.col("site").cast("long").alias("site"), F.col("weight").cast("long").alias("n"))


_ZLOG = """CASE WHEN n - m <= 0 THEN 1e0 WHEN sd = 0 THEN CASE WHEN log10(n - m) > 0 THEN 0e0 ELSE 1e0 END ELSE 1e0 / greatest(1e0, log10(n - m) / sd) END"""
_WEIGHTED = f"""{_SITES}, k AS (SELECT c_mktsegment AS ttype, c_custkey AS sample, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
z AS (SELECT ttype, sample, {_ZLOG} AS z FROM (SELECT *, avg(log10(n)) OVER g AS m, stddev_pop(log10(n)) OVER g AS sd FROM k WINDOW g AS (PARTITION BY ttype))),
w AS (SELECT uniprot, site, sum(z) AS weight FROM sites JOIN z USING (ttype, sample) GROUP BY ALL)"""


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return structure.site_weights(_order_sites(spark, d), spectra.frequency_weights(spectra.sample_counts(T.order_counts(spark, d))))


@query(f"WITH {_WEIGHTED} SELECT uniprot, site, round(weight, 6) AS weight FROM w")
def site_weights(spark: SparkSession, d: str) -> DataFrame:
    """Sites weighed by the samples' z-log scores."""
    return _weighted(spark, d).select("uniprot", F.col("site").cast("long").alias("site"), F.round("weight", 6).alias("weight"))


@query(f"WITH {_SITES} SELECT uniprot, site, round(sum(value) / greatest(1, count(DISTINCT (sample, ttype))), 6) AS weight FROM sites GROUP BY ALL")
def site_values(spark: SparkSession, d: str) -> DataFrame:
    """Given values, averaged over samples."""
    found = structure.site_weights(_order_sites(spark, d), values=True)
    return found.select("uniprot", F.col("site").cast("long").alias("site"), F.round("weight", 6).alias("weight"))


_PTM = """ptm AS (SELECT 'P' || user_id AS patient, 'U' || event_id % 30 AS uniprot, event_id % 100 AS site, (value > 50)::INT AS value, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'P' END AS mtype, event_type AS ttype FROM events)"""


def _ptm(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows = T.table(spark, d, "events").select(
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("patient"), F.concat(F.lit("U"), (e % 30).cast("string")).alias("uniprot_id"), (e % 100).alias("site_position"),
        F.lit("g").alias("geneSymbol"), (F.col("value") > 50).cast("int").alias("value"), F.when(e % 2 == 0, "A").otherwise("P").alias("mtype"), F.col("event_type").alias("ttype"),
    )
    path = files.new_path(spark, "ptm")
    writers.tsv(rows, path)
    return readers.ptm_sites(spark, path)


@query(f"WITH {_PTM} SELECT ttype, uniprot, 'p.' || site AS change, site, mtype, count(*) AS n, count(DISTINCT patient) AS samples FROM ptm WHERE value = 1 GROUP BY ALL")
def ptm_sites(spark: SparkSession, d: str) -> DataFrame:
    """Observed modification sites as rows of the per-protein table."""
    rows = mapping.ptm_rows(_ptm(spark, d))
    return rows.groupBy("ttype", "uniprot", "change", F.col("site").cast("long").alias("site"), "mtype").agg(F.count("*").alias("n"), F.count_distinct("sample").alias("samples"))


@query(f"""WITH {_PTM}, k AS (SELECT patient, sum(value) AS n FROM ptm GROUP BY 1 HAVING sum(value) > 0), z AS (SELECT patient,
  CASE WHEN n - m > 0 AND sd > 0 AND log10(n - m) <> 0 THEN sd / log10(n - m) END AS z FROM (SELECT *, avg(log10(n)) OVER () AS m, stddev_pop(log10(n)) OVER () AS sd FROM k))
SELECT uniprot, site, round(sum(coalesce(z, 0e0)), 5) AS weight FROM ptm JOIN z USING (patient) WHERE value = 1 AND mtype = 'A' GROUP BY ALL""")
def ptm_site_weights(spark: SparkSession, d: str) -> DataFrame:
    """Modification sites with weights of samples over all types."""
    ptm = _ptm(spark, d)
    weights = spectra.frequency_weights(spectra.ptm_counts(ptm).filter("mut_count > 0"), group=None, clamp=False)
    found = structure.site_weights(mapping.ptm_rows(ptm), weights, classes=["A"])
    return found.select("uniprot", F.col("site").cast("long").alias("site"), F.round("weight", 5).alias("weight"))


def _maps(spark: SparkSession, d: str) -> DataFrame:
    """Residue maps of suppliers' items, from a file of alignments: one line for each order with a supplier."""
    items = T.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_partkey") % 40).alias("u"), "l_linenumber")
    rows = items.groupBy("l_suppkey", (F.col("l_orderkey") % 20).alias("o")).agg(F.array_sort(F.collect_set("u")).alias("u"))
    pairs = F.array_join(F.transform("u", lambda x: F.concat(x.cast("string"), F.lit(":"), (x + F.col("o")).cast("string"))), " ")
    name = F.format_string("%03d%d-%s", F.col("l_suppkey") % 1000, F.col("o") % 10, F.substring(F.lit("ABCDEFGHIJKLMNOPQRST"), (F.col("o") + 1).cast("int"), F.lit(1)))
    attrs = F.when(F.col("o") % 4 == 0, "-").otherwise(F.concat(F.lit("x:1 pdb_identity:"), (50 + F.col("o")).cast("string")))
    path = files.lines(spark, rows, "maps", F.col("l_suppkey"), F.concat(F.lit("I"), F.col("l_suppkey").cast("string")), name, attrs, pairs)
    return readers.residue_maps(spark, path)


_MAPS = """m AS (SELECT l_suppkey AS s, l_orderkey % 20 AS o, l_partkey % 40 AS u FROM lineitem GROUP BY ALL),
lines AS (SELECT s, o, count(*) AS n, format('{:03d}{}-{}', s % 1000, o % 10, chr((65 + o)::INT)) AS pdb_chain, CASE WHEN o % 4 = 0 THEN 100e0 ELSE 50e0 + o END AS identity FROM m GROUP BY ALL),
usable AS (SELECT m.*, pdb_chain, identity, row_number() OVER (PARTITION BY s, o ORDER BY u) - 1 AS i FROM m JOIN lines USING (s, o) WHERE n >= 5)"""


@query(f"WITH {_MAPS} SELECT s::VARCHAR AS u1, 'I' || s AS u2, pdb_chain, identity, n FROM lines")
def residue_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = _maps(spark, d)
    return rows.select("u1", "u2", "pdb_chain", "identity", F.size("resmap").cast("long").alias("n"))


@query(f"""WITH {_MAPS}, {_WEIGHTED} SELECT pdb_chain, s::VARCHAR AS u1, i, round(pow(weight, 3) / (8e0 + pow(weight, 3)), 6) AS v FROM usable JOIN w ON w.uniprot = s::VARCHAR AND w.site = u""")
def mutated_residues(spark: SparkSession, d: str) -> DataFrame:
    """The mutated residues of structures, weighed through a Hill function."""
    weights = _weighted(spark, d)
    residues = structure.usable_maps(_maps(spark, d), weights)
    found = structure.mutated(residues, weights, hill=(2.0, 3.0))
    names = residues.select("structure", "u1", "pdb_chain").distinct()
    return found.join(names, "structure").select("pdb_chain", "u1", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(f"""WITH {_MAPS} SELECT pdb_chain, s::VARCHAR AS u1, i, u FROM usable WHERE substr(pdb_chain, 1, 4) IN ('0010', '0013', '0021')""")
def maps_of_structures(spark: SparkSession, d: str) -> DataFrame:
    """Maps in partitions by name, of which only those of a few structures are read."""
    path = files.new_path(spark, "shards")
    writers.by_structure(_maps(spark, d), path)
    rows = structure.usable_maps(readers.structure_maps(spark, path, ["0010", "0013", "0021"]))
    return rows.select("pdb_chain", "u1", F.col("i").cast("long").alias("i"), F.col("u").cast("long").alias("u"))


_RESIDUES = 9000  # of a structure, as their numbers have four digits


def _structure_name(block: Column) -> Column:
    return F.format_string("s%d%02d", F.col("label"), block)


def _structure_files(spark: SparkSession, d: str) -> str:
    """Structures ``s<label><block>`` with two atoms a residue, and a header with molecules."""
    e = T.table(spark, d, "embeddings").select("label", (F.row_number().over(_by_label()) - 1).alias("at"), "embedding")
    e = e.select(_structure_name(F.floor(F.col("at") / _RESIDUES)).alias("pdb"), (F.col("at") % _RESIDUES + 1).alias("r"), "embedding")
    atom = lambda k: F.format_string(
        "ATOM  %5d  C%d  %3s %1s%4d    %8.3f%8.3f%8.3f  1.00  0.00", F.col("r") * 2 + k, F.lit(k), F.when(F.col("r") % 7 == 0, "MSE").otherwise("GLY"), F.when(F.col("r") % 2 == 0, "A").otherwise("B"), F.col("r"),
        *(F.floor(F.get("embedding", F.lit(3 * k + o)).cast("double") * 1000) / 100 for o in range(3)),
    )
    atoms = e.select("pdb", (F.lit(10) + F.col("r")).alias("n"), F.explode(F.array(atom(0), atom(1))).alias("value"))
    head = e.select("pdb").distinct().select(
        "pdb", F.posexplode(F.array(
            F.lit("HEADER    MADE"), F.lit("COMPND    MOL_ID: 1;"), F.lit("COMPND   2 MOLECULE: ONE;"), F.lit("COMPND   3 CHAIN: A, C;"),
            F.concat(F.lit("COMPND   4 FRAGMENT: PART "), "pdb", F.lit(";")), F.lit("COMPND   5 MOL_ID: 2;"), F.lit("COMPND   6 CHAIN: B;"),
        )).alias("n", "value"),
    )
    return files.structures(spark, head.unionByName(atoms))


def _by_label():
    from pyspark.sql import Window

    return Window.partitionBy("label").orderBy("vec_id")


_BLOCKS = f"""e AS (SELECT format('s{{:d}}{{:02d}}', label, n // {_RESIDUES}) AS pdb, label, n % {_RESIDUES} + 1 AS r, embedding
  FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings))"""
_ATOMS = f"""{_BLOCKS},
atoms AS (SELECT pdb, r, CASE WHEN r % 2 = 0 THEN 'A' ELSE 'B' END AS chain, floor(embedding[3*k+1]::DOUBLE * 1000) / 100 AS x, floor(embedding[3*k+2]::DOUBLE * 1000) / 100 AS y, floor(embedding[3*k+3]::DOUBLE * 1000) / 100 AS z
  FROM e, (VALUES (0), (1)) t(k))"""


@query(f"WITH {_ATOMS} SELECT pdb, chain, r AS i, CASE WHEN r % 7 = 0 THEN 'MSE' ELSE 'GLY' END AS resname, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM atoms GROUP BY ALL")
def structure_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Residue centres from structure files."""
    atoms = readers.atoms(spark, _structure_files(spark, d), ["A", "B"])
    own = atoms.select("pdb", "chain", "resnum").distinct()
    residues = own.select(
        F.concat_ws("-", "pdb", "chain").alias("structure"), F.concat_ws("-", "pdb", "chain").alias("pdb_chain"), F.col("resnum").alias("p"), F.col("resnum").alias("i"), F.col("resnum").alias("u")
    )
    found = structure.residue_centroids(residues, atoms)
    parts = F.split("structure", "-")
    return found.select(F.get(parts, F.lit(0)).alias("pdb"), F.get(parts, F.lit(1)).alias("chain"), F.col("i").cast("long").alias("i"), "resname", *(F.round(c, 4).alias(c) for c in "xyz"))


@query(f"WITH {_BLOCKS} SELECT pdb, chain, CASE WHEN chain = 'B' THEN 'NA' ELSE 'PART ' || pdb END AS fragment FROM (SELECT DISTINCT pdb FROM e), (VALUES ('A'), ('B'), ('C')) t(chain)")
def structure_fragments(spark: SparkSession, d: str) -> DataFrame:
    return readers.fragments(spark, _structure_files(spark, d))


# Strata and types


@query("""WITH p AS (SELECT label, vec_id AS i, embedding[1]::DOUBLE * 20 AS x FROM embeddings), s AS (SELECT label, i, CASE WHEN x < -1 THEN 0 WHEN x < 1 THEN 1 ELSE 2 END AS stratum FROM p),
k AS (SELECT label, stratum, count(*) AS k FROM s WHERE i % 10 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label, stratum, rep ORDER BY (('0x' || substr(md5('draw:' || label || '/' || stratum || ':' || rep || ':' || i), 1, 12))::BIGINT + 0.5e0) / pow(16e0, 12), i) AS n
  FROM s JOIN k USING (label, stratum), range(5) t(rep))
SELECT label, stratum, rep, count(*) AS n, sum(i)::BIGINT AS i_sum FROM r WHERE n <= k GROUP BY ALL""")
def stratified_draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws inside strata of residues."""
    points = nullmodel.burial_groups(T.points(spark, d), "x", (-1.0, 1.0))
    sizes = points.filter("i % 10 = 0").groupBy("label", "stratum").agg(F.count("*").alias("k"))
    drawn = nullmodel.draw_in_strata(points, sizes, nullmodel.replicates(spark, 5), "label", "i")
    return drawn.groupBy("label", "stratum", "rep").agg(F.count("*").alias("n"), F.sum("i").alias("i_sum"))


@query("""WITH t AS (SELECT o_custkey % 200 AS c, list_distinct(list(o_orderpriority)) AS types FROM orders GROUP BY 1)
SELECT a.c AS a, b.c AS b, round(0.3e0 + 0.7e0 * list_has_any(a.types, b.types)::INT, 6) AS factor FROM t a JOIN t b ON a.c > b.c""")
def shared_types(spark: SparkSession, d: str) -> DataFrame:
    """The factor of pairs that share no type."""
    t = T.table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("c")).agg(F.collect_set("o_orderpriority").alias("types"))
    pairs = t.alias("x").join(t.alias("y"), F.col("x.c") > F.col("y.c"))  # at most 200 groups
    factor = structure.shared_type_factor(F.col("x.types"), F.col("y.types"), 0.3)
    return pairs.select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), F.round(factor, 6).alias("factor"))


# Interfaces


def _map_lines(spark: SparkSession, d: str) -> DataFrame:
    maps = _maps(spark, d)
    return maps.withColumn("line", F.substring(F.split_part("pdb_chain", F.lit("-"), F.lit(1)), 4, 1).cast("int"))


@query(f"""WITH {_MAPS} SELECT substr(pdb_chain, 1, 4) AS pdb, count(*) AS n FROM (SELECT DISTINCT substr(pdb_chain, 1, 4) AS pdb_chain FROM lines WHERE o % 4 = 0) GROUP BY 1""")
def native_structures(spark: SparkSession, d: str) -> DataFrame:
    return interface.native_structures(_maps(spark, d)).groupBy("pdb").agg(F.count("*").alias("n"))


@query(f"""WITH {_MAPS} SELECT s::VARCHAR AS u1, pdb_chain, 'I' || s AS u2, max(identity) AS identity FROM lines GROUP BY ALL""")
def last_identity(spark: SparkSession, d: str) -> DataFrame:
    return interface.last_identity(_map_lines(spark, d))


@query(f"WITH {_MAPS} SELECT s::VARCHAR AS u1, pdb_chain, n, 'native' AS kind FROM lines WHERE o % 4 = 0 UNION ALL SELECT s::VARCHAR, pdb_chain, n, 'fixed' FROM lines JOIN (SELECT s, o, min(u) AS f FROM m GROUP BY ALL) USING (s, o) WHERE f = 1")
def chosen_maps(spark: SparkSession, d: str) -> DataFrame:
    """Native maps, and those that a list names."""
    maps = _maps(spark, d)
    fixed = maps.select("pdb_chain", "u1").distinct().withColumn("first", F.lit(1))
    both = [interface.chosen_maps(maps).withColumn("kind", F.lit("native")), interface.chosen_maps(maps, fixed).withColumn("kind", F.lit("fixed"))]
    cut = [b.select("u1", "pdb_chain", F.size("resmap").cast("long").alias("n"), "kind") for b in both]
    return cut[0].unionByName(cut[1])


_CHAIN = f"""{_MAPS}, line AS (SELECT pdb_chain, arg_max(s || '/' || o, n * 1000 + o % 10) AS l, max(n * 1000 + o % 10) AS top FROM lines GROUP BY 1),
chain AS (SELECT DISTINCT substr(pdb_chain, 1, 4) AS pdb, substr(pdb_chain, 6) AS chain, u + o AS resnum, s::VARCHAR AS uniprot, u FROM m JOIN lines USING (s, o) JOIN line USING (pdb_chain) WHERE n * 1000 + o % 10 = top)"""


@query(f"WITH {_CHAIN} SELECT * FROM chain")
def chain_residues(spark: SparkSession, d: str) -> DataFrame:
    """Residues of the largest map of each chain."""
    rows = interface.chain_residues(_map_lines(spark, d)).distinct()
    return rows.select("pdb", "chain", F.col("resnum").cast("long").alias("resnum"), "uniprot", F.col("u").cast("long").alias("u"))


@query(f"WITH {_CHAIN}, {_WEIGHTED} SELECT pdb, chain, resnum, round(sum(z), 6) AS w FROM chain JOIN sites ON chain.uniprot = sites.uniprot AND u = site JOIN z USING (ttype, sample) GROUP BY ALL")
def chain_mutations(spark: SparkSession, d: str) -> DataFrame:
    """Mutation mass of chains' residues; a type is looked up by what stands before a hyphen."""
    residues = interface.chain_residues(_map_lines(spark, d)).distinct()
    sites = _order_sites(spark, d).filter("mtype LIKE 'M%'").withColumn("ttype", F.concat("ttype", F.lit("-x")))
    weights = spectra.frequency_weights(spectra.sample_counts(T.order_counts(spark, d)))
    found = interface.chain_mutations(residues, sites, weights)
    return found.groupBy("pdb", "chain", F.col("resnum").cast("long").alias("resnum")).agg(F.round(F.sum("w"), 6).alias("w"))


@query("""WITH i AS (SELECT l_suppkey, l_linenumber % 2 AS side, l_linenumber AS r, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)
SELECT l_suppkey, coalesce(string_agg(r || '_' || printf('%.2f', w), ';' ORDER BY r) FILTER (side = 0), '') AS masses1, coalesce(string_agg(r || '_' || printf('%.2f', w), ';' ORDER BY r) FILTER (side = 1), '') AS masses2,
  round(coalesce(sum(w) FILTER (side = 0), 0), 2) AS mass1 FROM i GROUP BY 1""")
def mass_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of residues and masses, and the mass read back from a list."""
    items = T.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("pdb"), F.lit("A").alias("chain"), F.col("l_linenumber").alias("resnum"), F.col("l_quantity").alias("w"))
    edges = items.select("pdb", F.lit("P").alias("kind"), F.lit("A").alias("c1"), F.lit("B").alias("c2"), (F.col("resnum") % 2).alias("side"), "chain", "resnum", F.lit(True).alias("direct")).distinct()
    found = interface.mass_lists(edges, items)
    return found.select(F.col("pdb").cast("long").alias("l_suppkey"), "masses1", "masses2", F.round(interface.listed_mass(F.col("masses1")), 2).alias("mass1"))


@query("""WITH g AS (SELECT l_orderkey AS k, list(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), f AS (SELECT k, unnest(list_sort(n)) AS n FROM g)
SELECT k::VARCHAR AS key, string_agg(CASE WHEN n <= 4 THEN 'name ' || n ELSE 'L' || n END, '; ' ORDER BY n) AS ligand_names FROM f GROUP BY 1""")
def ligand_names(spark: SparkSession, d: str) -> DataFrame:
    names = spark.range(1, 5).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
    path = files.lines(spark, names, "ligands", F.col("id"), F.lit("other"), F.col("name"))
    lists = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    rows = lists.select("key", F.transform("n", lambda x: F.concat(F.lit("L"), x.cast("string"))).alias("ligands"))
    return interface.ligand_names(rows, readers.ligands(spark, path)).select("key", "ligand_names")


@query("""WITH c AS (SELECT s_nationkey::VARCHAR AS pdb, format('{:06d}', s_suppkey) AS chain, 60 + s_suppkey % 41 AS identity, s_suppkey AS k FROM supplier)
SELECT pdb, chain FROM c WHERE k % 3 <> 0 AND identity >= 80 AND k % 7 <> 0""")
def ligand_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains for tests with other partners, without those that the pairs hold."""
    k = F.col("s_suppkey")
    chains = T.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("pdb"), F.format_string("%06d", k).alias("chain"), (60.0 + k % 41).alias("identity"), (k % 3 == 0).alias("native"), k.alias("k"))
    chosen = chains.filter("k % 7 = 0").select("pdb", F.col("chain").alias("a_chain"), F.when(F.col("k") % 2 == 0, F.col("chain")).otherwise(F.lit("none")).alias("b_chain"))
    return interface.ligand_structures(chains, chosen).select("pdb", "chain")


# Small sources


@query("SELECT l_suppkey::VARCHAR AS pdb, 'A' AS chain, 'D' AS type, l_linenumber::VARCHAR AS a, (list(l_partkey ORDER BY l_orderkey, l_partkey::VARCHAR))[-1]::VARCHAR AS b FROM lineitem GROUP BY ALL")
def nucleic_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairings of nucleic residues; of a repeated one the last stands."""
    pair = F.struct("l_orderkey", F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("t"))
    rows = T.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), ",").alias("pairs"))
    return readers.nucleic_pairs(spark, files.lines(spark, rows, "pairs", F.col("l_suppkey"), F.lit("A"), F.lit("D"), F.col("pairs")))


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), k AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM m), u AS (SELECT DISTINCT l_orderkey, 'U' || l_suppkey % 50 AS u FROM k WHERE n <= 5 AND l_suppkey % 4 <> 0)
SELECT DISTINCT a.u AS ua, b.u AS ub FROM u a JOIN u b USING (l_orderkey) WHERE a.u < b.u""")
def complexes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of proteins in small complexes, from a list with two lines of header."""
    sets = T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    entry = lambda x: F.concat(F.lit("E"), x.cast("string"))
    rows = sets.select(F.col("l_orderkey").cast("string").alias("a"), F.lit("x").alias("b"), F.array_join(F.transform("s", entry), ",").alias("members"))
    head = spark.createDataFrame([("#complexes", "", ""), ("id", "name", "members")], "a string, b string, members string")
    path = files.lines(spark, head.unionByName(rows), "complexes", F.col("a"), F.col("b"), F.col("members"))
    k = F.col("s_suppkey")
    names = T.table(spark, d, "supplier").filter("s_suppkey % 4 <> 0").select(entry(k).alias("entry"), F.concat(F.lit("U"), (k % 50).cast("string")).alias("uniprot"))
    return readers.complexes(spark, path, names)


@query("SELECT 'p' || p_partkey AS pdb, 'p' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '' ELSE '_A_' || p_size || '_B_' || (p_size + 1) END AS name FROM part")
def structure_list(spark: SparkSession, d: str) -> DataFrame:
    """A list of native entries and entries with two chains in any order."""
    n = F.col("p_size")
    sides = F.when(n % 2 == 0, "").otherwise(F.concat(F.lit(" B:"), (n + 1).cast("string"), F.lit(" A:"), n.cast("string")))
    path = files.new_path(spark, "list")
    T.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), sides).alias("value")).write.text(path)
    return readers.structure_list(spark, path).select("pdb", "name")


@query("SELECT s_nationkey::VARCHAR AS pdb, 'P' AS kind, 'A' AS c1, 'B' AS c2, s_suppkey % 2 AS side, s_suppkey AS resnum FROM supplier")
def contacts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = files.new_path(spark, "contacts")
    writers.tsv(T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("pdb"), F.lit("P").alias("kind"), F.lit("A").alias("c1"), F.lit("B").alias("c2"), (k % 2).alias("side"), k.alias("resnum")), path)
    return readers.contacts(spark, path).withColumns({"side": F.col("side").cast("long"), "resnum": F.col("resnum").cast("long")})


# Results, annotation and tables


def _result_file(spark: SparkSession, d: str) -> str:
    """Two runs over the parts as structures."""
    k = F.col("p_partkey")
    pair = lambda s, r: F.concat(((k * 7919 * (s + 1) + r) % 97).cast("string"), F.lit("/"), F.lit(str(100 + r)))
    runs = F.explode(F.array(F.lit(0), F.lit(1))).alias("r")
    rows = T.table(spark, d, "part").select("p_partkey", "p_size", runs)
    return files.lines(
        spark, rows, "results", F.concat(F.lit("U"), (k % 50).cast("string")), F.concat(F.lit("I"), k.cast("string")), F.concat(F.lit("p"), k.cast("string"), F.lit("-A")), F.col("p_size"),
        F.concat_ws(" ", *(F.when(F.col("r") == 0, pair(s, 0)).otherwise(pair(s, 1)) for s in range(5))), F.col("r"),
    )


_TOTALS = """t AS (SELECT p_partkey AS k, s, sum((p_partkey * 7919 * (s + 1) + r) % 97) AS e, sum(100 + r) AS d FROM part, range(5) a(s), range(2) b(r) GROUP BY 1, 2)"""


@query(f"WITH {_TOTALS} SELECT 'p' || k || '-A' AS pdb_chain, s AS scale_idx, e::BIGINT AS exceed, d::BIGINT AS draws, round(e / d::DOUBLE, 9) AS p FROM t")
def result_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of results of two runs, kept under their ids and summed."""
    path = files.new_path(spark, "runs")
    rows = readers.results(spark, _result_file(spark, d))
    for run in (0, 1):
        writers.append_results(rows.filter(F.col("status") == run), path, f"run{run}")
    found = nullmodel.p_values(spark.read.parquet(path), ["pdb_chain", "scale_idx"])
    return found.select("pdb_chain", F.col("scale_idx").cast("long").alias("scale_idx"), "exceed", "draws", F.round("p", 9).alias("p"))


@query(f"""WITH {_TOTALS}, b AS (SELECT 'U' || k % 50 AS uniprot, 'p' || k || '-A' AS key, e / d::DOUBLE AS p FROM t WHERE s = 2),
f AS (SELECT *, row_number() OVER (PARTITION BY uniprot ORDER BY p, key) AS r FROM b), i AS (SELECT *, row_number() OVER (ORDER BY p, uniprot) AS i, count(*) OVER () AS n FROM f WHERE r = 1)
SELECT uniprot, key, round(p, 9) AS p, round(least(1e0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM i""")
def best_by_protein(spark: SparkSession, d: str) -> DataFrame:
    """The best structure of each protein, with q over the proteins."""
    rows = readers.results(spark, _result_file(spark, d)).filter(F.col("scale_idx") == K.REPORTED_SCALE)
    total = nullmodel.p_values(rows.select(F.col("u1").alias("uniprot"), F.col("pdb_chain").alias("key"), "exceed", "draws"), ["uniprot", "key"])
    return summarize.best_by_protein(total).select("uniprot", "key", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


def _metadata(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Genes' metadata and a list of genes, from files."""
    k = F.col("c_custkey")
    names = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("G"), k.cast("string"), F.when(k % 3 == 0, ";").otherwise(" ALIAS")))
    rows = T.table(spark, d, "customer").filter("c_custkey % 13 <> 0").select(
        F.concat(F.lit("U"), k.cast("string")).alias("accession"), names.alias("gene_names"), F.concat(k.cast("string"), F.lit("; "), (k + 1).cast("string"), F.lit(";")).alias("entrez"), (k % 500).alias("length")
    )
    meta, genes = files.new_path(spark, "metadata"), files.new_path(spark, "gene-list")
    writers.tsv(rows, meta)
    writers.tsv(T.table(spark, d, "customer").filter("c_custkey % 5 = 0").select(k.alias("EntrezGeneID"), F.concat(F.lit("sym"), k.cast("string")).alias("GeneSymbol")), genes)
    return readers.gene_metadata(spark, meta, {"U1": 7, "U2": 9}), readers.gene_list(spark, genes)


@query("""WITH r AS (SELECT c_custkey AS k, count(o_orderkey) AS n_samples FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT 'U' || k AS u1, n_samples, CASE WHEN k % 13 = 0 THEN 'NA' ELSE 'G' || k END AS gene, CASE WHEN k % 13 = 0 THEN -1 WHEN k = 1 THEN 7 WHEN k = 2 THEN 9 ELSE k % 500 END AS length,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 5 = 4 AND k + 1 <= (SELECT max(c_custkey) FROM customer) THEN 'sym' || (k + 1) WHEN k % 5 = 0 THEN 'sym' || k END AS symbol
FROM r WHERE n_samples >= 3 AND (k % 13 = 0 OR k % 11 <> 0)""")
def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the first gene name, length and membership in a list; unknown proteins stay, nameless ones go."""
    orders = T.table(spark, d, "customer").join(T.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = orders.groupBy(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("u1")).agg(F.count("o_orderkey").alias("n_samples"))
    found = summarize.annotate(rows, *_metadata(spark, d), min_samples=3)
    return found.select("u1", "n_samples", "gene", F.coalesce(F.col("length").cast("long"), F.lit(-1)).alias("length"), "symbol")


def _summary_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the final table of parts as structures of their own proteins, and their maps."""
    k = F.col("p_partkey")
    name = k.cast("string")
    results = readers.results(spark, _result_file(spark, d)).select(F.col("pdb_chain").alias("structure"), "scale_idx", "exceed", "draws", "status")
    part = T.table(spark, d, "part")
    covered = part.select(
        F.concat(F.lit("p"), name, F.lit("-A")).alias("structure"), F.concat(F.lit("U"), name).alias("u1"), k.alias("start"), (k + 30).alias("end"),
        F.lit(3).cast("long").alias("n_sites"), (k % 9).cast("long").alias("n_samples"), F.lit("1+2+3").alias("sites"),
    )
    maps = part.select(F.concat(F.lit("p"), name, F.lit("-A")).alias("structure"), F.concat(F.lit("I"), name).alias("u2"), F.concat(F.lit("p"), name, F.lit("-A")).alias("pdb_chain"), (50.0 + k % 50).alias("identity"))
    return summarize.summarize(results, covered, *_metadata(spark, d)), maps


@query(f"""WITH {_TOTALS}, m AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 13 <> 0),
f AS (SELECT k, 'p' || k || '-A' AS key, e / d::DOUBLE AS p, m.k IS NOT NULL AS known, (SELECT max(c_custkey) FROM customer) AS most FROM t LEFT JOIN m USING (k) WHERE s = 2),
g AS (SELECT *, CASE WHEN known THEN 'G' || k ELSE 'NA' END AS gene, known AND (k % 5 = 0 OR k % 5 = 4 AND k + 1 <= most) AS listed FROM f WHERE NOT known OR k % 11 <> 0),
i AS (SELECT *, row_number() OVER (ORDER BY p, key) AS i, count(*) OVER () AS n FROM g), q AS (SELECT *, least(1e0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM i),
j AS (SELECT key, p, row_number() OVER (ORDER BY p, key) AS i, count(*) OVER () AS n FROM g WHERE listed), r AS (SELECT key, least(1e0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS r FROM j)
SELECT gene AS "GENE_NAMES", round(p, 9) AS "P", round(q, 9) AS "Q_FULL", k % 9 AS "NSAMPLES", 3::BIGINT AS "NSITES", '1+2+3' AS "SITES", 'U' || k AS "UNIPROT_ID", 'I' || k AS "MAPPED_UNIPROT_ID", key AS "PDBID-CHAIN", 50e0 + k % 50 AS "PERCENT_IDENTITY",
  CASE WHEN k % 2 = 0 THEN 'part of p' || k ELSE 'NA' END AS "PDB_FRAGMENT", CASE WHEN NOT known THEN -1 WHEN k = 1 THEN 7 WHEN k = 2 THEN 9 ELSE k % 500 END AS "UNIPROT_SEQ_LENGTH", k AS "MAP_START", k + 30 AS "MAP_END",
  listed AS "IN_CANCER_GENE_LISTS", round(coalesce(r, -1e0), 9) AS "Q_RESTRICTED" FROM q LEFT JOIN r USING (key)""")
def summary_file(spark: SparkSession, d: str) -> DataFrame:
    """The final table of sixteen columns, written and read again."""
    rows, maps = _summary_rows(spark, d)
    k = F.col("p_partkey").cast("string")
    fragments = T.table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("p"), k).alias("pdb"), F.lit("A").alias("chain"), F.concat(F.lit("part of p"), k).alias("fragment"))
    path = files.new_path(spark, "summary")
    writers.summary(summarize.summary_table(rows, maps, fragments), path)
    found = readers.summary(spark, path).fillna(-1, ["UNIPROT_SEQ_LENGTH"])
    number = [c for c in found.columns if dict(found.dtypes)[c] == "int"]
    return found.withColumns({c: F.round(c, 9) for c in ("P", "Q_FULL", "Q_RESTRICTED")} | {c: F.col(c).cast("long") for c in number})


@query("""WITH s AS (SELECT 'G' || c_nationkey AS g, 'p' || c_custkey || '-A' AS k, (c_custkey * 7919 % 997) / 1000e0 AS p FROM customer)
(SELECT g, k, p FROM s WHERE g = 'G3' ORDER BY p, k LIMIT 1) UNION ALL (SELECT g, k, p FROM s WHERE g = 'G4' AND k = (SELECT min(k) FROM s WHERE g = 'G4'))""")
def summary_row(spark: SparkSession, d: str) -> DataFrame:
    """The rows of two genes that are to be drawn."""
    k = F.col("c_custkey")
    rows = T.table(spark, d, "customer").select(F.concat(F.lit("G"), F.col("c_nationkey").cast("string")).alias("GENE_NAMES"), F.concat(F.lit("p"), k.cast("string"), F.lit("-A")).alias("PDBID-CHAIN"), ((k * 7919 % 997) / 1000.0).alias("P"))
    first = rows.filter("GENE_NAMES = 'G4'").agg(F.min("PDBID-CHAIN")).first()[0]
    both = readers.summary_row(rows, "G3").unionByName(readers.summary_row(rows, "G4", first))
    return both.select(F.col("GENE_NAMES").alias("g"), F.col("PDBID-CHAIN").alias("k"), F.col("P").alias("p"))


@query("""WITH c AS (SELECT event_type AS pdb, user_id % 50 AS resnum, count(DISTINCT (event_type, user_id)) AS n FROM events WHERE event_type LIKE 'c%' GROUP BY 1, 2 HAVING count(DISTINCT (event_type, user_id)) >= 2)
SELECT pdb, resnum, n FROM c""")
def residue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Residues of one type's prefix that two samples or more have mutated."""
    rows = T.table(spark, d, "events").select(F.col("event_type").alias("pdb"), F.lit("A").alias("chain"), (F.col("user_id") % 50).alias("resnum"), F.lit("M").alias("mtype"), F.col("event_type").alias("ttype"), F.col("user_id").alias("sample"))
    return interface.residue_counts(rows, least=2, ttype="c").select("pdb", "resnum", "n")


_FACES = """i AS (SELECT l_suppkey AS s, l_linenumber % 2 AS side, l_linenumber AS r, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
e AS (SELECT s, 'P' AS kind, side, r, r % 3 <> 0 AS direct FROM i UNION ALL SELECT s, 'L', 0, r, true FROM i WHERE side = 0 AND s % 2 = 0),
f AS (SELECT e.*, r + 100 AS u, CASE WHEN r % 4 <> 3 THEN w END AS w FROM e JOIN i USING (s, side, r)),
t AS (SELECT s, kind, sum(w) AS mass, sum(w) FILTER (side = 0) AS m1, sum(w) FILTER (side = 1) AS m2, count(*) FILTER (side = 0 AND direct) AS f1, count(*) FILTER (side = 1 AND direct) AS f2,
  coalesce(string_agg(u, ';' ORDER BY u) FILTER (side = 0), '') AS r1, coalesce(string_agg(u, ';' ORDER BY u) FILTER (side = 1), '') AS r2,
  coalesce(string_agg(u, ';' ORDER BY u) FILTER (side = 0 AND direct), '') AS d1, coalesce(string_agg(u || '_' || printf('%.2f', w), ';' ORDER BY u) FILTER (side = 1 AND w IS NOT NULL), '') AS k2 FROM f GROUP BY ALL),
n AS (SELECT s, count(*) FILTER (side = 0) AS n1, count(*) FILTER (side = 1) AS n2 FROM i GROUP BY 1),
p AS (SELECT *, (s * 37 % 101 + 1) / 102e0 AS p, (s * 41 % 101 + 1) / 102e0 AS p1, (s * 43 % 101 + 1) / 102e0 AS p2 FROM t JOIN n USING (s))"""


def _face_rows(spark: SparkSession, d: str) -> DataFrame:
    """Interfaces of two chains, and of one with a ligand, with given p-values."""
    s, r = F.col("l_suppkey"), F.col("l_linenumber")
    items = T.table(spark, d, "lineitem").groupBy(s.alias("s"), (r % 2).alias("side"), r.alias("resnum")).agg(F.sum("l_quantity").alias("w"))
    items = items.withColumns({"pdb": F.col("s").cast("string"), "chain": F.when(F.col("side") == 0, "A").otherwise("B")})
    name = lambda kind, c2, direct: [F.lit(kind).alias("kind"), F.lit("A").alias("c1"), F.lit(c2).alias("c2"), "side", "chain", "resnum", direct.alias("direct")]
    edges = items.select("pdb", *name("P", "B", F.col("resnum") % 3 != 0))
    edges = edges.unionByName(items.filter("side = 0 AND s % 2 = 0").select("pdb", *name("L", "A_1_X", F.lit(True))))
    residues = items.select("pdb", "chain", "resnum", F.concat(F.lit("U"), "chain", (F.col("s") % 40).cast("string")).alias("uniprot"), (F.col("resnum") + 100).alias("u"))
    muts = items.filter("resnum % 4 <> 3").select("pdb", "chain", "resnum", "w")
    p = lambda k: (F.col("pdb").cast("long") * k % 101 + 1) / 102.0
    sums = interface.interface_mass(edges, muts)
    kinds = [("total", "mass", 37), ("side1", "mass1", 41), ("side2", "mass2", 43)]
    tests = sums.select("pdb", "kind", "c1", "c2", F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(m).alias("mass"), p(k).alias("p")) for n, m, k in kinds))).alias("t"))
    tests = tests.select("pdb", "kind", "c1", "c2", "t.*").filter("kind = 'P' OR statistic = 'total'")
    return interface.result_rows(edges, residues, muts, tests)


@query(f"""WITH {_FACES} SELECT s, kind, 'UA' || s % 40 AS u1, CASE WHEN kind = 'P' AND n2 > 0 THEN 'UB' || s % 40 ELSE '-' END AS u2, round(coalesce(mass, 0), 2) AS mass, round(p, 9) AS p,
  n1 AS mapped1, f1 AS iface1, round(CASE WHEN kind = 'P' THEN coalesce(m1, 0) ELSE coalesce(mass, 0) END, 2) AS mass1, round(CASE WHEN kind = 'P' THEN p1 ELSE p END, 9) AS p1, r1 AS residues1, d1 AS direct1,
  CASE WHEN kind = 'P' THEN f2 ELSE -1 END AS iface2, round(CASE WHEN kind = 'P' THEN coalesce(m2, 0) ELSE -1 END, 2) AS mass2, CASE WHEN kind = 'P' THEN k2 ELSE '-' END AS masses2 FROM p WHERE n1 > 0""")
def interface_rows(spark: SparkSession, d: str) -> DataFrame:
    """The wide rows of the interface tool."""
    rows = _face_rows(spark, d).filter("u1 IS NOT NULL")
    two = lambda c: F.round(c, 2).alias(c)
    return rows.fillna(-1, ["iface2", "mass2"]).fillna("-", ["u2", "masses2"]).select(
        F.col("pdb").cast("long").alias("s"), "kind", "u1", "u2", two("mass"), F.round("p", 9).alias("p"), "mapped1", "iface1", two("mass1"), F.round("p1", 9).alias("p1"),
        "residues1", "direct1", F.col("iface2").cast("long").alias("iface2"), two("mass2"), "masses2",
    )


@query(f"""WITH {_FACES}, x AS (SELECT 'UA' || s % 40 AS uniprot, s || '/A/B/1' AS key, coalesce(m1, 0) AS mass, p1 AS p FROM p WHERE kind = 'P' AND n1 > 0 UNION ALL SELECT 'UB' || s % 40, s || '/A/B/2', coalesce(m2, 0), p2 FROM p WHERE kind = 'P' AND n2 > 0),
b AS (SELECT *, substr(uniprot, 3)::INT % 3 = 0 AS listed FROM (SELECT *, row_number() OVER (PARTITION BY uniprot ORDER BY p, key) AS r FROM x) WHERE r = 1),
g AS (SELECT *, row_number() OVER (ORDER BY p, uniprot) AS i, count(*) OVER () AS n FROM b), q AS (SELECT uniprot, least(1e0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM g),
j AS (SELECT *, row_number() OVER (ORDER BY p, uniprot) AS i, count(*) OVER () AS n FROM b WHERE listed), z AS (SELECT uniprot, least(1e0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS z FROM j)
SELECT uniprot, key, round(mass, 2) AS mass, round(p, 9) AS p, round(q, 9) AS q, round(coalesce(z, -1e0), 9) AS q_restricted FROM b JOIN q USING (uniprot) LEFT JOIN z USING (uniprot)""")
def interface_per_protein(spark: SparkSession, d: str) -> DataFrame:
    """The best interface side of each protein."""
    rows = _face_rows(spark, d).filter("kind = 'P'")
    listed = spark.range(0, 40, 3).select(F.explode(F.array(*(F.concat(F.lit(c), F.col("id").cast("string")) for c in ("UA", "UB")))).alias("uniprot"))
    found = interface.per_protein(rows, listed)
    return found.select("uniprot", "key", F.round("mass", 2).alias("mass"), *(F.round(c, 9).alias(c) for c in ("p", "q", "q_restricted")))


# Runs, medians, counts in passing and files by id


@query(f"""WITH {_GENES}, m AS (SELECT g, idx // 3 + 1 AS i, avg(CASE WHEN g % 6 <> 5 THEN ((b + 7 * ((p - b) // 7)) % 17)::DOUBLE END) AS v FROM coding WHERE NOT excluded GROUP BY 1, 2),
c AS (SELECT g, i, coalesce(v, 0) AS v FROM m)
SELECT 'U' || g AS structure, i, round(CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 1e0 / count(*) OVER w END, 9) AS weight FROM c WINDOW w AS (PARTITION BY g)""")
def coverage_runs(spark: SparkSession, d: str) -> DataFrame:
    """Draw weights of residues from runs of equal coverage, which cut codons anywhere."""
    g = _genes(spark, d).filter("g % 6 <> 5")
    step = F.explode(F.sequence(F.col("b"), F.col("e1") - 1, F.lit(7).cast("long"))).alias("start")
    rows = g.select(F.col("c").alias("chrn"), step, "e1")
    path = files.new_path(spark, "coverage-runs")
    writers.tsv(rows.select("chrn", "start", F.least(F.col("start") + 7, F.col("e1")).alias("end"), (F.col("start") % 17).alias("cov")), path)
    spans = mapping.residue_spans(readers.gene_map(spark, _gene_file(spark, d)))
    spans = spans.select(F.col("uniprot").alias("structure"), F.col("site").alias("i"), C.chromosome_number(F.col("chrom")).alias("chrn"), "s", "e")
    found = nullmodel.coverage_by_runs(spans, readers.coverage_runs(spark, path), 512)
    return found.select("structure", F.col("i").cast("long").alias("i"), F.round("weight", 9).alias("weight"))


@query("SELECT l_returnflag, l_linenumber % 2 AS side, median(l_extendedprice) AS middle FROM lineitem GROUP BY ALL")
def exact_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians of few keys with many values, in rounds of buckets."""
    rows = T.table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 2).cast("long").alias("side"), "l_extendedprice")
    return nullmodel.exact_median(rows, ["l_returnflag", "side"], "l_extendedprice", "middle", held=50)


@query(f"""WITH {_MAPPED}, s AS (SELECT 1 AS k, 'mutations' AS step, count(*) AS n FROM muts UNION ALL SELECT 2, 'single bases', count(*) FROM muts WHERE alt <> '-'
UNION ALL SELECT 3, 'in exons', count(*) FROM muts m JOIN tr t ON m.g = t.g AND m.p = t.p WHERE NOT excluded AND alt <> '-' UNION ALL SELECT 6, 'same amino acid', count(*) FROM mapped)
SELECT step, n FROM s""")
def dropped_mutations(spark: SparkSession, d: str) -> DataFrame:
    """Rows that reach the steps of the mapping, counted by the job that writes its result."""
    tally = Tally()
    mapped = mapping.to_residues(
        readers.mutations(spark, _mutation_file(spark, d)), readers.gene_map(spark, _gene_file(spark, d)),
        readers.genome(spark, _genome_file(spark, d), 4096), readers.proteins(spark, _protein_file(spark, d)), 4096, 512, tally,
    )
    mapped.write.parquet(files.new_path(spark, "counted"))
    return tally.table(spark).filter(F.col("step").isin("mutations", "single bases", "in exons", "same amino acid")).select("step", "n")


@query(f"WITH {_BLOCKS} SELECT pdb, 2 * count(*) AS atoms, 1::BIGINT AS found FROM e WHERE label % 3 = 1 GROUP BY 1 UNION ALL SELECT 'none', 0, 0")
def structures_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Only the files of structures that a table names are opened; an id without a file is reported."""
    blocks = T.table(spark, d, "embeddings").filter("label % 3 = 1").groupBy("label").agg(F.floor((F.count("*") - 1) / _RESIDUES).alias("last"))
    ids = blocks.select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block")).select(_structure_name(F.col("block")).alias("pdb"))
    ids = ids.unionByName(spark.range(1).select(F.lit("none").alias("pdb")))
    lines = structure_lines(ids, _structure_files(spark, d), pattern="pdb{id}.ent")
    found = lines.groupBy("pdb").agg(F.count_if(F.col("value").startswith("ATOM")).alias("atoms"), F.max(F.col("n").isNotNull().cast("long")).alias("found"))
    return found.select("pdb", "atoms", "found")


_CHROMOSOMES = "SELECT p_partkey AS k, CASE p_partkey % 29 WHEN 25 THEN 'X' WHEN 26 THEN 'Y' WHEN 27 THEN 'MT' WHEN 0 THEN '1' ELSE (p_partkey % 29)::VARCHAR END AS name FROM part"


@query(f"""SELECT k, 'chr' || CASE name WHEN '23' THEN 'X' WHEN '24' THEN 'Y' WHEN 'MT' THEN 'M' ELSE name END AS chrom,
  CASE WHEN name IN ('X', '23') THEN 23 WHEN name IN ('Y', '24') THEN 24 WHEN name = 'MT' THEN 25 ELSE name::INT END AS number FROM ({_CHROMOSOMES})""")
def chromosome_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with the prefix, and numbers back from them, sex chromosomes and mitochondria included."""
    n = F.col("p_partkey") % 29
    name = F.when(n == 25, "X").when(n == 26, "Y").when(n == 27, "MT").when(n == 0, "1").otherwise(n.cast("string"))
    rows = T.table(spark, d, "part").select(F.col("p_partkey").alias("k"), C.chromosome_name(name).alias("chrom"))
    return rows.withColumn("number", C.chromosome_number(F.col("chrom")))


@query("""WITH m AS (SELECT l_orderkey AS s, l_linenumber::BIGINT AS u, l_suppkey % 40 - 1 AS p FROM lineitem), ok AS (SELECT s FROM m GROUP BY 1 HAVING count(*) >= 5 AND min(p) >= 0),
c AS (SELECT *, count(*) OVER (PARTITION BY s, p) AS n FROM m WHERE s IN (FROM ok)) SELECT s AS structure, u, p FROM c WHERE n = 1""")
def negative_residues(spark: SparkSession, d: str) -> DataFrame:
    """Maps with a negative residue go as a whole; residues mapped twice lose all copies."""
    pair = F.struct(F.col("l_linenumber").cast("int").alias("u"), (F.col("l_suppkey") % 40 - 1).cast("int").alias("p"))
    maps = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("structure")).agg(F.array_sort(F.collect_list(pair)).alias("resmap"))
    maps = maps.withColumns({"u1": F.lit("P"), "u2": F.lit("P"), "pdb_chain": F.lit("s-A")})
    return structure.usable_maps(maps).select("structure", F.col("u").cast("long").alias("u"), F.col("p").cast("long").alias("p"))


@query("""WITH r AS (SELECT l_orderkey AS s, l_linenumber AS i, max(l_quantity) AS x, max(l_partkey) % 23 = 0 AS odd, max(l_suppkey) % 31 = 0 AS absent FROM lineitem GROUP BY 1, 2)
SELECT s::VARCHAR AS structure, i::BIGINT AS i, round(x + 0.5e0, 6) AS x FROM r WHERE s NOT IN (SELECT s FROM r WHERE odd OR absent)""")
def broken_structures(spark: SparkSession, d: str) -> DataFrame:
    """A structure with a residue of an unknown name, or without atoms of one, goes as a whole."""
    items = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("pdb"), F.col("l_linenumber").cast("int").alias("r"))
    items = items.agg(F.max("l_quantity").cast("double").alias("x"), *(F.max(c).alias(c) for c in ("l_partkey", "l_suppkey")))
    at = items.filter("l_suppkey % 31 <> 0").select("pdb", F.lit("A").alias("chain"), F.col("r").alias("resnum"), F.when(F.col("l_partkey") % 23 == 0, "???").otherwise("GLY").alias("resname"), F.explode(F.array(F.col("x"), F.col("x") + 1)).alias("x"))
    atoms = at.withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    residues = items.select(F.col("pdb").alias("structure"), F.concat("pdb", F.lit("-A")).alias("pdb_chain"), F.col("r").alias("i"), F.col("r").alias("u"), F.col("r").alias("p"))
    found = structure.residue_centroids(residues, atoms)
    return found.select("structure", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("""WITH r AS (SELECT l_orderkey AS k, 'u' || l_suppkey % 6 AS u1, 'u' || l_partkey % 6 AS u2, (l_partkey % 3)::DOUBLE * (l_suppkey % 6 % 2) AS i1, (l_linenumber % 3)::DOUBLE AS i2, l_linenumber AS n, ((l_orderkey * 31 + l_linenumber) % 101 + 1) / 102e0 AS p FROM lineitem),
f AS (SELECT *, least(u1, u2) AS ua, greatest(u1, u2) AS ub FROM r WHERE u1 <> u2), t AS (SELECT ua, ub, max(i1) AS t1, max(i2) AS t2 FROM f GROUP BY 1, 2)
SELECT ua, ub, least(t1, t2) > 0 AS kept, (SELECT count(*) FROM f WHERE f.ua = t.ua AND f.ub = t.ub) AS n FROM t""")
def empty_interfaces(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of proteins whose interfaces have no mapped residues on one side are dropped."""
    text = lambda c: F.concat(F.lit("u"), (F.col(c) % 6).cast("string"))
    name = lambda s, c: F.concat(F.lit(s), F.col(c).cast("string"))
    rows = T.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("pdb"), name("c", "l_suppkey").alias("c1"), name("d", "l_partkey").alias("c2"), text("l_suppkey").alias("u1"), text("l_partkey").alias("u2"),
        F.lit(10.0).alias("mapped1"), ((F.col("l_partkey") % 3) * (F.col("l_suppkey") % 6 % 2)).cast("double").alias("iface1"), F.lit(10.0).alias("mapped2"), (F.col("l_linenumber") % 3).cast("double").alias("iface2"),
        (((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 101 + 1) / 102.0).alias("p"),
    )
    ids = rows.select("u1", F.concat_ws("-", "pdb", "c1").alias("pdb_chain")).unionByName(rows.select(F.col("u2").alias("u1"), F.concat_ws("-", "pdb", "c2").alias("pdb_chain"))).distinct()
    best = interface.best_pair_rows(rows, ids.withColumn("identity", F.lit(90.0))).select("ua", "ub", F.lit(True).alias("_kept"))
    pairs = rows.filter("u1 <> u2").groupBy(F.least("u1", "u2").alias("ua"), F.greatest("u1", "u2").alias("ub")).agg(F.count("*").alias("n"))
    return pairs.join(best, ["ua", "ub"], "left").select("ua", "ub", F.coalesce("_kept", F.lit(False)).alias("kept"), "n")


@query("""WITH a AS (SELECT l_orderkey AS pdb, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS chain, l_linenumber AS r, l_quantity::DOUBLE AS x, l_partkey % 11 AS y, l_suppkey % 7 AS z FROM lineitem),
m AS (SELECT DISTINCT a.pdb, a.r AS r1, b.r AS r2 FROM a JOIN a b ON a.pdb = b.pdb AND a.chain = 'A' AND b.chain = 'B' AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 64)
SELECT DISTINCT pdb::VARCHAR AS pdb, side, CASE WHEN side = 0 THEN r1 ELSE r2 END AS resnum FROM m, (VALUES (0), (1)) t(side)""")
def contacts_of_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Residues of two chains that touch, from the atoms of all structures."""
    n = F.col("l_linenumber")
    atoms = T.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("pdb"), F.when(n % 2 == 0, "A").otherwise("B").alias("chain"), n.alias("resnum"),
        F.col("l_quantity").cast("double").alias("x"), (F.col("l_partkey") % 11).cast("double").alias("y"), (F.col("l_suppkey") % 7).cast("double").alias("z"),
    )
    return interface.atom_contacts(atoms, 8.0).select("pdb", "side", "resnum")
