"""Readers of the input tables, with explicit schemas; S-numbers follow the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.sources.structure_files import structure_lines
from residuum.sources.twobit import TwoBit
from residuum.sources.writers import protein_shard

MUTATIONS = (
    "Chromosome string, Start_position long, Reference_Allele string, Tumor_Seq_Allele2 string, "
    "Tumor_Sample_Barcode string, ttype string, Variant_Type string, Variant_Classification string"
)
SITES = "ttype string, sample string, filler string, uniprot string, change string, site int, mtype string, value double"
WEIGHTS = "TTYPE string, SAMPLE string, MUT_COUNT long, TTYPE_RANK_SCORE double, ZLOG_SCORE double"
PTM = (
    "patient", "uniprot_id", "site_position", "geneSymbol", "variableSites", "value", "mtype", "ttype",
)


def _tsv(spark: SparkSession, path: str, header: bool = True, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", header).option("quote", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def mutations(spark: SparkSession, path: str) -> DataFrame:
    """A headed table in any column order; chromosomes stay strings."""
    found = _tsv(spark, path)
    fields = [f.strip().split(" ") for f in MUTATIONS.split(",")]
    return found.select(*(F.col(n).cast(t).alias(n) for n, t in fields if n in found.columns))


def ptm_sites(spark: SparkSession, path: str) -> DataFrame:
    """Modification sites; a missing column is an error."""
    found = _tsv(spark, path)
    missing = set(PTM) - {"variableSites"} - set(found.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return found.withColumns({"value": F.col("value").cast("int"), "site_position": F.col("site_position").cast("int")})


def sites(spark: SparkSession, path: str) -> DataFrame:
    """Mutations by protein."""
    return _tsv(spark, path, False, SITES)


def protein_sites(spark: SparkSession, path: str, uniprots: list[str] | None = None) -> DataFrame:
    """What :func:`writers.by_protein` wrote; with ``uniprots`` only their partitions are read."""
    found = spark.read.parquet(path)
    if uniprots is not None:
        names = spark.createDataFrame([(u,) for u in uniprots], "uniprot string")
        shards = [r[0] for r in names.select(protein_shard(F.col("uniprot"))).distinct().collect()]  # of the given names
        found = found.filter(F.col("protein_shard").isin(shards)).filter(F.col("uniprot").isin(uniprots))
    return found.drop("protein_shard")


def proteins(spark: SparkSession, path: str) -> DataFrame:
    """``uniprot, seq`` of a FASTA file, the last record too."""
    records = spark.read.option("lineSep", "\n>").text(path)
    lines = F.split(F.regexp_replace(F.col("value"), "^>", ""), "\r?\n")
    return records.filter("trim(value) <> ''").select(
        F.get(F.split(F.get(lines, F.lit(0)), r"\|"), F.lit(1)).alias("uniprot"),
        F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "").alias("seq"),
    )


def gene_map(spark: SparkSession, path: str) -> DataFrame:
    """Genes with exons, protein blocks and excluded positions."""
    raw = _tsv(spark, path, False, "chrom string, start long, end long, exons string, strand string, uniprot string, blocks string, excluded string")
    pair = lambda x, sep, kind: (
        F.split_part(x, F.lit(sep), F.lit(1)).cast(kind), F.split_part(x, F.lit(sep), F.lit(2)).cast(kind)
    )

    def exon(x):
        s, e = pair(x, "-", "long")
        return F.struct(s.alias("s"), e.alias("e"))

    def block(x):
        ends = []
        for i, name in ((1, "a0"), (2, "a1")):
            part = F.split_part(x, F.lit("-"), F.lit(i))
            number = F.substring(part, F.lit(1), F.length(part) - 2).cast("int")
            ends.append(F.struct(number.alias("aa"), F.right(part, F.lit(1)).cast("int").alias("phase")).alias(name))
        return F.struct(*ends)

    listed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    return raw.select(
        "chrom", "start", "end", F.transform(listed(F.col("exons")), exon).alias("exons"), "strand", "uniprot",
        F.transform(listed(F.col("blocks")), block).alias("blocks"),
        listed(F.col("excluded")).cast("array<long>").alias("excluded"),
    ).withColumn("gene", F.xxhash64("chrom", "start", "end", "uniprot", F.col("exons").cast("string")))


def residue_maps(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of proteins to structure chains."""
    raw = _tsv(spark, path, False, "u1 string, u2 string, pdb_chain string, attrs string, residues string")
    return raw.select(
        "u1", "u2", "pdb_chain", "attrs", C.identity(F.col("attrs")).alias("identity"), C.residue_map(F.col("residues")).alias("resmap")
    ).withColumn("structure", F.xxhash64("u1", "u2", "pdb_chain", "attrs", F.to_json("resmap")))


def weights(spark: SparkSession, path: str) -> DataFrame:
    """S08."""
    return _tsv(spark, path, True, WEIGHTS)


def spectra(spark: SparkSession, path: str) -> DataFrame:
    """Long form ``patient, ttype, name, channel, n``; ``channel`` is the number of the header's ``abc-n``."""
    wide = _tsv(spark, path)
    counts = [c for c in wide.columns if c not in ("patient", "ttype")]
    if unknown := set(counts) - set(K.channels()):
        raise ValueError(f"unknown channels: {', '.join(sorted(unknown))}")
    wide = wide.withColumns({c: F.col(f"`{c}`").cast("long") for c in counts})
    number = F.element_at(C.literal_map({c: i for i, c in enumerate(K.channels())}), F.col("name"))
    return wide.unpivot(["patient", "ttype"], counts, "name", "n").withColumn("channel", number)


def genome(spark: SparkSession, path: str, chunk: int = 65536) -> DataFrame:
    """``chrom, chunk_id, seq`` from FASTA; each chunk holds two bases more than its step.

    Lines stay apart: each finds its place from sums inside its split of the file and over the
    splits before, of which there are few, so no row or task holds a chromosome.
    """
    raw = spark.read.text(path).select(
        F.regexp_replace("value", r"\s+$", "").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
    )
    head = F.when(F.col("line").startswith(">"), F.get(F.split(F.substring("line", 2, 1 << 30), r"\s"), F.lit(0)))
    rows = raw.withColumn("head", head).withColumn("n", F.when(F.col("head").isNull(), F.length("line")).otherwise(0))
    inside = Window.partitionBy("file", "block").orderBy("at")
    rows = rows.withColumn("record", F.count("head").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("file", "block", "record").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # the parts of records in each split, in the order of the file
    parts = rows.groupBy("file", "block", "record").agg(F.sum("n").alias("n"), F.max("head").alias("head"))
    along = Window.partitionBy("file").orderBy("block", "record")
    parts = parts.withColumn("whole", F.count("head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    of_record = Window.partitionBy("file", "whole")
    before = F.coalesce(F.sum("n").over(of_record.orderBy("block", "record").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "block", "record", F.max("head").over(of_record).alias("chrom"), before.alias("before"))
    placed = rows.filter("n > 0").join(parts, ["file", "block", "record"]).withColumn("start", F.col("offset") + F.col("before"))
    first = F.greatest(F.floor((F.col("start") - 2) / chunk), F.lit(0))  # the two bases that go to the chunk before, too
    chunks = F.explode(F.sequence(first, F.floor((F.col("start") + F.col("n") - 1) / chunk)))
    cut = placed.withColumn("chunk_id", chunks).withColumn("from", F.greatest(F.col("chunk_id") * chunk - F.col("start"), F.lit(0)))
    upto = F.least(F.col("n"), (F.col("chunk_id") + 1) * chunk + 2 - F.col("start"))
    piece = F.substring(F.col("line"), (F.col("from") + 1).cast("int"), (upto - F.col("from")).cast("int"))
    cut = cut.withColumn("piece", F.struct("start", piece.alias("bases"))).filter(upto > F.col("from"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["bases"]), "")
    return cut.groupBy("chrom", "chunk_id").agg(whole.alias("seq"))


def two_bit(spark: SparkSession, path: str, chunk: int = 65536, per_task: int = 64) -> DataFrame:
    """As :func:`genome`, from a 2bit file; filters on ``chrom`` and ``chunk_id`` decide which chunks are read."""
    spark.dataSource.register(TwoBit)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"chunk": chunk, "per_task": per_task, "pushdown": "true"}
    return spark.read.format("twobit").options(**options).load(path)


def _structure_text(spark: SparkSession, path: str, ids: DataFrame | None) -> DataFrame:
    """``pdb, value``: lines of all files under ``path``, or of those that ``ids`` names."""
    if ids is not None:
        return structure_lines(ids, path).filter("n IS NOT NULL").select("pdb", "value")
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"pdb(\w{4})\.", 1).alias("pdb"), "value")


def atoms(spark: SparkSession, path: str, chains: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Atom records of structure files ``pdbXXXX.ent`` (also compressed).

    With ``ids`` (``pdb``) only the files of those structures are opened, under the folders of their middle characters.
    """
    return atom_records(_structure_text(spark, path, ids), chains)


def atom_records(lines: DataFrame, chains: list[str] | None = None) -> DataFrame:
    """``pdb, chain, resnum, resname, x, y, z`` of the atom lines ``pdb, value``."""
    lines = lines.filter(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    field = lambda b, n: F.trim(F.substring("value", b, n))
    found = lines.select(
        "pdb",
        field(22, 1).alias("chain"),
        field(23, 4).cast("int").alias("resnum"),
        field(18, 3).alias("resname"),
        *(field(b, 8).cast("double").alias(c) for b, c in ((31, "x"), (39, "y"), (47, "z"))),
    )
    return found.filter(F.col("chain").isin(chains)) if chains else found


def fragments(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """``pdb, chain, fragment`` of structure headers, ``NA`` where a molecule names none; ``ids`` as in :func:`atoms`."""
    lines = _structure_text(spark, path, ids)
    parts = (
        lines.filter(F.col("value").startswith("COMPND"))
        .groupBy("pdb")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.substring("value", 8, 3).alias("n"), F.trim(F.substring("value", 11, 70)).alias("t")))), lambda x: x["t"]), " ").alias("text"))
        .select("pdb", F.explode(F.split("text", "MOL_ID:")).alias("molecule"))
    )
    chains = F.explode(F.split(F.regexp_extract("molecule", r"CHAIN:\s*([^;]+)", 1), r",\s*"))
    text = F.nullif(F.trim(F.regexp_extract("molecule", r"FRAGMENT:\s*([^;]+)", 1)), F.lit(""))
    rows = parts.select("pdb", chains.alias("chain"), F.coalesce(text, F.lit("NA")).alias("fragment"))
    return rows.withColumn("chain", F.trim("chain")).filter("chain <> ''")


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """``chrn, pos, cov`` as a table."""
    return _tsv(spark, path, True, "chrn int, pos long, cov double")


def coverage_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of equal coverage: ``chrn, start, end, cov``, positions from 0, the end not included."""
    return _tsv(spark, path, True, "chrn int, start long, end long, cov double")


def gene_metadata(spark: SparkSession, path: str, overrides: dict[str, int] | None = None) -> DataFrame:
    """``accession, entrez, gene_names, length``; ``overrides`` replaces lengths."""
    raw = _tsv(spark, path, True, "accession string, gene_names string, entrez string, length int")
    ids = F.transform(F.filter(F.split(F.coalesce("entrez", F.lit("")), ";"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    out = raw.withColumn("entrez", ids)
    if overrides:
        out = out.withColumn("length", F.coalesce(F.try_element_at(C.literal_map(overrides), F.col("accession")), "length"))
    return out


def gene_list(spark: SparkSession, path: str, id_col: str = "EntrezGeneID", symbol_col: str = "GeneSymbol") -> DataFrame:
    """S15."""
    return _tsv(spark, path).select(F.col(id_col).cast("int").alias("entrez_id"), F.col(symbol_col).alias("symbol"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Long rows ``structure key, scale_idx, exceed, draws, status`` of result lines.

    A line holds key columns, then ``e/d`` for each scale, then the status.
    """
    raw = _tsv(spark, path, False, "u1 string, u2 string, pdb_chain string, start int, scores string, status int")
    return _scores(raw, "u1", "u2", "pdb_chain", "start")


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """Results whose key is the file's name, ``number_u1_u2_chain_start``; lines of ``e/d`` and status lines ``#status`` take turns.

    As :func:`results`, with the number of the run in its file as ``run``.
    """
    raw = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", ""), "_").alias("k"), F.posexplode(F.split(F.trim("value"), r"\s*\n")).alias("line", "text"))
    raw = raw.filter((F.size("k") == 5) & (F.col("text") != "")).select(
        F.get("k", F.lit(1)).alias("u1"), F.get("k", F.lit(2)).alias("u2"), F.get("k", F.lit(3)).alias("pdb_chain"), F.get("k", F.lit(4)).cast("int").alias("start"),
        F.floor(F.col("line") / 2).cast("int").alias("run"), F.when(F.col("line") % 2 == 0, F.col("text")).alias("scores"), F.when(F.col("line") % 2 == 1, F.regexp_replace("text", "^#", "")).cast("int").alias("status"),
    )
    keys = ["u1", "u2", "pdb_chain", "start", "run"]
    return _scores(raw.groupBy(*keys).agg(F.max("scores").alias("scores"), F.max("status").alias("status")), *keys)


def _scores(raw: DataFrame, *keys: str) -> DataFrame:
    flat = raw.select(*keys, "status", F.posexplode(F.split("scores", r"\s+")).alias("scale_idx", "pair"))
    part = lambda i: F.split_part("pair", F.lit("/"), F.lit(i)).cast("long")
    return flat.select(*keys, "scale_idx", "status", part(1).alias("exceed"), part(2).alias("draws"))


def nucleic_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``pdb, chain, type, a, b``; the last value of a repeated key stands."""
    raw = _tsv(spark, path, False, "pdb string, chain string, type string, pairs string")
    rows = raw.select("pdb", "chain", "type", F.posexplode(F.split("pairs", ",")).alias("i", "pair"))
    rows = rows.select("pdb", "chain", "type", "i", F.split_part("pair", F.lit(":"), F.lit(1)).alias("a"), F.split_part("pair", F.lit(":"), F.lit(2)).alias("b"))
    return rows.groupBy("pdb", "chain", "type", "a").agg(F.max_by("b", "i").alias("b"))


def structure_maps(spark: SparkSession, path: str, pdbs: list[str] | None = None) -> DataFrame:
    """What :func:`writers.by_structure` wrote; with ``pdbs`` only their partitions are read."""
    found = spark.read.parquet(path)
    if pdbs is None:
        return found.drop("shard")
    shards = sorted({p[1:3] for p in pdbs})
    return found.filter(F.col("shard").isin(shards)).filter(F.split_part("pdb_chain", F.lit("-"), F.lit(1)).isin(pdbs)).drop("shard")


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """Interface residues ``pdb, kind, c1, c2, side, resnum``."""
    return _tsv(spark, path, True, "pdb string, kind string, c1 string, c2 string, side int, resnum int")


def structure_list(spark: SparkSession, path: str) -> DataFrame:
    """Native entries (an id) or entries with two chains; ``name`` is canonical."""
    raw = spark.read.text(path).filter("trim(value) <> ''")
    parts = F.split(F.trim("value"), r"\s+")
    sides = F.array_sort(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    name = F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(sides, lambda x: F.replace(x, F.lit(":"), F.lit("_")))), "_")
    return raw.select(F.get(parts, F.lit(0)).alias("pdb"), sides.alias("sides"), name.alias("name"))


def ligands(spark: SparkSession, path: str) -> DataFrame:
    """S26."""
    return _tsv(spark, path, False, "id string, other string, name string").select("id", "name")


def complexes(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Sorted pairs of proteins that share a complex of up to five known members.

    ``names`` maps ``entry`` to ``uniprot``. The two lines of header need no care: the first is a comment,
    and the second names no known entry.
    """
    raw = _tsv(spark, path, False, "a string, b string, members string").filter("NOT startswith(a, '#')")
    entries = F.split("members", ",")
    rows = raw.filter(F.size(entries) <= 5).withColumn("complex", F.xxhash64("a", "b", "members"))
    rows = rows.select("complex", F.explode(entries).alias("entry")).filter(~F.col("entry").contains("."))
    rows = rows.join(names, "entry").select("complex", "uniprot").distinct()
    left, right = rows.withColumnRenamed("uniprot", "ua"), rows.withColumnRenamed("uniprot", "ub")
    return left.join(right, "complex").filter("ua < ub").select("ua", "ub").distinct()


def summary(spark: SparkSession, path: str) -> DataFrame:
    """The final table with its types."""
    return _tsv(
        spark, path, True,
        "GENE_NAMES string, P double, Q_FULL double, NSAMPLES int, NSITES int, SITES string, UNIPROT_ID string, MAPPED_UNIPROT_ID string, `PDBID-CHAIN` string, "
        "PERCENT_IDENTITY double, PDB_FRAGMENT string, UNIPROT_SEQ_LENGTH int, MAP_START int, MAP_END int, IN_CANCER_GENE_LISTS boolean, Q_RESTRICTED double",
    )


def summary_row(summary: DataFrame, gene: str, pdb_chain: str | None = None) -> DataFrame:
    """The row of a gene to be drawn, the best by p unless a chain is named."""
    rows = summary.filter(F.col("GENE_NAMES") == gene)
    if pdb_chain:
        rows = rows.filter(F.col("PDBID-CHAIN") == pdb_chain)
    return rows.orderBy("P", "PDBID-CHAIN").limit(1)
