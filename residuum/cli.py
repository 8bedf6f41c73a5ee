"""``python -m residuum.cli prep|test|summarize|select|interface-test|interface-summarize``, for spark-submit or alone.

What a step drops is counted by the job that writes its result, and lies beside it under ``dropped``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.config import SAMPLERS, TestSettings
from residuum.functions import columns as C
from residuum.operators import interface, interface_tables, mapping, nullmodel, spectra, structure, summarize
from residuum.operators.tally import Tally
from residuum.sources import readers, writers
from residuum.sources.staging import Stage, scratch


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="residuum")
    steps = top.add_subparsers(dest="step", required=True)
    prep = steps.add_parser("prep", help="map mutations to residues; weights and spectra of samples")
    for name in ("mutations", "gene-map", "genome", "proteins"):
        prep.add_argument(f"--{name}")
    prep.add_argument("--ptm", help="a table of modification sites instead of mutations")
    prep.add_argument("--out", required=True)
    test = steps.add_parser("test", help="score structures against a null model")
    for name in ("sites", "maps", "atoms", "out"):
        test.add_argument(f"--{name}", required=True)
    test.add_argument("--weights")
    test.add_argument("--ttype")
    test.add_argument("--classes", default="M")
    test.add_argument("--no-sample-weights", action="store_true", help="every mutation counts one, whatever --weights holds")
    test.add_argument("--hill", default="2,4", help="threshold and exponent of the weights' Hill function, or none")
    test.add_argument("--sampler", choices=SAMPLERS, default="uniform")
    for name, text in (("gene-map", "coverage, spectrum"), ("coverage", "coverage, spectrum"), ("genome", "spectrum"), ("proteins", "spectrum"), ("spectra", "spectrum")):
        test.add_argument(f"--{name}", help=f"for the samplers: {text}")
    test.add_argument("--max-seconds", type=float, help="of one structure")
    test.add_argument("--scales", default="3,4.5,6,8,10")
    test.add_argument("--max-draws", type=int, default=10_000)
    test.add_argument("--seed", type=int, default=0)
    test.add_argument("--run", default="1")
    total = steps.add_parser("summarize", help="one table of structures with false discovery rates")
    for name in ("results", "sites", "maps", "metadata", "genes", "out"):
        total.add_argument(f"--{name}", required=True)
    total.add_argument("--atoms", help="structure files, for the names of fragments")
    select = steps.add_parser("select", help="lists of structures for interface tests")
    for name in ("maps", "complexes", "entries", "out"):
        select.add_argument(f"--{name}", required=True)
    select.add_argument("--contacts", help="a table of contacts; else they are derived from --atoms")
    select.add_argument("--atoms")
    faces = steps.add_parser("interface-test", help="mutation mass at interfaces against a null model")
    for name in ("list", "maps", "sites", "atoms", "out"):
        faces.add_argument(f"--{name}", required=True)
    faces.add_argument("--contacts", help="a table of contacts; else they are derived from --atoms")
    for name in ("weights", "ttype", "gene-map", "coverage", "genome", "proteins", "spectra"):
        faces.add_argument(f"--{name}")
    faces.add_argument("--sampler", choices=("uniform", "coverage", "spectrum"), default="uniform")
    faces.add_argument("--reach", type=float, default=5.0, help="of the band around contacts")
    faces.add_argument("--max-draws", type=int, default=10_000)
    faces.add_argument("--seed", type=int, default=0)
    faces.add_argument("--run", default="1")
    final = steps.add_parser("interface-summarize", help="tables of protein pairs, proteins and partners")
    for name in ("results", "maps", "metadata", "genes", "out"):
        final.add_argument(f"--{name}", required=True)
    final.add_argument("--ligands")
    for step in (test, faces, prep):
        step.add_argument("--genome-format", choices=("fasta", "2bit"), default="fasta")
    for step in (test, faces):
        step.add_argument("--coverage-format", choices=("positions", "runs"), default="positions")
        step.add_argument("--atoms-by-id", action="store_true", help="--atoms is a folder of {id[1:3]}/pdb{id}.ent.gz; only wanted files are opened")
    return top


def _genome(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return readers.two_bit(spark, a.genome) if a.genome_format == "2bit" else readers.genome(spark, a.genome)


def _atoms(spark: SparkSession, a: argparse.Namespace, wanted: DataFrame) -> DataFrame:
    """Atoms of the structures in ``wanted`` (``pdb_chain``)."""
    ids = wanted.select(F.split_part("pdb_chain", F.lit("-"), F.lit(1)).alias("pdb")).distinct()
    return readers.atoms(spark, a.atoms, ids=ids if a.atoms_by_id else None)


def prep(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.ptm:
        ptm = readers.ptm_sites(spark, a.ptm)
        writers.by_protein(mapping.ptm_rows(ptm), f"{a.out}/sites")
        spectra.frequency_weights(spectra.ptm_counts(ptm), group=None, clamp=False).write.parquet(f"{a.out}/weights")
        return
    if not (a.mutations and a.gene_map and a.genome and a.proteins):
        raise SystemExit("prep needs --ptm, or --mutations, --gene-map, --genome and --proteins")
    muts = readers.mutations(spark, a.mutations)
    genome = _genome(spark, a)
    tally, of_spectra = Tally(), Tally()
    mapped = mapping.to_residues(muts, readers.gene_map(spark, a.gene_map), genome, readers.proteins(spark, a.proteins), tally=tally)
    writers.by_protein(mapping.site_rows(mapped), f"{a.out}/sites")
    writers.tsv(tally.table(spark).coalesce(1), f"{a.out}/dropped/sites")
    samples = spectra.coding(muts).withColumnRenamed("Tumor_Sample_Barcode", "sample")
    spectra.frequency_weights(spectra.sample_counts(samples)).write.parquet(f"{a.out}/weights")
    writers.mapped(mapping.changes_by_mutation(mapped), f"{a.out}/mapped")
    writers.tsv(spectra.spectrum_pivot(spectra.channel_counts(muts, genome, tally=of_spectra)), f"{a.out}/spectra")
    writers.tsv(of_spectra.table(spark).coalesce(1), f"{a.out}/dropped/spectra")


def test(spark: SparkSession, a: argparse.Namespace) -> None:
    settings = TestSettings(
        ttype=a.ttype, classes=tuple(a.classes), sampler=a.sampler, max_draws=a.max_draws, seed=a.seed,
        scales=tuple(map(float, a.scales.split(","))), sample_weights=not a.no_sample_weights,
        hill=None if a.hill == "none" else tuple(map(float, a.hill.split(","))),
    )
    sites = readers.protein_sites(spark, a.sites)
    weights = spark.read.parquet(a.weights) if a.weights and settings.sample_weights else None
    residues = structure.usable_maps(readers.residue_maps(spark, a.maps), sites)
    found = structure.mutated(residues, structure.site_weights(sites, weights, list(settings.classes), settings.ttype), settings.hill)
    centres = structure.residue_centroids(residues, _atoms(spark, a, residues))
    points = centres.join(found.select("structure", "i", "v"), ["structure", "i"], "left")
    points = points.join(found.select("structure").distinct(), "structure", "left_semi")
    names = {"lysine": ("LYS",), "phospho": ("SER", "TYR", "THR")}.get(settings.sampler)
    draws = nullmodel.Draws(max_draws=settings.max_draws, scales=settings.scales, seed=settings.seed, max_seconds=a.max_seconds)
    vectors = None
    if settings.sampler in ("coverage", "spectrum"):
        if not a.gene_map or settings.sampler == "coverage" and not a.coverage:
            raise SystemExit("the coverage sampler needs --gene-map and --coverage")
        genes = readers.gene_map(spark, a.gene_map)
        covered = _coverage_weights(spark, a, residues, genes)
        if settings.sampler == "coverage":
            points = points.join(covered, ["structure", "i"], "left").fillna(0.0, ["weight"])
        else:
            if not (a.genome and a.proteins and a.spectra):
                raise SystemExit("the spectrum sampler needs --gene-map, --genome, --proteins and --spectra")
            hits = _hits(residues, sites, settings)
            vectors = _mutation_vectors(spark, a, residues, genes, covered, hits)
    with scratch(spark):
        writers.append_results(nullmodel.structure_test(points, names=names, options=draws, vectors=vectors), a.out, a.run)


def _coverage_weights(spark: SparkSession, a: argparse.Namespace, residues: DataFrame, genes: DataFrame) -> DataFrame:
    """``structure, i, weight``: by sequencing coverage, or alike for all residues of a structure without a table of it."""
    if not a.coverage:
        n = residues.groupBy("structure").agg(F.count("*").alias("n"))
        return residues.join(n, "structure").select("structure", "i", (1 / F.col("n")).alias("weight"))
    # over the positions of all gene models of a protein
    if a.coverage_format == "runs":
        spans = mapping.residue_spans(genes).select(F.col("uniprot").alias("u1"), F.col("site").alias("u"), C.chromosome_number(F.col("chrom")).alias("chrn"), "s", "e")
        return nullmodel.coverage_by_runs(residues.select("structure", "i", "u1", "u").join(spans, ["u1", "u"], "left"), readers.coverage_runs(spark, a.coverage))
    at = mapping.residue_positions(genes).select(F.col("uniprot").alias("u1"), F.col("site").alias("u"), C.chromosome_number(F.col("chrom")).alias("chrn"), "pos")
    return nullmodel.coverage_weights(residues.select("structure", "i", "u1", "u").join(at, ["u1", "u"], "left"), readers.coverage(spark, a.coverage))


def _hits(residues: DataFrame, sites: DataFrame, settings: TestSettings) -> DataFrame:
    """``structure, patient, i`` of the mutations that count."""
    rows = sites.filter(F.col("site").isNotNull() & F.substring("mtype", 1, 1).isin(list(settings.classes)))
    rows = rows.filter(F.col("ttype").startswith(settings.ttype)) if settings.ttype else rows
    return residues.join(rows.select(F.col("uniprot").alias("u1"), F.col("site").alias("u"), F.col("sample").alias("patient")), ["u1", "u"]).select("structure", "patient", "i").distinct()


def _mutation_vectors(spark: SparkSession, a: argparse.Namespace, residues: DataFrame, genes: DataFrame, covered: DataFrame, hits: DataFrame) -> DataFrame:
    """``structure, site, i, w``: where each mutation may fall by the spectra of its patients."""
    positions = mapping.first_gene(mapping.residue_positions(genes))
    codons = mapping.residue_codons(positions, _genome(spark, a), readers.proteins(spark, a.proteins))
    own = codons.withColumnsRenamed({"uniprot": "u1", "site": "u"}).join(residues.select("structure", "i", "u1", "u"), ["u1", "u"])
    channels = nullmodel.residue_channels(own.select("structure", "i", "strand", "codon", "ctx"))
    spectrum = readers.spectra(spark, a.spectra).groupBy("patient", "channel").agg(F.sum("n").alias("n"))
    q = nullmodel.patient_probabilities(residues, channels, spectrum, hits)
    return nullmodel.mutation_probabilities(hits, q, covered)


def summary(spark: SparkSession, a: argparse.Namespace) -> None:
    sites, maps = readers.protein_sites(spark, a.sites), readers.residue_maps(spark, a.maps)
    residues = structure.usable_maps(maps, sites)
    covered = summarize.coverage_summary(residues, sites)
    genes = readers.gene_list(spark, a.genes)
    tally = Tally()
    with scratch(spark):
        table = summarize.summarize(spark.read.parquet(a.results), covered, readers.gene_metadata(spark, a.metadata), genes, tally)
        fragments = readers.fragments(spark, a.atoms) if a.atoms else None
        writers.summary(summarize.summary_table(table, maps, fragments), a.out)
        writers.tsv(tally.table(spark).coalesce(1), f"{a.out.rstrip('/')}-dropped")


def select(spark: SparkSession, a: argparse.Namespace) -> None:
    entries = spark.read.option("sep", "\t").schema("entry string, uniprot string").csv(a.entries)
    known = readers.complexes(spark, a.complexes, entries)
    if not (a.contacts or a.atoms):
        raise SystemExit("select needs --contacts or --atoms")
    contacts = readers.contacts(spark, a.contacts) if a.contacts else interface.atom_contacts(readers.atoms(spark, a.atoms))
    writers.structure_lists(interface_tables.selected(readers.residue_maps(spark, a.maps), contacts, known), a.out)


def interface_test(spark: SparkSession, a: argparse.Namespace) -> None:
    settings = TestSettings(ttype=a.ttype, sampler=a.sampler, max_draws=a.max_draws, seed=a.seed)
    maps = readers.residue_maps(spark, a.maps).withColumn("line", F.monotonically_increasing_id())
    maps = interface_tables.listed_maps(maps, readers.structure_list(spark, a.list))
    residues = interface.chain_residues(maps).distinct()
    sites = readers.protein_sites(spark, a.sites).filter(F.substring("mtype", 1, 1) == "M")
    sites = sites.filter(F.col("ttype").startswith(a.ttype)) if a.ttype else sites
    muts = interface.chain_mutations(residues, sites, spark.read.parquet(a.weights) if a.weights else None)
    atoms = _atoms(spark, a, maps)
    centres = atoms.groupBy("pdb", "chain", "resnum").agg(*(F.avg(c).alias(c) for c in "xyz"))
    contacts = readers.contacts(spark, a.contacts) if a.contacts else interface.atom_contacts(atoms)
    contacts = contacts.join(residues.select("pdb").distinct(), "pdb", "left_semi")
    edges = interface.with_band(contacts, centres, a.reach)
    mass = muts.groupBy("pdb", "chain", "resnum").agg(F.sum("w").alias("w"))
    points = residues.select("pdb", "chain", "resnum").distinct().join(mass, ["pdb", "chain", "resnum"], "left")
    vectors = None
    if a.sampler != "uniform":
        if not a.gene_map or a.sampler == "coverage" and not a.coverage or a.sampler == "spectrum" and not (a.genome and a.proteins and a.spectra):
            raise SystemExit("the coverage sampler needs --gene-map and --coverage; the spectrum sampler --gene-map, --genome, --proteins and --spectra")
        own = residues.select(F.concat_ws("-", "pdb", "chain").alias("structure"), F.col("resnum").alias("i"), F.col("uniprot").alias("u1"), "u")
        genes = readers.gene_map(spark, a.gene_map)
        covered = _coverage_weights(spark, a, own, genes)
        of_chain = [F.split_part("structure", F.lit("-"), F.lit(k + 1)).alias(n) for k, n in enumerate(("pdb", "chain"))]
        if a.sampler == "coverage":
            weight = covered.select(*of_chain, F.col("i").alias("resnum"), "weight")
            points = points.join(weight, ["pdb", "chain", "resnum"], "left").fillna(0.0, ["weight"])
        else:
            vectors = _mutation_vectors(spark, a, own, genes, covered, _hits(own, sites, settings)).select(*of_chain, "site", F.col("i").alias("resnum"), "w")
    with scratch(spark):
        tested = interface.interface_test(points, edges, nullmodel.Draws(max_draws=a.max_draws, batch=min(10_000, a.max_draws), seed=a.seed), vectors)
        rows = interface.result_rows(edges, residues, muts, tested.filter("draws > 0"))
        writers.append_results(interface_tables.wide(rows), a.out, a.run)


def interface_summary(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.results).select(*(F.col(c) for c in interface_tables.WIDE if c not in ("gene1", "gene2", "list1", "list2", "length1", "length2", "q", "q_restricted")))
    maps = readers.residue_maps(spark, a.maps).withColumn("line", F.monotonically_increasing_id())
    metadata, genes = readers.gene_metadata(spark, a.metadata), readers.gene_list(spark, a.genes)
    with scratch(spark):
        pairs = Stage(spark, "pairs").write(interface_tables.pair_table(rows, maps, metadata, genes))
        writers.tsv(pairs, f"{a.out}/PPI")
        writers.tsv(interface_tables.protein_table(pairs), f"{a.out}/PPI_perProtein")
        ligands = readers.ligands(spark, a.ligands) if a.ligands else None
        for kind, name in (("L", "PLI"), ("d", "PdI"), ("D", "P_DI"), ("R", "PRI")):  # names that differ by more than case
            writers.tsv(interface_tables.partner_table(rows, kind, maps, metadata, genes, ligands), f"{a.out}/{name}")


STEPS = {"prep": prep, "test": test, "summarize": summary, "select": select, "interface-test": interface_test, "interface-summarize": interface_summary}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"residuum-{args.step}").getOrCreate()
    STEPS[args.step](spark, args)


if __name__ == "__main__":
    main()
