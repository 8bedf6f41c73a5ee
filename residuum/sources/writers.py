"""Sinks; K-numbers follow the inventory. Numbers stay numbers until the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_COLUMNS = [
    "GENE_NAMES", "P", "Q_FULL", "NSAMPLES", "NSITES", "SITES", "UNIPROT_ID", "MAPPED_UNIPROT_ID", "PDBID-CHAIN",
    "PERCENT_IDENTITY", "PDB_FRAGMENT", "UNIPROT_SEQ_LENGTH", "MAP_START", "MAP_END", "IN_CANCER_GENE_LISTS", "Q_RESTRICTED",
]


def tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated text with a header; nothing is quoted, and empty text is empty."""
    writer = df.write.mode(mode).option("sep", "\t").option("header", True)
    writer.option("quote", "").option("emptyValue", "").csv(path)


def by_protein(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Proteins in a fixed number of partitions by hash, in order inside, so that one protein is found without
    a folder for each.
    """
    sharded = df.withColumn("protein_shard", protein_shard(F.col("uniprot")))
    sorted_ = sharded.repartition("protein_shard").sortWithinPartitions("protein_shard", "uniprot")
    sorted_.write.mode(mode).partitionBy("protein_shard").parquet(path)


def protein_shard(uniprot: Column) -> Column:
    return F.pmod(F.hash(uniprot), F.lit(64))


def by_structure(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows with a ``pdb_chain``, partitioned by the two middle characters of the structure's name."""
    sharded = df.withColumn("shard", F.substring("pdb_chain", 2, 2))
    sharded.repartition("shard").write.mode(mode).partitionBy("shard").option("compression", "zstd").parquet(path)


def append_results(df: DataFrame, path: str, run: str) -> None:
    """Runs accumulate, each under its own id; a run that is written again replaces its own rows only."""
    rows = df.withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def summary(df: DataFrame, path: str) -> None:
    """The fixed column order."""
    tsv(df.select(*(F.col(f"`{c}`") for c in SUMMARY_COLUMNS)), path)


def mapped(df: DataFrame, path: str) -> None:
    """Mapped mutations with changes as ``U:AnB; U:AnB``."""
    one = lambda x: F.concat(x["uniprot"], F.lit(":"), x["aa_ref"], x["site"].cast("string"), x["aa_alt"])
    tsv(df.withColumn("uniprot_change", F.array_join(F.transform("uniprot_changes", one), "; ")).drop("uniprot_changes"), path)


def structure_lists(lists: dict[str, DataFrame], path: str) -> None:
    """A list of structures for each name: ids, or ``pdb c:uniprot:residue`` with ``_c:uniprot:residue`` for pairs."""
    for name, df in lists.items():
        side = lambda k: F.concat_ws(":", f"{k}_chain", f"{k}_uniprot", F.col(f"{k}_start").cast("string"))
        sides = [side(k) for k in "ab" if f"{k}_chain" in df.columns]
        line = F.concat(F.col("pdb"), F.lit(" "), F.concat_ws("_", *sides)) if sides else F.col("pdb")
        df.select(line.alias("value")).write.text(f"{path}/{name}")
