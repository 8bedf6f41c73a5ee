"""The interface tools' tables: which structures to test, the wide rows, and the final tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.operators import interface, summarize

#: The columns of a result row in order; genes, lists, lengths and q-values are filled by the final tables.
WIDE = (
    "kind pdb c1 c2 u1 u2 gene1 gene2 list1 list2 length1 mapped1 iface1 length2 mapped2 iface2 mass p q q_restricted "
    "mass1 p1 mass2 p2 residues1 residues2 direct1 direct2 masses1 masses2"
).split()


def wide(rows: DataFrame) -> DataFrame:
    """All thirty columns in order, null where ``rows`` has none; further columns follow."""
    more = [c for c in rows.columns if c not in WIDE]
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in WIDE), *more)


def chain_lines(maps: DataFrame) -> DataFrame:
    """``pdb, u, chain, identity, native, start`` of each map."""
    parts = F.split("pdb_chain", "-")
    return maps.select(
        F.get(parts, F.lit(0)).alias("pdb"), F.col("u1").alias("u"), F.get(parts, F.lit(1)).alias("chain"), "identity",
        (F.col("attrs") == "-").alias("native"), F.get("resmap", F.lit(0))["u"].alias("start"),
    )


def selected(maps: DataFrame, contacts: DataFrame, known: DataFrame, least_identity: float = 80.0) -> dict[str, DataFrame]:
    """The four lists of structures to test, by name.

    ``native`` holds ``pdb``; ``interlogs`` and ``highIdentity`` chain pairs of proteins, of which the first are in
    ``known`` (``ua, ub``); ``POhighIdentity`` the chains for partners that are no proteins, but for those in the pairs.
    """
    chains = chain_lines(maps)
    pairs = interface.select_pairs(interface.pair_candidates(chains, contacts.filter("kind = 'P'")), known, least_identity)
    alone = interface.ligand_structures(chains, pairs, least_identity).distinct()
    side = lambda s: [F.col(f"{s}_{c}").alias(n) for c, n in (("chain", f"{s}_chain"), ("u", f"{s}_uniprot"), ("start", f"{s}_start"))]
    of = lambda kind: pairs.filter(F.col("kind") == kind).select("pdb", *side("a"), *side("b"))
    others = alone.select("pdb", F.col("chain").alias("a_chain"), F.col("u").alias("a_uniprot"), F.col("start").alias("a_start"))
    return {"native": interface.native_structures(maps), "interlogs": of("interlog"), "highIdentity": of("high_identity"), "POhighIdentity": others}


def listed_maps(maps: DataFrame, entries: DataFrame) -> DataFrame:
    """The maps that a list of structures asks for: those named by chain, protein and first residue, or the native ones of an id.

    ``entries`` is what :func:`residuum.sources.readers.structure_list` gives.
    """
    pdb = F.split_part("pdb_chain", F.lit("-"), F.lit(1))
    part = lambda i: F.split_part("side", F.lit(":"), F.lit(i))
    named = entries.select("pdb", F.explode(F.flatten(F.transform("sides", lambda s: F.split(s, "_")))).alias("side"))
    fixed = named.select(F.concat_ws("-", "pdb", part(1)).alias("pdb_chain"), part(2).alias("u1"), part(3).cast("int").alias("first")).distinct()
    whole = entries.filter(F.size("sides") == 0).select("pdb").distinct()
    native = interface.chosen_maps(maps).withColumn("pdb", pdb).join(whole, "pdb", "left_semi").drop("pdb")
    return native.unionByName(interface.chosen_maps(maps, fixed)).dropDuplicates(["line"])


def _described(rows: DataFrame, side: str, metadata: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene, membership in the list and length of one side's protein."""
    name = F.regexp_replace(F.get(F.split("gene_names", " "), F.lit(0)), ";$", "")
    about = metadata.select(F.col("accession").alias(f"u{side}"), F.coalesce(name, F.lit("")).alias(f"gene{side}"), F.col("length").alias(f"length{side}"))
    symbols = summarize.gene_symbols(metadata, genes, first=True).select(F.col("accession").alias(f"u{side}"), F.col("symbol").alias(f"list{side}"))
    return rows.join(about, f"u{side}", "left").join(symbols, f"u{side}", "left")


def _with_q(rows: DataFrame, key: str, member: Column) -> DataFrame:
    return summarize.bh_fdr_restricted(summarize.bh_fdr(rows, "p", key, "q"), "p", key, member, "q_restricted")


def _identity(rows: DataFrame, identities: DataFrame, side: str) -> DataFrame:
    own = identities.select(F.col("u1").alias(f"u{side}"), F.col("pdb_chain").alias("_pc"), F.col("u2").alias(f"original{side}"), F.col("identity").alias(f"identity{side}"))
    return rows.withColumn("_pc", F.concat_ws("-", "pdb", f"c{side}")).join(own, [f"u{side}", "_pc"], "left").drop("_pc")


def pair_table(rows: DataFrame, maps: DataFrame, metadata: DataFrame, genes: DataFrame) -> DataFrame:
    """One structure for each pair of proteins with genes, lengths, identities and q-values, over all and over pairs with a listed gene."""
    identities = interface.last_identity(maps)
    chosen = interface.best_pair_rows(rows.filter("kind = 'P' AND u1 IS NOT NULL AND u2 IS NOT NULL"), identities).drop("id1", "id2")
    for side in "12":
        chosen = _identity(_described(chosen, side, metadata, genes), identities, side)
    chosen = chosen.withColumn("key", F.concat_ws("/", "ua", "ub"))
    found = _with_q(chosen, "key", F.col("list1").isNotNull() | F.col("list2").isNotNull())
    return wide(found.drop("ua", "ub", "key", "score", *(c for c in found.columns if c.startswith("top_"))))


def protein_table(pairs: DataFrame) -> DataFrame:
    """``uniprot, gene, mass, p, q, q_restricted``: the side of least p of each protein in :func:`pair_table`'s rows."""
    sides = [pairs.select(F.col(f"u{k}").alias("uniprot"), F.col(f"gene{k}").alias("gene"), F.concat_ws("/", "pdb", "c1", "c2", F.lit(k)).alias("key"), F.col(f"mass{k}").alias("mass"), F.col(f"p{k}").alias("p"), F.col(f"list{k}").alias("listed")) for k in "12"]
    first = summarize.best_by_protein(sides[0].unionByName(sides[1]).dropna(subset=["p"]))
    found = summarize.bh_fdr_restricted(first, "p", "uniprot", F.col("listed").isNotNull(), "q_restricted")
    return found.select("uniprot", "gene", "mass", "p", "q", "q_restricted")


def partner_table(rows: DataFrame, kind: str, maps: DataFrame, metadata: DataFrame, genes: DataFrame, ligands: DataFrame | None = None) -> DataFrame:
    """Interfaces with partners of a ``kind`` (``L``, ``D``, ``R`` or ``d``), nested ones merged, with names and q-values."""
    own = rows.filter("kind <> 'P'").withColumn("u2", F.coalesce("u2", F.substring_index("c2", "_", -1)))
    own = interface.partner_rows(own).filter(F.col("partner_kind") == kind)
    numbers = F.transform(F.filter(F.split(F.coalesce("residues1", F.lit("")), ";"), lambda x: x != ""), lambda x: x.cast("int"))
    keyed = own.withColumns({"key": F.concat_ws("/", "pdb", "c1", "c2"), "uniprot": F.col("u1"), "ligand": F.col("u2"), "residues": numbers})
    merged = interface.merge_nested(keyed.dropna(subset=["u1", "p"]))
    if kind == "L" and ligands is not None:
        merged = interface.ligand_names(merged, ligands).withColumnRenamed("ligand_names", "gene2")
    else:
        merged = merged.withColumn("gene2", F.col("u2"))
    merged = _identity(_described(merged, "1", metadata, genes), interface.last_identity(maps), "1")
    found = _with_q(merged, "key", F.col("list1").isNotNull())
    joined = {"pdbs": F.array_join("pdbs", ","), "ligands": F.array_join("ligands", ",")}
    return wide(found.withColumns(joined).drop("key", "uniprot", "ligand", "residues", "partner_kind"))
