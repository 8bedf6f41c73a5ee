"""Interfaces between chains and their partners: selection, bands, mass, tests, merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.operators import greedy, summarize
from residuum.operators.draws import Draws, Prepared, in_rounds
from residuum.operators.nullmodel import _HELD, Spots, _fresh, distributions, own_distributions, whole_draws
from residuum.operators.tally import Tally
from residuum.sources.staging import Stage

EDGE = ["pdb", "kind", "c1", "c2", "side"]


def largest_map(maps: DataFrame) -> DataFrame:
    """The map with most residues of each chain; of equal ones the last line."""
    return _chosen_line(maps, F.size("resmap"), F.col("line"))


def best_map(maps: DataFrame) -> DataFrame:
    """The map with the largest size times identity; the first of equal ones. No identity counts 0."""
    score = F.size("resmap") * F.coalesce("identity", F.lit(0.0))
    return _chosen_line(maps, score, -F.col("line"))


def _chosen_line(maps: DataFrame, score: Column, tie: Column) -> DataFrame:
    """The maps of the best line of each chain; lines are chosen before any residues move.

    Maps that share a line's number are judged one by one: only those that reach the best score stay.
    """
    order = F.struct(score.alias("score"), tie.alias("tie"))
    top = maps.groupBy("pdb_chain").agg(F.max(order).alias("_top"))
    return maps.withColumn("_top", order).join(top, ["pdb_chain", "_top"], "left_semi").select(*maps.columns)


def last_identity(maps: DataFrame) -> DataFrame:
    """Original id and identity of each protein and chain; the last line stands."""
    return maps.groupBy("u1", "pdb_chain").agg(
        F.max_by("u2", "line").alias("u2"), F.max_by("identity", "line").alias("identity")
    )


def native_structures(maps: DataFrame) -> DataFrame:
    """A22."""
    return maps.filter("attrs = '-'").select(F.split_part("pdb_chain", F.lit("-"), F.lit(1)).alias("pdb")).distinct()


def atom_contacts(atoms: DataFrame, reach: float = 4.0) -> DataFrame:
    """Contacts ``pdb, kind, c1, c2, side, resnum`` between chains: residues with an atom within ``reach`` of one of the other chain.

    ``atoms`` is what :func:`residuum.sources.readers.atoms` gives. Space is cut into cubes of four and a half times the
    reach. An atom is listed in its own cube and in those up to the reach above it on each axis, which are one to eight
    (1.8 on average). The list is shuffled once and meets itself; a pair counts in the cube of its greater coordinates.
    """
    width = 4.5 * reach
    cube = lambda at: F.floor(at / width)
    listed = atoms.select("pdb", "chain", "resnum", *"xyz")
    for c in "xyz":  # a hair wider than the reach, as sums are rounded
        listed = listed.withColumn(f"q{c}", F.explode(F.sequence(cube(F.col(c)), cube(F.col(c) + reach * 1.001))))
    # both sides rename all columns but the keys, so that they are one exchange
    own = lambda k: listed.select("pdb", "qx", "qy", "qz", F.col("chain").alias(f"c{k}"), F.col("resnum").alias(f"r{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz"))
    d2 = C.squared_distance([F.col(f"{c}1") for c in "xyz"], [F.col(f"{c}2") for c in "xyz"])
    met = own(1).join(own(2), ["pdb", "qx", "qy", "qz"]).filter("c1 < c2").filter(d2 <= reach * reach)
    for c in "xyz":
        met = met.filter(cube(F.greatest(f"{c}1", f"{c}2")) == F.col(f"q{c}"))
    sides = F.inline(F.array(*(F.struct(F.lit(k).alias("side"), F.col(r).alias("resnum")) for k, r in enumerate(("r1", "r2")))))
    return met.select("pdb", F.lit("P").alias("kind"), "c1", "c2", sides).distinct()


def with_band(contacts: DataFrame, residues: DataFrame, reach: float = 5.0) -> DataFrame:
    """Contacts and the residues of the same chain within ``reach`` of one; ``direct`` marks the former.

    ``residues`` holds ``pdb, chain, resnum, x, y, z``. Space is cut into cubes of
    the reach, so that only neighbouring cubes of a chain are compared.
    """
    chain = F.when(F.col("side") == 0, F.col("c1")).otherwise(F.col("c2"))
    direct = contacts.withColumn("chain", chain).select(*EDGE, "chain", "resnum").distinct()
    cube = lambda c: F.floor(F.col(c) / reach)
    near = residues.withColumns({f"q{c}": cube(c) for c in "xyz"})
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    seeds = direct.join(near, ["pdb", "chain", "resnum"]).withColumn("o", around)
    seeds = seeds.select(
        *EDGE, "chain", *(F.col(c).alias(f"s{c}") for c in "xyz"), *((F.col(f"q{c}") + F.col(f"o.{c}")).alias(f"q{c}") for c in "xyz")
    )
    pairs = seeds.join(near, ["pdb", "chain", "qx", "qy", "qz"])
    d2 = C.squared_distance([F.col(f"s{c}") for c in "xyz"], [F.col(c) for c in "xyz"])
    band = pairs.filter(d2 <= reach * reach).select(*EDGE, "chain", "resnum").distinct()
    rows = direct.withColumn("direct", F.lit(True)).unionByName(band.withColumn("direct", F.lit(False)))
    return rows.groupBy(*EDGE, "chain", "resnum").agg(F.bool_or("direct").alias("direct"))


def interface_mass(edges: DataFrame, muts: DataFrame) -> DataFrame:
    """Mass of each side and in total, with the residues listed.

    ``muts`` holds ``pdb, chain, resnum, w``.
    """
    rows = edges.join(muts, ["pdb", "chain", "resnum"], "left")
    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("w"))), F.lit(0.0))
    listed = lambda k, extra: F.array_join(
        F.transform(F.array_sort(F.collect_set(F.when((F.col("side") == k) & extra, F.col("resnum")))), lambda x: x.cast("string")), ";"
    )
    yes = F.lit(True)
    return rows.groupBy("pdb", "kind", "c1", "c2").agg(
        side(0).alias("mass1"), side(1).alias("mass2"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("mass"),
        listed(0, yes).alias("residues1"), listed(1, yes).alias("residues2"),
        listed(0, F.col("direct")).alias("direct1"), listed(1, F.col("direct")).alias("direct2"),
    )


def listed_mass(text: Column) -> Column:
    """Sum of a ``site_mass;site_mass`` list."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x.contains("_"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.split_part(x, F.lit("_"), F.lit(2)).cast("double"))


def interface_test(residues: DataFrame, edges: DataFrame, options: Draws = Draws(batch=10_000), vectors: DataFrame | None = None) -> DataFrame:
    """Exceedances of the interface masses, all interfaces of a structure on the same draws.

    ``residues`` holds ``pdb, chain, resnum, w`` (null where not mutated) and may
    hold ``weight`` for weighted draws; ``edges`` is the result of :func:`with_band`.
    Each replicate moves every chain's mutations, weights whole, to residues of
    that chain. With ``vectors`` (``pdb, chain, site, resnum, w``) each mutation, known by its
    residue ``site``, is drawn from its own distribution over its chain and keeps its weight, no
    residue twice; a replicate in which one chain finds no room is discarded as a whole and drawn
    again. Gives ``pdb, kind, c1, c2, statistic, mass, exceed, draws, p, status``.
    """
    weighted, by_site = "weight" in residues.columns, vectors is not None

    def prepare(name: object, own: dict[str, pd.DataFrame]) -> Prepared:
        points = own["residues"].sort_values(["chain", "resnum"]).reset_index(drop=True)
        masks, labels = _masks(points, own["edges"])
        w = points["w"].fillna(0).to_numpy(float)
        observed = masks @ w
        hit = points["w"].notna().to_numpy()
        chains = [np.flatnonzero((points["chain"] == c).to_numpy()) for c in points["chain"].unique()]
        chains = [members for members in chains if hit[members].any()]
        if by_site:
            draw = _by_spectra(points, chains, hit, own["vectors"])
        else:
            draw = _by_weight(chains, hit, points["weight"].to_numpy(float) if weighted else None)
        masses = np.concatenate([w[members[hit[members]]] for members in chains]) if chains else np.empty(0)
        bounds = np.cumsum([0, *(hit[members].sum() for members in chains)])

        def add(rng: np.random.Generator, n: int) -> np.ndarray | None:
            exceed, some = np.zeros(len(labels), np.int64), max(1, _HELD // max(1, len(points)))
            for m in (min(some, n - at) for at in range(0, n, some)):  # a bounded table of draws at a time
                chosen = whole_draws(draw, rng, m) if draw else None
                if chosen is None:
                    return None
                drawn = np.zeros((m, len(points)))
                for at, b, e in zip(chosen, bounds, bounds[1:]):
                    laid = np.broadcast_to(masses[b:e], at.shape)
                    # heavy residues come first among the chosen, so by weight the masses must not keep their order
                    np.put_along_axis(drawn, at, laid if by_site else rng.permuted(laid, axis=1), axis=1)
                exceed += (drawn @ masks.T >= observed - 1e-12).sum(0)
            return exceed

        return labels, observed, add

    needed = ["pdb", "chain", "resnum", "w", *(["weight"] if weighted else [])]
    tables = {"residues": residues.select(*needed), "edges": _fresh(edges.select(*EDGE, "chain", "resnum"))}
    if vectors is not None:
        tables["vectors"] = _fresh(distributions(vectors, ["pdb", "chain"], "resnum"))
    both = [tables[t].select(F.col("pdb").alias("pdb")).distinct() for t in ("residues", "edges")]
    common = _fresh(both[0].join(both[1], "pdb", "left_semi"))
    tables = {t: df.join(_fresh(common), "pdb", "left_semi") for t, df in tables.items()}
    found = in_rounds(tables, "pdb", "kind string, c1 string, c2 string, statistic string", prepare, options)
    p = C.p_floor(F.col("exceed"), F.col("draws"))
    return found.select("pdb", "kind", "c1", "c2", "statistic", F.col("score").alias("mass"), "exceed", "draws", F.when(F.col("draws") > 0, p).alias("p"), "status")


def _masks(points: pd.DataFrame, sides: pd.DataFrame) -> tuple[np.ndarray, list[tuple]]:
    """The residues of each statistic, and its interface and name."""
    place = {x: n for n, x in enumerate(zip(points["chain"], points["resnum"]))}
    rows, labels = [], []
    for label, part in sides.sort_values(["kind", "c1", "c2"]).groupby(["kind", "c1", "c2"]):
        masks = np.zeros((3, len(points)))
        for side, chain, resnum in zip(part["side"], part["chain"], part["resnum"]):
            if (chain, resnum) in place:
                masks[[int(side), 2], place[chain, resnum]] = 1
        wanted = (("side1", 0), ("side2", 1), ("total", 2)) if label[0] == "P" else (("total", 2),)
        for name, k in wanted:
            rows.append(masks[k])
            labels.append((*label, name))
    return np.array(rows).reshape(len(rows), len(points)), labels


def _by_weight(chains: list[np.ndarray], hit: np.ndarray, weight: np.ndarray | None):
    """Draws of each chain's number of residues, uniform or by weight; residues without weight are never drawn."""
    allowed = [m if weight is None else m[weight[m] > 0] for m in chains]
    sizes = [int(hit[m].sum()) for m in chains]
    if any(len(a) < k for a, k in zip(allowed, sizes)):
        return None

    def draw(rng: np.random.Generator, n: int) -> tuple[list[np.ndarray], np.ndarray]:
        out = []
        for members, k in zip(allowed, sizes):
            keys = rng.random((n, len(members)))
            if weight is not None:
                keys = -np.log(keys) / weight[members]
            out.append(members[np.argsort(keys, axis=1)[:, :k]])
        return out, np.ones(n, bool)

    return draw


def _by_spectra(points: pd.DataFrame, chains: list[np.ndarray], hit: np.ndarray, vectors: pd.DataFrame):
    """Joint draws of all chains, each mutation from its own distribution; whole only if every chain's is."""
    spots = []
    for members in chains:
        numbers = points["resnum"].to_numpy()[members]
        own = vectors[vectors["chain"] == points["chain"].iat[members[0]]]
        p, of = own_distributions(own, pd.Series(numbers), numbers[hit[members]])
        if (p.sum(1) <= 0).any():
            return None
        spots.append((members, Spots(p, of)))

    def draw(rng: np.random.Generator, n: int) -> tuple[list[np.ndarray], np.ndarray]:
        out, whole = [], np.ones(n, bool)
        for members, spot in spots:
            at, good = spot.draw(rng, n)
            out.append(members[at])
            whole &= good
        return out, whole

    return draw


#: Tables of so many rows are broadcast.
_FEW = 1_000_000


def _held(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(_FEW + 1).count() <= _FEW else df


def _held_stage(stage: Stage, df: DataFrame) -> DataFrame:
    """A staged table as :func:`_held`, its rows counted by the job that writes them."""
    tally = Tally()
    out = stage.write(tally.at(df, "rows"))
    return F.broadcast(out) if tally.counts()["rows"] <= _FEW else out


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(own)).filter("_r = 1").drop("_r")


def pair_candidates(chains: DataFrame, contacts: DataFrame) -> DataFrame:
    """Chain pairs of unlike proteins in one structure that share an interface.

    ``chains`` holds ``pdb, u, chain, identity, native, start``. ``contacts`` holds ``pdb, c1, c2, side, resnum``, or
    one row ``pdb, c1, c2, residues0, residues1`` for each pair. Pairs are not moved: each meets the attributes
    of its chains, which are broadcast up to a checked number.
    """
    ca, cb = F.least("c1", "c2").alias("ca"), F.greatest("c1", "c2").alias("cb")
    if "residues0" in contacts.columns:
        first, last = (F.size(F.array_distinct(f"residues{s}")).cast("long") for s in (0, 1))
        straight = F.col("c1") <= F.col("c2")
        sizes = contacts.select("pdb", ca, cb, F.when(straight, first).otherwise(last).alias("na"), F.when(straight, last).otherwise(first).alias("nb"))
    else:
        sizes = contacts.groupBy("pdb", ca, cb).agg(
            F.count_distinct(F.when((F.col("side") == 0) == (F.col("c1") <= F.col("c2")), F.col("resnum"))).alias("na"),
            F.count_distinct(F.when((F.col("side") == 0) != (F.col("c1") <= F.col("c2")), F.col("resnum"))).alias("nb"),
        )
    side = lambda s, c: _held(chains.select("pdb", F.col("chain").alias(c), *(F.col(x).alias(f"{s}_{x}") for x in ("u", "chain", "identity", "native", "start"))))
    pairs = sizes.filter("ca < cb").join(side("a", "ca"), ["pdb", "ca"]).join(side("b", "cb"), ["pdb", "cb"])
    pairs = pairs.filter("a_u <> b_u AND NOT (a_native AND b_native)")
    return pairs.withColumns({
        "ua": F.least("a_u", "b_u"), "ub": F.greatest("a_u", "b_u"),
        "size": F.col("a_identity") * F.col("na") + F.col("b_identity") * F.col("nb"),
    })


def select_pairs(candidates: DataFrame, known: DataFrame, least_identity: float = 80.0) -> DataFrame:
    """One structure per protein pair and kind: ``interlog`` if the pair is known, else ``high_identity``."""
    rows = candidates.join(_held(known.withColumn("_known", F.lit(True))), ["ua", "ub"], "left")
    both = (F.col("a_identity") >= least_identity) & (F.col("b_identity") >= least_identity)
    rows = rows.withColumn("kind", F.when(F.col("_known"), "interlog").when(both, "high_identity")).filter("kind IS NOT NULL")
    rows, keys = rows.drop("_known"), ["kind", "ua", "ub"]
    tops = Stage(rows.sparkSession, "pairs").write(rows.groupBy(*keys).agg(F.max("size").alias("_top")))
    # rows are read twice, but only those of the greatest size are sorted
    largest = rows.join(_held(tops), keys).filter(F.col("size").eqNullSafe(F.col("_top"))).drop("_top")
    return _first(largest, keys, ["pdb", "a_chain", "b_chain"])


def ligand_structures(chains: DataFrame, chosen: DataFrame, least_identity: float = 80.0) -> DataFrame:
    """High-identity chains for partner tests, without those that the pairs hold."""
    rows = chains.filter(~F.col("native") & (F.col("identity") >= least_identity))
    for s in "ab":
        used = chosen.select("pdb", F.col(f"{s}_chain").alias("chain"))
        rows = rows.join(used, ["pdb", "chain"], "left_anti")
    return rows


def best_pair_rows(rows: DataFrame, identities: DataFrame, share: float = 0.8) -> DataFrame:
    """One result row per protein pair.

    ``rows`` holds ``pdb, c1, c2, u1, u2, mapped1, iface1, mapped2, iface2, p``.
    Rows are scored by identity-weighted lengths and interface sizes relative to
    the pair's largest, taken by column; of those that reach ``share`` of the best
    score the least p is chosen.
    """
    rows = rows.filter("u1 <> u2").withColumns({"ua": F.least("u1", "u2"), "ub": F.greatest("u1", "u2")})
    stage, keys = Stage(rows.sparkSession, "pairs"), ["ua", "ub"]
    tops = rows.groupBy(*keys).agg(*(F.max(c).alias(f"top_{c}") for c in ("mapped1", "iface1", "mapped2", "iface2")))
    tops = _held_stage(stage, tops.filter("least(top_iface1, top_iface2) > 0"))
    known = _held_stage(stage, identities.select(F.col("u1").alias("u"), F.col("pdb_chain").alias("chain"), "identity"))

    def part(side: str, top: str):
        return F.col(f"id{side}") * (F.col(f"iface{side}") / F.col(f"top_iface{top}") + F.col(f"mapped{side}") / F.col(f"top_mapped{top}"))

    straight = F.col("u1") == F.col("ua")
    score = F.when(straight, part("1", "1") + part("2", "2")).otherwise(part("2", "1") + part("1", "2"))
    of_chain = lambda k: F.concat_ws("-", "pdb", f"c{k}")

    def scored(rows: DataFrame, known: DataFrame) -> DataFrame:
        rows = rows.join(tops, keys)
        for k in "12":  # both sides rename all columns, so that they are one exchange
            ids = known.select(F.col("u").alias(f"u{k}"), F.col("chain").alias("_pc"), F.col("identity").alias(f"id{k}"))
            rows = rows.withColumn("_pc", of_chain(k)).join(ids, [f"u{k}", "_pc"]).drop("_pc")
        return rows.withColumn("score", score)

    # of one p only the best score can be chosen, so a number for each p is kept, and only the chosen rows are sorted
    best = stage.write(scored(rows, known).groupBy(*keys, "p").agg(F.max("score").alias("_best")))
    high = F.max("_best").over(Window.partitionBy(*keys))
    chosen = _first(best.withColumn("_top", high).filter(F.col("_best") >= share * F.col("_top")).drop("_top"), keys, ["p"])
    chosen = _held_stage(stage, chosen.select(F.col("ua").alias("_ua"), F.col("ub").alias("_ub"), F.col("p").alias("_p"), "_best"))
    near = rows.join(chosen, (F.col("ua") == F.col("_ua")) & (F.col("ub") == F.col("_ub")) & F.col("p").eqNullSafe(F.col("_p"))).drop("_ua", "_ub", "_p")
    near = stage.write(near)
    # the few chains of these rows are looked up in one pass, and only their identities meet the rows again
    chains = near.select(F.inline(F.array(*(F.struct(F.col(f"u{k}").alias("u"), of_chain(k).alias("chain")) for k in "12")))).distinct()
    known = _held_stage(stage, known.join(_held_stage(stage, chains), ["u", "chain"], "left_semi"))
    return _first(scored(near, known).filter(F.col("score") == F.col("_best")).drop("_best"), keys, ["pdb", "c1", "c2"])


def partner_rows(rows: DataFrame) -> DataFrame:
    """rows with another partner, typed; ligands of solvents go."""
    rows = rows.withColumn("partner_kind", C.partner_kind(F.col("c2")))
    return rows.filter((F.col("partner_kind") != "L") | ~F.col("u2").isin(*K.SOLVENT_LIGANDS))


def merge_nested(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """A smaller interface of a protein joins the first larger one that holds ``share`` of it.

    ``rows`` holds ``partner_kind, uniprot, key, pdb, ligand, residues, p``; a key is one
    interface of its protein. Interfaces are taken from the largest on, equal ones by key; the
    kept row has its own p and lists the ``pdbs`` and ``ligands`` of all that joined. Rows
    without residues go.

    Equal interfaces are one row with their names, so the input is read and moved once. A small one shares at least ``share`` of its residues with its
    home, so at least one of its rarest few; only those are looked up in the lists of a protein's
    interfaces by residue. Which are homes is settled in rounds over the links found.
    """
    stage = Stage(rows.sparkSession, "nested")
    own = F.array_sort(F.array_distinct("residues"))
    sized = rows.filter(F.size("residues") > 0).withColumn("_set", own)
    of = ["partner_kind", "uniprot"]
    listed = lambda c: F.array_sort(F.array_distinct(c))
    alike = sized.filter("partner_kind IS NOT NULL AND uniprot IS NOT NULL").groupBy(*of, "_set").agg(
        F.min_by(F.struct(*rows.columns), "key").alias("row"), F.collect_set("pdb").alias("pdbs"), F.collect_set("ligand").alias("ligands")
    )
    whole = stage.write(alike.withColumns({"first": F.col("row.key"), "n": F.size("_set")}).filter("first IS NOT NULL"))
    sets = whole.select(*of, "_set", "first", "n")
    name = lambda key: F.struct(*of, F.col(key).alias("first"))

    flat = sets.select(*of, "first", "n", F.explode("_set").alias("residue"))
    common = flat.groupBy(*of, "residue").agg(F.count("*").alias("f"))
    by_rarity = F.array_sort(F.collect_list(F.struct("f", "residue")))
    prefix = F.col("n") - F.ceil(F.col("n") * share - 1e-9).cast("int") + 1
    ordered = flat.join(common, [*of, "residue"]).groupBy(*of, "first", "n").agg(by_rarity.alias("r"))
    rare = ordered.select(*of, F.col("first").alias("small"), F.col("n").alias("ns"), F.explode(F.slice("r", F.lit(1), F.least(F.col("n"), prefix))).alias("x"))
    rare = rare.select(*of, "small", "ns", F.col("x.residue").alias("residue"))
    pairs = rare.join(flat, [*of, "residue"]).filter((F.col("n") > F.col("ns")) | (F.col("n") == F.col("ns")) & (F.col("first") < F.col("small")))
    pairs = pairs.select(*of, "small", "first", "n").distinct()
    held = pairs.join(sets.select(*of, F.col("first").alias("small"), F.col("_set").alias("inner")), [*of, "small"])
    held = held.join(sets.select(*of, "first", F.col("_set").alias("outer")), [*of, "first"])
    held = held.filter(F.size(F.array_intersect("inner", "outer")) >= share * F.size("inner"))
    links = stage.write(held.select(name("small").alias("item"), name("first").alias("earlier"), "n"))

    gone = greedy.dropped(links, stage)
    to_kept = links.join(gone.withColumnRenamed("item", "earlier"), "earlier", "left_anti")
    home = to_kept.groupBy("item").agg(F.min_by("earlier", F.struct(-F.col("n"), F.col("earlier.first"))).alias("home"))
    home = home.select("item.*", F.col("home.first").alias("home"))
    members = whole.join(home, [*of, "first"], "left").withColumn("home", F.coalesce("home", "first"))
    own = F.any_value(F.when(F.col("first") == F.col("home"), F.col("row")), F.lit(True))
    merged = members.groupBy(*of, "home").agg(own.alias("row"), *(listed(F.flatten(F.collect_list(c))).alias(c) for c in ("pdbs", "ligands")))
    return merged.select("row.*", "pdbs", "ligands")


def ligand_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Names of the listed ligands, the id where none is known."""
    flat = rows.select("key", F.posexplode("ligands").alias("n", "id")).join(names, "id", "left")
    joined = flat.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("name", "id").alias("x")))), lambda s: s["x"]), "; ").alias("ligand_names"))
    return rows.join(joined, "key", "left")


def missing_structures(expected: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """J20."""
    return expected.join(done.select(key).distinct(), key, "left_anti")


def residue_counts(muts: DataFrame, least: int = 1, ttype: str | None = None) -> DataFrame:
    """Distinct samples of each residue with a colour value."""
    rows = muts.filter(F.substring("mtype", 1, 1) == "M")
    if ttype:
        rows = rows.filter(F.col("ttype").startswith(ttype))
    counts = rows.groupBy("pdb", "chain", "resnum").agg(F.count_distinct("ttype", "sample").alias("n")).filter(F.col("n") >= least)
    return counts.withColumn("color", C.color_value(F.col("n"), ["pdb"]))


def chosen_maps(maps: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """the maps named by ``pdb_chain, u1, first`` in ``fixed``, else only native ones."""
    if fixed is None:
        return maps.filter((F.col("attrs") == "-") | (F.col("u2") == "-"))
    first = F.get("resmap", F.lit(0))["u"]
    return maps.withColumn("first", first).join(fixed, ["pdb_chain", "u1", "first"], "left_semi").drop("first")


def chain_residues(maps: DataFrame) -> DataFrame:
    """``pdb, chain, resnum, uniprot, u`` of the largest map of each chain."""
    chain = F.split("pdb_chain", "-")
    rows = largest_map(maps).select("pdb_chain", "u1", F.explode("resmap").alias("r"))
    return rows.select(
        F.get(chain, F.lit(0)).alias("pdb"), F.get(chain, F.lit(1)).alias("chain"), F.col("r.p").alias("resnum"),
        F.col("u1").alias("uniprot"), F.col("r.u").alias("u"),
    )


def chain_mutations(residues: DataFrame, sites: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``pdb, chain, resnum, w`` of mutated residues; weights are looked up by the type's prefix."""
    rows = sites.filter(F.col("site").isNotNull()).withColumn("ttype", C.type_prefix(F.col("ttype")))
    if weights is not None:
        missing = F.raise_error(F.concat_ws(" ", F.lit("no weight for"), "ttype", "sample")).cast("double")
        keys = [c for c in ("ttype", "sample") if c in weights.columns]
        rows = rows.join(weights.select(*keys, "zlog_score", F.lit(True).alias("_has")), keys, "left")
        rows = rows.withColumn("w", F.when(F.col("_has"), F.coalesce("zlog_score", F.lit(0.0))).otherwise(missing))
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    mass = rows.groupBy("uniprot", F.col("site").alias("u")).agg(F.sum("w").alias("w"))
    return residues.join(mass, ["uniprot", "u"]).select("pdb", "chain", "resnum", "w")


def mass_lists(edges: DataFrame, muts: DataFrame) -> DataFrame:
    """``residue_mass`` lists of each side, by residue."""
    rows = edges.join(muts, ["pdb", "chain", "resnum"]).groupBy("pdb", "kind", "c1", "c2", "side", "resnum").agg(F.sum("w").alias("w"))
    text = F.format_string("%d_%.2f", "resnum", "w")
    listed = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("resnum", text.alias("t"))))), lambda x: x["t"]), ";")
    return rows.groupBy("pdb", "kind", "c1", "c2").agg(listed(0).alias("masses1"), listed(1).alias("masses2"))


def result_rows(edges: DataFrame, residues: DataFrame, muts: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per interface with proteins, sizes, masses, p-values and residues in protein coordinates.

    ``edges`` is the result of :func:`with_band`, ``residues`` of :func:`chain_residues`, ``muts`` of
    :func:`chain_mutations`, ``tests`` of :func:`interface_test`. Partners other than proteins leave the
    columns of the second side null.
    """
    keys = ["pdb", "kind", "c1", "c2"]
    per_chain = residues.groupBy("pdb", "chain").agg(F.min("uniprot").alias("uniprot"), F.count_distinct("resnum").alias("mapped"))
    mass = muts.groupBy("pdb", "chain", "resnum").agg(F.sum("w").alias("w"))
    own = residues.select("pdb", "chain", "resnum", "u").distinct()
    rows = edges.join(own, ["pdb", "chain", "resnum"]).join(mass, ["pdb", "chain", "resnum"], "left")

    def listed(side: int, keep: Column, text: Column = F.col("u").cast("string")) -> Column:
        items = F.array_sort(F.collect_set(F.when((F.col("side") == side) & keep, F.struct("u", text.alias("t")))))
        return F.array_join(F.transform(items, lambda x: x["t"]), ";")

    yes, hit = F.lit(True), F.col("w").isNotNull()
    with_mass = F.format_string("%d_%.2f", "u", "w")
    lists = rows.groupBy(*keys).agg(
        *(F.count_distinct(F.when((F.col("side") == k) & F.col("direct"), F.col("u"))).alias(f"iface{k + 1}") for k in (0, 1)),
        *(listed(k, yes).alias(f"residues{k + 1}") for k in (0, 1)),
        *(listed(k, F.col("direct")).alias(f"direct{k + 1}") for k in (0, 1)),
        *(listed(k, hit, with_mass).alias(f"masses{k + 1}") for k in (0, 1)),
    )
    wide = tests.groupBy(*keys).agg(
        *(F.max(F.when(F.col("statistic") == name, F.col(c))).alias(f"{c}{suffix}") for name, suffix in (("total", ""), ("side1", "1"), ("side2", "2")) for c in ("mass", "p"))
    )
    out = wide.join(lists, keys, "left")
    for k in "12":
        side = per_chain.select("pdb", F.col("chain").alias(f"c{k}"), F.col("uniprot").alias(f"u{k}"), F.col("mapped").alias(f"mapped{k}"))
        out = out.join(side, ["pdb", f"c{k}"], "left")
    two = F.col("kind") == "P"
    of_total = {c: F.when(two, F.col(f"{c}1")).otherwise(F.col(c)).alias(f"{c}1") for c in ("mass", "p")}  # one side is all
    sides = ("mapped", "iface", "mass", "p", "residues", "direct", "masses")
    return out.select(
        *keys, "u1", F.when(two, F.col("u2")).alias("u2"), "mass", "p", *(of_total.get(c, F.col(f"{c}1")) for c in sides), *(F.when(two, F.col(f"{c}2")).alias(f"{c}2") for c in sides)
    )


def per_protein(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The interface side of least p of each protein, with q over all proteins and over those in ``listed``.

    ``rows`` is the result of :func:`result_rows` for kind ``P``; ``listed`` holds ``uniprot``. -1 where a protein is not listed.
    """
    sides = [
        rows.select(F.col(f"u{k}").alias("uniprot"), F.concat_ws("/", "pdb", "c1", "c2", F.lit(k)).alias("key"), F.col(f"mass{k}").alias("mass"), F.col(f"p{k}").alias("p"))
        for k in "12"
    ]
    first = summarize.best_by_protein(sides[0].unionByName(sides[1]).dropna(subset=["uniprot", "p"]))
    marked = first.join(listed.select("uniprot").distinct().withColumn("_in", F.lit(True)), "uniprot", "left")
    return summarize.bh_fdr_restricted(marked, "p", "uniprot", F.coalesce("_in", F.lit(False)), "q_restricted").drop("_in")
