"""Pairs of chains and ranges: the best row of each without sorting all, equal ranges counted."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from residuum.operators import interface
from residuum.plans import tables as T


def test_contacts_as_arrays_are_those_as_rows(spark):
    random.seed(3)
    chains = [("p", f"u{n % 4}", f"{n:02d}", 75.0 + n, n % 3 == 0, n) for n in range(12)]
    pairs = [(a[2], b[2]) if random.random() < 0.5 else (b[2], a[2]) for a, b in itertools.combinations(chains, 2)]
    arrays = [("p", a, b, random.choices(range(6), k=5), random.choices(range(6), k=3)) for a, b in pairs]
    rows = [(p, a, b, s, r) for p, a, b, *own in arrays for s in (0, 1) for r in own[s]]
    chains = spark.createDataFrame(chains, "pdb string, u string, chain string, identity double, native boolean, start int")
    known = spark.createDataFrame([("u0", "u1")], "ua string, ub string")
    found = []
    for data, kind in ((arrays, "residues0 array<int>, residues1 array<int>"), (rows, "side int, resnum int")):
        candidates = interface.pair_candidates(chains, spark.createDataFrame(data, f"pdb string, c1 string, c2 string, {kind}"))
        cols = ["ua", "ub", "a_chain", "b_chain", "na", "nb", "size"]
        found.append((sorted(candidates.select(cols).collect()), sorted(interface.select_pairs(candidates, known).select("kind", *cols).collect())))
    assert found[0] == found[1] and len(found[0][0]) > 20 and len(found[0][1]) > 3


def test_crowded_keys_are_spread_over_tasks(spark):
    rows = spark.range(400).select(F.format_string("p%d", F.col("id") % 2).alias("pdb"), "id")
    met = T.with_others(rows, rows.withColumnRenamed("id", "other"), "pdb")
    assert met.count() == met.distinct().count() == 80_000
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 20_000


def test_best_pair_rows_against_loops(spark):
    """Nulls, equal scores and equal p-values; only chosen rows are sorted."""
    random.seed(5)
    one = lambda n: (f"p{n % 3}", f"c{n}", f"d{n}", f"u{n % 4}", f"u{n // 4 % 4}", *(float(random.randint(0, 3)) for _ in range(4)), random.choice([0.1, 0.1, 0.2, 0.5, None]))
    data = [one(n) for n in range(300)]
    cols = ["pdb", "c1", "c2", "u1", "u2", "mapped1", "iface1", "mapped2", "iface2", "p"]
    ids = {(r[2 + k], f"{r[0]}-{r[k]}"): random.choice([50.0, 90.0, None]) for r in data for k in (1, 2)}
    groups = {}
    for r in (dict(zip(cols, x)) for x in data):
        if r["u1"] != r["u2"]:
            groups.setdefault(tuple(sorted((r["u1"], r["u2"]))), []).append(r)
    expected = set()
    for pair, rows in groups.items():
        top = {c: max(r[c] for r in rows) for c in ("mapped1", "iface1", "mapped2", "iface2")}
        for r in rows:
            part = lambda s, t: (i := ids[r[f"u{s}"], f"{r['pdb']}-{r[f'c{s}']}"]) and i * (r[f"iface{s}"] / top[f"iface{t}"] + r[f"mapped{s}"] / top[f"mapped{t}"])  # noqa: E731, B023
            own = [part("1", "1"), part("2", "2")] if r["u1"] == pair[0] else [part("2", "1"), part("1", "2")]
            r["score"] = None if None in own else sum(own)
        best = max(r["score"] for r in rows if r["score"] is not None)
        high = [r for r in rows if r["score"] is not None and r["score"] >= 0.8 * best]
        first = min(high, key=lambda r: (r["p"] is not None, r["p"] or 0, -r["score"], r["pdb"], r["c1"], r["c2"]))
        expected.add((*pair, first["c1"], first["c2"], first["p"], first["score"]))
    rows = spark.createDataFrame(data, "pdb string, c1 string, c2 string, u1 string, u2 string, mapped1 double, iface1 double, mapped2 double, iface2 double, p double")
    names = spark.createDataFrame([(*k, v) for k, v in ids.items()], "u1 string, pdb_chain string, identity double")
    found = interface.best_pair_rows(rows, names)
    assert {tuple(r) for r in found.select("ua", "ub", "c1", "c2", "p", "score").collect()} == expected and len(expected) == 6
    windows = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_best" in windows  # rows are filtered by the number of their pair before any window


def test_overlap_totals_count_equal_ranges(spark):
    from residuum.operators import summarize

    random.seed(7)
    ranges = [(g, (s := random.randint(0, 30)), s + random.choice([0, 3, 9, 20])) for g in "ab" for _ in range(120)] + [("c", 1, 5)]
    expected = {}
    for g in "ab":
        own = [r[1:] for r in ranges if r[0] == g]
        pairs = [(max(0, min(e, y) - max(s, x)), e - s, y - x) for (s, e), (x, y) in itertools.combinations(own, 2)]
        near = [p for p in pairs if p[0]]
        expected[g] = (len(pairs), sum(p[0] for p in near), sum(o / (x + y - o) for o, x, y in near), sum(o / min(x, y) for o, x, y in near))
    frame = spark.createDataFrame(ranges, "brand string, start long, end long").withColumn("key", F.monotonically_increasing_id())
    got = {r.brand: (r.n_pairs, r.shared, r.jaccard, r.of_shorter) for r in summarize.overlap_totals(frame, "brand").collect()}
    assert got == {g: pytest.approx(e) for g, e in expected.items()}


def test_best_pair_rows_read_identities_little(spark, monkeypatch):
    """Identities are moved once for both sides, and only those of the chosen rows are read again; odd rows stay as they were."""
    plans = []

    class Recorded(interface.Stage):
        def write(self, df):
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().write(df)

    def read(found):
        folders = {f.rpartition("/")[0] for f in found.inputFiles()}
        return max(spark.read.parquet(f).count() for f in folders)

    random.seed(11)
    one = lambda n: (f"p{n % 7}", f"c{n}", f"d{n}", f"u{n % 3}", f"u{n // 3 % 3}", 10.0, float(n % 4), 10.0, float(n % 3), random.choice([0.1, 0.2, 0.3, None]))
    data = [one(n) for n in range(300)]
    data += [(None, "c1", "d1", "u0", "u1", 10.0, 3.0, 10.0, 2.0, 0.1), ("p1", None, "d1", "u0", "u1", 10.0, 3.0, 10.0, 2.0, 0.1), ("p1", "c1", "d1", None, "u1", 10.0, 3.0, 10.0, 2.0, 0.1)]
    rows = spark.createDataFrame(data, "pdb string, c1 string, c2 string, u1 string, u2 string, mapped1 double, iface1 double, mapped2 double, iface2 double, p double")
    ids = [(r[3 + k], f"{r[0]}-{r[1 + k]}", random.choice([50.0, 90.0])) for r in data[:300] for k in (0, 1)]
    ids += [*ids[:200], (None, "p1-c1", 90.0), ("u0", None, 90.0), ("u0", "c1", 40.0), ("u0", "p1", 30.0), *((f"x{n}", "none", 1.0) for n in range(100))]
    known = spark.createDataFrame(ids, "u1 string, pdb_chain string, identity double")
    wanted = ["ua", "ub", "pdb", "c1", "c2", "p", "id1", "id2", "score"]

    part = lambda s, t: f"id{s} * (iface{s} / ti{t} + mapped{s} / tm{t})"
    tops = ", ".join(f"max({c}{k}) OVER w AS t{c[0]}{k}" for c in ("mapped", "iface") for k in "12")
    expected = spark.sql(
        f"""WITH r AS (SELECT *, least(u1, u2) AS ua, greatest(u1, u2) AS ub FROM {{rows}} WHERE u1 <> u2), t AS (SELECT *, {tops} FROM r WINDOW w AS (PARTITION BY ua, ub)),
        i AS (SELECT t.*, a.identity AS id1, b.identity AS id2 FROM t JOIN {{known}} a ON a.u1 = t.u1 AND a.pdb_chain = concat_ws('-', pdb, c1) JOIN {{known}} b ON b.u1 = t.u2 AND b.pdb_chain = concat_ws('-', pdb, c2)),
        s AS (SELECT *, CASE WHEN u1 = ua THEN {part(1, 1)} + {part(2, 2)} ELSE {part(2, 1)} + {part(1, 2)} END AS score FROM i), h AS (SELECT *, max(score) OVER (PARTITION BY ua, ub) AS top FROM s),
        n AS (SELECT *, row_number() OVER (PARTITION BY ua, ub ORDER BY p, score DESC, pdb, c1, c2) AS n FROM h WHERE score >= 0.8 * top) SELECT {", ".join(wanted)} FROM n WHERE n = 1""",
        rows=rows, known=known,
    )
    expected = sorted(expected.collect())
    few = interface.best_pair_rows(rows, known)
    assert sorted(few.select(wanted).collect()) == expected and len(expected) == 3 and read(few) < 300 < len(ids)
    monkeypatch.setattr(interface, "_FEW", 0)
    monkeypatch.setattr(interface, "Stage", Recorded)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = interface.best_pair_rows(rows, known)
        assert sorted(many.select(wanted).collect()) == expected and read(many) < 300
        assert any("ReusedExchange" in p or "ReusedQueryStage" in p for p in plans if "score" in p or "_best" in p)
        assert interface.best_pair_rows(rows.limit(0), known).count() == interface.best_pair_rows(rows, known.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
