"""Input columns that are named like those the stages add."""

from residuum.llm import exact_dedup, near_dedup, quality, secrets


def test_redact_keeps_columns_of_its_own_names(spark):
    text = "x token = 'abcdef12345' y 0123456789abcdef0123456789abcdef z"
    names = ["doc_id", "text", "base", "found", "_token", "row", "id", "a.b"]
    rows = [(1, text, 7, "f", 1.5, "r", 9, 2), (2, None, None, "g", 2.5, "s", 8, 3), (3, "plain", 8, None, None, None, None, 4)]
    types = "doc_id long, text string, base long, found string, _token double, row string, id long, `a.b` int"
    frame = spark.createDataFrame(rows, types)
    got = secrets.redact(frame)
    assert got.columns == names and [t for _, t in got.dtypes] == [t for _, t in frame.dtypes]
    assert sorted(map(tuple, got.collect())) == [(1, "x [SECRET]' y [SECRET] z", *rows[0][2:]), *rows[1:]]
    swapped = frame.select("doc_id", frame["text"].alias("base"), frame["base"].alias("text"))
    assert {r.doc_id: r.base for r in secrets.redact(swapped, text_col="base").collect()}[1] == "x [SECRET]' y [SECRET] z"


def test_kept_documents_keep_a_column_gone(spark):
    words = " ".join(f"word{n}" for n in range(60))
    rows = [(n, text, "h", -n) for n, text in enumerate([words, words, "other words of the text " * 9, "short"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _gone long")
    for keep in (near_dedup.keep_one, quality.keep_good):
        got = keep(frame)
        plain = {r.doc_id for r in keep(frame.drop("_gone")).collect()}
        assert got.columns == frame.columns
        assert {(r.doc_id, r._gone) for r in got.collect()} == {(n, -n) for n in plain} and plain


def test_exact_copies_keep_all_values(spark):
    names = "_key long, _again string, _sha string, _gone long, _id string, _nth long, row string, id string, sha string, n long, stays string, `a.b` long"
    own = lambda n: (n, f"a{n}", f"s{n}", -n, f"i{n}", n + 1, "r", f"x{n}", "y", 3, "z", n)
    rows = [(n, text, *own(n)) for n, text in enumerate(["same", "other", "same", None, "", "last"])]
    rows += [(None, "same", *own(50)), (None, "none", *own(51)), (None, "none", *own(51)), (9, "nine", *own(60)), (9, "nine", *own(60)), (9, "other", *own(61))]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, {names}").repartition(3)
    got = exact_dedup.deduplicate(frame)
    assert got.columns == frame.columns
    wanted = [rows[0], rows[1], rows[3], rows[5], rows[7], rows[9]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(wanted, key=key)
