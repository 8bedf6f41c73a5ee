"""Fingerprints, edited texts and the search within a radius against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from residuum.llm import fingerprints

SCHEMA = "doc_id long, text string, range string, f0 string, hash string"


@pytest.fixture(scope="module")
def hashes(spark):
    """128 bits of terms by Spark's own hash functions."""

    def of(terms):
        rows = spark.createDataFrame(sorted(terms, key=str), "a string, b string")
        first = rows.withColumn("h", F.xxhash64("a", "b")).withColumn("g", F.xxhash64("h")).collect()
        return {(r.a, r.b): (r.h % (1 << 64) << 64) | r.g % (1 << 64) for r in first}

    return of


def terms_of(text, piece=1 << 15):
    out = []
    for at in range(0, len(text), piece):
        words = re.findall(r"[^\x20\x09-\x0D]+", text[at : at + piece].lower())
        out += zip(words, [*words[1:], None])
    return out


def simhash(terms, value):
    bits = 0
    for k in range(128):
        votes = sum(1 if value[t] >> k & 1 else -1 for t in terms)
        bits |= (votes > 0) << k
    return f"{bits:032x}"


def rows_():
    rnd = random.Random(4)
    words = [f"w{i}é" if i % 5 else f"W{i}" for i in range(200)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(60)]
    texts += [None, "", " \n", "one", "ONE", "two words\n", texts[0], texts[1] + " more", "x" * 70_000, " ".join(rnd.choices(words, k=30_000))]
    ids = rnd.sample(range(-50, 1000), len(texts))
    return list(zip(ids, texts))


def plain(rows, hashes):
    """By descending identifier: the row's values."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out, terms = [], set()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append([i, len(text), hashlib.sha256(edited.encode()).hexdigest(), terms_of(text), terms_of(edited)])
        terms.update(out[-1][3], out[-1][4])
    value = hashes(terms)
    for row in out:
        row[3:5] = (simhash(t, value) for t in row[3:5])
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    return {(i, n, sha, f, e, like(f, e), like(f, after[3])) for (i, n, sha, f, e), after in zip(out, out[1:] + out[:1])}


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("ranges", [1, 2, 7, 300])
def test_equals_plain(spark, hashes, ranges):
    rows = rows_() if ranges == 7 else rows_()[:66]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    got = fingerprints.edited_fingerprints(frame, ranges=ranges).select(COLUMNS).collect()
    assert {tuple(r) for r in got} == plain(rows, hashes) and len(got) == len(rows)


def test_repeated_and_missing_identifiers(spark, hashes):
    rows = [(None, f"text number {i % 9}") for i in range(12)] + [(3, "same id a"), (3, "same id b"), (3, "same id b"), (9, None)]
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(4)
    got = fingerprints.edited_fingerprints(frame, ranges=3).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    alike = {}
    for r in fingerprints.fingerprints(frame).collect():
        alike.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(alike[None]) == 9 and len(alike[3]) == 2 and alike[9] == {"0" * 32}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "a single text", "", "", "")], SCHEMA)
    (row,) = fingerprints.edited_fingerprints(one).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"a singla sing").hexdigest()
    assert fingerprints.edited_fingerprints(one.limit(0)).collect() == []


@pytest.mark.parametrize("radius", [2, 3, 6, 11])
def test_all_within_the_radius_are_found_once(spark, radius):
    rnd = random.Random(radius)
    made = []
    for _ in range(25):
        base = rnd.getrandbits(128)
        made += [base] + [base ^ sum(1 << b for b in rnd.sample(range(128), rnd.randint(0, radius + 3))) for _ in range(12)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in made], "f0 long, f1 long")
    got = fingerprints.within(frame, frame, radius).collect()
    join = lambda a, b: (a % (1 << 64) << 64) | b % (1 << 64)
    found = [(join(r.q0, r.q1), join(r.f0, r.f1), r.distance) for r in got]
    expected = {(a, b, (a ^ b).bit_count()) for a in made for b in made if (a ^ b).bit_count() <= radius}
    assert set(found) == expected and len(found) == len(expected)
    shuffled = fingerprints.within(frame, frame, radius, broadcast_rows=5)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, got))


def test_number_of_near_documents(spark):
    rnd = random.Random(1)
    base = [f"v{rnd.randrange(300)}" for _ in range(400)]
    texts = []
    for i in range(40):
        words = list(base)
        for _ in range(i % 8):
            words[rnd.randrange(400)] = f"u{i}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame([(i * 25, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame).collect()}
    for i, r in got.items():
        near = sum((int(r.fingerprint, 16) ^ int(o.fingerprint, 16)).bit_count() <= 6 for o in got.values()) - 1
        assert r.n_near == (None if i % 100 else near)
    assert any(r.n_near for r in got.values())


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a b c", "", "", "")], SCHEMA)
    for df in (fingerprints.edits(frame), fingerprints.fingerprints(frame)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
