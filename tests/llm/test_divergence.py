"""The divergence of sources against a plain version that counts everything."""

import random
import re
from collections import Counter

import numpy as np
from residuum.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"


def plain(rows, min_docs, top):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= min_docs]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        whole = Counter(t for d in own for t in d[2])

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        differ = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = sorted((-sum(differ(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            over = sorted((-differ(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", over)):
                out |= {(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)}
    return out


def rows_of(df):
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(set(got)) == len(got)
    return set(got)


def corpus():
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("Wört", "is", "THE", "été", "東京", "o'x9", "zz") for b in ("a", "É", "b2c", "", "_d")]
    rows = []
    for i in range(300):
        weights = [1 + (j * (i % 5)) % 11 for j in range(len(words))]
        text = " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))
        rows.append((text, rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "a", "a", "c", None, "é", "~"])))
    return rows + [(None, "en", "nothing"), ("", "only", "one"), (None, "two", "x"), ("rare words", "two", "y"), (rows[0][0], *rows[0][1:])] * 2


def test_equals_plain(spark):
    rows = corpus()
    frame = spark.createDataFrame([(None, *r, 1, "x") for r in rows], SCHEMA).repartition(5)
    assert rows_of(divergence.audit(frame)) == plain(rows, 10, 10)
    assert rows_of(divergence.audit(frame, min_docs=3, top_terms=2, parts=1)) == plain(rows, 3, 2)


def test_odd_names_of_languages_and_sources(spark):
    """Names with zero bytes and digits, which keys hold as they are."""
    rows = [("one two three", lang, source) for lang in ("", "3", "a\0b", "é\0", "a") for source in ("", "\0", "b\0c", "1\0x", "0")] * 4
    frame = spark.createDataFrame([(1, *r, 1, "x") for r in rows], SCHEMA).repartition(3)
    assert rows_of(divergence.audit(frame)) == plain(rows, 10, 10)


def test_a_small_sketch_and_small_pieces_change_nothing(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame([(None, *r, 1, "x") for r in rows], SCHEMA).repartition(3)
    assert rows_of(divergence.audit(frame, sketch_bits=4, sketch_depth=2)) == plain(rows, 10, 10)
    text = "abc Déf, ghi\n" * 50
    expected = [w for some in divergence.terms(text) for w in some]
    monkeypatch.setattr(divergence, "_PIECE", 7)
    assert [w for some in divergence.terms(text) for w in some] == expected


def test_sketch_never_underestimates_and_discards(spark):
    shape = divergence.Sketch(12, 4)
    rows = [("fr" if i % 2 else "en", "s", " ".join([f"rare{'x' * i}", "often", *(["some"] if i < 18 else [])])) for i in range(200)]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    bits = np.unpackbits(divergence.document_frequency_sketch(frame, shape, 10)).astype(bool)
    possible = lambda lang, word: bits[shape.places(lang, [word])].all()
    assert possible("fr", b"often") and possible("en", b"often") and not possible("de", b"often")
    assert not possible("fr", b"some") and not any(possible("en", b"rare" + b"x" * i) for i in range(200))


def test_empty_table_and_long_text(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    long = " ".join(f"w{'abcdefghij'[i % 10]}{'k' * (i % 7)}" for i in range(500_000))
    rows = [(long, "en", "a")] + [("wa wbk wc", "en", "b")] * 12
    assert rows_of(divergence.audit(spark.createDataFrame([(1, *r, 1, "x") for r in rows], SCHEMA))) == plain(rows, 10, 10)
