import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from residuum.llm import suffix_dedup
from residuum.llm.suffix_dedup import removal_digests


def brute(rows, length):
    first, out = {}, {}
    rows = sorted((i, (t or "").encode()) for i, t, *_ in rows)
    for i, raw in rows:
        for s in range(len(raw) - length + 1):
            first.setdefault(raw[s : s + length], i)
    for i, raw in rows:
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < i:
                covered[s : s + length] = b"\1" * length
        spans = sum(c and not b for b, c in zip(b"\0" + covered, covered))
        kept = bytes(x for x, c in zip(raw, covered) if not c)
        out[i] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(frame, **options):
    return {r.doc_id: tuple(r)[1:] for r in removal_digests(frame, **options).collect()}


@pytest.mark.parametrize("length", [50, 25, 70])
def test_removals_match_brute_force(docs, corpus, length):
    assert got(docs, length=length) == brute(corpus, length)


@pytest.mark.parametrize("length", [50, 16, 70])
def test_doubling_matches_brute_force(docs, corpus, length):
    assert got(docs, length=length, method="doubling") == brute(corpus, length)


def test_repetitive_texts(spark):
    """Periodic strings, many hosts of one passage, offsets of one byte, overlaps."""
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage, rows = noise(90), []
    for i in range(60):
        kind = i % 6
        text = {
            0: noise(rnd.randint(0, 120)),
            1: noise(rnd.randint(0, 40)) + passage + noise(rnd.randint(0, 40)),
            2: "ab" * rnd.randint(20, 60) + noise(5),
            3: passage[rnd.randint(0, 30) :] + passage[: rnd.randint(30, 90)],
            4: " " * rnd.randint(40, 80) + noise(20) + " " * 60,
            5: noise(30) + passage[20:70] + noise(30),
        }[kind]
        rows.append((i, text))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(frame) == got(frame, method="doubling") == brute(rows, 50)


def test_streams_do_not_depend_on_batches():
    """Runs of equal ranks that go on over batches."""
    rng = np.random.default_rng(0)
    rows = np.stack([rng.integers(0, 6, 400), rng.integers(0, 3, 400), rng.integers(0, 9, 400), np.arange(400) * 64 + 1])
    rows = np.concatenate([rows[:, np.lexsort(rows[2::-1])], np.ones((1, 400), int)])
    names = ["gram", "span", "doc", "at", "kind"]

    def batches(size):
        for b in range(0, 400, size):
            yield pa.RecordBatch.from_arrays([pa.array(r[b : b + size]) for r in rows], names)

    def settled(size):
        return sorted(x for b in suffix_dedup._settle_spans(batches(size)) for x in zip(*(b[c].to_pylist() for c in b.schema.names)))

    assert settled(400) == settled(7) == settled(1)
    one = np.stack([np.repeat(5, 9), np.repeat(1, 9), np.arange(9), np.arange(9) * 64 + 1, np.ones(9, int)])
    alone = [pa.RecordBatch.from_arrays([pa.array(r[b : b + 2]) for r in one], names) for b in range(0, 9, 2)]
    kinds = [k for b in suffix_dedup._settle_spans(iter(alone)) for k in b["kind"].to_pylist()]
    assert kinds == [0] * 8


def test_rows_without_or_with_repeated_ids(spark):
    """They lose what others have, and what one of their own kind has."""
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    a, b = noise(80), noise(90)
    rows = [(2, noise(20) + a), (None, a + noise(30)), (None, noise(9) + b), (None, b), (6, b + "one"), (6, "two" + a), (None, None), (None, b)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got_rows = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed) for r in removal_digests(frame).collect()))
    size = lambda t: len((t or "").encode())
    full = {(i or 0, size(t)) for i, t in rows}
    assert {x[:2] for x in got_rows} == full and len(got_rows) == len(rows)
    lost = {x[:2]: x[2] for x in got_rows}
    assert lost[2, size(rows[0][1])] == 0 and lost[0, size(rows[1][1])] >= size(a) and lost[6, size(rows[5][1])] >= size(a)
    assert sum(n >= size(b) for (_, total), n in lost.items() if total in {size(rows[k][1]) for k in (2, 3, 4)}) == 2


def test_edges(odd, nothing, docs):
    rows = {r.doc_id: r for r in removal_digests(odd).collect()}
    assert rows[9].n_bytes == 0 and rows[4].n_removed == 0 and removal_digests(odd).count() == odd.count()
    assert removal_digests(nothing).count() == 0
    kept = suffix_dedup.deduplicate(docs).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == got_row for r, got_row in ((r, got(docs)[r.doc_id][3]) for r in kept[:3]))
    with pytest.raises(ValueError):
        removal_digests(docs, length=20)


def test_texts_of_several_pieces(spark):
    """Passages that two long texts and a short one share, over the borders of pieces and beside them."""
    rnd = random.Random(12)
    prose = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    edge = suffix_dedup._PIECE
    first = prose(edge + 90_000)
    second = prose(edge - 3000) + first[edge - 2000 : edge + 4000] + "x" * 60 + first[100:700] + prose(20_000) + "x" * 75
    short = [first[edge - 40 : edge + 40], second[edge - 30 : edge + 30], first[edge : edge + 200], "x" * 120]
    rows = list(enumerate([first, second, *short]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(frame) == brute(rows, 50)
    parts = list(suffix_dedup.pieces(second.encode(), 50))
    assert len(parts) == 2 and all(second.encode()[o : o + len(p)] == p for o, p in parts)
