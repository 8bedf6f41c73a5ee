import random

import numpy as np
import pyarrow as pa
import pytest

from residuum.llm import near_dedup
from residuum.llm.common import Staged
from residuum.llm.components import components


def brute(rows, size, percent):
    sets = {}
    for i, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def got(frame, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(frame, **options).collect()}


@pytest.mark.parametrize("size,percent", [(2, 80), (5, 80), (1, 60)])
def test_groups_match_brute_force(docs, corpus, size, percent):
    assert got(docs, shingle_words=size, percent=percent) == brute(corpus, size, percent)


def test_dense_group_in_small_blocks(spark):
    """Members that are near to some, not to the first: lists over many blocks, ids joined by shuffle."""
    rnd = random.Random(11)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(70):
        copy = list(base)
        for k in range(rnd.randint(1, 5)):
            copy[rnd.randrange(60)] = f"e{rnd.randrange(6)}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 2, 80)
    assert 1 < len({c for _, c, _ in expected.values()})
    assert got(frame, shingle_words=2, percent=80, block_rows=16, broadcast_rows=3, sketch_bits=14) == expected


def test_list_rows_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 17, 2, 40, 16, 1]
    value = np.repeat(np.arange(len(sizes)), sizes)
    rows = [value, np.concatenate([np.sort(rng.choice(100, s, replace=False)) for s in sizes]), np.full(len(value), 50), np.full(len(value), 2)]
    names = ["value", "doc_id", "n", "pos"]

    def found(step):
        batches = (pa.RecordBatch.from_arrays([pa.array(r[b : b + step]) for r in rows], names) for b in range(0, len(value), step))
        return sorted(x for b in near_dedup._list_rows(80)(batches) for x in zip(*(b[c].to_pylist() for c in b.schema.names)))

    assert found(100) == found(1) == found(5)
    pairs = {(a, b) for kind, a, b in found(100) if kind == 0}
    for v, s in enumerate(sizes):
        ids = rows[1][value == v].tolist()
        wanted = {(ids[0], x) for x in ids[1:]} if s > 16 else {(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :]}
        assert wanted <= pairs
    assert sum(kind for kind, _, _ in found(100)) == 57


def test_edges(odd, nothing):
    rows = near_dedup.near_groups(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.kept and r.component_id == r.doc_id for r in rows)
    assert near_dedup.near_groups(nothing).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "9", "None"]  # one of those repeated entire


def test_rows_without_or_with_repeated_ids(spark):
    """They link and go like others; the smallest identifier names the group."""
    base = [f"v{i}" for i in range(60)]
    near = lambda k: " ".join(base[:k] + ["x"] + base[k + 1 :])
    other = " ".join(f"z{i}" for i in range(60))
    rows = [(None, near(5), 1), (None, near(50), 2), (7, near(30), 3), (3, near(20), 4), (3, other, 5), (None, other, 6), (None, "q w e r t y", 7), (None, None, 8), (8, "", 9), (None, near(5), 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _key long").repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(frame, shingle_words=2).collect()}
    assert {(i, c) for i, c, _ in got} == {(None, 3), (7, 3), (3, 3), (None, None), (8, 8)}
    kept = sorted((r._key for r in near_dedup.keep_one(frame, shingle_words=2).collect()))
    assert kept == [4, 5, 7, 8, 9]


def test_components_of_long_path(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (100, 101), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components(links, Staged(spark, "test")).collect()}
    assert found == {**{i: 0 for i in order}, 100: 100, 101: 100}
    assert components(links.limit(0), Staged(spark, "test")).count() == 0


def test_words_that_collide_under_polynomials_stay_apart(spark):
    """Thue-Morse words have equal polynomial hashes modulo powers of two, for any odd base."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    rows = [(i, "".join(("xy", "yx")[i % 2][b] for b in bits)) for i in range(2)]
    rows += [(i + 10, f"{rows[i][1]} and more words") for i in range(2)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2, percent=80) == brute(rows, 2, 80)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 9000}\n" for i in range(60_000)) + "\tend"
    whole = next(near_dedup.shingle_sets([text], 3))
    monkeypatch.setattr(near_dedup, "_PIECE", 1000)
    assert (next(near_dedup.shingle_sets([text], 3)) == whole).all() and len(whole) == 9001
    other = next(near_dedup.shingle_sets([text], 3, lane=1))
    assert len(other) == len(whole) and not set(other.tolist()) & set(whole.tolist())
    words = ["a", "y" * 9000, "b" * 63, "b" * 64, "b" * 65, "c" * 2001, "é", "y" * 9000]
    few = near_dedup._word_hashes(" ".join(words).encode(), 1)[0]
    monkeypatch.setattr(near_dedup, "_PIECE", 1 << 20)
    assert (near_dedup._word_hashes(" ".join(words).encode(), 1)[0] == few).all() and len(np.unique(few)) == 7


@pytest.mark.parametrize("size", [15, 16, 17, 18])
def test_lists_about_the_limit_of_short_ones(spark, size):
    base = [f"v{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: 38 - i % 3], *(f"e{i}x{k}" for k in range(2 + i % 4))])) for i in range(size)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2, percent=80) == brute(rows, 2, 80)
