import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from residuum.llm import packing, token_ids

WORDS = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    library = ids_of.__dict__.setdefault("library", Tokenizer.from_file(WORDS))
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_pieces(rows, corpus, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text, *_ in corpus:
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


@pytest.mark.parametrize("window,bins", [(2048, 256), (64, 64)])
def test_pack(docs, corpus, window, bins):
    check_pieces(packing.pack(docs, WORDS, window=window, bins=bins, group_pieces=30).collect(), corpus, window)


def test_pack_edges(odd, nothing):
    for group in (10_000, 2):
        rows = packing.pack(odd, WORDS, group_pieces=group).collect()
        assert len(rows) == 6 and sum(r.length for r in rows if r.doc_id == 9) == 1
    assert len(rows) == 6 and sum(r.length for r in rows if r.doc_id == 9) == 1
    assert packing.pack(nothing, WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing, WORDS, window=100, bins=64)


def test_equal_rows_are_dealt_over_groups(spark):
    """Rows repeated entire do not meet in one group."""
    frame = spark.createDataFrame([(None, "")] * 3000, "doc_id long, text string").repartition(6)
    rows = packing.pack(frame, WORDS, window=64, bins=64, group_pieces=100)
    at = {}
    for r in rows.collect():
        at.setdefault(r.sequence_id, []).append(r.offset)
    assert sum(map(len, at.values())) == 3000 and all(sorted(x) == list(range(len(x))) for x in at.values())
    assert len(at) <= 3000 // 64 + 40


def test_plan_uses_no_more_than_there_is_and_pads_little():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.gamma(1.2, 60, 20000).astype(int) + 1, 1, 256)
    histogram = np.bincount(lengths, minlength=257)
    used = np.zeros(257, int)
    for combo, repeats in packing.plan_repeats(histogram, 3):
        assert sum(combo) == 256
        for b in combo:
            used[b] += repeats
    assert (used <= histogram).all()
    assert (used * np.arange(257)).sum() > 0.6 * (histogram * np.arange(257)).sum()


def test_least_squares_on_known_answer():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = packing.nonnegative_least_squares(a, np.array([3.0, 5.0]))
    assert np.allclose(a @ x, [3, 5]) and (x >= 0).all()
    assert np.allclose(packing.nonnegative_least_squares(np.array([[1.0], [1.0]]), np.array([-1.0, -2.0])), 0)


def test_packed_ids_round_trip(docs, corpus, odd, nothing, spark, tmp_path):
    path = str(tmp_path / "packed")
    token_ids.write_packed(docs, path, WORDS, window=256, group_tokens=4000)
    packed, kind = spark.read.parquet(path), token_ids.id_type(WORDS)
    assert kind == "<u2" and token_ids.id_type(WORDS, 1 << 17) == "<u4" and token_ids.position_type(1 << 17) == "<u4"
    found = defaultdict(dict)
    for r in packed.collect():
        ids, positions = np.frombuffer(r.ids, kind), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[0] == 0
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts)):
            b, e = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert positions[b:e].tolist() == list(range(e - b))
            found[doc][start] = ids[b:e]
        assert (ids[r.cu_seqlens[-1] :] == 0).all()
    for i, text, *_ in corpus:
        assert np.concatenate([found[i][s] for s in sorted(found[i])]).tolist() == ids_of(text).tolist()
    assert sum(r.n_tokens for r in token_ids.digests(packed).collect()) == sum(len(ids_of(c[1])) for c in corpus)
    both = [token_ids.digests(token_ids.pack_ids(docs, WORDS)), token_ids.written_digests(docs, WORDS)]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))
    assert token_ids.pack_ids(nothing, WORDS).count() == 0
    assert sum(len(r.doc_ids) for r in token_ids.pack_ids(odd, WORDS).collect()) == odd.count()
    assert len(list(token_ids.read_matrix(packed, kind, 256))) == packed.count()


def test_fill_windows_is_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300).tolist()
    rooms = []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        fit = [r for r in rooms if r >= lengths[i]]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - lengths[i])
        else:
            rooms.append(100 - lengths[i])
    windows = token_ids.fill_windows(lengths, 100)
    assert sorted(100 - sum(lengths[i] for i in w) for w in windows) == sorted(rooms)
    assert sorted(i for w in windows for i in w) == list(range(300))
