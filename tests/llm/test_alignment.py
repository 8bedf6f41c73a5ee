"""Cross-tokenizer alignment against whole texts encoded by the libraries."""

import hashlib
from collections import Counter

import pytest
from residuum.llm import alignment, queries

TEXTS = [
    None, "", " ", "  two  spaces ", "\n line\n\n next \t tab", "it's we'll don't 12345 3.14", "naïve café 東京 の 😀 words", "low ▁ line", "a b 　c",
    "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 3000, "Is and retitioning ouen the of, nterti thorreou", "Is and retitioning ouen the of, nterti thorreou",
    "trailing \n", "tabs\t\tand\r\nreturns\x0b\x0c\x85 \x1c end", "the " * 500, "\x00 nul \x01", " \n the\n \n the", "a" + " " * 40 + "b", "  sep ​ zero", "é" * 200,
]


def plain(texts, path_a, path_b):
    made = alignment.Aligner(path_a, path_b, 99)
    rows, held = [], []
    for text in texts:
        raw = b" " + (text or "").encode()
        a = made._a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = made._b.encode(text or "")
        if not text or b"".join(made.bytes_a[i] for i in a) != raw or b"".join(made.bytes_b[i] for i in b) != raw:
            rows.append((0, 0, 0, [], ""))
            held.append(set())
            continue
        spans = []
        for ids, surface in ((a, made.bytes_a), (b, made.bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(surface[i]), i))
                at += len(surface[i])
            spans.append(out)
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = []
        for low, high in zip([0, *both], both):
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in spans))
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
        held.append(set(links))
    counts = Counter(p for h in held for p in h)
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(n, top.get(x, 0))
    return counts, [
        (n_a, n_b, n_g, len(links), g, sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links)) for n_a, n_b, n_g, links, g in rows
    ]


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")


def test_equals_whole_texts(spark, paths, corpus):
    texts = TEXTS + [r[1] for r in corpus if len(r[1] or "") < 2000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    made = alignment.align(frame, *paths)
    counts, expected = plain(texts, *paths)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in made.documents().collect()}
    assert [got[i] for i in range(len(texts))] == expected
    pairs = {(r.a, r.b): (r["count"], r.best) for r in made.pairs().collect()}
    assert {k: n for k, (n, _) in pairs.items()} == counts
    top = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    assert all(best == (n == top[a]) for (a, _), (n, best) in pairs.items())


def test_borders_leave_the_encodings_alone(paths):
    made = alignment.Aligner(*paths, 99)
    for text in filter(None, TEXTS):
        words = made.words(text)
        assert " ".join(words) == text
        assert [i for w in words for i in made._a.encode(f" {w}", add_special_tokens=False).ids] == made._a.encode(f" {text}", add_special_tokens=False).ids
        if "▁" not in text:
            assert [i for w in words for i in made._b.encode(w)] == made._b.encode(text)


def test_words_that_lose_bytes_are_found_among_many(paths):
    made = alignment.Aligner(*paths, 99)
    words = [f"w{i}" if i % 17 else f"lo▁st{i}" for i in range(300)] + [" a", "b ", "\n"]
    many = made._align(words)
    assert [x is None for x in many] == ["▁" in w for w in words]
    assert many == [made._align([w])[0] for w in words]


def test_blocks_and_parts_do_not_matter(spark, paths, monkeypatch):
    frame = spark.createDataFrame([(i % 7 or None, t, "x") for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, stripe string").repartition(4)
    one = alignment.align(frame, *paths, digest=True, stripes=7, salts=1).documents().collect()
    more = alignment.align(frame.repartition(1), *paths, digest=True, stripes=200, salts=5).documents().collect()
    assert sorted(map(str, one)) == sorted(map(str, more)) and len(one) == len(TEXTS) * 3
    whole = alignment.align(frame, *paths).documents().collect()
    assert {hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in whole} == {r.groups for r in one}


def test_empty_table(spark, paths, nothing):
    made = alignment.align(nothing, *paths)
    assert made.documents().count() == made.pairs().count() == 0
