import random
import re
from collections import Counter

import numpy as np
from residuum.llm.quality import beta_above, judge, keep_good, text_counts


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    dup = sum(x in lines[:n] for n, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(corpus):
    more = ["a b c a b c a b", "x\n\nx\n x\nx", "#*|<>&$% \x0b\x0c\r é ß", "a a a a", None, "\x1c \x85 \xa0"]
    for text in [c[1] for c in corpus] + more:
        assert text_counts(text)[:5] == brute(text)


def test_judge(docs, corpus, odd, nothing):
    rows = {r.doc_id: r for r in judge(docs).collect()}
    assert len(rows) == len(corpus)
    for i, text, *_ in corpus:
        n, _, _, _, repeated = brute(text)
        assert rows[i].base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (rows[i].base_failed and rows[i].kept)
    assert judge(odd).count() == odd.count() and judge(nothing).count() == 0
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def above(a, b, x, steps=20_000):
    """The chance of a beta variable to be above ``x``, by plain sums over a grid in the log-odds."""
    ys = np.linspace(-60, 60, 40 * steps)
    logs = -a * np.logaddexp(0, -ys) - b * np.logaddexp(0, ys)
    w = np.exp(logs - logs.max())
    return w[ys > np.log(x / (1 - x))].sum() / w.sum()


def verdicts(rows, odds=2.0, level=0.9, min_words=50):
    """``kept`` of each row ``(id, text, host)`` by plain sums."""
    counts = [text_counts(t) for _, t, _ in rows]
    fails = [
        (s * 10 > n, d * 10 > lines * 6, c < 2 * n or c > 15 * n, r * 100 > n * 30) for n, c, s, d, r, lines in counts
    ]
    hosts = {}
    for (_, _, h), f in zip(rows, fails):
        hosts.setdefault(h, []).append(f)
    bad = {}
    for k in range(4):
        sums = {h: (sum(f[k] for f in fs), len(fs)) for h, fs in hosts.items()}
        mean = sum(x for x, _ in sums.values()) / len(rows)
        spread = mean * (1 - mean)
        apart = 1 - sum(n * n for _, n in sums.values()) / len(rows) ** 2
        between = sum(n * (x / n - mean) ** 2 for x, n in sums.values()) / len(rows) - spread * (len(sums) - 1) / len(rows)
        for h, (x, n) in sums.items():
            if between <= 1e-12 or apart <= 1e-12 or not 0 < mean < 1:
                bad[h, k] = False
                continue
            strength = max(spread * apart / between - 1, 1.0)
            limit = odds * mean / (1 - mean + odds * mean)
            bad[h, k] = above(mean * strength + x, (1 - mean) * strength + n - x, limit) >= level
    out = []
    for (_, _, h), f, (n, *_, r, _) in zip(rows, fails, counts):
        base = n < min_words or 100 * r > 50 * n
        out.append(not base and not any(f[k] and bad[h, k] for k in range(4)))
    return out


def test_beta_tails():
    for a, b, x in ((0.5, 0.5, 0.3), (2, 5, 0.2), (3, 900, 0.01), (800, 40, 0.97), (0.5, 4, 0.4), (1e4, 2e4, 0.34)):
        assert abs(beta_above(a, b, x) - above(a, b, x)) < 1e-4
    assert beta_above(1e7, 1e9, 0.01) < 1e-6 and beta_above(1e7, 1e9, 0.0098) > 1 - 1e-6


def test_hosts_are_judged_at_any_rate(spark):
    """Where most documents fail, the host that is far worse still stands out; where none fails, there is no verdict."""
    clean, noisy = " ".join(f"word{i}" for i in range(80)), " ".join(f"word{i}###" for i in range(80))
    rows = [(i, noisy if i < 270 else clean, "worse") for i in range(300)] + [(1000 + i, noisy if i < 20 else clean, "better") for i in range(200)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in judge(frame(rows)).collect()}
    assert not any(got[i] for i in range(270)) and all(got[i] for i in got if i >= 270)
    assert [got[i] for i, _, _ in rows] == verdicts(rows)
    assert judge(frame([(i, clean, f"h{i % 3}") for i in range(90)])).filter("NOT kept").count() == 0
    assert judge(frame([(i, noisy, f"h{i % 3}") for i in range(90)])).filter("NOT kept").count() == 0


def _hosted(rnd, n=900):
    """Hosts of many sizes, some with many noisy pages, one without a name."""
    rows = []
    for i in range(n):
        h = rnd.choice(["big"] * 6 + ["mid", "small", "noisy", "noisy", None] + [f"tiny{i % 40}"])
        share = {"noisy": 0.6, "big": 0.05, "mid": 0.1}.get(h, 0.08)
        words = [f"word{rnd.randrange(500)}" for _ in range(rnd.randint(40, 90))]
        if rnd.random() < share:
            words = [w + "##" for w in words]
        elif rnd.random() < 0.05:
            words = words[:30] * 2
        rows.append((i, " ".join(words), h))
    return rows


def test_verdicts_match_brute_force(spark):
    rnd = random.Random(12)
    rows = _hosted(rnd)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    expected = verdicts(rows)
    for limit in (100_000, 3):
        got = {r.doc_id: r.kept for r in judge(frame, broadcast_hosts=limit).collect()}
        assert [got[i] for i, _, _ in rows] == expected
    plain = [brute(t)[0] >= 50 and 100 * brute(t)[4] <= 50 * brute(t)[0] for _, t, _ in rows]
    assert 20 < sum(p and not e for p, e in zip(plain, expected))  # the method decides


def test_hosts_get_different_verdicts_on_equal_texts(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    noisy = " ".join(f"word{i}###" for i in range(80))
    rows = [(i, noisy if i < 8 else clean, "bad") for i in range(10)] + [(100 + i, noisy if i == 0 else clean, "good") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in judge(frame).collect()}
    assert not got[0].kept and got[9].kept and got[100].kept  # 0 and 100 have the same text
    assert 0.5 < got[0].rate_symbols < 0.8 and got[100].rate_symbols < 0.1
    assert [got[i].kept for i, _, _ in rows] == verdicts(rows)
    kept = {r.doc_id for r in keep_good(frame).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_hosts_that_differ_by_chance_get_no_verdict(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(f"word{k}" + "##" * (rnd.random() < 0.02 or i % 10 == 0) for k in range(80)), f"h{i % 30}") for i in range(600)]
    frame = spark.createDataFrame([(i, t, f"h{rnd.randrange(5)}") for i, t, _ in rows], "doc_id long, text string, source string")
    assert judge(frame).filter("NOT kept").count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), "too short"
    rows = [(None, good, "a"), (None, bad, "a"), (None, None, "a"), (5, good, "a"), (5, bad, "b"), (5, bad, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0, r.text) for r in keep_good(frame).collect()) == [(0, good), (5, good)]
    long = " ".join(f"w{i}" for i in range(300_000))
    assert judge(spark.createDataFrame([(1, long, "a")], frame.schema)).first().n_words == 300_000
