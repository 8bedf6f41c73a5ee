"""Quality rules with host-level verdicts.

Each document gets counts and rule failures. Failures are summed by host; each
host's failure rate is shrunk towards the rate of all hosts with an empirical
beta prior (moments of the hosts' rates), so that a host with two documents is
not judged by them alone. A host gets a verdict on a rule if its posterior, the
prior updated by its own documents, gives a chance of ``level`` or more that its rate
is beyond the limit: the rate at which failures are ``odds`` times as frequent,
against passes, as in all documents. Such a limit lies between 0 and 1 for any rate of all,
and the verdict is sharper the more documents a host has. Where hosts differ no
more than chance allows, or no document fails, there is no verdict. The verdicts are
joined back: a document goes if it fails the base rules, or fails a rule on which its host has
a verdict. So of two equal texts from different hosts one may go and one stay; a
document that fails nothing always stays.

Null text counts as no text (it fails the base rules). Rows with a null host
form one host of their own. Rows with a null or repeated identifier are judged
like others, each by its own text. Very long texts are counted whole. An empty
table gives an empty result; extra columns, whatever their names, are ignored by
:func:`judge` and kept by :func:`keep_good`.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import Staged, count_white, is_few, map_batches, text_bytes, without

_SYMBOLS = "#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)} if len(set(windows)) < len(windows) else None
    if not twice:
        return 0
    covered, upto = 0, 0
    for i, window in enumerate(windows):
        if window in twice:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def text_counts(text: str | None) -> tuple[int, ...]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines``."""
    text = text or ""
    raw = text_bytes(text)
    words = raw.split()  # bytes split at exactly space and 0x09-0x0D
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - count_white(text),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def _host(docs: DataFrame, host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("h:"), docs[host_col].cast("string")), F.lit("none"))


def _digest(docs: DataFrame, text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256))


def document_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``doc_id, host, digest`` (of the text) and the counts of each document."""
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        _host(docs, host_col).alias("host"),
        _digest(docs, text_col).alias("digest"),
        docs[text_col].alias("text"),
    )
    own = ["doc_id", "host", "digest"]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [text_counts(x) for x in batch["text"].to_pylist()]
        columns = [pa.array(x, pa.int64()) for x in zip(*found)] if found else [pa.array([], pa.int64())] * len(_COUNTS)
        return pa.RecordBatch.from_arrays([*(batch[c] for c in own), *columns], [*own, *_COUNTS])

    return map_batches(rows, count, "doc_id long, host string, digest binary, " + ", ".join(f"{c} long" for c in _COUNTS))


def rules() -> dict[str, Column]:
    """Name and failure condition of each document rule that hosts are judged by."""
    return {
        "symbols": F.col("n_symbols") * 10 > F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 6,
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "repeats": F.col("n_repeat_words") * 100 > F.col("n_words") * 30,
    }


def beta_above(a: float, b: float, x: float) -> float:
    """The chance that a beta variable is above ``x``, by the continued fraction of the incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x <= 0)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_above(b, a, 1 - x) if a > 0 else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, max(0.0, 1 - front * f / a))


def host_verdicts(flags: DataFrame, names: list[str], odds: float, level: float) -> DataFrame:
    """Per host: documents, and for each rule the shrunk rate, the chance that it is beyond the limit, and the verdict."""
    hosts = flags.groupBy("host").agg(
        F.count("*").alias("n_docs"), *(F.sum(F.col(f"fail_{r}").cast("long")).alias(f"n_{r}") for r in names)
    )
    square = F.col("n_docs").cast("double") * F.col("n_docs")
    moments = [F.sum("n_docs").alias("all_docs"), F.sum(square).alias("squares"), F.count("*").alias("hosts")]
    for r in names:
        moments += [F.sum(f"n_{r}").alias(f"all_{r}"), F.sum(F.col(f"n_{r}").cast("double") * F.col(f"n_{r}") / F.col("n_docs")).alias(f"var_{r}")]
    judged = hosts.crossJoin(hosts.agg(*moments))  # one row of moments
    columns = ["host", "n_docs", "all_docs"]
    for r in names:
        mean = F.col(f"all_{r}") / F.col("all_docs")
        spread = mean * (1 - mean)
        # variance of the hosts' rates, weighted by documents, beyond that of drawing so many documents
        apart = 1 - F.col("squares") / F.col("all_docs") / F.col("all_docs")
        between = F.col(f"var_{r}") / F.col("all_docs") - mean * mean - spread * (F.col("hosts") - 1) / F.col("all_docs")
        strength = F.when((between > 1e-12) & (apart > 1e-12), F.greatest(spread * apart / between - 1, F.lit(1.0)))
        judged = judged.withColumns({f"mean_{r}": mean, f"strength_{r}": strength})
        shrunk = (F.col(f"n_{r}") + F.col(f"mean_{r}") * F.col(f"strength_{r}")) / (F.col("n_docs") + F.col(f"strength_{r}"))
        judged = judged.withColumn(f"rate_{r}", F.coalesce(shrunk, mean))
        columns += [f"rate_{r}"]
    needed = [c for r in names for c in (f"n_{r}", f"mean_{r}", f"strength_{r}")]
    judged = judged.select(*columns, *needed)

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [batch[c] for c in columns]
        for r in names:
            chances = []
            for n, bad, mean, strength in zip(*(batch[c].to_pylist() for c in ("n_docs", f"n_{r}", f"mean_{r}", f"strength_{r}"))):
                if strength is None or not 0 < mean < 1:
                    chances.append(0.0)
                else:
                    limit = odds * mean / (1 - mean + odds * mean)
                    chances.append(beta_above(mean * strength + bad, (1 - mean) * strength + n - bad, limit))
            out.append(pa.array(chances, pa.float64()))
        return pa.RecordBatch.from_arrays(out, [*columns, *(f"chance_{r}" for r in names)])

    schema = "host string, n_docs long, all_docs long, " + ", ".join(f"{c}_{r} double" for c in ("rate", "chance") for r in names)
    weighed = map_batches(judged, weigh, schema)
    return weighed.withColumns({f"bad_{r}": F.col(f"chance_{r}") >= level for r in names})


def _with_hosts(flags: DataFrame, hosts: DataFrame, broadcast_hosts: int) -> DataFrame:
    """Verdicts joined back: broadcast if the hosts are few; else only those of a thousandth of all rows or more are."""
    if is_few(hosts, broadcast_hosts):
        return flags.join(F.broadcast(hosts), "host")
    hot = hosts.filter("n_docs * 1000 >= all_docs")  # 1000 at most
    rest = flags.join(F.broadcast(hot.select("host")), "host", "left_anti").join(hosts, "host")
    return flags.join(F.broadcast(hot), "host").unionByName(rest)


def _judged(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int, odds: float, level: float, broadcast_hosts: int
) -> DataFrame:
    staged = Staged(docs.sparkSession, "quality")
    counts = staged.write(document_counts(docs, id_col, text_col, host_col))
    found = rules()
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    flags = counts.withColumn("base_failed", base).withColumns({f"fail_{r}": c for r, c in found.items()})
    hosts = staged.write(host_verdicts(flags, list(found), odds, level))
    failed = F.lit(False)
    for r in found:
        failed = failed | (F.col(f"fail_{r}") & F.col(f"bad_{r}"))
    return _with_hosts(flags, hosts, broadcast_hosts).withColumn("kept", ~F.col("base_failed") & ~failed)


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    odds: float = 2.0,
    level: float = 0.9,
    broadcast_hosts: int = 100_000,
) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept``, and its host's shrunk rate of each rule.

    :param odds: the limit of a rule has this multiple of the odds of failure in all documents.
    :param level: the chance to be beyond it from which a host is bad.
    :param broadcast_hosts: verdicts of at most so many hosts are broadcast.
    """
    judged = _judged(docs, id_col, text_col, host_col, min_words, odds, level, broadcast_hosts)
    return judged.select("doc_id", *_COUNTS, "base_failed", "kept", *(f"rate_{r}" for r in rules()))


def keep_good(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    odds: float = 2.0,
    level: float = 0.9,
    broadcast_hosts: int = 100_000,
) -> DataFrame:
    """The documents that stay, with all their columns.

    Text and host decide about a document, so it is found again by the digest of the one and
    the other, whatever its identifier is.
    """
    judged = _judged(docs, id_col, text_col, host_col, min_words, odds, level, broadcast_hosts)
    gone = judged.filter("NOT kept").select("digest", "host").distinct()
    return without(docs, gone, {"digest": _digest(docs, text_col), "host": _host(docs, host_col)})
