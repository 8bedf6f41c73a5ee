"""Secret scans with built-in functions only.

Three patterns give the base spans. Further spans come from two character
Markov models, one of random strings and one of ordinary identifiers: a token of
12 characters or more is a secret if its log-likelihood ratio for each of its
characters reaches a threshold, so long tokens are judged like short ones. A pair of
characters that a model has not met falls back to how often its classes (lower case,
upper case, digits, marks) follow each other.

The models are trained from labelled samples. Random strings of 12 to 40 characters are
made from hash digests in five alphabets; digits alone are not among them, as nothing tells
them from ordinary numbers. Ordinary ones are the distinct tokens of a
bounded sample of documents outside their base spans, as they are and in capitals, and
made ones: rules of one character, alphabets, and names and paths of a list of common words.
A fifth of the labelled tokens is held out; the threshold is the greatest that a share
``recall`` of the held-out random tokens reaches, but no less than one that at most
``false_rate`` of the ordinary ones reach. :class:`Model` has the held-out recall of each
alphabet and length.

Positions come from ``split``: the pieces between the matches of a pattern and
the matches themselves give each start, by sums in blocks of matches, so a text
with very many matches, or one very long match, takes time in line with its
length. Texts of any length are scanned whole.

Null text counts as empty; a null identifier is passed through; repeated rows are
scanned alike; an empty table trains on made samples only and gives an empty
result. Extra columns stay; :func:`scan` replaces input columns named ``base`` or
``found``, :func:`redact` keeps all.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN = 6

TOKEN = r"[A-Za-z0-9+/_-]{12,}"
SHORTER = r"[A-Za-z0-9+/_-]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_KINDS = ("assign", "access", "hex", "markov")
_SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string,score:double>>"
_BLOCK = 128
_FAR = (1 << 31) - 1
_BINS, _STEP = 200, 0.02  # scores are counted in steps from -_BINS to _BINS
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-")
RANDOM_KINDS = ("hex", "base64", "capitals", "url", "lower")

#: Common words of names and paths; ordinary tokens are made of them.
WORDS = (
    "abstract account action active adapter address admin after agent alert alpha android angular apache api app archive array assets async auth auto back backend banner base batch "
    "bean before block board body boot bottom bridge browser buffer build builder bundle button cache call canvas card cart catalog center change channel chart check child class "
    "clean client clock close cloud cluster code collection color column com command common compile complete component config connect console container content context control copy "
    "core count create cross css current custom dash data database date debug default delete demo deploy detail device dialog digest direct display docker document domain download "
    "driver dynamic edit editor element email empty engine entity error event example export factory feature field file filter final first flow folder font form format frame front "
    "function gateway general global graph group handler header height hidden home host html http image import index info init inner input install instance int interface item java "
    "jquery json key lang language last layer layout left length library light line link list load local lock log login long loop main manager map master max member memory menu merge "
    "message method min mobile mode model module monitor mouse name native network new next node note number object offset old open option order output page panel parent parse password "
    "path pattern payment person photo pipeline player plugin point policy pool post power prefix press primary print private process product profile program project property proxy public "
    "query queue quick random range read real record redirect register release remote remove render replace report request reset resource response rest result return right role root "
    "route router rule run sample save scale schema screen script scroll search second section select send server service session set shadow shape share shell shop sign simple single "
    "singleton site size slider small socket sort source space split src stack standard start state static status step stop storage store stream string style submit success summary support "
    "switch system tab table tag target task team template test text theme thread time title token tool top total track transaction tree trigger type unit update upload url user util "
    "value vendor version video view visible void wait watch web widget width window word worker wrapper write yellow zone"
).split()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often and wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    before = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(values, before, add, lambda s: s["out"])


def _blocks(values: Column) -> Column:
    """``values``, not empty, cut into blocks."""
    last = F.floor((F.size(values) - 1) / _BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))


def _running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values``, integers and not empty, the fold of all before it; ``step`` is associative."""

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, zero, step))
        inside = lambda heads: F.flatten(F.transform(blocks, lambda x, i: _scan(x, F.get(heads, i), step)))
        return _let(_scan(totals, zero, step), inside)

    return _let(values, lambda v: _let(_blocks(v), over))


def _matches(text: Column, pattern: str, kind: str, minimum: int = 0) -> Column:
    """Array of ``struct(start, kind_no, end, kind, value, score)`` of a pattern's matches."""
    none = F.array().cast(_SPANS)

    def spans(whole: Column, between: Column, value: Column) -> Column:
        sizes = F.transform(whole, lambda m, i: F.length(F.get(between, i)) + F.length(m))

        def span(ends: Column) -> Callable[[Column, Column], Column]:
            return lambda m, i: F.struct(
                (F.get(ends, i) + F.length(F.get(between, i))).alias("start"),
                F.lit(_KINDS.index(kind)).alias("kind_no"),
                (F.get(ends, i) + F.length(F.get(between, i)) + F.length(m)).alias("end"),
                F.lit(kind).alias("kind"),
                F.get(value, i).alias("value"),
                F.lit(None).cast("double").alias("score"),
            )

        all_ = _let(_running(sizes, F.lit(0), lambda s, x: s + x), lambda ends: F.transform(whole, span(ends)))
        return F.filter(all_, lambda s: F.length(s["value"]) >= minimum)

    def found(whole: Column) -> Column:
        cut = F.split(text, pattern, -1)
        if not minimum:
            return _let(cut, lambda between: spans(whole, between, whole))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return _let(cut, lambda between: _let(value, lambda v: spans(whole, between, v)))

    return _let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda whole: F.when(F.size(whole) > 0, found(whole)).otherwise(none),
    )


def base_spans(text: Column) -> Column:
    return F.array_sort(
        F.concat(
            _matches(text, ASSIGN, "assign", MIN_ASSIGN), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex")
        )
    )


def _outside(spans: Column, base: Column) -> Column:
    """Spans that overlap none of the base ones, by the furthest end before and the next start behind each."""
    markov = F.lit(_KINDS.index("markov"))

    def free(all_: Column) -> Column:
        ends = F.transform(all_, lambda s: F.when(s["kind_no"] == markov, F.lit(0)).otherwise(s["end"]))
        starts = F.transform(F.reverse(all_), lambda s: F.when(s["kind_no"] == markov, F.lit(_FAR)).otherwise(s["start"]))
        before = _running(ends, F.lit(0), lambda s, x: F.greatest(s, x))
        behind = F.reverse(_running(starts, F.lit(_FAR), lambda s, x: F.least(s, x)))
        alone = lambda b, a: lambda s, i: (s["kind_no"] == markov) & (F.get(b, i) <= s["start"]) & (F.get(a, i) >= s["end"])
        return _let(before, lambda b: _let(behind, lambda a: F.filter(all_, alone(b, a))))

    joined_ = lambda b, s: _let(F.array_sort(F.concat(b, s)), free)
    return _let(
        spans,
        lambda s: F.when(F.size(s) > 0, _let(base, lambda b: F.when(F.size(b) > 0, joined_(b, s)).otherwise(s))).otherwise(s),
    )


def made_ordinary(number: int = 1500) -> list[str]:
    """Rules of one character, alphabets in order, and names and paths of ``WORDS``."""
    out = [c * n for c in ALPHABET for n in (12, 20, 32, 40)]
    out += [pair * n for pair in ("-_", "ab", "xy", "01", "xX", "+-", "_-", "abc", "123") for n in (8, 14)]
    for letters in (*_CLASSES[:3], _CLASSES[2] * 3, "".join(_CLASSES[:2]), "qwertyuiopasdfghjklzxcvbnm", "1234567890" * 2):
        for line in (letters, letters[::-1], letters.upper()):
            out += [line[b : b + n] for n in range(12, len(line) + 1) for b in range(len(line) - n + 1)]
    for n in range(number):
        words = [WORDS[(n * 7919 + k * (104729 + n)) % len(WORDS)] for k in range(2 + n % 4)]
        camel = "".join(w.capitalize() for w in words)
        out += [camel, camel[0].lower() + camel[1:], "/".join(words), "_".join(words), "-".join(words), "_".join(words).upper(), f"{'-'.join(words)}-{n % 10}_{n % 7}_{n % 3}", f"/{'/'.join(words)}{n % 100}", "".join(words)]
    return sorted(set(out))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """``token, kind, random, held``: distinct ordinary tokens of about ``sample_docs`` documents and made ones, and random ones.

    A document is taken if the hash of its identifier and text is low enough for
    the share wanted, so no task sees more than its own part, and rows repeated
    entire count once. Every fifth token, by hash, is held out.
    """
    spark = docs.sparkSession
    known = docs.filter(docs[text_col].isNotNull())
    share = sample_docs / max(known.count(), sample_docs, 1)
    low = F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    chosen = known.filter(F.xxhash64(docs[id_col], docs[text_col]) <= low).select(docs[text_col].alias("text")).distinct()
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = chosen.select(F.explode(F.regexp_extract_all(clean, F.lit(SHORTER), F.lit(0))).alias("token")).distinct()
    ordinary = ordinary.select(F.explode(F.array("token", F.upper("token"))).alias("token"))
    known_names = F.from_json(F.lit(json.dumps(made_ordinary())), "array<string>")
    ordinary = ordinary.unionByName(spark.range(1).select(F.explode(known_names).alias("token"))).distinct()
    digest = F.sha2(F.col("id").cast("string"), 512)
    size = F.lit(12) + F.pmod("id", F.lit(29)).cast("int")
    alphabets = (
        digest,
        F.translate(F.base64(F.unhex(digest)), "=\r\n", ""),
        F.concat(*(F.upper(F.conv(F.substring(digest, i, 15), 16, 36)) for i in (1, 16, 31, 46))),
        F.translate(F.base64(F.unhex(F.reverse(digest))), "+/=\r\n", "-_"),
        F.lower(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("lower"), F.col("id").cast("string")), 512))), "0123456789+/=\r\n", "")),
    )
    strings = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.substring(x, F.lit(1), size).alias("token")) for k, x in zip(RANDOM_KINDS, alphabets))))
    made = spark.range(sample_docs).select(strings.alias("x")).select("x.token", "x.kind", F.lit(True).alias("random"))
    both = ordinary.select("token", F.lit("ordinary").alias("kind"), F.lit(False).alias("random")).unionByName(made)
    return both.withColumn("held", F.pmod(F.xxhash64("token"), F.lit(5)) == 0)


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of pairs of ``ALPHABET``, the threshold for each character, and held-out figures.

    ``by_kind`` has the held-out recall of each alphabet of random strings and length, rounded down to tens.
    """

    ratios: list[float]
    threshold: float
    recall: float
    false_rate: float
    by_kind: dict[tuple[str, int], float]

    def column(self) -> Column:
        return F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = 2000,
    recall: float = 0.97,
    false_rate: float = 0.0005,
) -> Model:
    """The models and the threshold.

    What reaches the driver is a count per class and pair, at most twice the
    alphabet squared, and a count per alphabet, length and step of scores.
    """
    sample = labelled_sample(docs, id_col, text_col, sample_docs).filter(F.length("token") > 1)
    pairs = F.transform(
        F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2))
    )
    short = sample.filter("NOT held").withColumn("token", F.substring("token", 1, 100))  # one token is no more than that
    counted = short.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = {kind: [[0] * size for _ in ALPHABET] for kind in (True, False)}
    for row in counted:
        counts[row["random"]][place[row["pair"][0]]][place[row["pair"][1]]] += row["count"]
    logs = {kind: _log_transitions(m) for kind, m in counts.items()}
    ratios = [round(a - b, 6) for x, y in zip(logs[True], logs[False]) for a, b in zip(x, y)]

    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    step = F.least(F.greatest(F.floor(score(F.col("token"), table) / _STEP), F.lit(-_BINS)), F.lit(_BINS))
    ten = F.least(F.floor(F.length("token") / 10) * 10, F.lit(40)).cast("int")
    held = sample.filter("held AND length(token) >= 12").groupBy("random", "kind", ten.alias("ten"), step.alias("step")).count().collect()
    reach = {kind: [sum(r["count"] for r in held if r["random"] == kind and r["step"] >= t) for t in range(-_BINS, _BINS + 2)] for kind in (True, False)}
    share = {kind: [n / max(c[0], 1) for n in c] for kind, c in reach.items()}
    rare = next(i for i, x in enumerate(share[False]) if x <= false_rate)
    most = max((i for i, x in enumerate(share[True]) if x >= recall), default=0)
    best = max(rare, most, _BINS + 1)  # above 0: likelier random than not
    by_kind: dict[tuple[str, int], list[int]] = {}
    for r in held:
        if r["random"]:
            found = by_kind.setdefault((r["kind"], r["ten"]), [0, 0])
            found[0] += r["count"] * (r["step"] >= best - _BINS)
            found[1] += r["count"]
    return Model(ratios, (best - _BINS) * _STEP, share[True][best], share[False][best], {k: x / n for k, (x, n) in sorted(by_kind.items())})


def _log_transitions(counts: list[list[int]], backing: float = 5.0) -> list[list[float]]:
    """Log transition probabilities, smoothed towards those of the characters' classes."""
    class_of = [next(k for k, letters in enumerate(_CLASSES) if c in letters) for c in ALPHABET]
    kinds = range(len(_CLASSES))
    column = [sum(line[j] for line in counts) + 0.5 for j in range(len(counts))]
    whole = [sum(column[j] for j in range(len(column)) if class_of[j] == k) for k in kinds]
    steps = [[1.0 + sum(counts[i][j] for i in range(len(counts)) for j in range(len(counts)) if class_of[i] == k and class_of[j] == m) for m in kinds] for k in kinds]
    out = []
    for i, line in enumerate(counts):
        row = steps[class_of[i]]
        expected = [row[class_of[j]] / sum(row) * column[j] / whole[class_of[j]] for j in range(len(line))]
        out.append([math.log((x + backing * e) / (sum(line) + backing)) for x, e in zip(line, expected)])
    return out


def llr(token: Column, ratios: Column) -> Column:
    """Log-likelihood ratio of a token, random against ordinary, over its character pairs."""
    begin = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), c) - 1
        more = F.when(s["last"] >= 0, F.get(ratios, s["last"] * len(ALPHABET) + at)).otherwise(F.lit(0.0))
        return F.struct(at.alias("last"), (s["sum"] + more).alias("sum"))

    return F.aggregate(F.split(token, ""), begin, step, lambda s: s["sum"])


def score(token: Column, ratios: Column) -> Column:
    """The ratio for each pair of a token of two characters or more."""
    return llr(token, ratios) / (F.length(token) - 1)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = 2000,
    model: Model | None = None,
) -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of spans, base ones and all, in order.

    Spans of the models carry their log-likelihood ratio for each character as ``score``.

    :param sample_docs: expected size of the labelled sample of documents, all if there are fewer.
    :param model: what :func:`train` gave on other documents; trained on ``docs`` if not given.
    """
    model = model or train(docs, id_col, text_col, sample_docs)
    text = F.coalesce(docs[text_col], F.lit(""))
    ratios = model.column()

    def scored(tokens: Column) -> Column:
        with_score = lambda r: F.transform(tokens, lambda s: s.withField("score", score(s["value"], r)))
        return F.filter(_let(ratios, with_score), lambda s: s["score"] >= model.threshold)

    likely = _let(_matches(text, TOKEN, "markov"), lambda t: F.when(F.size(t) > 0, scored(t)).otherwise(t))
    together = lambda b: F.array_sort(F.concat(b, _outside(likely, b)))
    both = _let(base_spans(text), lambda b: F.struct(b.alias("base"), together(b).alias("found")))
    kept = [docs[f"`{c}`"] for c in docs.columns if c not in ("base", "found")]
    spans = _unused("spans", docs.columns)
    return docs.select(*kept, both.alias(spans)).select(*(f"`{c}`" for c in docs.columns if c not in ("base", "found")), f"{spans}.base", f"{spans}.found")


def _unused(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``spans``, sorted and not empty, replaced by ``mark``; overlapping ones give one."""

    def block(spans_ends: Column) -> Column:
        """Of a block of spans, each with the furthest end before it: the text from that end on, and marks."""
        first = F.get(spans_ends, F.lit(0))["before"]
        part = F.substring(text, first + 1, F.greatest(F.element_at(spans_ends, -1)["start"] - first, F.lit(0)))
        piece = lambda p: lambda s: F.when(
            s["start"] >= s["before"], F.concat(F.substring(p, s["before"] - first + 1, s["start"] - s["before"]), F.lit(mark))
        ).otherwise("")
        return _let(part, lambda p: F.array_join(F.transform(spans_ends, piece(p)), ""))

    def over(s: Column) -> Column:
        ends = F.transform(s, lambda x: x["end"])
        before = _running(ends, F.lit(0), lambda a, b: F.greatest(a, b))
        paired = _let(before, lambda m: F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), F.get(m, i).alias("before"))))
        body = _let(paired, lambda p: F.array_join(F.transform(_blocks(p), block), ""))
        return F.concat(body, F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return _let(spans, over)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans give one."""
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")  # apart from the columns that the scan adds
    found = scan(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), whole), "id", "text", **options)
    clean = F.when(F.size("found") > 0, masked(F.coalesce("text", F.lit("")), F.col("found"), mark)).otherwise(F.col("text"))
    return found.select(*((clean if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
