"""Column helpers: every one is built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from residuum.functions import constants as K


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def hill(x: Column, t: float = 2.0, n: float = 4.0) -> Column:
    """``x^n / (t^n + x^n)``."""
    return F.pow(x, F.lit(n)) / (F.lit(float(t) ** n) + F.pow(x, F.lit(n)))


def kernel(d2: Column, scale: Column | float) -> Column:
    """Gaussian kernel of a squared distance."""
    s = F.lit(scale) if not isinstance(scale, Column) else scale
    return F.exp(-d2 / (2 * s * s))


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)])


def reverse_complement(bases: Column) -> Column:
    return F.translate(F.reverse(bases), "acgt", "tgca")


def channel_index(context: Column, new: Column) -> Column:
    """Index of a spectrum channel, folded to a middle ``a`` or ``c``; null if a base is unknown."""
    fold = F.substring(context, 2, 1).isin("g", "t")
    abc = F.when(fold, reverse_complement(context)).otherwise(context)
    to = F.when(fold, F.translate(new, "acgt", "tgca")).otherwise(new)
    at = lambda c: F.instr(F.lit(K.BASES), c) - 1
    first, middle, last = (F.substring(abc, i, 1) for i in (1, 2, 3))
    alt = at(to) - F.when(at(to) > at(middle), 1).otherwise(0)
    known = abc.rlike("^[acgt]{3}$") & to.rlike("^[acgt]$") & (to != middle)
    return F.when(known, 24 * at(first) + 6 * at(last) + 3 * (middle == "c").cast("int") + alt)


def chromosome_name(value: Column) -> Column:
    """``23`` to ``X`` and so on, with the ``chr`` prefix."""
    name = F.when(value == "23", "X").when(value == "24", "Y").when(value == "MT", "M").otherwise(value)
    return F.concat(F.lit("chr"), name)


def chromosome_number(value: Column) -> Column:
    bare = F.regexp_replace(value, "^chr", "")
    return F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(bare.try_cast("int"))


def residue_map(text: Column) -> Column:
    """``u:p u:p`` to an array of structs."""
    parts = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            F.split_part(x, F.lit(":"), F.lit(1)).cast("int").alias("u"), F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("p")
        ),
    )


def identity(attributes: Column) -> Column:
    """Per cent identity of an alignment; 100 where none is given."""
    found = F.regexp_extract(attributes, r"pdb_identity:([0-9.]+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("double"), F.lit(100.0))


def mutation_class(reference: Column, alternative: Column) -> Column:
    return F.when(alternative == "*", "N").when(alternative == reference, "S").otherwise("M")


def type_prefix(ttype: Column) -> Column:
    """A tumour type without what follows a hyphen."""
    return F.split_part(ttype, F.lit("-"), F.lit(1))


def zlog(count: Column, mean: Column, sd: Column, clamp: bool = True) -> Column:
    """``1 / max(1, log10(count - mean) / sd)``, with a defined value at every edge.

    A count up to the mean weighs 1. Without spread the weight is 0 above the
    clamp and 1 below. Without ``clamp`` undefined cases are null.
    """
    above = count - mean
    score = F.log10(F.when(above > 0, above)) / F.nullif(sd, F.lit(0.0))
    if not clamp:
        return F.when((above > 0) & (sd > 0), F.try_divide(F.lit(1.0), score))
    flat = F.when(F.log10(F.when(above > 0, above)) > 0, 0.0).otherwise(1.0)
    return F.when(above <= 0, 1.0).when(sd == 0, flat).otherwise(1 / F.greatest(F.lit(1.0), score))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def jaccard(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    shared = overlap(s1, e1, s2, e2)
    return F.coalesce(F.try_divide(shared, (e1 - s1) + (e2 - s2) - shared), F.lit(0.0))


def overlap_of_shorter(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.coalesce(F.try_divide(overlap(s1, e1, s2, e2), F.least(e1 - s1, e2 - s2)), F.lit(0.0))


def translate_codon(codon: Column) -> Column:
    return F.try_element_at(literal_map(K.CODONS), F.lower(codon))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on ``parts`` only, alike in any engine with MD5."""
    digest = F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 12)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**12)


def p_floor(exceed: Column, draws: Column) -> Column:
    return F.greatest(F.lit(1), exceed) / draws


def partner_kind(label: Column) -> Column:
    """``d`` one DNA chain, ``D`` several nucleic chains, ``R`` RNA, ``L`` ligand, from a partner's label."""
    several = label.contains(",")
    return (
        F.when((label.endswith("_0_DNA") | label.endswith("_0_DNA/RNA")) & ~several, "d")
        .when(label.endswith("_0_DNA/RNA"), "D")
        .when(label.endswith("_0_RNA"), "R")
        .otherwise("L")
    )


def color_value(count: Column, group: list[str] | None = None) -> Column:
    """``min(ln count, 4)`` over the largest such value, in hundredths."""
    log = F.least(F.ln(count.cast("double")), F.lit(4.0))
    top = F.max(log).over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1)))
    return F.coalesce(F.round(F.try_divide(100 * log, top)) / 100, F.lit(0.0))
