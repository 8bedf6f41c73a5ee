"""Mutation counts, frequency weights and spectra of samples."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.operators.mapping import context, snps
from residuum.operators.ranges import in_ranges
from residuum.operators.tally import Tally, counted


def coding(muts: DataFrame, column: str = "Variant_Classification") -> DataFrame:
    """coding classes stay, noncoding ones go, an unknown one is an error."""
    kind = F.col(column)
    known = F.when(kind.isin(*K.CODING_CLASSES), True).when(kind.isin(*K.NONCODING_CLASSES), False)
    return muts.filter(F.coalesce(known, F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(kind, F.lit("null")))).cast("boolean")))


def sample_counts(muts: DataFrame, group: str = "ttype", sample: str = "sample") -> DataFrame:
    """A01."""
    return muts.groupBy(group, sample).agg(F.count("*").alias("mut_count"))


def frequency_weights(counts: DataFrame, group: str | None = "ttype", sample: str = "sample", clamp: bool = True) -> DataFrame:
    """Rank score and z-log weight of each sample within its group.

    Ties of a count are ordered by sample. Rows are numbered inside ranges of
    group, count and sample; the sums of the ranges and the means are joined
    back, so no task holds a whole group.
    """
    keys = [group] if group else []
    logs = F.log10(F.col("mut_count").cast("double"))
    placed = in_ranges(counts, [*keys, "mut_count", sample])
    moments = placed.groupBy(*keys).agg(F.avg(logs).alias("_mean"), F.stddev_pop(logs).alias("_sd"), F.count("*").alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_m"))
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_m").over(below), F.lit(0)).alias("_base"))
    sums = sums.join(moments, keys) if keys else sums.crossJoin(moments)  # one row of moments
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("mut_count", sample)) - 1
    joined = placed.withColumn("_i", inside).join(sums, [*keys, "_b"]).withColumn("_i", F.col("_base") + F.col("_i"))
    return joined.select(
        *keys, sample, "mut_count", (F.col("_i") / F.col("_n")).alias("rank_score"),
        C.zlog(F.col("mut_count").cast("double"), F.col("_mean"), F.col("_sd"), clamp).alias("zlog_score"),
    )


def ptm_counts(ptm: DataFrame) -> DataFrame:
    """Observed sites of each patient."""
    return ptm.groupBy(F.col("patient").alias("sample")).agg(F.sum("value").alias("mut_count"))


def channel_counts(muts: DataFrame, genome: DataFrame, chunk: int = 65536, tally: Tally | None = None) -> DataFrame:
    """``patient, ttype, channel`` of each usable SNP; patients without one stay with a null channel."""
    rows = snps(muts).filter("Variant_Type = 'SNP'").withColumn("chrom", C.chromosome_name(F.col("Chromosome")))
    rows = counted(tally, context(rows, genome, F.col("Start_position") - 2, 3, "abc", chunk), "with bases around")
    rows = counted(tally, rows.filter(F.substring("abc", 2, 1) == F.lower("Reference_Allele")), "same base")
    rows = rows.select(F.col("Tumor_Sample_Barcode").alias("patient"), "ttype", "abc", F.lower("Tumor_Seq_Allele2").alias("new"))
    return with_channel(rows).select("patient", "ttype", "channel")


def with_channel(rows: DataFrame) -> DataFrame:
    """``channel`` of ``abc`` and ``new`` as in :func:`columns.channel_index`, null if there is none, looked up in a table of 192 rows.

    The expression mentions the bases dozens of times, and each mention is computed anew where it meets a filter.
    """
    number, turn = {name: n for n, name in enumerate(K.channels())}, str.maketrans("acgt", "tgca")
    table = []
    for abc in map("".join, product(K.BASES, repeat=3)):
        for new in set(K.BASES) - {abc[1]}:
            folded = (abc[::-1].translate(turn), new.translate(turn)) if abc[1] in "gt" else (abc, new)
            table.append((abc, new, number[f"{folded[0]}-{folded[1]}"]))
    known = rows.sparkSession.createDataFrame(table, "abc string, new string, channel int")
    return rows.join(F.broadcast(known), ["abc", "new"], "left")


def spectrum_pivot(rows: DataFrame) -> DataFrame:
    """The 96 counts of each patient in channel order, zero where absent.

    Mutations of a channel are counted first, so the 96 columns are made from a few rows of each patient.
    """
    found = rows.groupBy("patient", "ttype", "channel").agg(F.count("*").alias("n"))
    counts = [F.coalesce(F.sum(F.when(F.col("channel") == i, F.col("n"))), F.lit(0).cast("long")).alias(name) for i, name in enumerate(K.channels())]
    return found.groupBy("patient", "ttype").agg(*counts)
