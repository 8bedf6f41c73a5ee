"""Domain-shaped views of the benchmark tables, so that each operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, i, x, y, z, v``: vectors as residues, labels as structures."""
    at = lambda k: (F.get("embedding", F.lit(k)).cast("double") * 20)
    return table(spark, sf_dir, "embeddings").select(
        "label", F.col("vec_id").alias("i"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (1.0 + F.col("vec_id") % 5).alias("v")
    )


POINTS = """points AS (SELECT label, vec_id AS i, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y,
  embedding[3]::DOUBLE * 20 AS z, 1e0 + vec_id % 5 AS v FROM embeddings)"""


def with_others(a: DataFrame, b: DataFrame, key: str, slices: int = 32, tasks: int = 96) -> DataFrame:
    """All rows of ``a`` beside those of ``b`` with the same ``key``; ``a`` is cut into slices, so that a key with many rows is spread over tasks."""
    cut = a.withColumn("_slice", F.pmod(F.xxhash64(*a.columns), F.lit(slices)))
    others = b.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")))
    near = [df.repartition(tasks, key, "_slice") for df in (cut, others)]
    return near[0].join(near[1].hint("shuffle_hash"), [key, "_slice"]).drop("_slice")


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ttype, sample, mut_count``: orders of customers by market segment."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.col("c_mktsegment").alias("ttype"), F.col("c_custkey").alias("sample"))


def scored_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ((F.col("p_partkey") * 7919) % 997 + 1) / F.lit(998.0)
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("p"), (F.col("p_size") <= 20).alias("listed"))


def part_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``brand, key, start, end, p``."""
    start = (F.col("p_partkey") * 37) % 500
    return scored_parts(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select(
        F.col("p_brand").alias("brand"), F.format_string("%09d", "p_partkey").alias("key"), start.alias("start"),
        (start + F.col("p_size") + 20).alias("end"), "p",
    )
