"""A corpus pipeline over ``documents``, in five stages.

Each stage works on what the one before it kept and its decisions take effect:
documents that the quality rules reject go, then exact copies, then all but one
of each group of near copies; secrets are replaced in the texts; the documents
left are packed. Every stage's result is written as Parquet in the shared folder
and read again for the next; what a stage staged for itself is deleted then. All
stages but the last return the columns of ``documents``, extra ones included,
whatever their names.

Null texts count as empty and go with the quality rules, as do all short ones; so
an empty result is packed into no sequence. Rows without an identifier and rows
that repeat one are treated like others, each by its own text; of rows repeated
entire one stays. Very long texts are treated whole by every stage. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.llm import exact_dedup, near_dedup, packing, quality, secrets
from residuum.llm.common import Staged, read_table, scratch
from residuum.llm.queries import tokenizer_file

#: SQL has no form for near copies or packing; tests hold the run against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8."""
    return near_dedup.keep_one(docs, shingle_words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and ``n_chars`` follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on; the last one's result."""
    staged = Staged(spark, "corpus-pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch():
            docs = staged.write(stage(spark, docs, sf_dir))
        if before is not None:
            staged.drop(before)
        before = docs
    return docs
