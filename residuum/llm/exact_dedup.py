"""Exact deduplication: a tree merge of sorted digest runs.

Every input partition becomes one run: its digests in order, each with the
identifier to retain and the number of rows. Runs are exchanged in binomial
rounds. After round ``j`` a row lives on the node given by its digest and by the
source number without its lowest ``j * bits`` bits, so each round merges
``2 ** bits`` runs, and a digest that a third of all rows share reaches any
merger as at most ``2 ** bits`` rows. A digest counts as equal only together
with the text's byte length and a second 64-bit hash.

Nulls: a null text equals the empty text; a null identifier loses against any
other. Repeated rows (same identifier and text) count in ``group_size`` and just
one of them is kept. An empty table gives an empty result. Extra columns are
ignored by :func:`duplicate_groups` and kept by :func:`deduplicate`, whatever their
names. Very long texts are hashed whole; only digests move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import Staged, one_of_each, without

_RUN = "digest binary, check long, n_bytes long, rank long, row long, keep_id long, n long, node long"
_SAME = ["digest", "check", "n_bytes"]


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours with equal digests; the first row of each holds the best id."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        keys = np.frombuffer(b"".join(table["digest"].to_pylist()), "u8").reshape(-1, 4)
        more = np.stack([table[c].to_numpy() for c in ("check", "n_bytes")], 1)
        head = np.ones(len(keys), bool)
        head[1:] = (keys[1:] != keys[:-1]).any(1) | (more[1:] != more[:-1]).any(1)
        at = np.flatnonzero(head)
        total = np.add.reduceat(table["n"].to_numpy(), at)
        merged = table.take(pa.array(at))
        merged = merged.set_column(merged.schema.get_field_index("n"), "n", pa.array(total))
        merged = merged.combine_chunks().to_batches()[0]
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield held


def merge_runs(digests: DataFrame, fan_bits: int = 4, rounds: int = 2) -> DataFrame:
    """One row per distinct text: its digest, retained id and number of rows.

    :param fan_bits: each round merges ``2 ** fan_bits`` runs.
    :param rounds: ``2 ** (fan_bits * rounds)`` source nodes; source partitions
        beyond that number share nodes.
    """
    order = [*_SAME, "rank", "row"]
    nodes = 1 << (fan_bits * rounds)
    runs = (
        digests.withColumn("node", F.pmod(F.spark_partition_id(), F.lit(nodes)).cast("long"))
        .sortWithinPartitions(*order)
        .mapInArrow(_merge_sorted, _RUN)
    )
    for _ in range(rounds):
        runs = (
            runs.withColumn("node", F.shiftright("node", fan_bits))
            .repartition("digest", "node")
            .sortWithinPartitions(*order)
            .mapInArrow(_merge_sorted, _RUN)
        )
    return runs


def _digests(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    identifier = docs[id_col].cast("long")
    rank = -identifier if keep == "largest" else identifier
    return docs.select(
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.coalesce(rank, F.lit((1 << 63) - 1)).alias("rank"),
        F.monotonically_increasing_id().alias("row"),
        identifier.alias("keep_id"),
        F.lit(1).cast("long").alias("n"),
    )


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    :param keep: ``smallest`` or ``largest`` identifier of each group stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    staged = Staged(docs.sparkSession, "exact-dedup")
    digests = staged.write(_digests(docs, id_col, text_col, keep))
    classes = merge_runs(digests).filter("n > 1").select(
        *_SAME, F.col("keep_id").alias("class_id"), F.col("row").alias("class_row"), F.col("n").alias("class_n")
    )
    # Only groups of two or more are joined back; a hot one is split by AQE's skew join.
    return digests.join(classes, _SAME, "left").select(
        F.col("keep_id").alias("doc_id"),
        F.when(F.col("class_n").isNull(), F.col("keep_id")).otherwise(F.col("class_id")).alias("keep_id"),
        F.coalesce("class_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("class_n").isNull() | (F.col("row") == F.col("class_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Rows are found again by identifier and text digest; of rows repeated with
    both equal, one stays. Texts are shuffled only where the digests that go are too many
    to broadcast.
    """
    staged = Staged(docs.sparkSession, "exact-dedup-rows")
    name = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("none"))
    keys = {"id": name(docs[id_col]), "sha": F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)}
    groups = duplicate_groups(docs, id_col, text_col, keep).filter("group_size > 1")
    marks = staged.write(
        groups.groupBy(name(F.col("doc_id")).alias("id"), F.col("text_sha256").alias("sha"))
        .agg(F.count("*").alias("n"), F.first(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("stays"))
        .filter("NOT stays OR n > 1")
    )
    rows = without(docs, marks.filter("NOT stays"), keys)
    return one_of_each(rows, marks.filter("stays"), keys)
