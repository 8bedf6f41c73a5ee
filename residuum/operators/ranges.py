"""Rows dealt into ranges of a total order, so that ranks and running sums need no task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.sources.staging import Stage


def in_ranges(rows: DataFrame, order: list[str], least: int = 64) -> DataFrame:
    """``rows`` with ``_b``, numbers of ranges in the order of ``order``, of about equal size.

    The rows are partitioned by range and staged with the number of their partition, so ranges
    are split by the later columns where the earlier ones are equal. There are as many ranges as
    shuffle partitions, ``least`` at least.
    """
    number = max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(number, *order).withColumn("_b", F.spark_partition_id())
    return Stage(rows.sparkSession, "ranges").write(placed)
