"""Greedy steps that follow an order, on tables: rounds decide every row whose earlier neighbours are decided.

No group of rows is gathered in a task. What a round decides depends only on links
between rows, so the outcome is that of going through the rows one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.sources.staging import Stage


def dropped(links: DataFrame, stage: Stage) -> DataFrame:
    """``item`` of every row that an earlier kept row rules out, from links ``item, earlier``.

    A row is kept if no linked earlier one is. In each round the rows that wait for
    none are kept, and all that are linked to them are dropped; links of dropped rows
    vanish, which frees others. The rounds are as many as the longest chain of rows that
    wait for each other.
    """
    pending = stage.write(links.select("item", "earlier").distinct())
    out = pending.select("item").limit(0)
    while not pending.isEmpty():
        waiting = pending.select(F.col("item").alias("earlier")).distinct()
        free = pending.select("earlier").distinct().join(waiting, "earlier", "left_anti")
        gone = stage.write(pending.join(free, "earlier", "left_semi").select("item").distinct())
        out = out.unionByName(gone)
        left = pending.join(gone, "item", "left_anti").join(gone.withColumnRenamed("item", "earlier"), "earlier", "left_anti")
        before, pending = pending, stage.write(left.select("item", "earlier"))
        stage.drop(before)
    return stage.write(out)


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """``node, root`` of every node in a link ``a, b``; ``root`` is the least node reachable.

    Each round takes every node to its least neighbour, shortens the way to it, and replaces
    the ends of all links; what is left at least halves.
    """
    ends = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, labels = stage.write(ends(links)), None
    while labels is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")))
        for _ in range(2):
            above = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = stage.write(parent.join(above, "p").select("a", F.col("pp").alias("p")))
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("a").alias("root"), "p")
            labels = stage.write(labels.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        moved = left.join(parent, "a").select(F.col("p").alias("a"), "b")
        moved = moved.join(parent.withColumnsRenamed({"a": "b", "p": "q"}), "b").select("a", F.col("q").alias("b"))
        left = stage.write(ends(moved))
    return labels
