"""Connected components of a table of links, by contraction.

Every round hooks each node to its least neighbour, shortens the paths, and
replaces the nodes of each link by their roots; links inside a root vanish. The
links at least halve their nodes, so the rounds grow with the logarithm of the
longest path. Nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import Staged


def _proper(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, staged: Staged) -> DataFrame:
    """``node, root`` of every node in a link ``a, b``; ``root`` is the least node reachable."""
    links = staged.write(_proper(links))
    labels = links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    first = True
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("a", F.col("pp").alias("p"))
            parent = staged.write(parent)
        if first:
            labels, first = parent.select(F.col("a").alias("node"), F.col("p").alias("root")), False
        else:
            step = parent.select(F.col("a").alias("root"), "p")
            labels = staged.write(labels.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        of_a = parent.select("a", F.col("p").alias("pa"))
        of_b = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        joined = links.join(of_a, "a").join(of_b, "b")
        links = staged.write(_proper(joined.select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    return labels
