"""Random draws in blocks over tasks, with a stop rule on the counts of all blocks.

A block is a fixed number of draws of one key, seeded by key and block. A round deals
the next blocks of every open key over tasks, adds their counts in order of blocks, and
closes a key at the first block where the rule holds; later blocks of the round do not
count. So the results are the same for any size of rounds and number of tasks, a key
with many draws uses all cores, and keys that are done cost nothing more: the next
round has only open ones. Rounds double the blocks, so less than half of them is wasted.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import constants as K
from residuum.sources.staging import Stage


@dataclass(frozen=True)
class Draws:
    """How long to draw."""

    max_draws: int = 10_000
    batch: int = 1000  # draws of a block
    threshold: float = K.STOP_THRESHOLD
    scales: tuple[float, ...] = K.SCALES
    seed: int = 0
    max_seconds: float | None = None  # of one key, in all tasks
    first_round: int = 4  # blocks of the first round
    tasks: int = 256  # a key's blocks of a round are dealt to so many tasks at most


#: Of a key, from its rows of each table: ``None`` if nothing can be drawn, else the observed values and a function
#: that adds up a block: generator and number of draws to counts of values reached, or ``None`` if a draw failed.
Prepared = tuple[list[tuple], np.ndarray, Callable[[np.random.Generator, int], np.ndarray | None]]
Prepare = Callable[[object, dict[str, pd.DataFrame]], Prepared]


def settled(exceed: F.Column | np.ndarray, draws) -> F.Column | np.ndarray:
    """How well a p-value is known; small when well."""
    return (draws - exceed + 1) / ((draws + 3) * (exceed + 1))


def in_rounds(tables: dict[str, DataFrame], key: str, labels: str, prepare: Prepare, options: Draws) -> DataFrame:
    """``key, labels.., score, exceed, draws, status`` of every statistic of each key.

    ``tables`` share the column ``key``; a key's rows of all of them are together in a
    task. ``labels`` are the columns that name a statistic. Status 0: the rule holds; 1:
    the budget of draws or seconds ended first; 2: a draw was not possible.
    """
    first = next(iter(tables.values()))
    spark = first.sparkSession
    stage = Stage(spark, "draws")
    kind = dict(first.dtypes)[key]
    names = [x.split()[0] for x in labels.split(", ")]
    parts = [
        df.select(F.col(key).alias("_key"), F.lit(name).alias("_table"), *(F.col(c).alias(f"{name}__{c}") for c in df.columns if c != key))
        for name, df in tables.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    last = -(-options.max_draws // options.batch)  # blocks in all
    schema = f"_key {kind}, {labels}, block long, score double, exceed long, draws long, failed boolean, seconds double"
    run = _blocks(list(tables), names, prepare, options)
    begin, size, state = 0, options.first_round, None
    closed: list[DataFrame] = []
    while begin < last:
        end = min(last, begin + size)
        todo = rows if state is None else rows.join(state.filter("status IS NULL").select("_key").distinct(), "_key", "left_semi")
        each = -(-(end - begin) // options.tasks)
        ranges = F.explode(F.sequence(F.lit(begin).cast("long"), F.lit(end - 1).cast("long"), F.lit(each).cast("long")))
        dealt = todo.withColumns({"_begin": ranges, "_end": F.lit(end).cast("long"), "_each": F.lit(each).cast("long")})
        counts = dealt.groupBy("_key", "_begin").applyInPandas(run, schema)
        found = stage.write(_decide(counts, state, names, end == last, options))
        if state is not None:
            closed.append(state.filter("status IS NOT NULL"))
        state, size = found, end  # as many blocks again as there were
        begin = end
        if begin < last and found.filter("status IS NULL").isEmpty():
            break
    for part in closed:
        state = state.unionByName(part)
    return state.select(F.col("_key").alias(key), *names, "score", "exceed", "draws", "status")


def _decide(counts: DataFrame, before: DataFrame | None, names: list[str], over: bool, options: Draws) -> DataFrame:
    """The counts of each key up to the block that closes it, or to the last one; null status if it stays open."""
    if before is not None:
        earlier = before.filter("status IS NULL").select("_key", *names, F.col("exceed").alias("_e"), F.col("draws").alias("_d"), F.col("seconds").alias("_s"))
        counts = counts.join(earlier, ["_key", *names], "left")
    else:
        counts = counts.withColumns({"_e": F.lit(0).cast("long"), "_d": F.lit(0).cast("long"), "_s": F.lit(0.0)})
    along = Window.partitionBy("_key", *names).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda c, base: F.sum(c).over(along) + F.coalesce(base, F.lit(0))
    rows = counts.withColumns({"exceed": whole("exceed", "_e"), "draws": whole("draws", "_d"), "seconds": whole("seconds", "_s")})
    known = settled(F.col("exceed"), F.col("draws")) < options.threshold
    of_block, of_key = Window.partitionBy("_key", "block"), Window.partitionBy("_key")
    rows = rows.withColumns({"_known": F.bool_and(known).over(of_block), "_failed": F.bool_or("failed").over(of_block)})
    rows = rows.withColumn("_at", F.coalesce(F.min(F.when(F.col("_known") | F.col("_failed"), F.col("block"))).over(of_key), F.max("block").over(of_key)))
    late = F.lit(over) if options.max_seconds is None else F.lit(over) | (F.col("seconds") >= options.max_seconds)
    status = F.when(F.col("_failed"), 2).when(F.col("_known"), 0).when(late, 1)
    return rows.filter(F.col("block") == F.col("_at")).select("_key", *names, "score", "exceed", "draws", status.alias("status"), "seconds")


def _blocks(tables: list[str], names: list[str], prepare: Prepare, options: Draws) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    out = ["_key", *names, "block", "score", "exceed", "draws", "failed", "seconds"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        begin, end = key[1], min(int(pdf["_end"].iat[0]), key[1] + int(pdf["_each"].iat[0]))
        own = {}
        for name in tables:
            part = pdf.loc[pdf["_table"] == name, [c for c in pdf.columns if c.startswith(f"{name}__")]]
            own[name] = part.rename(columns=lambda c: c.partition("__")[2]).reset_index(drop=True)
        labels, observed, add = prepare(key[0], own)
        rows: list[tuple] = []
        for block, exceed, n, seconds in _counted(key[0], range(begin, end), add, len(labels), options):
            failed = exceed is None
            exceed = np.zeros(len(labels), np.int64) if failed else exceed
            rows += [(key[0], *lab, block, s, e, 0 if failed else n, failed, seconds) for lab, s, e in zip(labels, observed, exceed)]
        return pd.DataFrame(rows, columns=out)

    return run


def _counted(name: object, blocks: range, add, size: int, options: Draws) -> Iterator[tuple]:
    """Counts and seconds of each block, until one fails or the time is over."""
    began = time.monotonic()
    for block in blocks:
        start = time.monotonic()
        if block > blocks.start and options.max_seconds is not None and start - began >= options.max_seconds:
            return
        n = min(options.batch, options.max_draws - block * options.batch)
        exceed = add(np.random.default_rng([options.seed, crc32(str(name).encode()), block]), n)
        yield block, exceed, n, time.monotonic() - start
        if exceed is None:
            return
