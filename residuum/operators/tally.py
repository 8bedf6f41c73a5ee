"""Counts of rows at the steps of a job, taken in passing by the action that runs it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Tally:
    """Observed numbers of rows by step, in the order in which the steps were named."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def at(self, df: DataFrame, step: str, only: Column | None = None) -> DataFrame:
        """``df``, its rows (those where ``only`` holds, if given) counted as ``step`` whenever it is computed."""
        self._seen[step] = Observation(step)
        return df.observe(self._seen[step], (F.count(F.lit(1)) if only is None else F.count_if(only)).alias("n"))

    def counts(self) -> dict[str, int]:
        """The rows of each step; an action must have run through all of them."""
        return {step: seen.get["n"] for step, seen in self._seen.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """``step, n, dropped``: rows that reached a step, and those that the step before had more."""
        found = self.counts()
        before = [None, *found.values()]
        rows = [(step, n, None if b is None else b - n) for (step, n), b in zip(found.items(), before)]
        return spark.createDataFrame(rows, "step string, n long, dropped long")


def counted(tally: Tally | None, df: DataFrame, step: str, only: Column | None = None) -> DataFrame:
    return df if tally is None else tally.at(df, step, only)
