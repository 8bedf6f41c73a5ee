"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections import ChainMap
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WHITE = " \t\n\v\f\r"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
NO_ID = 1 << 62  # keys from here on stand for rows without an identifier of their own


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset in
    local mode, as in tests, a folder under the system's temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "residuum-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scopes: list[list[Staged]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete all tables staged inside when done; what is returned from them must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for staged in _scopes.pop():
            staged.delete(staged.root)


class Staged:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        for scope in _scopes:
            scope.append(self)

    def write(self, df: DataFrame, batch_rows: int | None = None) -> DataFrame:
        """Write a table and read it; Spark deletes the shuffle files behind it at once.

        :param batch_rows: rows of an Arrow batch, for tables of wide rows.
        """
        path = f"{self.root}/{self.count}"
        self.count += 1
        wanted = {_CLEAN_UP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        self.delete(df.staged_path)

    def delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, id_col: str, text_col: str, staged: Staged) -> tuple[DataFrame, bool]:
    """``doc_id, own, text`` with a key ``doc_id`` for every row, and whether it differs from the identifier ``own`` anywhere.

    The key is the identifier where that stands for one row. Rows without one, or
    with one that others have too, get a key beyond all identifiers from the hash
    of identifier and text, so that rows repeated entire share it and others do not.
    """
    rows = docs.select(docs[id_col].cast("long").alias("own"), docs[text_col].alias("text"))
    name = F.coalesce(F.col("own").cast("string"), F.lit("none")).alias("name")
    many = F.count("*") > 1
    odd = rows.groupBy("own").agg(many.alias("many")).filter(f"many OR own IS NULL OR own >= {NO_ID}")
    odd = staged.write(odd.select(name, F.lit(True).alias("odd")))
    if odd.isEmpty():
        return rows.select(F.col("own").alias("doc_id"), "own", "text"), False
    few = is_few(odd, 100_000)
    marked = rows.withColumn("name", name).join(F.broadcast(odd) if few else odd, "name", "left")
    hashed = F.xxhash64(F.lit("key"), "own", "text").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    return marked.select(F.when(F.col("odd"), hashed).otherwise(F.col("own")).alias("doc_id"), "own", "text"), True


def is_few(rows: DataFrame, limit: int) -> bool:
    return rows.limit(limit + 1).count() <= limit


def _with_keys(docs: DataFrame, keys: dict[str, Column]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with key columns under names that it does not have."""
    names = {}
    for key in keys:
        name = f"_{key}"
        while name in docs.columns or name in names.values():
            name += "_"
        names[key] = name
    return docs.select("*", *(c.alias(names[k]) for k, c in keys.items())), names


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column], broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are not in ``gone``, which has columns named like them.

    Few keys are broadcast; many are joined by a shuffle, where AQE splits a hot key.
    """
    rows, names = _with_keys(docs, keys)
    gone = gone.select(*(F.col(k).alias(n) for k, n in names.items()))
    few = is_few(gone, broadcast_rows)
    return rows.join(F.broadcast(gone) if few else gone, list(names.values()), "left_anti").select(_columns(docs))


def one_of_each(docs: DataFrame, repeated: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` with one row of those that share ``keys`` that are in ``repeated``; all others stay.

    A hot key is reduced before the shuffle.
    """
    if repeated.isEmpty():
        return docs
    rows, names = _with_keys(docs, keys)
    again = repeated.select(*(F.col(k).alias(n) for k, n in names.items()))
    among = rows.join(F.broadcast(again) if is_few(again, 200_000) else again, list(names.values()), "left_semi")
    first = among.groupBy(*names.values()).agg(F.first(F.struct(_columns(docs))).alias("row"))
    return without(docs, repeated, keys).unionByName(first.select("row.*"))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(releasing(run), schema)


def release() -> None:
    """Give memory that a task has freed back to the system, so that the worker's next task, and others, have it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over the batches of a task, then :func:`release`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def text_bytes(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def count_white(text: str) -> int:
    return sum(map(text.count, _WHITE))


class BoundedCache:
    """Values of words by a function of many words, in two generations.

    A word met again moves to the young generation; when that is full, the old
    one goes. So common words stay, and memory is bounded: a word takes a place
    for every ``_PLACE`` characters, and words of over ``_LONGEST`` characters are
    not kept at all.
    """

    _PLACE, _LONGEST = 32, 256

    def __init__(self, limit: int, make: Callable[[list], list]):
        self.limit, self.make = limit, make
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def clear(self, keep: int = 0) -> None:
        """Forget words at the end of a task, so that the worker's next task has the memory; all but ``keep`` of those met first, which are the common ones."""
        self.young = dict(islice(chain(self.young.items(), self.old.items()), keep))
        self.old, self.held = {}, len(self.young) + sum(map(len, self.young)) // self._PLACE

    def look_up(self, wanted: set) -> Mapping:
        """A mapping that holds every wanted word."""
        if self.held + len(wanted) > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        absent = wanted.difference(young)
        again = [w for w in absent if w in old]
        young.update(zip(again, map(old.__getitem__, again)))
        absent.difference_update(again)
        longer = [w for w in absent if len(w) > self._LONGEST]
        absent.difference_update(longer)
        missing = list(absent)
        young.update(zip(missing, self.make(missing)))
        for words in (again, missing):
            self.held += len(words) + sum(map(len, words)) // self._PLACE
        return ChainMap(dict(zip(longer, self.make(longer))), young) if longer else young

    def held_of(self, words: Iterable) -> dict:
        """Those of ``words`` that are in either generation."""
        young, old = self.young, self.old
        return {w: v for w in words if (v := young.get(w) or old.get(w)) is not None}

    def keep(self, values: dict) -> None:
        """Words that ``make`` met on its way."""
        self.young.update((w, v) for w, v in values.items() if len(w) <= self._LONGEST)
        self.held += len(values) + sum(map(len, values)) // self._PLACE


def slices(texts: list[str | None], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters, one text at least."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
