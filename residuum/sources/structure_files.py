"""Structure files by identifier: a table of ids decides which files are opened."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.sources.opening import system

_LINES = 20_000  # of a file in a batch


def structure_lines(ids: DataFrame, root: str, id_col: str = "pdb", pattern: str = "{middle}/pdb{id}.ent.gz") -> DataFrame:
    """``pdb, n, value``: the lines of ``root/{id[1:3]}/pdb{id}.ent.gz`` for the distinct ids of a table.

    No folder is listed, and no other file is opened. An id without a file has one row with null
    ``n`` and ``value``. The ids are dealt over tasks; a task streams one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pdb in batch["pdb"].to_pylist():
                where, base = system(root)
                path = f"{base.rstrip('/')}/{pattern.format(id=pdb, middle=pdb[1:3])}"
                try:
                    source = where.open_input_stream(path, compression=None)
                except FileNotFoundError:
                    yield _rows(pdb, [None], [None])
                    continue
                with source:
                    lines = gzip.open(source, "rt", errors="replace") if path.endswith(".gz") else (x.decode(errors="replace") for x in _split(source))
                    held: list[str] = []
                    n = 0
                    for line in lines:
                        held.append(line.rstrip("\r\n"))
                        if len(held) == _LINES:
                            yield _rows(pdb, list(range(n, n + _LINES)), held)
                            held, n = [], n + _LINES
                    if held:
                        yield _rows(pdb, list(range(n, n + len(held))), held)

    wanted = ids.select(F.col(id_col).cast("string").alias("pdb")).filter(F.length("pdb") >= 3).distinct().repartition("pdb")
    return wanted.mapInArrow(run, "pdb string, n long, value string")


def _split(source) -> Iterator[bytes]:
    rest = b""
    while block := source.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _rows(pdb: str, n: list, value: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pdb] * len(n)), pa.array(n, pa.int64()), pa.array(value, pa.string())], ["pdb", "n", "value"])


def missing(lines: DataFrame) -> DataFrame:
    """``pdb`` of the ids without a file."""
    return lines.filter("n IS NULL").select("pdb")
