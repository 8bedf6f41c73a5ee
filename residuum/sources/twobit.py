"""The public 2bit genome format as a Spark data source.

``spark.dataSource.register(TwoBit)``, then ``spark.read.format("twobit").load(path)``
gives ``chrom, chunk_id, seq`` with chunks that overlap the next by two bases.
Each task seeks to its own chunks; no task reads the file whole. The path is opened
through the file system that its scheme names (``file``, ``hdfs``, ``s3``, ``gs``).

With the option ``pushdown``, which needs the setting ``spark.sql.python.filterPushdown.enabled``,
filters on ``chrom`` and ``chunk_id`` (equality, membership, order) decide which chunks are read;
the others have no task. :func:`residuum.sources.readers.two_bit` sets both.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from residuum.sources.opening import opened

_SIGNATURE = 0x1A412743  # fixed value of the format
_QUARTETS = ["".join("TCAG"[(byte >> shift) & 3] for shift in (6, 4, 2, 0)) for byte in range(256)]
_OVERLAP = 2


@dataclass
class Chunks(InputPartition):
    name: str
    offset: int
    first: int
    last: int


class TwoBitReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, per_task: int):
        self.path, self.chunk, self.per_task = path, chunk, per_task
        self.chroms: set[str] | None = None
        self.ids: set[int] | None = None
        self.low, self.high = 0, float("inf")  # of chunks, the upper one not included

    def _order(self, f) -> str:
        head = f.read(4)
        for order in "<>":
            if struct.unpack(f"{order}I", head)[0] == _SIGNATURE:
                return order
        raise ValueError("not a 2bit file")

    def _index(self) -> list[tuple[str, int, int]]:
        with opened(self.path) as f:
            order = self._order(f)
            version, count, _ = struct.unpack(f"{order}3I", f.read(12))
            if version:
                raise ValueError(f"unknown version {version}")
            found = []
            for _ in range(count):
                name = f.read(f.read(1)[0]).decode()
                found.append((name, struct.unpack(f"{order}I", f.read(4))[0]))
            out = []
            for name, offset in found:
                if self.chroms is None or name in self.chroms:
                    f.seek(offset)
                    out.append((name, offset, struct.unpack(f"{order}I", f.read(4))[0]))
            return out

    def partitions(self) -> list[Chunks]:
        parts = []
        for name, offset, size in self._index():
            chunks = range(max(0, self.low), int(min(-(-size // self.chunk), self.high)))
            if self.ids is None:
                parts += [Chunks(name, offset, b, min(b + self.per_task, chunks.stop)) for b in chunks[:: self.per_task]]
            else:
                parts += [Chunks(name, offset, k, k + 1) for k in sorted(k for k in self.ids if k in chunks)]
        return parts or [Chunks("", 0, 0, 0)]  # a task without chunks

    def read(self, part: Chunks) -> Iterator[tuple[str, int, str]]:
        if part.first >= part.last:
            return
        with opened(self.path) as f:
            order = self._order(f)
            f.seek(part.offset)
            one = lambda: struct.unpack(f"{order}I", f.read(4))[0]
            many = lambda n: struct.unpack(f"{order}{n}I", f.read(4 * n))
            size = one()
            blocks = []
            for _ in range(2):  # unknown bases, then lower case; both in order of their starts
                n = one()
                starts = many(n)
                blocks.append((starts, many(n)))
            one()
            base = f.tell()
            for k in range(part.first, part.last):
                begin, end = k * self.chunk, min(size, (k + 1) * self.chunk + _OVERLAP)
                f.seek(base + begin // 4)
                raw = f.read(-(-end // 4) - begin // 4)
                seq = "".join([_QUARTETS[x] for x in raw])[begin % 4 :][: end - begin]
                for table, change in zip(blocks, (lambda s: "N" * len(s), str.lower)):
                    for s, n in _touching(*table, begin, end):
                        b, e = max(s, begin) - begin, min(s + n, end) - begin
                        seq = seq[:b] + change(seq[b:e]) + seq[e:]
                yield part.name, k, seq


class FilteredTwoBitReader(TwoBitReader):
    """Takes filters on ``chrom`` and ``chunk_id``; Spark refuses such readers where the setting for it is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        column = getattr(f, "attribute", None)
        if isinstance(f, (EqualTo, In)) and column in (("chrom",), ("chunk_id",)):
            wanted = set(f.value) if isinstance(f, In) else {f.value}
            name = "chroms" if column == ("chrom",) else "ids"
            known = getattr(self, name)
            setattr(self, name, wanted if known is None else known & wanted)
            return True
        if column == ("chunk_id",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            return True
        if column == ("chunk_id",) and isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            return True
        return False


def _touching(starts: tuple[int, ...], sizes: tuple[int, ...], begin: int, end: int) -> Iterator[tuple[int, int]]:
    """The blocks, which do not overlap, that hold a base of ``[begin, end)``."""
    at = max(0, bisect_right(starts, begin) - 1)
    while at < len(starts) and starts[at] < end:
        if starts[at] + sizes[at] > begin:
            yield starts[at], sizes[at]
        at += 1


class TwoBit(DataSource):
    """Options: ``path``; ``chunk`` (65536) bases a row; ``per_task`` (64) rows a task; ``pushdown`` (false) of filters."""

    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self) -> str:
        return "chrom string, chunk_id long, seq string"

    def reader(self, schema) -> TwoBitReader:
        get = self.options.get
        kind = FilteredTwoBitReader if get("pushdown", "false").lower() == "true" else TwoBitReader
        return kind(self.options["path"], int(get("chunk", 65536)), int(get("per_task", 64)))
