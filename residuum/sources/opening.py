"""Files opened by tasks, wherever they lie."""

from __future__ import annotations

import pyarrow.fs as fs


def system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is a folder that all nodes mount."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A file for reading at any place."""
    where, inner = system(path)
    return where.open_input_file(inner)
