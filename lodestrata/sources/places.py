"""Files that tasks open themselves, by any path that Arrow has a file system for, and a folder shared by the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; on one machine without that setting, below a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:", uri):
        return fs.LocalFileSystem(), unquote(re.sub(r"^file:/+", "/", uri))
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def listed(uri: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path below the folder, size) of its files whose names fit the pattern, sorted; names that begin with . or _ are hidden."""
    files, base = located(uri)
    base = base.rstrip("/")
    out = []
    for info in files.get_file_info(fs.FileSelector(base, recursive=True)):
        name = info.path[len(base) :].lstrip("/")
        parts = name.split("/")
        hidden = parts[-1][0] in "._" or any(p[0] in "._" and "=" not in p for p in parts[:-1])
        if info.type == fs.FileType.File and not hidden and fnmatch(parts[-1], pattern):
            out.append((name, info.size))
    return sorted(out)


def ranges(files: list[tuple[str, int, int]], most: int) -> list[list[tuple[str, int, int]]]:
    """Lists of (name, start, end) of `most` bytes each: large files are cut, small ones put together."""
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for name, start, end in files:
        for at in range(start, end, most):
            part = (name, at, min(at + most, end))
            if part[2] - at > room:
                out.append([])
                room = most
            out[-1].append(part)
            room -= part[2] - at
    return out


def lines(file, start: int, end: int, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end), whatever their length, without the line end."""
    at, skip, rest = max(start - 1, 0), start > 0, []  # the byte before start tells whether a line begins there
    file.seek(at)
    while at < end:
        chunk = file.read(block)
        first, *more = chunk.split(b"\n")
        rest.append(first)
        for part in more if chunk else [b""]:  # a line is whole when the next one begins, or at the file's end
            line, rest = b"".join(rest), [part]
            if skip:
                skip = False
            elif at < end and (chunk or line):
                yield at, line
            at += len(line) + 1
        if not chunk:
            return
