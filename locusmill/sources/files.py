"""Single files on the driver's side, in any file system that Spark knows: written as streams, and read at their heads."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Characters that are gathered before they are written.
BUFFER = 1 << 20


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class Text:
    """A text file that is written piece by piece."""

    def __init__(self, put) -> None:
        self.put, self.held, self.size = put, [], 0

    def write(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text)
        if self.size >= BUFFER:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.put("".join(self.held))
            self.held, self.size = [], 0


@contextmanager
def text_file(spark: SparkSession, path: str) -> Iterator[Text]:
    """A new text file; a path with a scheme is that file system's, others are the driver's."""
    if "://" in path:
        fs, where = _hadoop(spark, path)
        out = fs.create(where, True)
        put = lambda text: out.write(bytearray(text.encode()))
    else:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        out = open(path, "w")
        put = out.write
    try:
        f = Text(put)
        yield f
        f.flush()
    finally:
        out.close()


def head(spark: SparkSession | None, path: str, most: int) -> bytes:
    """A file's first bytes."""
    if "://" not in path or spark is None:
        with open(path.removeprefix("file://"), "rb") as f:
            return f.read(most)
    fs, where = _hadoop(spark, path)
    size = min(most, fs.getFileStatus(where).getLen())
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()
