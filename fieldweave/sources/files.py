"""Small files in any file system that Spark reads: through Hadoop's client, from the driver."""

from __future__ import annotations

import io

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str, folder: bool = False) -> bool:
    system, place = _at(spark, path)
    return system.exists(place) and (not folder or system.getFileStatus(place).isDirectory())


class _Stream(io.RawIOBase):
    """A Hadoop input stream as a Python file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        system, place = _at(spark, path)
        self._in = system.open(place)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self._in.readNBytes(len(buffer))
        buffer[: len(got)] = got
        return len(got)

    def close(self) -> None:
        if not self.closed:
            self._in.close()
        super().close()


def opened(spark: SparkSession, path: str) -> io.BufferedReader:
    return io.BufferedReader(_Stream(spark, path), 2**20)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """Write a small text, replacing what was there; missing folders are made."""
    system, place = _at(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
