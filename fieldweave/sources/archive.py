"""A Python data source that streams a tar.gz: bounded batches, any size, checked to its end in the same reading.

A compressed archive can be read from its start only, so one task unpacks it; it holds a
batch of members at a time and never the archive. What goes wrong, such as a broken or cut-off
archive, is the last row's ``fault``, and the rows before it stand for what could be read.
"""

from __future__ import annotations

import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Members leave the task in batches of about so many bytes.
BATCH_BYTES = 2**22
BROKEN = (tarfile.TarError, EOFError, OSError, zlib.error)
SCHEMA = pa.schema([("path", pa.string()), ("body", pa.string()), ("fault", pa.string())])


def opened(path: str) -> pa.NativeFile:
    """A stream over a file of any system that Arrow opens; a path without a scheme is local."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)
    return system.open_input_stream(place, compression=None, buffer_size=2**20)


class Members(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix, self.bodies = options["path"], options.get("suffix", ""), options.get("bodies", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str | None, str | None]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            paths, bodies, faults = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.string()), pa.array(faults, pa.string())], schema=SCHEMA)

        try:
            with opened(self.path) as stream, tarfile.open(fileobj=stream, mode="r|gz") as tar:
                for member in tar:
                    tar.members.clear()  # else the list of all of them stays
                    if not member.isfile() or not member.name.endswith(self.suffix):
                        continue
                    held.append((member.name, tar.extractfile(member).read().decode() if self.bodies else None, None))
                    size += member.size if self.bodies else len(member.name)
                    if size > BATCH_BYTES:
                        yield batch()
                        held, size = [], 0
                while stream.read(2**20):
                    pass
        except BROKEN as broken:
            held.append((None, None, f"{type(broken).__name__}: {broken}"))
        if held:
            yield batch()


class TarArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_archive"

    def schema(self) -> str:
        return "path string, body string, fault string"

    def reader(self, schema) -> Members:
        return Members(self.options)


def members(spark: SparkSession, path: str, suffix: str = ".json", bodies: bool = True) -> DataFrame:
    """(path, body, fault) of an archive's files whose names end so, and a row for what went wrong."""
    spark.dataSource.register(TarArchive)
    return spark.read.format("tar_archive").option("path", path).option("suffix", suffix).option("bodies", str(bodies).lower()).load()


def reads_whole(spark: SparkSession, path: str, folder: str) -> bool:
    """Whether an archive reads to its end and holds a JSON file below ``folder``; a task walks it, not the driver."""
    told = members(spark, path, bodies=False).agg(F.count_if(F.contains("path", F.lit(folder))).alias("found"), F.count("fault").alias("faults")).first()  # one row
    return told["found"] > 0 and not told["faults"]
