"""Readers of raw feeds and advisory trees, plain or archived. Schemas are given, never inferred."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave import constants as K
from fieldweave.operators.normalize import node_type, nvd_records, too_deep
from fieldweave.schemas import ADVISORY, ALIGNED, NODE_DEPTH, RECORD, cve_type, feed_type
from fieldweave.sources import archive
from fieldweave.sources.files import exists
from fieldweave.staging import cut

def feed_files(spark: SparkSession, raw_dir: str, pattern: str = "nvdcve-2.0-*.json*") -> list[str]:
    """One feed file a year, in year order; plain JSON goes before zip, then the smaller name."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(raw_dir).select("path")
    rows = choose_files(listing).orderBy("year").collect()  # one a year
    if not rows:
        raise FileNotFoundError(f"no feed file matches {pattern} in {raw_dir}")
    return [r["path"] for r in rows]


def choose_files(listing: DataFrame) -> DataFrame:
    """(year, path): of the files of a year, plain JSON before zip, then by path."""
    name = F.element_at(F.split("path", "/"), -1)
    year = F.get(F.split(F.get(F.split(name, "-"), F.lit(2)), r"\."), F.lit(0))
    first = Window.partitionBy("year").orderBy(F.col("path").endswith(".zip"), "path")
    ranked = listing.select("path", year.alias("year")).withColumn("n", F.row_number().over(first))
    return ranked.where((F.col("n") == 1) & F.col("year").isNotNull()).select("year", "path")


def read_feed(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file_name, cve) of plain and zipped feed documents; malformed documents fail the read.

    Configuration nodes are read to any depth: while some lie deeper than the
    schema goes, it is doubled. That takes a scan of the feed each time.
    """
    depth = NODE_DEPTH
    while True:
        rows = _read_feed(spark, files, depth)
        if rows.where(too_deep(F.col("cve.configurations"), node_type(rows))).isEmpty():
            return rows
        depth *= 2


def write_feed_records(spark: SparkSession, files: list[str], path: str) -> dict[str, int]:
    """Write the normalized records of a feed as Parquet; returns how many each year's file gave.

    The write itself counts, and notices nodes below the schema's depth: only then the
    schema is doubled and the feed parsed again. Otherwise it is parsed once.
    """
    years = {f.rsplit("/", 1)[-1]: f for f in files}
    depth = NODE_DEPTH
    while True:
        rows, seen = _read_feed(spark, files, depth), Observation()
        told = [F.count_if(F.col("file_name") == name).alias(name) for name in years]
        deep = F.coalesce(F.bool_or(too_deep(F.col("cve.configurations"), node_type(rows))), F.lit(False)).alias("_too_deep")
        nvd_records(rows.observe(seen, deep, *told)).write.mode("overwrite").parquet(path)
        if not seen.get["_too_deep"]:
            break
        depth *= 2
    counts: dict[str, int] = {}
    for name in years:
        if seen.get[name]:
            year = name.split("-")[2].split(".")[0]
            counts[year] = counts.get(year, 0) + seen.get[name]
    return dict(sorted(counts.items()))


def _read_feed(spark: SparkSession, files: list[str], depth: int) -> DataFrame:
    plain, zipped = [f for f in files if not f.endswith(".zip")], [f for f in files if f.endswith(".zip")]
    parts = []
    if plain:
        docs = spark.read.schema(feed_type(depth)).option("multiLine", True).option("mode", "FAILFAST").json(plain)
        parts.append(docs.select(F.col("_metadata.file_name").alias("file_name"), F.explode("vulnerabilities.cve").alias("cve")))
    if zipped:
        held = spark.read.format("binaryFile").load(zipped).select(F.col("path"), "content")
        rows = held.mapInArrow(_unzipped, "file_name string, body string").repartition("file_name", "body")
        parts.append(rows.select("file_name", F.from_json("body", f"struct<cve: {cve_type(depth)}>", {"mode": "FAILFAST"})["cve"].alias("cve")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("cve").isNotNull())


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as zipped:
                for member in zipped.namelist():
                    with zipped.open(member) as stream:
                        found = members_of(io.TextIOWrapper(stream, "utf-8"), "vulnerabilities")
                        while body := list(islice(found, 1000)):
                            yield pa.RecordBatch.from_pydict({"file_name": [path.rsplit("/", 1)[-1]] * len(body), "body": body})


def members_of(stream: io.TextIOBase, name: str, chunk: int = 2**20) -> Iterator[str]:
    """The members of the list at ``name`` of a JSON object, each as its own text; what is no JSON fails.

    The stream is read piece by piece: no more is held than the piece and the member that crosses its end.
    """
    decode, white = json.JSONDecoder().raw_decode, " \t\n\r"
    held, at, ended = "", 0, False

    def more() -> None:
        nonlocal held, at, ended
        piece = stream.read(max(chunk, len(held) - at))  # in growing steps, so that a long member is not tried too often
        held, at, ended = held[at:] + piece, 0, not piece

    def mark(of: str) -> str:
        """Take the next character, which is one of these."""
        nonlocal at
        while True:
            while at < len(held) and held[at] in white:
                at += 1
            if at < len(held):
                break
            if ended:
                raise ValueError(f"the document ends where one of {of} is expected")
            more()
        if held[at] not in of:
            raise ValueError(f"{held[at]!r} stands where one of {of} is expected")
        at += 1
        return held[at - 1]

    def peek(of: str) -> bool:
        nonlocal at
        mark("".join(map(chr, range(32, 127))))
        at -= 1
        return held[at] in of

    def value():
        """The next value and its text."""
        nonlocal at
        peek("")
        while True:
            try:
                found, end = decode(held, at)
                if end < len(held) or ended:  # a number may go on
                    text, at = held[at:end], end
                    return found, text
            except json.JSONDecodeError:
                if ended:
                    raise
            more()

    mark("{")
    if peek("}"):
        return
    while True:
        key = value()[0]
        mark(":")
        if key == name and peek("["):
            mark("[")
            if peek("]"):
                mark("]")
            else:
                while True:
                    yield value()[1]
                    if mark(",]") == "]":
                        break
        else:
            value()
        if mark(",}") == "}":
            return


def wanted_prefixes(include_unreviewed: bool) -> list[str]:
    return [K.REVIEWED_PREFIX, *([K.UNREVIEWED_PREFIX] if include_unreviewed else [])]


def read_advisory_tree(spark: SparkSession, root: str, include_unreviewed: bool = False) -> DataFrame:
    """Advisories below ``root``, with ``relative_path``; only the wanted folders are listed."""
    folders = [f"{root.rstrip('/')}/{p}" for p in wanted_prefixes(include_unreviewed)]
    folders = [f for f in folders if exists(spark, f)]
    if not folders:
        raise FileNotFoundError(f"no advisory folder below {root}")
    read = spark.read.schema(ADVISORY).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    rows = read.json(folders)
    return rows.withColumn("relative_path", F.regexp_extract(F.col("_metadata.file_path"), r"(?:^|/)(advisories/.*)$", 1))


def read_advisory_archive(spark: SparkSession, path: str, include_unreviewed: bool = False) -> DataFrame:
    """Advisories of a tar.gz of any size whose members stand below one root folder; a broken one is a FileNotFoundError.

    One task streams the archive, in bounded batches, to a checkpoint, which tells whether it read to its end;
    parsing is spread out from there.
    """
    prefixes = wanted_prefixes(include_unreviewed)
    relative = F.substring("path", F.instr("path", F.lit("/")) + 1, 2**31 - 1)
    wanted = F.lit(False)
    for prefix in prefixes:
        wanted = wanted | F.col("relative_path").startswith(prefix)
    held = archive.members(spark, path).select(relative.alias("relative_path"), "body", "fault")
    rows = cut(held.where(wanted | F.col("fault").isNotNull()).repartition("relative_path"))
    told = rows.agg(F.count("relative_path").alias("members"), F.first("fault", ignorenulls=True).alias("fault")).first()  # one row
    if told["fault"] or not told["members"]:
        raise FileNotFoundError(f"{path} is no advisory archive: {told['fault'] or 'no advisory in it'}")
    parsed = rows.select("relative_path", F.from_json("body", f"struct<{_typed(ADVISORY)}>", {"mode": "FAILFAST"}).alias("a"))
    return parsed.select("a.*", "relative_path")


def _typed(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def read_advisories(spark: SparkSession, tree: str | None, archive_path: str | None, include_unreviewed: bool = False) -> DataFrame:
    """The tree if it is valid, else the archive."""
    if tree and is_valid_tree(spark, tree):
        return read_advisory_tree(spark, tree, include_unreviewed)
    if archive_path and exists(spark, archive_path):
        return read_advisory_archive(spark, archive_path, include_unreviewed)
    raise FileNotFoundError("no valid advisory folder or archive")


def is_valid_tree(spark: SparkSession, root: str) -> bool:
    """Whether there is a folder of advisories below ``root``, in any file system Spark reads."""
    return exists(spark, f"{root.rstrip('/')}/advisories", folder=True)


def is_valid_archive(spark: SparkSession, path: str, folder: str = "/advisories/") -> bool:
    """Whether a tar.gz reads to its end and holds a JSON file below ``folder``."""
    return exists(spark, path) and archive.reads_whole(spark, path, folder)


def extract_archive(path: str, target: str) -> Path:
    """Unpack a tar.gz that has exactly one root folder; that folder's content replaces ``target``."""
    import shutil
    import tempfile

    with tempfile.TemporaryDirectory(dir=Path(target).parent) as scratch:
        with tarfile.open(path, "r:gz") as tar:
            tar.extractall(scratch, filter="data")
        roots = list(Path(scratch).iterdir())
        if len(roots) != 1:
            raise ValueError(f"{path} has {len(roots)} root entries")
        shutil.rmtree(target, ignore_errors=True)
        shutil.move(roots[0], target)
    return Path(target)


def feed_year_counts(feed: DataFrame) -> DataFrame:
    """(year, records) by the year in the file's name."""
    year = F.get(F.split(F.get(F.split("file_name", "-"), F.lit(2)), r"\."), F.lit(0))
    return feed.groupBy(year.alias("year")).agg(F.count("*").alias("records")).orderBy("year")


def advisory_year_counts(records: DataFrame) -> DataFrame:
    """(year, records) by the third part of the path, where there is one."""
    parts = F.split("source_specific.relative_path", "/")
    return records.where(F.size(parts) >= 3).groupBy(F.get(parts, F.lit(2)).alias("year")).agg(F.count("*").alias("records")).orderBy("year")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Normalized records from JSON lines."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """Aligned rows from JSON lines."""
    return spark.read.schema(ALIGNED).option("mode", "FAILFAST").json(path)
