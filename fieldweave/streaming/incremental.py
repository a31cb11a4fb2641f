"""Incremental ingestion: advisory files that arrive become normalized records.

An addition to the batch jobs: the same projections over a file stream, with
exactly-once appends by Spark's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldweave.operators.normalize import ghsa_records
from fieldweave.schemas import ADVISORY


def advisory_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Normalized records of advisory files as they appear below ``folder``."""
    read = spark.readStream.schema(ADVISORY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_trigger)
    rows = read.json(folder)
    return ghsa_records(rows.withColumn("relative_path", F.regexp_extract(F.col("_metadata.file_path"), r"(?:^|/)(advisories/.*)$", 1)))


def append_records(records: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of records to a Parquet folder; stops once all files present are in."""
    return records.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
