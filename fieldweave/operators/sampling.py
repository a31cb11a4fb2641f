"""Samples for annotation: the same rows at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bottom_k(rows: DataFrame, strata: list[str], k: int, identity: list[str], seed: str = "0") -> DataFrame:
    """The ``k`` rows of each stratum whose hashes of seed and identity are least, with ``place`` from 1.

    The hash depends on nothing but the row's identity, so neither order nor partitioning of
    the input changes the sample. Tasks pass on their own k least of each stratum, so a stratum of any size
    comes to one task as k rows a task. Rows of one identity have one hash and stand in the order of all columns.
    Nulls in the identity count as empty; null strata are strata.
    """
    told = F.concat_ws("/", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])
    hashed = rows.withColumn("_hash", F.md5(told))
    least = Window.partitionBy(*strata).orderBy("_hash", *rows.columns)
    return hashed.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k).drop("_hash")


def long_statuses(statuses: dict[str, Column], keys: list[str], pairs: DataFrame) -> DataFrame:
    """(keys, field, status): a row for each field of each pair."""
    return pairs.select(*keys, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), s.alias("status")) for f, s in statuses.items()])))
