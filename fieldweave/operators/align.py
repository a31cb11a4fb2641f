"""Alignment of two record tables by CVE id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.text import cve_year, truthy


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """(cve_id, nvd, ghsa): each left record with all right records of its id, in path order.

    A left outer join: unmatched left rows have an empty list, unmatched right
    rows are dropped, null and empty ids match nothing, repeated left ids each
    give a row. The right side is grouped once and only holds rows that can
    match; the planner picks the join by the sizes it sees.
    """
    record = F.struct(*left.columns)
    kind = right.select(F.struct(*right.columns).alias("r")).schema["r"].dataType.simpleString()
    order = F.struct(F.col("source_specific.relative_path").alias("p"), F.col("source_id").alias("i"), F.struct(*right.columns).alias("r"))
    grouped = right.where(truthy(F.col("cve_id"))).groupBy(F.col("cve_id").alias("_key")).agg(F.sort_array(F.collect_list(order)).alias("found"))
    lists = grouped.select("_key", F.transform("found", lambda x: x["r"]).alias("ghsa"))
    rows = left.select(F.col("cve_id"), record.alias("nvd"))
    joined = rows.join(lists, rows["cve_id"] == lists["_key"], "left")
    return joined.select("cve_id", "nvd", F.coalesce("ghsa", F.array().cast(f"array<{kind}>")).alias("ghsa"))


def counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """(cve_id, n): each left record with how many right records its id has; no record moves."""
    found = right.where(truthy(F.col("cve_id"))).groupBy(F.col("cve_id").alias("_key")).agg(F.count("*").alias("n"))
    rows = left.select("cve_id")
    return rows.join(found, rows["cve_id"] == found["_key"], "left").select("cve_id", F.coalesce("n", F.lit(0)).alias("n"))


def one_to_one_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """What ``one_to_one`` gives for ``align(left, right)``, without lists: ids of one right record, each with that record."""
    single = right.where(truthy(F.col("cve_id"))).groupBy(F.col("cve_id").alias("_key")).agg(F.count("*").alias("_n"), F.any_value(F.struct(*right.columns)).alias("ghsa")).where("_n = 1")
    rows = left.select(F.col("cve_id"), F.struct(*left.columns).alias("nvd"))
    return rows.join(single, rows["cve_id"] == single["_key"]).select("cve_id", "nvd", "ghsa")


def one_to_one(aligned: DataFrame) -> DataFrame:
    """(cve_id, nvd, ghsa record) of the rows with exactly one right record."""
    return aligned.where(F.size("ghsa") == 1).select("cve_id", "nvd", F.get("ghsa", F.lit(0)).alias("ghsa"))


def matches(rows: DataFrame) -> Column:
    """How many right records a row of ``align`` or ``counted`` has."""
    return F.col("n") if "n" in rows.columns else F.size("ghsa")


def match_counts(rows: DataFrame) -> DataFrame:
    """One row: total, matched and multiply matched rows of ``align`` or ``counted``."""
    n = matches(rows)
    return rows.agg(F.count("*").alias("total_rows"), F.count_if(n > 0).alias("matched_rows"), F.count_if(n > 1).alias("multi_rows"))


def year_counts(rows: DataFrame) -> DataFrame:
    """(year, total_rows, matched_rows) of ``align`` or ``counted``, by the year in the id."""
    year = F.coalesce(cve_year(F.col("cve_id")), F.lit("unknown"))
    return rows.groupBy(year.alias("year")).agg(F.count("*").alias("total_rows"), F.count_if(matches(rows) > 0).alias("matched_rows"))
