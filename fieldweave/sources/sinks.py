"""Writers: JSON lines with counts, JSON documents, and the coverage report."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldweave import constants as K
from fieldweave.sources.files import write_text


def write_jsonl(df: DataFrame, path: str, compression: str | None = None, **counters: Column) -> dict:
    """Write JSON lines and return ``rows`` and the named aggregates, counted by the write itself; nulls are spelled out.

    ``compression`` names a codec of Spark's JSON writer; readers tell it from the files' names.
    """
    seen = Observation()
    told = [F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counters.items()]]
    df.observe(seen, *told).write.mode("overwrite").option("ignoreNullFields", False).json(path, compression=compression)
    return seen.get


def write_document(spark: SparkSession, content: dict, path: str) -> None:
    """A pretty-printed JSON document, in any file system Spark writes to."""
    write_text(spark, path, json.dumps(content, indent=2, ensure_ascii=False) + "\n")


def statistics(input_path: str, pairs: int, counts: DataFrame) -> dict:
    """Discrepancy statistics from ``status_counts``."""
    fields = {r["field"]: {s: r[s] for s in K.STATUSES} for r in counts.collect()}  # five rows
    return {"input_aligned_path": input_path, "processed_pairs": pairs, "fields": dict(sorted(fields.items()))}


def coverage_markdown(summary: dict) -> str:
    """The coverage summary as Markdown.

    Headings and labels are fixed values, but for the heading of the field table: the first rate of it has all rows
    as its denominator, the others matched rows, and the heading says so.
    """

    def table(head: list[str], rows: list[list[str]]) -> list[str]:
        rule = ["---", *["---:"] * (len(head) - 1)]
        return ["| " + " | ".join(r) + " |" for r in [head, rule, *rows]]

    def pct(x: float) -> str:
        return f"{x:.4%}"

    facts = [
        ("Total aligned rows", summary["total_rows"]),
        ("Matched rows", summary["matched_rows"]),
        ("Unmatched rows", summary["unmatched_rows"]),
        ("Matched rate", pct(summary["matched_rate"])),
        ("Rows with multiple GHSA records", summary["rows_with_multiple_ghsa"]),
        ("Multi-GHSA rate among matched rows", pct(summary["rows_with_multiple_ghsa_rate"])),
    ]
    years = [[y, str(s["total_rows"]), str(s["matched_rows"]), pct(s["matched_rate"])] for y, s in summary["year_summary"].items()]
    order = ("nvd_nonempty", "matched_ghsa_nonempty", "matched_both_nonempty", "matched_nvd_only", "matched_ghsa_only", "matched_both_empty")
    fields = [[f, *[pct(s[f"{c}_rate"]) for c in order]] for f, s in summary["field_coverage"].items()]
    sections = [
        ["# RQ1 Bootstrap Field Coverage"],
        ["## Alignment Coverage"],
        [f"- {name}: {value}" for name, value in facts],
        ["## Matched Rate by CVE Year"],
        table(["Year", "Total", "Matched", "Matched Rate"], years),
        ["## Field Coverage (NVD Non-empty over all rows, the rest over matched rows)"],
        table(["Field", "NVD Non-empty", "GHSA Non-empty", "Both Non-empty", "NVD Only", "GHSA Only", "Both Empty"], fields),
    ]
    return "\n\n".join("\n".join(s) for s in sections) + "\n"
