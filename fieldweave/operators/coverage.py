"""Field coverage over aligned rows, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave import constants as K
from fieldweave.functions.text import cve_year, ratio, stripped, truthy
from fieldweave.operators.align import matches

COUNTERS = ("nvd_nonempty", "matched_ghsa_nonempty", "matched_both_nonempty", "matched_nvd_only", "matched_ghsa_only", "matched_both_empty")


def has_severity(record: Column) -> Column:
    s = record["severity"]
    return F.coalesce(s["score"].cast("string"), s["label"], s["vector"]).isNotNull()


def field_present(record: Column, field: str) -> Column:
    """Whether a record has the field: strings not blank, lists not empty; a null record has none."""
    if field == "severity":
        found = has_severity(record)
    elif field in ("cwe_ids", "references", "affected"):
        found = F.size(record[field]) > 0
    else:
        found = stripped(record[field]) != ""
    return record.isNotNull() & F.coalesce(found, F.lit(False))


def _has(field: str):
    return lambda record: field_present(record, field)


def presence(aligned: DataFrame) -> DataFrame:
    """(year, matched, multi, field, nvd_has, ghsa_has): a row for each aligned row and field."""
    nvd, ghsa = F.col("nvd"), F.col("ghsa")
    entries = [
        F.struct(
            F.lit(name).alias("field"),
            field_present(nvd, f).alias("nvd_has"),
            F.coalesce(F.exists(ghsa, _has(f)), F.lit(False)).alias("ghsa_has"),
        )
        for f, name in K.COVERAGE.items()
    ]
    flags = aligned.select(cve_year(F.col("cve_id")).alias("year"), (F.size("ghsa") > 0).alias("matched"), (F.size("ghsa") > 1).alias("multi"), F.array(*entries).alias("f"))
    return flags.select("year", "matched", "multi", F.inline("f"))


def presence_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """What ``presence`` gives for ``align(left, right)``, from a flag for each field and id of the right side; no record moves."""
    right_flags = [field_present(F.struct(*right.columns), f) for f in K.COVERAGE]
    found = (
        right.where(truthy(F.col("cve_id")))
        .select(F.col("cve_id").alias("_key"), *[v.alias(f"_{i}") for i, v in enumerate(right_flags)])
        .groupBy("_key")
        .agg(F.count("*").alias("_n"), *[F.bool_or(f"_{i}").alias(f"_{i}") for i in range(len(right_flags))])
    )
    left_flags = [field_present(F.struct(*left.columns), f) for f in K.COVERAGE]
    rows = left.select("cve_id", *[v.alias(f"_l{i}") for i, v in enumerate(left_flags)])
    joined = rows.join(found, rows["cve_id"] == found["_key"], "left")
    entries = [F.struct(F.lit(name).alias("field"), F.col(f"_l{i}").alias("nvd_has"), F.coalesce(f"_{i}", F.lit(False)).alias("ghsa_has")) for i, name in enumerate(K.COVERAGE.values())]
    n = F.coalesce("_n", F.lit(0))
    return joined.select(cve_year(F.col("cve_id")).alias("year"), (n > 0).alias("matched"), (n > 1).alias("multi"), F.inline(F.array(*entries)))


def _counts() -> list[Column]:
    m, n, g = F.col("matched"), F.col("nvd_has"), F.col("ghsa_has")
    tests = (n, m & g, m & n & g, m & n & ~g, m & ~n & g, m & ~n & ~g)
    return [F.count_if(t).alias(c) for c, t in zip(COUNTERS, tests, strict=True)]


def field_coverage(present: DataFrame) -> DataFrame:
    """(field, six counters, six rates) of ``presence``; the first rate is over all rows, the others over matched rows."""
    counted = present.groupBy("field").agg(F.count("*").alias("total_rows"), F.count_if("matched").alias("matched_rows"), *_counts())
    return with_rates(counted)


def with_rates(counted: DataFrame) -> DataFrame:
    rates = [ratio(F.col(c), F.col("total_rows" if c == COUNTERS[0] else "matched_rows")).alias(f"{c}_rate") for c in COUNTERS]
    return counted.select("field", *COUNTERS, *rates)


def year_coverage(rows: DataFrame) -> DataFrame:
    """(year, total_rows, matched_rows, matched_rate) of ``align`` or ``counted``, sorted by year."""
    counted = rows.groupBy(cve_year(F.col("cve_id")).alias("year")).agg(F.count("*").alias("total_rows"), F.count_if(matches(rows) > 0).alias("matched_rows"))
    return counted.withColumn("matched_rate", ratio(F.col("matched_rows"), F.col("total_rows"))).orderBy("year")


def summary(aligned: DataFrame) -> dict:
    """All coverage figures as a dictionary, from one scan: partial counts by (year, field)."""
    parts = presence(aligned).groupBy("year", "field").agg(
        F.count("*").alias("total_rows"), F.count_if("matched").alias("matched_rows"), F.count_if("multi").alias("multi_rows"), *_counts()
    )
    rows = parts.collect()  # years times seven fields
    some = next(iter(K.COVERAGE.values()))
    total, matched, multi = (sum(r[c] for r in rows if r["field"] == some) for c in ("total_rows", "matched_rows", "multi_rows"))

    def rate(part: int, whole: int) -> float:
        return round(part / whole, 6) if whole else 0.0

    years = {
        r["year"]: {"total_rows": r["total_rows"], "matched_rows": r["matched_rows"], "matched_rate": rate(r["matched_rows"], r["total_rows"])}
        for r in sorted(rows, key=lambda r: r["year"])
        if r["field"] == some
    }
    fields = {}
    for name in K.COVERAGE.values():
        sums = {c: sum(r[c] for r in rows if r["field"] == name) for c in COUNTERS}
        fields[name] = sums | {f"{c}_rate": rate(v, total if c == COUNTERS[0] else matched) for c, v in sums.items()}
    return {
        "total_rows": total,
        "matched_rows": matched,
        "unmatched_rows": total - matched,
        "matched_rate": rate(matched, total),
        "rows_with_multiple_ghsa": multi,
        "rows_with_multiple_ghsa_rate": rate(multi, matched),
        "year_summary": years,
        "field_coverage": fields,
    }
