"""Rule variants side by side: ablations of the typing, and stress by missing values, each in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave import constants as K
from fieldweave.operators import compare

#: The fields whose raw values can be held against each other as they are listed.
RAW = {
    "severity": lambda r: r["severity"]["label"],
    "published": lambda r: r["published"],
    "cwe_ids": lambda r: F.array_join(r["cwe_ids"], "|"),
    "references": lambda r: F.array_join(F.transform(r["references"], lambda x: x["url"]), "|"),
}
SAME, DIFFERENT = "same", "different"


def raw_status(left: Column, right: Column) -> Column:
    """Typing without normalization: equal, missing on one side, or a conflict; an empty value is missing."""
    a, b = (F.nullif(x, F.lit("")) for x in (left, right))
    return F.when(a.eqNullSafe(b), K.EQUIVALENT).when(a.isNull() | b.isNull(), K.INCOMPLETE).otherwise(K.CONFLICT)


def typing_ablations(pairs: DataFrame) -> DataFrame:
    """(variant, field, status, pairs): counts under the full rules, without normalization, and as same or different only."""
    told = compare.normalized(compare.tallied(pairs, tuple(RAW)))
    raw = F.lit(None).cast("string")
    for field, value in RAW.items():
        raw = F.when(F.col("field") == field, raw_status(value(F.col("nvd")), value(F.col("ghsa")))).otherwise(raw)
    judged = told.select("field", "n", compare.status_of().alias("_full"), raw.alias("_raw"))
    variants = {"full": F.col("_full"), "no_normalization": F.col("_raw"), "binary": F.when(F.col("_full") == K.EQUIVALENT, SAME).otherwise(DIFFERENT)}
    rows = F.array(*[F.struct(F.lit(variant).alias("variant"), status.alias("status")) for variant, status in variants.items()])
    return judged.select("field", "n", F.inline(rows)).groupBy("variant", "field", "status").agg(F.sum("n").alias("pairs"))


def stress(pairs: DataFrame, share: Column, levels: tuple[int, ...] = (0, 25, 50, 75)) -> DataFrame:
    """(missing, field, pairs, incomplete, conflict): typing of severity, dates and weaknesses as values go missing.

    Each combination of values is compared once for all pairs that have it and lose them at the same level. A pair that loses
    its right values is typed as a comparison with nothing, which depends on the left side alone.
    """
    fields = ("severity", "published", "cwe_ids")
    gone = {
        "severity": F.col("nvd_label").isNull(), "published": F.col("nvd_published").isNull(), "cwe_ids": F.size("nvd_cwe") == 0,
    }
    kept = F.lit(min(levels) - 1)  # the highest level that a pair keeps its values at; one without a share never loses them
    for level in sorted(levels):
        kept = F.when(share.isNull() | (share >= level), level).otherwise(kept)
    lost = F.lit(None).cast("boolean")
    for f in fields:
        lost = F.when(F.col("field") == f, gone[f]).otherwise(lost)
    told = compare.normalized(compare.tallied(pairs.withColumn("_kept", kept), fields, "_kept"))
    judged = told.select("field", "_kept", "n", compare.status_of().alias("_status"), F.when(lost, K.EQUIVALENT).otherwise(K.INCOMPLETE).alias("_gone"))
    rows = F.array(*[F.struct(F.lit(level).alias("missing"), F.when(F.col("_kept") < level, F.col("_gone")).otherwise(F.col("_status")).alias("status")) for level in levels])
    counted = judged.select("field", "n", F.inline(rows)).groupBy("missing", "field")

    def of(status: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0))

    return counted.agg(F.sum("n").alias("pairs"), of(K.INCOMPLETE).alias("incomplete"), of(K.CONFLICT).alias("conflict"))


def official_presence(hosts: Column, official: tuple[str, ...]) -> Column:
    """Whether any host is an official one or below one."""
    return F.coalesce(F.exists(hosts, lambda h: F.exists(F.array(*[F.lit(o) for o in official]), lambda o: (h == o) | h.endswith(F.concat(F.lit("."), o)))), F.lit(False))
