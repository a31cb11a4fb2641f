"""Field comparators: ordered decision ladders over normalized columns.

A comparator takes columns of the two sides and returns a struct with
``status``, ``note``, ``step`` and its own optional fields; a field that does
not apply is null. The first condition that holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave import constants as K
from fieldweave.functions import dates, text, urls, versions


def ladder(*steps: tuple[Column | None, str, str]) -> tuple[Column, Column]:
    """(status, note) of the first step whose condition is true; a null condition always holds."""

    def chain(pick: int) -> Column:
        out = None
        for step in steps:
            value = F.lit(step[pick])
            if step[0] is None:
                return value if out is None else out.otherwise(value)
            out = F.when(step[0], value) if out is None else out.when(step[0], value)
        return out

    return chain(1), chain(2)


def _missing(a: Column, b: Column) -> list[tuple[Column, str, str]]:
    return [(a & b, K.EQUIVALENT, K.BOTH_MISSING), (a | b, K.INCOMPLETE, K.ONE_MISSING)]


def _empty(values: Column) -> Column:
    return values.isNull() | (F.size(values) == 0)


def _result(steps, **fields: Column) -> Column:
    status, note = ladder(*steps)
    return F.struct(status.alias("status"), note.alias("note"), *[v.alias(k) for k, v in fields.items()])


def severity(left: Column, right: Column) -> Column:
    """Compare raw labels; an empty label is a value."""
    a, b = (text.canonical_severity(x, K.SEVERITY) for x in (left, right))
    known = a.isNotNull() & b.isNotNull()

    def rank(label: Column) -> Column:
        out = F.lit(None).cast("int")
        for word, place in K.SEVERITY_RANK.items():
            out = F.when(label == word, place).otherwise(out)
        return out

    steps = [
        *_missing(left.isNull(), right.isNull()),
        (known & (a == b) & (F.upper(left) == F.upper(right)), K.EQUIVALENT, K.SAME_LABEL),
        (known & (a == b), K.REPRESENTATION, K.SAME_CANONICAL_LABEL),
        (known, K.CONFLICT, K.DIFFERENT_LABELS),
        (None, K.REPRESENTATION, K.ODD_LABELS),
    ]
    distance = F.when(known & (a != b), F.abs(rank(a) - rank(b)))
    return _result(steps, nvd_value=left, ghsa_value=right, nvd_normalized=a, ghsa_normalized=b, rank_distance=distance)


def published(left: Column, right: Column, a: Column, b: Column) -> Column:
    """Compare instants ``a`` and ``b``, then their UTC dates, then raw strings."""
    parsed = a.isNotNull() & b.isNotNull()
    steps = [
        *_missing(left.isNull(), right.isNull()),
        (parsed & (a == b), K.EQUIVALENT, K.SAME_TIME),
        (parsed & (F.to_date(a) == F.to_date(b)), K.REPRESENTATION, K.SAME_DATE),
        (parsed, K.TEMPORAL, K.DIFFERENT_DATES),
        (text.normalize_text(left).eqNullSafe(text.normalize_text(right)), K.REPRESENTATION, K.SAME_RAW_TIME),
        (None, K.CONFLICT, K.ODD_TIMES),
    ]
    return _result(steps, nvd_value=left, ghsa_value=right, day_diff=F.when(parsed, dates.day_difference(a, b)))


def set_field(left: Column, right: Column, *, overlap: str, conflict_note: str) -> Column:
    """Compare canonical sets."""
    subset = text.is_subset(left, right) | text.is_subset(right, left)
    meets = F.arrays_overlap(left, right)
    steps = [
        *_missing(_empty(left), _empty(right)),
        (left == right, K.EQUIVALENT, K.SAME_SET),
        (subset, K.INCOMPLETE, K.SUBSET),
        (meets, overlap, K.OVERLAP),
        (None, K.CONFLICT, conflict_note),
    ]
    differs = ~_empty(left) & ~_empty(right) & (left != right) & (subset | meets)
    return _result(steps, nvd_value=left, ghsa_value=right, shared_values=F.when(differs, text.shared(left, right)))


def references(left: Column, right: Column, left_hosts: Column, right_hosts: Column, left_raw: Column, right_raw: Column) -> Column:
    """Compare canonical URL sets and hosts; ``*_raw`` count the references as listed."""
    repeats = (left_raw != F.size(left)) | (right_raw != F.size(right))
    subset = text.is_subset(left, right) | text.is_subset(right, left)
    meets = F.arrays_overlap(left_hosts, right_hosts) | F.arrays_overlap(left, right)
    steps = [
        *_missing(_empty(left), _empty(right)),
        ((left == right) & repeats, K.REPRESENTATION, K.SAME_URLS_DEDUPED),
        (left == right, K.EQUIVALENT, K.SAME_URLS),
        (subset, K.INCOMPLETE, K.URL_SUBSET),
        (meets, K.REPRESENTATION, K.URL_OVERLAP),
        (None, K.CONFLICT, K.URL_DISJOINT),
    ]
    differs = ~_empty(left) & ~_empty(right) & (left != right) & (subset | meets)
    return _result(steps, nvd_value=left, ghsa_value=right, nvd_hosts=left_hosts, ghsa_hosts=right_hosts, shared_values=F.when(differs, text.shared(left, right)))


def affected_versions(left: Column, right: Column, left_effective: Column, right_effective: Column) -> Column:
    """Compare canonical spans; the later steps are directed from left to right."""
    subset = text.is_subset(left_effective, right_effective) | text.is_subset(right_effective, left_effective)
    ends_in = versions.bound_set(left, lambda s: s["version_end_including"])
    ends_out = versions.bound_set(right, versions.upper_excluding)
    left_out = versions.bound_set(left, lambda s: s["version_end_excluding"])
    unversioned = ~F.exists(left, lambda s: s["version"].isNotNull())
    bordered = (F.size(ends_in) > 0) & (F.size(ends_out) > 0) & unversioned & versions.share_major_minor(ends_in, ends_out)
    same_effective = text.is_subset(left_effective, right_effective) & text.is_subset(right_effective, left_effective)
    steps = [
        *_missing(_empty(left), _empty(right)),
        (left == right, K.EQUIVALENT, K.SAME_SPANS),
        (same_effective, K.REPRESENTATION, K.SAME_EFFECTIVE),
        (subset, K.INCOMPLETE, K.SPAN_SUBSET),
        (F.arrays_overlap(versions.endpoints(left_effective), versions.endpoints(right_effective)), K.REPRESENTATION, K.SHARED_ENDPOINT),
        (bordered, K.REPRESENTATION, K.SHARED_PREFIX),
        (versions.points_covered(left, right), K.REPRESENTATION, K.POINTS_COVERED),
        (text.any_prefix_pair(left_out, ends_out), K.REPRESENTATION, K.TRUNCATED),
        (F.exists(left_out, text.date_like), K.REPRESENTATION, K.DATE_VERSION),
        (None, K.CONFLICT, K.SPAN_CONFLICT),
    ]
    return _result(steps, nvd_value=left, ghsa_value=right)


def needed(records: DataFrame) -> DataFrame:
    """Records as far as ``statuses`` reads them: what a shuffle before it has to move."""
    spans = F.transform("affected", lambda a: F.struct(*[a[f].alias(f) for f in (*versions.SPAN, "package_name", "product")]))
    urls_of = F.transform("references", lambda r: F.struct(r["url"].alias("url"), r["host"].alias("host")))
    return records.select("cve_id", F.struct("severity.label").alias("severity"), "published", "cwe_ids", urls_of.alias("references"), spans.alias("affected"))


def _raw(side: str) -> dict[str, Column]:
    """The raw columns of a side that the status of each field follows from."""
    r = F.col(side)
    return {
        "severity": r["severity"]["label"], "published": r["published"], "cwe_ids": r["cwe_ids"],
        "references": F.transform(r["references"], lambda x: F.struct(x["url"].alias("url"), x["host"].alias("host"))),
        "affected_versions": F.transform(r["affected"], lambda a: F.struct(*[a[f].alias(f) for f in versions.SPAN])),
    }


def tallied(pairs: DataFrame, fields: tuple[str, ...] = K.COMPARED, *beside: str) -> DataFrame:
    """(field, beside, n, nvd, ghsa): how often each field meets the same two raw values, for counts that depend on nothing else.

    The records hold the values of their field only, so ``normalized`` and the comparators judge a combination once
    however many pairs have it. Partial counts go by hash: values that never repeat move as they are, once.
    """
    both = {side: _raw(side) for side in ("nvd", "ghsa")}
    kinds = pairs.select(*[both[s][f].alias(f"{s}_{f}") for s in both for f in fields]).schema
    rows = [
        F.struct(F.lit(f).alias("field"), *[(both[s][g] if g == f else F.lit(None).cast(kinds[f"{s}_{g}"].dataType)).alias(f"{s}_{g}") for s in both for g in fields])
        for f in fields
    ]
    counts = pairs.select(*beside, F.inline(F.array(*rows))).groupBy("field", *beside, *kinds.names).agg(F.count("*").alias("n"))

    def record(side: str) -> Column:
        def value(field: str, kind: str) -> Column:
            return F.col(f"{side}_{field}") if field in fields else F.lit(None).cast(kind)

        none = F.lit(None).cast("string")
        spans = value("affected_versions", versions.SPAN_TYPE)
        affected = F.transform(spans, lambda a: F.struct(*[a[f].alias(f) for f in versions.SPAN], none.alias("package_name"), none.alias("product")))
        return F.struct(
            F.struct(value("severity", "string").alias("label")).alias("severity"), value("published", "string").alias("published"), value("cwe_ids", "array<string>").alias("cwe_ids"),
            value("references", "array<struct<url: string, host: string>>").alias("references"), affected.alias("affected"),
        ).alias(side)

    # few bytes, but judging them costs much: a number of parts is not reduced by their size
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.repartition(parts, *beside, *kinds.names).select("field", *beside, "n", record("nvd"), record("ghsa"))


def status_of(field: str = "field") -> Column:
    """The status of the one field that a row of ``normalized(tallied(...))`` holds."""
    out = F.lit(None).cast("string")
    for name, told in discrepancies().items():
        out = F.when(F.col(field) == name, told["status"]).otherwise(out)
    return out


def status_totals(pairs: DataFrame) -> DataFrame:
    """What ``status_counts(statuses(pairs))`` gives, each combination of values judged once."""
    judged = normalized(tallied(pairs)).select("field", "n", status_of().alias("status"))
    counts = judged.groupBy("field").agg(*[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in K.STATUSES])
    return counts.orderBy("field")


def normalized(pairs: DataFrame) -> DataFrame:
    """Pairs with each side's normalized columns, computed once for the view and the comparators.

    What they read raw stands beside the records as columns too: a plan that needs no more of a record does not build it.
    """
    columns = {}
    for side in ("nvd", "ghsa"):
        r = F.col(side)
        columns |= {
            f"{side}_label": r["severity"]["label"],
            f"{side}_published": r["published"],
            f"{side}_time": dates.parse_iso(r["published"]),
            f"{side}_cwe": text.cwe_set(r["cwe_ids"]),
            f"{side}_urls": urls.url_set(r["references"]),
            f"{side}_hosts": urls.host_set(r["references"]),
            f"{side}_spans": versions.spans(r["affected"]),
            f"{side}_packages": text.package_names(r["affected"]),
            f"{side}_listed": F.coalesce(F.size(r["references"]), F.lit(0)),
        }
    first = pairs.withColumns(columns)
    return first.withColumns({f"{side}_effective": versions.effective(F.col(f"{side}_spans")) for side in ("nvd", "ghsa")})


def discrepancies() -> dict[str, Column]:
    """The five comparisons over the columns of ``normalized``."""
    c = F.col
    return {
        "severity": severity(c("nvd_label"), c("ghsa_label")),
        "published": published(c("nvd_published"), c("ghsa_published"), c("nvd_time"), c("ghsa_time")),
        "cwe_ids": set_field(c("nvd_cwe"), c("ghsa_cwe"), overlap=K.REPRESENTATION, conflict_note=K.DISJOINT_CWE),
        "references": references(c("nvd_urls"), c("ghsa_urls"), c("nvd_hosts"), c("ghsa_hosts"), c("nvd_listed"), c("ghsa_listed")),
        "affected_versions": affected_versions(c("nvd_spans"), c("ghsa_spans"), c("nvd_effective"), c("ghsa_effective")),
    }


def unified_view() -> Column:
    """Six groups of both sides' values over the columns of ``normalized``."""
    c = F.col

    def label(side: str) -> Column:
        s = c(f"{side}.severity")
        canonical = text.canonical_severity(c(f"{side}_label"), K.SEVERITY)
        return F.struct(c(f"{side}_label").alias("label"), s["score"].alias("score"), s["vector"].alias("vector"), canonical.alias("canonical_label"))

    def both(suffix: str) -> Column:
        return F.struct(c(f"nvd_{suffix}").alias("nvd"), c(f"ghsa_{suffix}").alias("ghsa"))

    return F.struct(
        F.struct(label("nvd").alias("nvd"), label("ghsa").alias("ghsa")).alias("severity"),
        both("published").alias("published"),
        both("cwe").alias("cwe_ids"),
        F.struct("nvd_urls", "ghsa_urls", "nvd_hosts", "ghsa_hosts").alias("references"),
        both("spans").alias("affected_versions"),
        both("packages").alias("package_names"),
    )


def compare_pairs(pairs: DataFrame) -> DataFrame:
    """(cve_id, nvd_source_id, ghsa_source_id, unified_view, field_discrepancies) of one-to-one pairs; a map-only stage."""
    fields = F.struct(*[v.alias(k) for k, v in discrepancies().items()])
    return normalized(pairs).select(
        "cve_id",
        F.col("nvd.source_id").alias("nvd_source_id"),
        F.col("ghsa.source_id").alias("ghsa_source_id"),
        unified_view().alias("unified_view"),
        fields.alias("field_discrepancies"),
    )


def statuses(pairs: DataFrame) -> DataFrame:
    """(cve_id, a status column for each compared field): what ``compare_pairs`` says of statuses, without notes and values."""
    return normalized(pairs).select("cve_id", *[v["status"].alias(k) for k, v in discrepancies().items()])


def long_form(compared: DataFrame) -> DataFrame:
    """(cve_id, field, status) with a row for each compared field, of ``compare_pairs`` or ``statuses``."""
    whole = "field_discrepancies" in compared.columns
    status = {f: F.col("field_discrepancies")[f]["status"] if whole else F.col(f) for f in K.COMPARED}
    entries = F.array(*[F.struct(F.lit(f).alias("field"), s.alias("status")) for f, s in status.items()])
    return compared.select("cve_id", F.inline(entries))


def status_counts(compared: DataFrame) -> DataFrame:
    """(field, one column for each status), zero-filled, from partial counts of five rows a task."""
    counts = long_form(compared).groupBy("field").agg(*[F.count_if(F.col("status") == s).alias(s) for s in K.STATUSES])
    return counts.orderBy("field")
