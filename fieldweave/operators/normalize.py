"""Raw feed rows to the shared record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from fieldweave import constants as K
from fieldweave.functions.text import cpe_part, first_with_prefix, or_empty, sorted_set, truthy
from fieldweave.functions.urls import host
from fieldweave.schemas import AFFECTED, AFFECTED_FIELDS, RECORD

_AFFECTED_LIST = f"array<{AFFECTED}>"


def _affected(**fields: Column) -> Column:
    return F.struct(*[fields.get(f, F.lit(None).cast("boolean" if f == "vulnerable" else "string")).alias(f) for f in AFFECTED_FIELDS])


def references(of: Column) -> Column:
    """References as (url, host, source, tags)."""
    made = F.transform(
        of,
        lambda r: F.struct(r["url"].alias("url"), host(r["url"]).alias("host"), r["source"].alias("source"), or_empty(r["tags"]).alias("tags")),
    )
    return or_empty(made, RECORD["references"].dataType.simpleString())


def chosen_metric(metrics: Column) -> Column:
    """(key, entry) of the most preferred metric with entries: its primary entry, or else its first."""

    def primary(e: Column) -> Column:
        return F.coalesce(e["type"] == K.PRIMARY_TYPE, F.lit(False)) | F.coalesce(e["source"] == K.PRIMARY_SOURCE, F.lit(False))

    found = []
    for key in K.METRIC_KEYS:
        entries = metrics[key]
        entry = F.coalesce(F.get(F.filter(entries, primary), F.lit(0)), F.get(entries, F.lit(0)))
        found.append(F.when(F.size(entries) > 0, F.struct(F.lit(key).alias("key"), entry.alias("entry"))))
    return F.coalesce(*found)


def english_summary(descriptions: Column) -> Column:
    """The first non-empty English description."""
    english = F.filter(descriptions, lambda d: (d["lang"] == "en") & truthy(d["value"]))
    return F.get(english, F.lit(0))["value"]


def weakness_ids(weaknesses: Column) -> Column:
    """Distinct ids that start with CWE-, sorted."""
    values = F.flatten(F.transform(weaknesses, lambda w: F.transform(or_empty(w["description"], "array<struct<lang: string, value: string>>"), lambda d: d["value"])))
    return or_empty(sorted_set(F.filter(values, lambda v: v.startswith("CWE-"))))


def _node_matches(node: Column, kind: StructType) -> Column:
    """Matches of a node, then of its children, in pre-order."""
    matches = kind["cpeMatch"].dataType.simpleString()
    own = or_empty(node["cpeMatch"], matches)
    if not _goes_on(kind):
        return own
    below = F.flatten(F.transform(node["children"], lambda c: _node_matches(c, kind["children"].dataType.elementType)))
    return F.concat(own, or_empty(below, matches))


def _goes_on(kind: StructType) -> bool:
    return "children" in kind.names and isinstance(kind["children"].dataType, ArrayType)


def cpe_matches(configurations: Column, kind: StructType) -> Column:
    """All matches of the configuration trees in pre-order; ``kind`` is the type of a node, with as many levels as it has."""
    per = F.transform(configurations, lambda c: F.flatten(F.transform(c["nodes"], lambda n: _node_matches(n, kind))))
    return or_empty(F.flatten(F.array_compact(per)), kind["cpeMatch"].dataType.simpleString())


def too_deep(configurations: Column, kind: StructType) -> Column:
    """Whether some node has children below the last level of its type."""

    def deeper(node: Column, at: StructType) -> Column:
        if _goes_on(at):
            return F.exists(node["children"], lambda c: deeper(c, at["children"].dataType.elementType))
        return node["children"].isNotNull() & (node["children"] != "[]")

    return F.coalesce(F.exists(configurations, lambda c: F.exists(c["nodes"], lambda n: deeper(n, kind))), F.lit(False))


def match_affected(matches: Column) -> Column:
    """One affected row for each match."""

    def row(m: Column) -> Column:
        start = F.when(truthy(m["versionStartIncluding"]), m["versionStartIncluding"]).otherwise(m["versionStartExcluding"])
        return _affected(
            source_type=F.lit("cpe"),
            criteria=m["criteria"],
            vendor=cpe_part(m["criteria"], 3),
            product=cpe_part(m["criteria"], 4),
            package_name=cpe_part(m["criteria"], 4),
            version=cpe_part(m["criteria"], 5),
            introduced=start,
            version_start_including=m["versionStartIncluding"],
            version_start_excluding=m["versionStartExcluding"],
            version_end_including=m["versionEndIncluding"],
            version_end_excluding=m["versionEndExcluding"],
            vulnerable=m["vulnerable"],
        )

    return or_empty(F.transform(matches, row), _AFFECTED_LIST)


def nvd_records(cves: DataFrame) -> DataFrame:
    """Rows of ``cve`` structs to shared records."""
    c = F.col("cve")
    staged = cves.select(c.alias("c"), chosen_metric(c["metrics"]).alias("m"))
    c, m = F.col("c"), F.col("m")
    data = m["entry"]["cvssData"]
    return _shaped(
        staged,
        source=F.lit("nvd"),
        source_id=c["id"],
        cve_id=c["id"],
        aliases=F.when(truthy(c["id"]), F.array(c["id"])).otherwise(F.array().cast("array<string>")),
        summary=english_summary(c["descriptions"]),
        published=c["published"],
        last_modified=c["lastModified"],
        severity=F.struct(m["key"].alias("metric_key"), data["baseScore"].alias("score"), data["baseSeverity"].alias("label"), data["vectorString"].alias("vector"), m["entry"]["source"].alias("source")),
        cwe_ids=weakness_ids(c["weaknesses"]),
        references=references(c["references"]),
        affected=match_affected(cpe_matches(c["configurations"], node_type(cves))),
        source_specific=_specific(vuln_status=c["vulnStatus"]),
    )


def node_type(cves: DataFrame) -> StructType:
    return cves.schema["cve"].dataType["configurations"].dataType.elementType["nodes"].dataType.elementType


def _specific(**fields: Column) -> Column:
    kinds = RECORD["source_specific"].dataType
    return F.struct(*[fields.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds])


def _shaped(df: DataFrame, beside: tuple[str, ...] = (), **fields: Column) -> DataFrame:
    return df.select(*[fields[f.name].cast(f.dataType).alias(f.name) for f in RECORD], *beside)


def advisory_affected(affected: Column) -> Column:
    """One row for each range; an item with neither ranges nor versions gives one row without bounds."""

    def first_event(r: Column, name: str) -> Column:
        told = F.filter(r["events"], lambda e: F.map_contains_key(e, name))
        return F.get(F.transform(told, lambda e: F.try_element_at(e, F.lit(name))), F.lit(0))

    def item(a: Column) -> Column:
        package = a["package"]
        common = {"source_type": F.lit("ghsa"), "product": package["name"], "package_name": package["name"], "ecosystem": package["ecosystem"], "vulnerable": F.lit(True)}
        last = F.get(a["versions"], F.size(a["versions"]) - 1)

        def of_range(r: Column) -> Column:
            start, fixed = first_event(r, "introduced"), first_event(r, "fixed")
            return _affected(**common, version=last, introduced=start, fixed=fixed, version_start_including=start, version_end_excluding=fixed)

        bare = (F.coalesce(F.size(a["ranges"]), F.lit(0)) <= 0) & (F.coalesce(F.size(a["versions"]), F.lit(0)) <= 0)
        return F.when(bare, F.array(_affected(**common))).otherwise(or_empty(F.transform(a["ranges"], of_range), _AFFECTED_LIST))

    return or_empty(F.flatten(F.transform(affected, item)), _AFFECTED_LIST)


def ghsa_records(advisories: DataFrame) -> DataFrame:
    """Advisory rows with ``relative_path`` to shared records."""
    first, own = F.get("severity", F.lit(0)), F.col("database_specific")
    return _shaped(
        advisories,
        source=F.lit("ghsa"),
        source_id=F.col("id"),
        cve_id=first_with_prefix(F.col("aliases"), "CVE-"),
        aliases=or_empty(F.col("aliases")),
        summary=F.col("summary"),
        published=F.col("published"),
        last_modified=F.col("modified"),
        severity=F.struct(first["type"].alias("metric_key"), F.lit(None).cast("double").alias("score"), own["severity"].alias("label"), first["score"].alias("vector"), F.lit(K.ADVISORY_SEVERITY_SOURCE).alias("source")),
        cwe_ids=F.array_sort(or_empty(own["cwe_ids"])),
        references=references(F.col("references")),
        affected=advisory_affected(F.col("affected")),
        source_specific=_specific(
            github_reviewed=own["github_reviewed"],
            github_reviewed_at=own["github_reviewed_at"],
            nvd_published_at=own["nvd_published_at"],
            relative_path=F.col("relative_path"),
        ),
    )
