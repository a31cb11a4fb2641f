"""Schemas of raw feeds and of the shared record; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, StringType, StructField, StructType

_TEXT = "struct<lang: string, value: string>"
_METRIC = "array<struct<source: string, type: string, cvssData: struct<baseScore: double, baseSeverity: string, vectorString: string>>>"
_MATCH = (
    "struct<criteria: string, vulnerable: boolean, versionStartIncluding: string, versionStartExcluding: string,"
    " versionEndIncluding: string, versionEndExcluding: string>"
)
#: Levels of ``children`` below a configuration's nodes that a first reading holds; readers double it until all fit.
NODE_DEPTH = 6


def _node(depth: int) -> str:
    below = f"array<{_node(depth - 1)}>" if depth else "string"  # what lies deeper, as it stands
    return f"struct<cpeMatch: array<{_MATCH}>, children: {below}>"


def cve_type(depth: int = NODE_DEPTH) -> str:
    """A feed's record with configuration nodes of so many levels."""
    return (
        "struct<id: string, published: string, lastModified: string, vulnStatus: string,"
        f" descriptions: array<{_TEXT}>,"
        f" metrics: struct<cvssMetricV40: {_METRIC}, cvssMetricV31: {_METRIC}, cvssMetricV30: {_METRIC}, cvssMetricV2: {_METRIC}>,"
        f" weaknesses: array<struct<description: array<{_TEXT}>>>,"
        " `references`: array<struct<url: string, source: string, tags: array<string>>>,"
        f" configurations: array<struct<nodes: array<{_node(depth)}>>>>"
    )


def feed_type(depth: int = NODE_DEPTH) -> str:
    return f"vulnerabilities array<struct<cve: {cve_type(depth)}>>"

ADVISORY = (
    "id string, aliases array<string>, summary string, published string, modified string,"
    " severity array<struct<type: string, score: string>>,"
    " `references` array<struct<type: string, url: string, source: string, tags: array<string>>>,"
    " affected array<struct<package: struct<name: string, ecosystem: string>,"
    " ranges: array<struct<events: array<map<string, string>>>>, versions: array<string>>>,"
    " database_specific struct<severity: string, cwe_ids: array<string>, github_reviewed: boolean,"
    " github_reviewed_at: string, nvd_published_at: string>"
)

AFFECTED_FIELDS = (
    "source_type",
    "criteria",
    "vendor",
    "product",
    "package_name",
    "ecosystem",
    "version",
    "introduced",
    "fixed",
    "version_start_including",
    "version_start_excluding",
    "version_end_including",
    "version_end_excluding",
    "vulnerable",
)


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _SS = StringType(), ArrayType(StringType())
AFFECTED_TYPE = _struct(**{f: BooleanType() if f == "vulnerable" else _S for f in AFFECTED_FIELDS})
AFFECTED = AFFECTED_TYPE.simpleString()
RECORD = _struct(
    source=_S,
    source_id=_S,
    cve_id=_S,
    aliases=_SS,
    summary=_S,
    published=_S,
    last_modified=_S,
    severity=_struct(metric_key=_S, score=DoubleType(), label=_S, vector=_S, source=_S),
    cwe_ids=_SS,
    references=ArrayType(_struct(url=_S, host=_S, source=_S, tags=_SS)),
    affected=ArrayType(AFFECTED_TYPE),
    source_specific=_struct(vuln_status=_S, github_reviewed=BooleanType(), github_reviewed_at=_S, nvd_published_at=_S, relative_path=_S),
)
ALIGNED = _struct(cve_id=_S, nvd=RECORD, ghsa=ArrayType(RECORD))
