"""Values that results must spell exactly so."""

from __future__ import annotations

# The five discrepancy types.
EQUIVALENT = "equivalent"
REPRESENTATION = "representation_discrepancy"
INCOMPLETE = "incomplete"
TEMPORAL = "temporal_discrepancy"
CONFLICT = "factual_conflict"
STATUSES = (EQUIVALENT, REPRESENTATION, INCOMPLETE, TEMPORAL, CONFLICT)

# Severity labels and their order.
SEVERITY = {"LOW": "LOW", "MODERATE": "MEDIUM", "MEDIUM": "MEDIUM", "HIGH": "HIGH", "CRITICAL": "CRITICAL"}
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

# Score metrics from most to least preferred.
METRIC_KEYS = ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
PRIMARY_TYPE, PRIMARY_SOURCE = "Primary", "nvd@nist.gov"
ADVISORY_SEVERITY_SOURCE = "github-advisory-database"

# Folders of an advisory tree.
REVIEWED_PREFIX, UNREVIEWED_PREFIX = "advisories/github-reviewed/", "advisories/unreviewed/"

# Notes of the comparisons.
BOTH_MISSING = "both sides missing"
ONE_MISSING = "value present on only one side"
SAME_LABEL = "same severity label"
SAME_CANONICAL_LABEL = "same canonical severity label"
DIFFERENT_LABELS = "different canonical severity labels"
ODD_LABELS = "severity labels could not be fully canonicalized"
SAME_TIME = "same timestamp"
SAME_DATE = "same calendar date but different timestamp representation"
DIFFERENT_DATES = "different publication dates"
SAME_RAW_TIME = "same raw timestamp after normalization"
ODD_TIMES = "unparseable and unequal publication values"
SAME_SET = "same canonical set"
SUBSET = "one side is a strict subset of the other"
OVERLAP = "sets overlap but differ"
DISJOINT_CWE = "CWE assignments are disjoint"
SAME_URLS_DEDUPED = "same canonical reference URLs after deduplication"
SAME_URLS = "same canonical reference URLs"
URL_SUBSET = "one side lists a strict subset of canonical references"
URL_OVERLAP = "reference coverage differs but points to overlapping evidence sources"
URL_DISJOINT = "reference sets are disjoint with no overlapping hosts"
SAME_SPANS = "same canonical version-bound spans"
SAME_EFFECTIVE = "same effective version bounds after collapsing equivalent upper/lower markers"
SPAN_SUBSET = "one side lists a strict subset of effective version-bound spans"
SHARED_ENDPOINT = "version-bound spans differ, but share at least one upper-bound endpoint"
SHARED_PREFIX = "end_including vs end_excluding boundary with shared major.minor prefix"
POINTS_COVERED = "NVD point versions are covered by GHSA version ranges"
TRUNCATED = "end_excluding version string is a prefix truncation of the other"
DATE_VERSION = "NVD uses a date string as version_end_excluding"
SPAN_CONFLICT = "canonical version-bound spans are incompatible"

# Compared fields, and coverage fields with their report names.
COMPARED = ("severity", "published", "cwe_ids", "references", "affected_versions")
COVERAGE = {
    "summary": "summary",
    "published": "published_date",
    "last_modified": "last_modified_date",
    "severity": "severity",
    "cwe_ids": "cwe",
    "references": "references",
    "affected": "affected",
}
