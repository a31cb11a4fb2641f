"""One row for each line of the decision ladders, with the expected step written by hand."""

import pytest

from fieldweave import constants as K
from fieldweave.operators import compare
from fieldweave.schemas import AFFECTED_FIELDS, RECORD


def record(**fields):
    refs = [{"url": u, "host": h, "source": None, "tags": []} for u, h in fields.pop("refs", [])]
    affected = [{f: a.get(f) for f in AFFECTED_FIELDS} for a in fields.pop("affected", [])]
    base = {f.name: None for f in RECORD}
    base |= {"source_id": "s", "cve_id": "CVE-2024-1", "severity": {"label": fields.pop("label", None)}, "cwe_ids": [], "references": refs, "affected": affected, "source_specific": {}}
    return base | fields


def outcome(spark, field, left, right):
    df = spark.createDataFrame([("CVE-2024-1", left, right)], compare_schema())
    r = compare.compare_pairs(df).select(f"field_discrepancies.{field}.*").first()
    return r["status"], r["note"], r


def compare_schema():
    from pyspark.sql.types import StructType

    return StructType().add("cve_id", "string").add("nvd", RECORD).add("ghsa", RECORD)


SEVERITY = [
    (None, None, K.EQUIVALENT, K.BOTH_MISSING, None),
    ("HIGH", None, K.INCOMPLETE, K.ONE_MISSING, None),
    ("HIGH", "HIGH", K.EQUIVALENT, K.SAME_LABEL, None),
    ("high", "HIGH", K.EQUIVALENT, K.SAME_LABEL, None),
    ("MEDIUM", "MODERATE", K.REPRESENTATION, K.SAME_CANONICAL_LABEL, None),
    ("LOW", "CRITICAL", K.CONFLICT, K.DIFFERENT_LABELS, 3),
    ("", "HIGH", K.REPRESENTATION, K.ODD_LABELS, None),
    ("URGENT", "URGENT", K.REPRESENTATION, K.ODD_LABELS, None),
]


@pytest.mark.parametrize(("a", "b", "status", "note", "distance"), SEVERITY)
def test_severity(spark, a, b, status, note, distance):
    got = outcome(spark, "severity", record(label=a), record(label=b))
    assert got[:2] == (status, note) and got[2]["rank_distance"] == distance


PUBLISHED = [
    (None, None, K.EQUIVALENT, K.BOTH_MISSING, None),
    ("", None, K.INCOMPLETE, K.ONE_MISSING, None),
    ("2024-01-01T00:00:00", "2024-01-01T00:00:00Z", K.EQUIVALENT, K.SAME_TIME, 0),
    ("2024-01-01T00:00:00", "2024-01-01T05:00:00Z", K.REPRESENTATION, K.SAME_DATE, 0),
    ("2024-01-03", "2024-01-01T23:59:59Z", K.TEMPORAL, K.DIFFERENT_DATES, 2),
    ("N/A ", "n/a", K.REPRESENTATION, K.SAME_RAW_TIME, None),
    ("n/a", "2024-01-01", K.CONFLICT, K.ODD_TIMES, None),
]


@pytest.mark.parametrize(("a", "b", "status", "note", "days"), PUBLISHED)
def test_published(spark, a, b, status, note, days):
    got = outcome(spark, "published", record(published=a), record(published=b))
    assert got[:2] == (status, note) and got[2]["day_diff"] == days


CWE = [
    ([], [], K.EQUIVALENT, K.BOTH_MISSING, None),
    (["CWE-1"], None, K.INCOMPLETE, K.ONE_MISSING, None),
    (["CWE-1", "CWE-1"], [" cwe-1"], K.EQUIVALENT, K.SAME_SET, None),
    (["CWE-1"], ["CWE-1", "CWE-2"], K.INCOMPLETE, K.SUBSET, ["CWE-1"]),
    (["CWE-1", "CWE-3"], ["CWE-1", "CWE-2"], K.REPRESENTATION, K.OVERLAP, ["CWE-1"]),
    (["CWE-3"], ["CWE-2"], K.CONFLICT, K.DISJOINT_CWE, None),
]


@pytest.mark.parametrize(("a", "b", "status", "note", "shared"), CWE)
def test_cwe(spark, a, b, status, note, shared):
    got = outcome(spark, "cwe_ids", record(cwe_ids=a), record(cwe_ids=b))
    assert got[:2] == (status, note) and got[2]["shared_values"] == shared


A, A2, B, C = ("https://h/a", "h"), ("https://H/a/", "h"), ("https://h/b", "h"), ("https://x/c", "x")
REFERENCES = [
    ([], [], K.EQUIVALENT, K.BOTH_MISSING),
    ([A], [], K.INCOMPLETE, K.ONE_MISSING),
    ([A, A2], [A], K.REPRESENTATION, K.SAME_URLS_DEDUPED),
    ([A, ("", None)], [A], K.REPRESENTATION, K.SAME_URLS_DEDUPED),
    ([A], [A2], K.EQUIVALENT, K.SAME_URLS),
    ([A], [A, C], K.INCOMPLETE, K.URL_SUBSET),
    ([A], [B], K.REPRESENTATION, K.URL_OVERLAP),
    ([A], [C], K.CONFLICT, K.URL_DISJOINT),
]


@pytest.mark.parametrize(("a", "b", "status", "note"), REFERENCES)
def test_references(spark, a, b, status, note):
    assert outcome(spark, "references", record(refs=a), record(refs=b))[:2] == (status, note)


def span(**bounds):
    short = {"si": "version_start_including", "se": "version_start_excluding", "ei": "version_end_including", "ee": "version_end_excluding"}
    return {short.get(k, k): v for k, v in bounds.items()}


VERSIONS = [
    ([], [span(version="*")], K.EQUIVALENT, K.BOTH_MISSING),
    ([span(si="0")], [], K.EQUIVALENT, K.BOTH_MISSING),
    ([span(ee="0")], [], K.INCOMPLETE, K.ONE_MISSING),
    ([span(si="1", introduced="1", ee="2")], [span(si="1", introduced="1", ee="2")], K.EQUIVALENT, K.SAME_SPANS),
    ([span(si="1", introduced="1", ee="2")], [span(si="1", introduced="1", ee="2", fixed="2")], K.REPRESENTATION, K.SAME_EFFECTIVE),
    ([span(ee="2")], [span(ee="2"), span(ee="3")], K.INCOMPLETE, K.SPAN_SUBSET),
    ([span(si="1", ee="2")], [span(si="0.5", ee="2")], K.REPRESENTATION, K.SHARED_ENDPOINT),
    ([span(si="1")], [span(si="2")], K.REPRESENTATION, K.SHARED_ENDPOINT),
    ([span(ei="2.1.5")], [span(si="1.0", ee="2.1.6")], K.REPRESENTATION, K.SHARED_PREFIX),
    ([span(ei="2.1.5", version="3.0")], [span(si="1.0", ee="2.1.6")], K.CONFLICT, K.SPAN_CONFLICT),
    ([span(version="1.5")], [span(si="1.0", ee="2.0")], K.REPRESENTATION, K.POINTS_COVERED),
    ([span(version="1.5")], [span(si="oops!", ee="2.0")], K.REPRESENTATION, K.POINTS_COVERED),
    ([span(version="2.0")], [span(si="1.0", ee="2.0")], K.CONFLICT, K.SPAN_CONFLICT),
    ([span(ee="2.0.1")], [span(ee="2.0")], K.REPRESENTATION, K.TRUNCATED),
    ([span(ee="2024-01-01")], [span(ee="7")], K.REPRESENTATION, K.DATE_VERSION),
    ([span(ee="5")], [span(ee="7")], K.CONFLICT, K.SPAN_CONFLICT),
    ([span(se="1", introduced="1", ee="9")], [span(si="1", introduced="1", ee="8")], K.CONFLICT, K.SPAN_CONFLICT),
]


@pytest.mark.parametrize(("a", "b", "status", "note"), VERSIONS)
def test_affected_versions(spark, a, b, status, note):
    assert outcome(spark, "affected_versions", record(affected=a), record(affected=b))[:2] == (status, note)


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([("CVE-2024-1", record(), record())], compare_schema())
    compare.status_counts(compare.compare_pairs(df)).explain()
    assert "Python" not in capsys.readouterr().out


def test_totals_judge_each_combination_once(spark):
    """Pairs of equal values are one row of the tally, and its totals are those of pairs judged one by one."""
    from fieldweave.plans import adapter

    pairs = adapter.all_pairs(spark, "/root/testdata/sf0.001").limit(400)
    pairs = pairs.unionByName(pairs)
    tally = compare.tallied(pairs)
    assert {r["n"] % 2 for r in tally.collect()} == {0} and tally.where("field = 'severity'").count() < 50
    assert compare.status_totals(pairs).collect() == compare.status_counts(compare.statuses(pairs)).collect()
    assert all(sum(r[1:]) == 0 for r in compare.status_totals(pairs.limit(0)).collect())
