"""Registered queries against their SQL twins on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest

import __spark_entry__ as entry
from fieldweave.plans import oracles, queries, study

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


def rows_of(columns, values):
    return sorted(repr([None if v is None or v != v else (str(v) if hasattr(v, "isoformat") else v) for v in r]) for r in values), columns


def assert_same(spark, name, query, sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, str(SF))
    columns = sorted(df.columns)
    got = rows_of(columns, [list(r) for r in df.select(*columns).collect()])
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})")
    assert sorted(d[0] for d in cursor.description) == columns
    assert got == rows_of(columns, [list(r) for r in cursor.fetchall()])


def test_every_query_has_a_twin():
    assert set(queries.QUERIES) == set(oracles.ORACLES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_twin(spark, name):
    assert_same(spark, name, queries.QUERIES[name], oracles.ORACLES[name])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["field"] for r in rows] == ["affected_versions", "cwe_ids", "published", "references", "severity"]
    assert len({sum(r[1:]) for r in rows}) == 1


def test_entry_works_without_the_corpus_operators(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if "llm" in name or name == "corpus_pipeline" else real(name, *a))
    assert set(entry.queries()) == {*queries.QUERIES, *study.QUERIES}


def test_alignment_moves_only_what_its_query_reads(spark):
    """No list of links, spans or summaries crosses a shuffle."""
    for name in ("align_left_join", "one_to_one_pairs"):
        plan = queries.QUERIES[name](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
        assert "example.org" not in plan and "r_summary" not in plan


def test_comparing_a_field_builds_no_records(spark):
    """A comparison of dates or labels does not make the links, spans and summaries of both records."""
    for name in ("cmp_published", "cmp_severity"):
        plan = queries.QUERIES[name](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
        assert "example.org" not in plan and "r_summary" not in plan, name


def test_records_go_round_packed(spark, monkeypatch):
    names, read = [], queries.read_records
    monkeypatch.setattr(queries, "read_records", lambda session, path: names.extend(Path(path.removeprefix("file:")).glob("part-*")) or read(session, path))
    assert queries.records_round_trip(spark, str(SF)).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert names and all(n.name.endswith(".json.gz") for n in names)
