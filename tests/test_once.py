"""Combinations of values that are judged once, and rows that are judged one by one where they do not repeat."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from fieldweave.operators.once import once
from fieldweave.plans import oracles, queries, study, study_oracles
from tests.test_queries import SF, assert_same


@pytest.mark.parametrize(("most", "judged"), [(9, 9), (8, 40)])
def test_each_combination_is_judged_once_unless_there_are_too_many(spark, most, judged):
    lefts = spark.createDataFrame([("a",), ("b",), (None,)] * 4, "a string")
    rights = spark.createDataFrame([(True,), (False,), (None,)] * 5, "b boolean")
    rows = spark.range(40).select("id", F.get(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3).cast("int")).alias("a"), F.when(F.col("id") % 4 != 0, F.col("id") % 4 == 1).alias("b"))
    seen = []

    def judge(df):
        seen.append(df.count())
        return df.select(*df.columns, F.concat_ws("/", F.coalesce("a", F.lit("-")), F.coalesce(F.col("b").cast("string"), F.lit("-"))).alias("told"))

    got = once(rows, [lefts, rights], judge, most)
    assert got.columns == ["id", "a", "b", "told"] and seen == [judged]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, judge(rows).collect()))


def test_nothing_is_judged_of_empty_tables(spark):
    none = spark.createDataFrame([], "a string")
    assert once(none, [none], lambda df: df.withColumn("told", F.lit(1))).collect() == []


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize(("module", "sql", "name"), [
    (study, study_oracles, "version_interval_relation"), (queries, oracles, "cmp_references"), (queries, oracles, "unified_view_flat"),
])
def test_values_that_do_not_repeat_are_judged_one_by_one(spark, monkeypatch, module, sql, name):
    monkeypatch.setattr(module, "once", partial(once, most=0))
    assert_same(spark, name, module.QUERIES[name], sql.ORACLES[name])
