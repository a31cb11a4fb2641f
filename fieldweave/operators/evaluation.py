"""Figures of merit: typing against gold labels, agreement of annotators, decisions and their risk.

Every figure over counts of zero is 0, and figures are rounded to six digits, ties to even.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from fieldweave import constants as K
from fieldweave.functions.text import ratio
from fieldweave.staging import cut


def _sum(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def typing_metrics(rows: DataFrame, *, group: str = "field", gold: str = "gold", predicted: str = "predicted", labels: tuple[str, ...] = K.STATUSES) -> DataFrame:
    """A row for each group and one for ``all``: accuracy, macro_f1, kappa, weighted_kappa and ``f1_<label>``.

    The confusion cube of groups, gold and predicted labels is counted in one
    shuffle of partial counts, and every figure follows from its cells. Macro-F1 is over the labels that occur.
    Weights of kappa are squared distances in the order of ``labels``. Rows with a label outside of them are not counted.
    """
    size = range(len(labels))
    cells = [F.count_if((F.col(gold) == labels[g]) & (F.col(predicted) == labels[p])).alias(f"c{g}_{p}") for g in size for p in size]
    cube = rows.rollup(group).agg(F.grouping(group).alias("_all"), *cells)
    c = [[F.col(f"c{g}_{p}") for p in size] for g in size]
    by_gold, by_predicted = [_sum(c[g]) for g in size], [_sum([c[g][p] for g in size]) for p in size]
    named = cube.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col(group)).alias(group), *[f"c{g}_{p}" for g in size for p in size],
        *[v.alias(f"g{i}") for i, v in enumerate(by_gold)], *[v.alias(f"p{i}") for i, v in enumerate(by_predicted)],
    )
    gs, ps, n = [F.col(f"g{i}") for i in size], [F.col(f"p{i}") for i in size], F.col("n")
    counted = named.withColumn("n", _sum(gs))
    occurs = [F.when(gs[i] + ps[i] > 0, 1).otherwise(0) for i in size]
    f1 = [F.when(gs[i] + ps[i] > 0, 2 * c[i][i] / (gs[i] + ps[i])).otherwise(0.0) for i in size]
    agree = _sum([c[i][i] for i in size])
    chance = _sum([gs[i] * ps[i] for i in size])
    off = _sum([(g - p) ** 2 * c[g][p] for g in size for p in size])
    off_chance = _sum([(g - p) ** 2 * gs[g] * ps[p] for g in size for p in size])
    return counted.select(
        group, "n", ratio(agree, n).alias("accuracy"), ratio(_sum(f1), _sum(occurs)).alias("macro_f1"), ratio(n * agree - chance, n * n - chance).alias("kappa"),
        F.when(off_chance > 0, F.bround(1 - n * off / F.nullif(off_chance, F.lit(0)), 6)).otherwise(0.0).alias("weighted_kappa"), *[F.bround(f, 6).alias(f"f1_{labels[i]}") for i, f in enumerate(f1)],
    )


def discrepancy_rates(counts: DataFrame) -> DataFrame:
    """The rows of ``status_counts`` with ``pairs``, ``discrepancy_rate`` (not equivalent) and ``conflict_ratio`` (conflicts among those)."""
    pairs = _sum([F.col(s) for s in K.STATUSES])
    differ = pairs - F.col(K.EQUIVALENT)
    return counts.select("field", pairs.alias("pairs"), ratio(differ, pairs).alias("discrepancy_rate"), ratio(F.col(K.CONFLICT), differ).alias("conflict_ratio"), ratio(F.col(K.INCOMPLETE), pairs).alias("incomplete_rate"))


def adjudication_metrics(decided: DataFrame, *, gold: str = "gold", group: str = "field") -> DataFrame:
    """Accuracy (all answered), coverage, abstention precision and selective accuracy of decisions, and the baselines' accuracy.

    Abstention is right where the winner is wrong.
    """

    def right(column: str) -> Column:
        return F.coalesce(F.col(column) == F.col(gold), F.lit(False))

    answered = ~F.col("abstained")
    counts = decided.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(answered).alias("answered"), F.count_if(right("winner")).alias("right"), F.count_if(answered & right("winner")).alias("right_answered"),
        F.count_if(~answered & ~right("winner")).alias("well_abstained"), F.count_if(right("by_priority")).alias("right_priority"), F.count_if(right("by_freshness")).alias("right_freshness"),
    )
    n = F.col("n")
    return counts.select(
        group, "n", ratio(F.col("right"), n).alias("accuracy"), ratio(F.col("answered"), n).alias("coverage"), ratio(F.col("well_abstained"), n - F.col("answered")).alias("abstention_precision"),
        ratio(F.col("right_answered"), F.col("answered")).alias("selective_accuracy"), ratio(F.col("right_priority"), n).alias("priority_accuracy"), ratio(F.col("right_freshness"), n).alias("freshness_accuracy"),
    )


def risk_coverage(decided: DataFrame, order: list[Column], wrong: Column) -> DataFrame:
    """``decided`` with ``rank``, ``errors``, ``coverage`` and ``risk`` of answering it and all before it in ``order``.

    ``order`` must be total. Rows are dealt to ranges of the order; a row a range tells how many rows and
    errors it holds, and each task counts on from what the ranges before it hold. No task reads more than its range.
    """
    spark = decided.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(decided.withColumn("_wrong", F.when(wrong, 1).otherwise(0)).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.count("*").alias("n"), F.sum("_wrong").alias("wrong")).orderBy("_range").collect()  # a row a range
    before, n, wrongs = {}, 0, 0
    for r in totals:
        before[r["_range"]] = (n, wrongs)
        n, wrongs = n + r["n"], wrongs + r["wrong"]
    schema = StructType(ranged.schema.fields).add("rank", LongType()).add("errors", LongType())
    arrow, at = to_arrow_schema(schema), {c: i for i, c in enumerate(ranged.columns)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rank, errors = None, 0, 0
        for batch in batches:
            ranges, bad = batch.column(at["_range"]).to_numpy(), batch.column(at["_wrong"]).to_numpy().astype(np.int64)
            ranks, sums = np.empty(len(bad), np.int64), np.empty(len(bad), np.int64)
            edges = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if ranges[lo] != current:
                    current = ranges[lo]
                    rank, errors = before[int(current)]
                ranks[lo:hi], sums[lo:hi] = rank + np.arange(1, hi - lo + 1), errors + np.cumsum(bad[lo:hi])
                rank, errors = int(ranks[hi - 1]), int(sums[hi - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks), pa.array(sums)], schema=arrow)

    counted = ranged.sortWithinPartitions("_range", *order).mapInArrow(scan, schema)
    return counted.select(*decided.columns, "rank", "errors", ratio(F.col("rank"), F.lit(n)).alias("coverage"), ratio(F.col("errors"), F.col("rank")).alias("risk"))
