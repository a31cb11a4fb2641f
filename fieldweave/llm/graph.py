"""Connected components by alternating stars.

Links are kept as (lo, hi), the smaller node first. A small star ties the smaller
neighbours of a node to the least of them; a large star ties a node to what the
least neighbour of its own smaller neighbour is. Neither adds links, and both
keep what is connected, so links never grow in number. They end as stars around
the smallest node of each component. A small star needs no join: links come as
forests, in which a task names at most one smaller neighbour of a node, so these
are as many as the tasks at most, however many larger neighbours it has. Those of
a popular node are split by adaptive execution, as rows of two numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import scratch, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``edges`` (a, b); all are long.

    Rounds are written to the shared folder. A link of a node to itself says
    nothing. Empty edges give no rows.
    """
    with scratch(edges.sparkSession) as kept:
        labels = _labels(edges)
        kept.append(labels)
    return labels


def _labels(edges: DataFrame) -> DataFrame:
    links = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    while True:
        links = stage(_large_star(_small_star(links)), "links")
        if _unsettled(links).isEmpty():
            break
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return stage(links.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(roots), "labels")


def _small_star(links: DataFrame) -> DataFrame:
    def link(end: str) -> Column:
        return F.struct(F.col("least").alias("lo"), F.col(end).alias("hi"))

    other = F.col("lo") != F.col("least")
    known = links.withColumn("least", F.min("lo").over(Window.partitionBy("hi")))
    return known.select(F.inline(F.when(other, F.array(link("hi"), link("lo"))).otherwise(F.array(link("hi"))))).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("least"))
    return links.join(least, "lo", "left").select(F.coalesce("least", "lo").alias("lo"), "hi").distinct()


def _unsettled(links: DataFrame) -> DataFrame:
    """Nodes that have two smaller neighbours, or a smaller and a larger one."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).unionByName(
        links.select(F.col("lo").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger"))
    )
    return ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger")).where("smaller > 1 or (smaller = 1 and larger = 1)")
