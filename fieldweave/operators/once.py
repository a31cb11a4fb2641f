"""Judging each combination of values once, where few values make up many rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.staging import stage

#: Most combinations that are judged beforehand and broadcast.
MOST = 100_000


def once(rows: DataFrame, sides: list[DataFrame], judge: Callable[[DataFrame], DataFrame], most: int = MOST) -> DataFrame:
    """What ``judge(rows)`` gives, which adds columns that follow from the columns of ``sides`` alone.

    Every row of ``rows`` has, in those columns, a row of each side. If all sides' distinct rows make at most ``most``
    combinations, those are judged and every row looks its own up; otherwise nothing is gained and rows are judged one by one.
    Nulls are values like others.
    """
    combos, number = None, 1
    for side in sides:
        # one row beyond the bound tells that there are too many
        found = stage(side.distinct().limit(most + 1))
        number *= found.count()
        if number > most:
            return judge(rows)
        combos = found if combos is None else combos.crossJoin(F.broadcast(found))
    columns = combos.columns
    # few bytes, but judging them costs much: a number of parts is not reduced by their size
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = judge(combos.repartition(parts, *columns)).withColumnsRenamed({c: f"_of_{c}" for c in columns})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns])
    return rows.join(F.broadcast(told), same, "left").drop(*[f"_of_{c}" for c in columns])
