"""Update gaps between two change histories: for each change, how far the other side is behind.

The histories are one table of changes (key, side, time, value). An as-of join is a
union with the last value of each side carried forward. A key's changes are dealt to spans of
time, so that no task holds a key of many changes: values are carried inside a span,
a row a span tells what it ends with, these rows are carried across spans, and what a span begins with comes
from there.

At one time, changes are ordered by side, then value, and all that come before in that order are known to a change. Rows
without a key or a time say nothing and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(changes: DataFrame, sides: tuple[str, str], *, key: str = "key", side: str = "side", time: str = "time", value: str = "value", span: str = "week") -> DataFrame:
    """``changes`` with ``<side>_time`` and ``<side>_value``: the last change of each side up to and including the row."""
    known = changes.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_span", F.date_trunc(span, time))
    held = F.struct(F.col(time).alias("time"), F.col(value).alias("value"))
    order = [time, side, value]
    inside = Window.partitionBy(key, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = known.withColumns({f"_{s}": F.last(F.when(F.col(side) == s, held), ignorenulls=True).over(inside) for s in sides})
    place = F.struct(*order)
    ends = known.groupBy(key, "_span").agg(*[F.max_by(F.when(F.col(side) == s, held), F.when(F.col(side) == s, place)).alias(f"_e_{s}") for s in sides])
    across = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    begins = ends.select(key, "_span", *[F.last(f"_e_{s}", ignorenulls=True).over(across).alias(f"_b_{s}") for s in sides])
    joined = here.join(begins, [key, "_span"])
    last = {s: F.coalesce(f"_{s}", f"_b_{s}") for s in sides}
    return joined.select(*changes.columns, *[last[s][part].alias(f"{s}_{part}") for s in sides for part in ("time", "value")])


def update_gaps(changes: DataFrame, sides: tuple[str, str], *, key: str = "key", side: str = "side", time: str = "time", value: str = "value", span: str = "week") -> DataFrame:
    """``changes`` with ``other_time``, ``other_value``, ``lag_seconds`` and ``gap``.

    ``lag_seconds`` is the age of the other side's last change when this one is made, and ``gap`` says
    what follows: ``first`` (the other side knows nothing yet), ``level`` (it says the same) or ``behind``.
    """
    rows = carried(changes, sides, key=key, side=side, time=time, value=value, span=span)

    def other(part: str) -> Column:
        return F.when(F.col(side) == sides[0], F.col(f"{sides[1]}_{part}")).otherwise(F.col(f"{sides[0]}_{part}"))

    lag = F.unix_seconds(F.col(time)) - F.unix_seconds(other("time"))
    gap = F.when(other("time").isNull(), "first").when(F.col(value).eqNullSafe(other("value")), "level").otherwise("behind")
    return rows.where(F.col(side).isin(*sides)).select(*changes.columns, other("time").alias("other_time"), other("value").alias("other_value"), lag.alias("lag_seconds"), gap.alias("gap"))
