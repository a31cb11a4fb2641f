"""ISO 8601 timestamps; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.functions.text import let

_SEP = "\x01"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?"
_CLOCK = r"(\d{2})(?:(:?)(\d{2})(?:\3(\d{2})(?:[.,](\d+))?)?)?"
_STAMP = rf"(?s)^({_DATE})(?:.{_CLOCK}(?:(Z)|([+-]\d{{2}}):?(\d{{2}})?)?)?$"
_COMMON = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z?\z"
_DATE_ZULU = rf"^({_DATE})Z$"


def _day(of: Column) -> Column:
    """A date in any of the forms as YYYY-MM-DD; null if a week date is none."""
    whole = F.regexp_replace(of, "-", "")
    monday = F.date_trunc("week", F.to_date(F.concat(F.substring(of, 1, 4), F.lit("-01-04"))))
    week, day = F.substring(whole, 6, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(whole, 8, 1), F.lit("")), F.lit("1")).try_cast("int")
    told = F.date_add(monday, (week - 1) * 7 + day - 1)
    by_week = F.when(day.between(1, 7) & (F.weekofyear(told) == week), told.cast("string"))
    return F.when(F.contains(of, F.lit("W")), by_week).otherwise(F.regexp_replace(whole, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))


def parse_iso(value: Column) -> Column:
    """A timestamp, null if it is not one; without an offset the time is in UTC.

    Dates are plain, compact or week dates, times plain or compact; any single
    character may part them.
    """
    # one pass of the expression cuts the string into its nine parts
    cut = F.split(F.regexp_replace(value, _STAMP, _SEP.join(f"${g}" for g in range(1, 10))), _SEP)

    def spell(p: Column) -> Column:
        def part(i: int, default: str) -> Column:
            return F.coalesce(F.nullif(F.get(p, F.lit(i)), F.lit("")), F.lit(default))

        clock = F.concat_ws(":", part(1, "00"), part(3, "00"), part(4, "00"))
        return F.concat(_day(part(0, "")), F.lit("T"), clock, F.lit("."), part(5, "0"), part(7, "+00"), F.lit(":"), part(8, "00"))

    # the common form is what the cast reads as it stands
    text = F.when(value.rlike(_COMMON), value).when(value.rlike(_STAMP), let(cut, spell)).when(
        value.rlike(_DATE_ZULU), F.concat(_day(F.regexp_replace(value, _DATE_ZULU, "$1")), F.lit("T00:00:00+00:00"))
    )
    return text.try_cast("timestamp")


def day_difference(left: Column, right: Column) -> Column:
    """Days between the UTC dates of two timestamps, without sign."""
    return F.abs(F.datediff(F.to_date(left), F.to_date(right)))
