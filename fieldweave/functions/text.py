"""Scalar functions on strings and string sets; null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that Python's ``str.strip`` takes off too.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE))


def normalize_text(value: Column) -> Column:
    """Stripped and lower-cased; empty becomes null."""
    return F.nullif(F.lower(stripped(value)), F.lit(""))


def truthy(value: Column) -> Column:
    """Whether a string is neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))


def sorted_set(values: Column) -> Column:
    """Distinct, non-null, in code-point order."""
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def or_empty(values: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(values, F.array().cast(kind))


def cwe_set(ids: Column) -> Column:
    """Stripped, upper-cased, non-empty weakness ids as a sorted set."""
    clean = F.transform(or_empty(ids), lambda x: F.nullif(F.upper(stripped(x)), F.lit("")))
    return sorted_set(clean)


def package_names(affected: Column) -> Column:
    """For each affected item its package name or else its product, normalized; a sorted set."""
    names = F.transform(affected, lambda a: F.coalesce(normalize_text(a["package_name"]), normalize_text(a["product"])))
    return sorted_set(or_empty(names))


def canonical_severity(label: Column, table: dict[str, str]) -> Column:
    """Case-insensitive lookup; unknown and null labels give null."""
    upper, out = F.upper(label), F.lit(None).cast("string")
    for word, canonical in table.items():
        out = F.when(upper == word, canonical).otherwise(out)
    return out


def cve_year(cve_id: Column) -> Column:
    """The year part of a CVE id of three parts or more, else ``unknown``."""
    parts = F.split(cve_id, "-")
    fits = cve_id.startswith("CVE-") & (F.size(parts) > 2)
    return F.when(fits, F.get(parts, F.lit(1))).otherwise("unknown")


def major_minor(version: Column) -> Column:
    """The first two non-empty dot parts; null if there are fewer."""
    parts = F.filter(F.split(version, "[.]"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def any_prefix_pair(left: Column, right: Column) -> Column:
    """Whether some string of one set starts with some string of the other."""
    hit = F.exists(left, lambda a: F.exists(right, lambda b: a.startswith(b) | b.startswith(a)))
    return F.coalesce(hit, F.lit(False))


def date_like(version: Column) -> Column:
    return F.coalesce(version.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def first_with_prefix(values: Column, prefix: str) -> Column:
    return F.get(F.filter(or_empty(values), lambda x: x.startswith(prefix)), F.lit(0))


def cpe_part(criteria: Column, index: int) -> Column:
    """Part ``index`` of a CPE string split on colons; null if it is short or empty."""
    return F.nullif(F.get(F.split(criteria, ":"), F.lit(index)), F.lit(""))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def shared(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` to six digits, ties to even; 0 for an empty whole."""
    return F.coalesce(F.bround(part / F.nullif(whole, F.lit(0)), 6), F.lit(0.0))
