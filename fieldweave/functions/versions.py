"""Versions and version-bound spans.

``version_key`` gives an orderable struct for a version of the public Python
scheme (PEP 440), so that Spark compares versions without a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.functions.text import let, major_minor, or_empty, truthy

_VERSION = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d+)?)?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d+)?)?"
    r"(?:[-_.]?(dev)[-_.]?(\d+)?)?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
_SEP = "\x01"
_CUT = _SEP.join(f"${g}" for g in range(1, 11))
_NUMBER = "struct<size: int, digits: string>"


def _number(digits: Column) -> Column:
    """An orderable form of a whole number of any length: how many digits it has without leading zeros, and those."""
    bare = F.ltrim(digits, F.lit("0"))
    return F.struct(F.length(bare).alias("size"), bare.alias("digits"))


def _bound(size: int) -> Column:
    """Before all numbers (-1) or after them."""
    return F.struct(F.lit(size).alias("size"), F.lit("").alias("digits"))


_NONE, _LAST = -1, 2**31 - 1


def _release(dotted: Column) -> Column:
    """The numbers between dots, without zeros at the end."""
    return F.transform(F.split(F.regexp_replace(dotted, r"(\.0+)+$", ""), r"\."), _number)


def version_key(value: Column) -> Column:
    """Orderable key of a version; null for null, empty and invalid ones."""
    # one pass of the expression cuts the string into its ten parts
    parts = F.split(F.regexp_replace(value, _VERSION, _CUT), _SEP)

    def keyed(p: Column) -> Column:
        def text(i: int) -> Column:
            return F.lower(F.get(p, F.lit(i)))

        def number(i: int) -> Column:
            return _number(F.coalesce(text(i), F.lit("")))

        release = _release(text(1))
        pre, post, dev = text(2), (text(4) != "") | (text(5) != ""), text(7) != ""
        rank = (
            F.when(pre.isin("a", "alpha"), 0).when(pre.isin("b", "beta"), 1).when(pre != "", 2).when(dev & ~post, -1).otherwise(3)
        )
        post_n = F.when(text(4) != "", number(4)).when(text(5) != "", number(6)).otherwise(_bound(_NONE))
        local = F.when(
            text(9) != "",
            F.transform(
                F.split(text(9), "[-_.]"),
                lambda x: F.struct(
                    F.when(x.rlike(r"^\d+$"), _number(x)).otherwise(_bound(_NONE)).alias("n"),
                    F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("s"),
                ),
            ),
        ).otherwise(F.array().cast(f"array<struct<n: {_NUMBER}, s: string>>"))
        return F.struct(
            number(0).alias("epoch"),
            release.alias("release"),
            rank.alias("pre"),
            number(3).alias("pre_n"),
            post_n.alias("post"),
            F.when(dev, number(8)).otherwise(_bound(_LAST)).alias("dev"),
            local.alias("local"),
        )

    # most versions are dotted numbers and need no more than their parts
    plain = F.struct(
        _number(F.lit("")).alias("epoch"), _release(value).alias("release"), F.lit(3).alias("pre"), _number(F.lit("")).alias("pre_n"),
        _bound(_NONE).alias("post"), _bound(_LAST).alias("dev"), F.array().cast(f"array<struct<n: {_NUMBER}, s: string>>").alias("local"),
    )
    return F.when(value.rlike(r"^\d+(?:\.\d+)*\z"), plain).when(F.coalesce(value.rlike(_VERSION), F.lit(False)), let(parts, keyed))


SPAN = (
    "version_start_including",
    "version_start_excluding",
    "version_end_including",
    "version_end_excluding",
    "fixed",
    "introduced",
    "version",
)
_OPEN_START, _OPEN_END = ("", "0"), ("", "*", "-")
SPAN_TYPE = "array<struct<" + ", ".join(f"{f}: string" for f in SPAN) + ">>"


def spans(affected: Column) -> Column:
    """Canonical version-bound spans: open bounds null, empty spans dropped, a set, nulls first."""

    def clean(item: Column) -> Column:
        fields = []
        for name in SPAN:
            none = _OPEN_START if "start" in name or name == "introduced" else _OPEN_END
            fields.append(F.when(~item[name].isin(*none), item[name]).alias(name))
        return F.struct(*fields)

    def bounded(s: Column) -> Column:
        return F.coalesce(*[s[f] for f in SPAN]).isNotNull()

    kept = F.filter(F.transform(affected, clean), bounded)
    return or_empty(F.sort_array(F.array_distinct(kept)), SPAN_TYPE)


def lower_including(span: Column) -> Column:
    return F.coalesce(span["version_start_including"], span["introduced"])


def upper_excluding(span: Column) -> Column:
    return F.coalesce(span["version_end_excluding"], span["fixed"])


def effective(of: Column) -> Column:
    """Spans with synonymous bounds merged; a version counts only without bounds."""

    def merge(s: Column) -> Column:
        bounds = [lower_including(s), s["version_start_excluding"], s["version_end_including"], upper_excluding(s)]
        names = ("lower_including", "lower_excluding", "upper_including", "upper_excluding")
        version = F.when(F.coalesce(*bounds).isNull(), s["version"])
        return F.struct(*[b.alias(n) for b, n in zip(bounds, names, strict=True)], version.alias("version"))

    return F.array_distinct(F.transform(of, merge))


def endpoints(effective_spans: Column) -> Column:
    """Upper endpoints of effective spans; a span without any gives a pair of nulls."""
    return F.transform(effective_spans, lambda s: F.struct(s["upper_including"].alias("i"), s["upper_excluding"].alias("e")))


def point_version(span: Column) -> Column:
    """The version of a span without bounds, else null."""
    return F.when(F.coalesce(*[span[f] for f in SPAN[:-1]]).isNull(), span["version"])


def keyed_ranges(of: Column) -> Column:
    """Spans as ranges of version keys."""
    return F.transform(
        of,
        lambda s: F.struct(
            version_key(lower_including(s)).alias("li"),
            version_key(s["version_start_excluding"]).alias("le"),
            version_key(s["version_end_including"]).alias("ui"),
            version_key(upper_excluding(s)).alias("ue"),
        ),
    )


def in_range(key: Column, r: Column) -> Column:
    """Whether a key lies in a range; unreadable bounds are open, a range without bounds holds nothing."""
    bounded = r["li"].isNotNull() | r["le"].isNotNull() | r["ui"].isNotNull() | r["ue"].isNotNull()
    return (
        bounded
        & (r["li"].isNull() | (key >= r["li"]))
        & (r["le"].isNull() | (key > r["le"]))
        & (r["ui"].isNull() | (key <= r["ui"]))
        & (r["ue"].isNull() | (key < r["ue"]))
    )


def points_covered(points_of: Column, ranges_of: Column) -> Column:
    """Whether every span on the left is a readable point inside some range on the right; empty left: no."""
    ranges = keyed_ranges(ranges_of)

    def all_in(rs: Column) -> Column:
        keys = F.transform(points_of, lambda s: version_key(point_version(s)))
        return F.forall(keys, lambda k: k.isNotNull() & F.coalesce(F.exists(rs, lambda r: F.coalesce(in_range(k, r), F.lit(False))), F.lit(False)))

    return (F.size(points_of) > 0) & F.coalesce(let(ranges, all_in), F.lit(False))


def share_major_minor(left: Column, right: Column) -> Column:
    """Whether two version sets share a major.minor prefix."""
    a = F.array_compact(F.transform(left, major_minor))
    b = F.array_compact(F.transform(right, major_minor))
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def bound_set(of: Column, bound) -> Column:
    """Non-empty values of a bound over spans."""
    return F.filter(F.transform(of, bound), truthy)
