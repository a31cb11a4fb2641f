"""Interval algebra over version ranges, inside a row.

An end of a range is a cut in the order of versions: below a version (an
including start, an excluding end) or above it (an excluding start, an including
end), or before or after all versions. Every range is then the stretch between two cuts,
whatever its ends, and sets of ranges are swept cut by cut with the number
of ranges of each side that are open. Union, intersection, gaps and relation follow from
the stretches of one sweep.

A range with a bound that cannot be read has no place in the order; it is left
out and counted. Of bounds that are equal but spelled in two ways, the smaller text is shown. Ranges whose start is not before their end are empty. Null
arrays are empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.functions.text import let, or_empty
from fieldweave.functions.versions import version_key

_NUMBER = "struct<size: int, digits: string>"
KEY = f"struct<epoch: {_NUMBER}, release: array<{_NUMBER}>, pre: int, pre_n: {_NUMBER}, post: {_NUMBER}, dev: {_NUMBER}, local: array<struct<n: {_NUMBER}, s: string>>>"
_EFFECTIVE = "array<struct<lower_including: string, lower_excluding: string, upper_including: string, upper_excluding: string, version: string>>"
CUT = f"struct<at: struct<beyond: int, key: {KEY}, above: int>, version: string>"
RANGES = f"array<struct<lo: {CUT}, hi: {CUT}>>"
STRETCHES = f"array<struct<lo: {CUT}, hi: {CUT}, a: int, b: int>>"


def _cut(version: Column, above: int) -> Column:
    """The cut below or above a version; null if the version is null, with a null key if it cannot be read."""
    at = F.struct(F.lit(0).alias("beyond"), version_key(version).alias("key"), F.lit(above).alias("above"))
    return F.when(version.isNotNull(), F.struct(at.alias("at"), version.alias("version")))


def _beyond(where: int) -> Column:
    at = F.struct(F.lit(where).alias("beyond"), F.lit(None).cast(KEY).alias("key"), F.lit(0).alias("above"))
    return F.struct(at.alias("at"), F.lit(None).cast("string").alias("version"))


def _readable(cut: Column) -> Column:
    return cut.isNull() | cut["at"]["key"].isNotNull()


def ranges(effective: Column) -> Column:
    """Struct of ``of``, the ranges of effective spans, and ``unreadable``, how many could not be read; a version without bounds is a range."""

    def ends(s: Column) -> Column:
        point = F.when(F.coalesce(s["lower_including"], s["lower_excluding"], s["upper_including"], s["upper_excluding"]).isNull(), s["version"])
        cuts = {
            "li": _cut(F.coalesce(point, s["lower_including"]), 0), "le": _cut(s["lower_excluding"], 1),
            "ui": _cut(F.coalesce(point, s["upper_including"]), 1), "ue": _cut(s["upper_excluding"], 0),
        }
        return F.struct(*[c.alias(k) for k, c in cuts.items()])

    def placed(e: Column) -> Column:
        # of two starts the later one binds, of two ends the earlier one
        lo = F.coalesce(F.greatest(e["li"], e["le"]), _beyond(-1))
        hi = F.coalesce(F.least(e["ui"], e["ue"]), _beyond(1))
        fine = _readable(e["li"]) & _readable(e["le"]) & _readable(e["ui"]) & _readable(e["ue"])
        return F.struct(fine.alias("fine"), lo.alias("lo"), hi.alias("hi"))

    def told(found: Column) -> Column:
        kept = F.filter(found, lambda r: r["fine"] & (r["lo"]["at"] < r["hi"]["at"]))
        bare = F.transform(kept, lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi")))
        return F.struct(bare.alias("of"), F.size(F.filter(found, lambda r: ~r["fine"])).alias("unreadable"))

    found = F.transform(F.transform(or_empty(effective, _EFFECTIVE), ends), placed)
    return let(found, told)


def sweep(left: Column, right: Column) -> Column:
    """Stretches between neighbouring cuts that a range covers, with how many of each side do."""

    def events(of: Column, a: int, b: int) -> Column:
        def of_range(r: Column) -> Column:
            return F.array(*[F.struct(r[end].alias("cut"), F.lit(sign * a).alias("a"), F.lit(sign * b).alias("b")) for end, sign in (("lo", 1), ("hi", -1))])

        return F.flatten(F.transform(of, of_range))

    start = F.struct(F.array().cast(STRETCHES).alias("done"), F.lit(None).cast(CUT).alias("cut"), F.lit(0).alias("a"), F.lit(0).alias("b"))

    def step(acc: Column, e: Column) -> Column:
        wide = (acc["a"] + acc["b"] > 0) & (acc["cut"]["at"] < e["cut"]["at"])
        one = F.array(F.struct(acc["cut"].alias("lo"), e["cut"].alias("hi"), acc["a"].alias("a"), acc["b"].alias("b")))
        done = F.when(wide, F.concat(acc["done"], one)).otherwise(acc["done"])
        cut = F.when(acc["cut"]["at"] == e["cut"]["at"], acc["cut"]).otherwise(e["cut"])  # of equal cuts the least spelling
        return F.struct(done.alias("done"), cut.alias("cut"), (acc["a"] + e["a"]).alias("a"), (acc["b"] + e["b"]).alias("b"))

    return F.aggregate(F.sort_array(F.concat(events(left, 1, 0), events(right, 0, 1))), start, step, lambda acc: acc["done"])


def merged(stretches: Column, keep) -> Column:
    """The stretches that ``keep(a, b)`` holds for, those that touch joined: a normalised set of ranges."""
    kept = F.filter(stretches, lambda s: keep(s["a"], s["b"]))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), s["hi"].alias("hi"))))
        fresh = F.concat(acc, F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))
        return F.when(F.size(acc) == 0, fresh).when(last["hi"]["at"] == s["lo"]["at"], grown).otherwise(fresh)

    return F.aggregate(kept, F.array().cast(RANGES), step)


def union(stretches: Column) -> Column:
    return merged(stretches, lambda a, b: a + b > 0)


def intersection(stretches: Column) -> Column:
    return merged(stretches, lambda a, b: (a > 0) & (b > 0))


def only_left(stretches: Column) -> Column:
    return merged(stretches, lambda a, b: (a > 0) & (b == 0))


def only_right(stretches: Column) -> Column:
    return merged(stretches, lambda a, b: (a == 0) & (b > 0))


def gaps(of: Column) -> Column:
    """What lies between the first and the last of normalised ranges and in none of them."""
    inner = F.greatest(F.size(of) - 1, F.lit(0))
    return F.zip_with(F.slice(of, 1, inner), F.slice(of, 2, inner), lambda x, y: F.struct(x["hi"].alias("lo"), y["lo"].alias("hi")))


def relation(left: Column, right: Column, stretches: Column) -> Column:
    """equal, subset (left in right), superset, overlap or disjoint; ``empty`` if a side has no range."""
    both, a, b = (F.exists(stretches, c) for c in (lambda s: (s["a"] > 0) & (s["b"] > 0), lambda s: s["b"] == 0, lambda s: s["a"] == 0))
    return (
        F.when((F.size(left) == 0) | (F.size(right) == 0), "empty")
        .when(~both, "disjoint").when(~a & ~b, "equal").when(~a, "subset").when(~b, "superset").otherwise("overlap")
    )


def spelled(of: Column) -> Column:
    """Ranges as text: ``[1.0,2.0)``, open where a side has no end; joined by a bar."""

    def one(r: Column) -> Column:
        lo, hi = r["lo"], r["hi"]
        first = F.when((lo["at"]["beyond"] < 0) | (lo["at"]["above"] == 1), "(").otherwise("[")
        last = F.when((hi["at"]["beyond"] == 0) & (hi["at"]["above"] == 1), "]").otherwise(")")
        return F.concat(first, F.coalesce(lo["version"], F.lit("")), F.lit(","), F.coalesce(hi["version"], F.lit("")), last)

    return F.array_join(F.transform(of, one), "|")


def compared(left: Column, right: Column) -> Column:
    """Struct of relation, shared, left_only, right_only, union and unreadable of two arrays of effective spans."""

    def told(x: Column) -> Column:
        left, right = x["left"]["of"], x["right"]["of"]

        def of_sweep(s: Column) -> Column:
            return F.struct(
                relation(left, right, s).alias("relation"), intersection(s).alias("shared"), only_left(s).alias("left_only"), only_right(s).alias("right_only"),
                union(s).alias("union"), (x["left"]["unreadable"] + x["right"]["unreadable"]).alias("unreadable"),
            )

        return let(sweep(left, right), of_sweep)

    return let(F.struct(ranges(left).alias("left"), ranges(right).alias("right")), told)
