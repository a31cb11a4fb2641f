"""CVSS vectors: their metrics as a map, and base scores by the public formulas as column arithmetic.

Versions 2.0, 3.0 and 3.1 are scored; any other vector, one that lacks a base metric, names one twice or has
an unknown value has no score. Metrics beyond the base ones are kept in the map and do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.text import let

# Weights of the base metrics in the public specifications.
V3 = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "UI": {"N": 0.85, "R": 0.62},
    "S": {"U": 0.0, "C": 1.0},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
V2 = {
    "AV": {"L": 0.395, "A": 0.646, "N": 1.0},
    "AC": {"H": 0.35, "M": 0.61, "L": 0.71},
    "Au": {"M": 0.45, "S": 0.56, "N": 0.704},
    "C": {"N": 0.0, "P": 0.275, "C": 0.66},
    "I": {"N": 0.0, "P": 0.275, "C": 0.66},
    "A": {"N": 0.0, "P": 0.275, "C": 0.66},
}
_V3_HEAD = r"^CVSS:3\.[01]/"


def version(vector: Column) -> Column:
    """2.0, 3.0, 3.1, another number that the vector names, or null."""
    named = F.nullif(F.regexp_extract(vector, r"^CVSS:(\d+\.\d+)/", 1), F.lit(""))
    return F.coalesce(named, F.when(vector.rlike(r"^\(?AV:[LAN]/AC:[HML]/Au:"), "2.0"))


def metrics(vector: Column) -> Column:
    """Metric to value; null for a null vector, one without pairs, or one that names a metric twice."""
    bare = F.regexp_replace(vector, r"^CVSS:\d+\.\d+/|[()]", "")
    pairs = F.filter(F.split(bare, "/"), lambda p: p.rlike(r"^[A-Za-z]+:[A-Za-z]+$"))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.substring_index(p, ":", -1).alias("v")))
    names = F.transform(entries, lambda e: e["k"])
    return F.when((F.size(entries) > 0) & (F.size(F.array_distinct(names)) == F.size(names)), F.map_from_entries(entries))


def _weight(of: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for value, weight in table.items():
        out = F.when(of == value, weight).otherwise(out)
    return out


def _weights(m: Column, tables: dict[str, dict[str, float]]) -> dict[str, Column]:
    return {name: _weight(m[name], table) for name, table in tables.items()}


def _loss(w: Column) -> Column:
    """1 less the product of what each loss leaves."""
    return 1.0 - (1.0 - w["C"]) * (1.0 - w["I"]) * (1.0 - w["A"])


def _impact_v3(w: Column, iss: Column) -> Column:
    return F.when(w["S"] == 1.0, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).when(w["S"] == 0.0, 6.42 * iss)


def _ease_v3(w: Column) -> Column:
    return 8.22 * w["AV"] * w["AC"] * w["PR"] * w["UI"]


def _raw_v3(w: Column, impact: Column, ease: Column) -> Column:
    return F.when(w["S"] == 1.0, 1.08 * (impact + ease)).otherwise(impact + ease)


def _capped(raw: Column) -> Column:
    return F.when(raw > 10.0, 10.0).otherwise(raw)


def _up(x: Column, minor: Column) -> Column:
    """The next tenth, as the version's text has it."""
    fine = F.round(x * 100000.0).cast("long")
    newer = F.when(fine % 10000 == 0, fine / 100000.0).otherwise((F.floor(fine / 10000.0) + 1) / 10.0)
    # the older text rounds up plainly; what rounding of the machine adds is taken off first
    return F.when(minor == "3.1", newer).otherwise(F.ceil(F.round(x * 10.0, 9)) / 10.0)


def _of_parts_v3(impact: Column, ease: Column, rounded: Column) -> Column:
    return F.when(ease.isNotNull(), F.when(impact <= 0, 0.0).otherwise(rounded))


def _ease_v2(w: Column) -> Column:
    return 20.0 * w["AV"] * w["AC"] * w["Au"]


def _of_parts_v2(impact: Column, ease: Column) -> Column:
    whole = F.round((0.6 * impact + 0.4 * ease - 1.5) * 1.176, 1)
    return F.when(impact == 0, F.when(ease.isNotNull(), 0.0)).otherwise(whole)


def _score_v3(m: Column, minor: Column) -> Column:
    weights = _weights(m, V3)
    weights["PR"] = F.when(weights["S"] == 1.0, _weight(m["PR"], PR_CHANGED)).otherwise(weights["PR"])

    def of_weights(w: Column) -> Column:
        def of_loss(iss: Column) -> Column:
            return F.struct(_impact_v3(w, iss).alias("impact"), _ease_v3(w).alias("ease"))

        def of_parts(x: Column) -> Column:
            raw = _raw_v3(w, x["impact"], x["ease"])
            return _of_parts_v3(x["impact"], x["ease"], let(_capped(raw), lambda r: _up(r, minor)))

        return let(let(_loss(w), of_loss), of_parts)

    return let(F.struct(*[c.alias(k) for k, c in weights.items()]), of_weights)


def _score_v2(m: Column) -> Column:
    def of_weights(w: Column) -> Column:
        return let(10.41 * _loss(w), lambda impact: _of_parts_v2(impact, _ease_v2(w)))

    return let(F.struct(*[c.alias(k) for k, c in _weights(m, V2).items()]), of_weights)


def base_score(vector: Column) -> Column:
    """The base score recomputed from a vector; null if it has none."""

    def of(x: Column) -> Column:
        return F.when(x["n"].isin("3.0", "3.1"), _score_v3(x["m"], x["n"])).when(x["n"] == "2.0", _score_v2(x["m"]))

    return let(F.struct(version(vector).alias("n"), metrics(vector).alias("m")), of)


def differing(left: Column, right: Column) -> Column:
    """Sorted ``metric:left>right`` of what two maps of metrics say differently; a dash for what one lacks. Null if either is null."""

    def of(x: Column) -> Column:
        names = F.array_sort(F.array_union(F.map_keys(x["a"]), F.map_keys(x["b"])))

        def told(k: Column) -> Column:
            a, b = (F.coalesce(F.try_element_at(x[s], k), F.lit("-")) for s in ("a", "b"))
            return F.when(a != b, F.concat(k, F.lit(":"), a, F.lit(">"), b))

        return F.array_compact(F.transform(names, told))

    return F.when(left.isNotNull() & right.isNotNull(), let(F.struct(left.alias("a"), right.alias("b")), of))


def _ending(names: tuple[str, ...]) -> str:
    """An expression of metrics with values of one letter, in this order, that may end after any of them."""
    out = ""
    for name in reversed(names):
        out = f"(?:/{name}:[A-Za-z]{out})?"
    return out


# Common vectors hold base metrics only, in the order of the specification, and may end early: a value stands at a fixed place.
_COMMON_V3 = r"^CVSS:3\.[01]/AV:[A-Za-z]" + _ending(("AC", "PR", "UI", "S", "C", "I", "A")) + r"\z"
_COMMON_V2 = r"^AV:[LAN]/AC:[HML]/Au:[A-Za-z]" + _ending(("C", "I", "A")) + r"\z"
_PLACES_V3 = {"AV": 13, "AC": 18, "PR": 23, "UI": 28, "S": 32, "C": 36, "I": 40, "A": 44}
_PLACES_V2 = {"AV": 4, "AC": 9, "Au": 14, "C": 18, "I": 22, "A": 26}
_NAMES = tuple(sorted(_PLACES_V3.keys() | _PLACES_V2.keys()))


def consistency(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with ``left_base`` and ``right_base``, what ``base_score`` gives for two columns of vectors, and ``differing`` of their metrics.

    Values of common vectors are columns, and a score goes on from column to column, compiled; all other vectors
    take the expressions above, which are evaluated node by node.
    """
    sides = {"left": F.col(left), "right": F.col(right)}
    new = []

    def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        new.extend(columns)
        return df.withColumns(columns)

    def of(side: str, prefix: str, names) -> dict[str, Column]:
        return {n: F.col(f"_{side}_{prefix}{n}") for n in names}

    def letter(side: str, name: str) -> Column:
        vector, n, out = sides[side], F.col(f"_{side}_n"), F.lit(None).cast("string")
        if name in _PLACES_V2:
            out = F.when(n == "2.0", F.nullif(F.substring(vector, _PLACES_V2[name], 1), F.lit("")))
        if name in _PLACES_V3:
            out = F.when(n != "2.0", F.nullif(F.substring(vector, _PLACES_V3[name], 1), F.lit(""))).otherwise(out)
        return out

    def weight(side: str, name: str) -> Column:
        n, m = F.col(f"_{side}_n"), F.col(f"_{side}_m{name}")
        older = _weight(m, V2[name]) if name in V2 else F.lit(None).cast("double")
        newer = _weight(m, V3[name]) if name in V3 else F.lit(None).cast("double")
        if name == "PR":
            newer = F.when(F.col(f"_{side}_mS") == "C", _weight(m, PR_CHANGED)).otherwise(newer)
        return F.when(n == "2.0", older).otherwise(newer)

    df = staged(pairs, {f"_{s}_n": F.when(v.rlike(_COMMON_V3), F.substring(v, 6, 3)).when(v.rlike(_COMMON_V2), "2.0") for s, v in sides.items()})
    df = staged(df, {f"_{s}_m{name}": letter(s, name) for s in sides for name in _NAMES})
    df = staged(df, {f"_{s}_w{name}": weight(s, name) for s in sides for name in _NAMES})
    w = {s: of(s, "w", _NAMES) for s in sides}
    df = staged(df, {f"_{s}_loss": _loss(w[s]) for s in sides})
    parts = {}
    for s in sides:
        loss, older = F.col(f"_{s}_loss"), F.col(f"_{s}_n") == "2.0"
        parts[f"_{s}_impact"] = F.when(older, 10.41 * loss).otherwise(_impact_v3(w[s], loss))
        parts[f"_{s}_ease"] = F.when(older, _ease_v2(w[s])).otherwise(_ease_v3(w[s]))
    df = staged(df, parts)
    impact, ease = ({s: F.col(f"_{s}_{p}") for s in sides} for p in ("impact", "ease"))
    df = staged(df, {f"_{s}_raw": _raw_v3(w[s], impact[s], ease[s]) for s in sides})
    df = staged(df, {f"_{s}_top": _capped(F.col(f"_{s}_raw")) for s in sides})

    scores = {}
    for s, vector in sides.items():
        n = F.col(f"_{s}_n")
        newer = _of_parts_v3(impact[s], ease[s], _up(F.col(f"_{s}_top"), n))
        scores[f"{s}_base"] = F.when(n == "2.0", _of_parts_v2(impact[s], ease[s])).when(n.isNotNull(), newer).otherwise(base_score(vector))
    told = []
    for name in _NAMES:
        a, b = (F.coalesce(F.col(f"_{s}_m{name}"), F.lit("-")) for s in sides)
        told.append(F.when(a != b, F.concat(F.lit(f"{name}:"), a, F.lit(">"), b)))
    both = F.col("_left_n").isNotNull() & F.col("_right_n").isNotNull()
    scores["differing"] = F.when(both, F.array_compact(F.array(*told))).otherwise(differing(metrics(sides["left"]), metrics(sides["right"])))
    return df.withColumns(scores).drop(*new)
