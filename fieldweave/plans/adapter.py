"""Record pairs derived from the driver tables: orders on the left, their lines on the right.

The driver tables hold no vulnerability feeds, so a fixed rule gives both sides
the values that reach every branch of the comparators. Its scalar expressions
are plain SQL that Spark and the oracle engine read alike; everything built
from them (sets, URLs, spans, statuses) is computed by each side on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.operators.normalize import _affected, _shaped, _specific, references
from fieldweave.schemas import AFFECTED, RECORD

CVE_ID = "CASE WHEN o_orderkey % 97 = 0 THEN 'BAD-' || CAST(o_orderkey AS STRING) ELSE 'CVE-' || CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(o_orderkey AS STRING), 7, '0') END"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_SHIP = "CAST(CAST(l_shipdate AS DATE) AS STRING)"


def _n(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


#: Scalars of an order.
LEFT = {
    "l_label": "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' END",
    "l_pub": f"CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 13 = 0 THEN 'N/A' ELSE {_DAY} || 'T00:00:00.000' END",
    "l_summary": "CASE WHEN o_custkey % 4 = 0 THEN '  ' ELSE 'order ' || o_orderstatus END",
    "l_cwe1": f"CASE WHEN o_custkey % 6 <> 0 THEN 'CWE-' || {_n('o_custkey % 4')} END",
    "l_cwe2": f"CASE WHEN o_custkey % 6 <> 0 THEN 'CWE-' || {_n('o_custkey % 3')} END",
    "l_ref1": f"CASE WHEN o_custkey % 9 <> 0 THEN 'https://H' || {_n('o_custkey % 3')} || '.example.org/a/' || {_n('o_custkey % 2')} || '/' END",
    "l_ref2": f"CASE WHEN o_custkey % 9 <> 0 AND o_custkey % 2 = 0 THEN 'http://h' || {_n('(o_custkey + 1) % 4')} || '.example.org/b' END",
    "l_start": f"CASE WHEN o_custkey % 8 IN (1, 7) THEN '1.' || {_n('o_custkey % 3')} || '.0' END",
    "l_end_in": f"CASE WHEN o_custkey % 8 = 2 THEN '2.' || {_n('o_custkey % 4')} || '.5' END",
    "l_end_ex": f"CASE o_custkey % 8 WHEN 1 THEN '2.' || {_n('o_custkey % 4')} || '.0' WHEN 4 THEN '2.' || {_n('o_custkey % 4')} || '.0.1' WHEN 5 THEN '2024-01-0' || {_n('o_custkey % 9 + 1')} END",
    "l_version": f"CASE o_custkey % 8 WHEN 3 THEN '1.' || {_n('o_custkey % 5')} || '.0' WHEN 6 THEN '*' END",
}
#: Scalars of a line.
RIGHT = {
    "r_label": "CASE l_linenumber % 7 WHEN 1 THEN 'low' WHEN 2 THEN 'MODERATE' WHEN 3 THEN 'High' WHEN 4 THEN 'CRITICAL' WHEN 5 THEN 'URGENT' WHEN 6 THEN 'medium' END",
    "r_pub": f"CASE l_partkey % 5 WHEN 0 THEN {_DAY} || 'T00:00:00Z' WHEN 1 THEN {_DAY} || 'T05:00:00Z' WHEN 2 THEN {_SHIP} || 'T00:00:00Z' WHEN 4 THEN 'n/a' END",
    "r_summary": "CASE WHEN l_partkey % 3 <> 0 THEN 'line ' || l_returnflag END",
    "r_cwe1": f"CASE WHEN l_partkey % 7 <> 0 THEN 'cwe-' || {_n('l_partkey % 4')} END",
    "r_cwe2": f"CASE WHEN l_partkey % 7 <> 0 THEN ' CWE-' || {_n('l_suppkey % 3')} END",
    "r_ref1": f"CASE WHEN l_partkey % 9 <> 0 THEN 'https://h' || {_n('l_partkey % 3')} || '.example.org/a/' || {_n('l_partkey % 2')} END",
    "r_ref2": f"CASE WHEN l_partkey % 9 <> 0 AND l_suppkey % 2 = 0 THEN 'http://h' || {_n('(l_partkey + 1) % 4')} || '.example.org/b#x' END",
    "r_ref3": f"CASE WHEN l_partkey % 9 <> 0 AND l_suppkey % 5 = 0 THEN 'https://h' || {_n('l_partkey % 3')} || '.example.org/a/' || {_n('l_partkey % 2')} || '/' END",
    "r_start": f"CASE WHEN l_partkey % 6 = 2 THEN '0' WHEN l_partkey % 6 <> 0 THEN '1.' || {_n('l_partkey % 3')} || '.0' END",
    "r_end": f"CASE WHEN l_partkey % 6 = 4 THEN '2.' || {_n('(l_partkey + 1) % 4')} || '.0' WHEN l_partkey % 6 IN (1, 2, 5) THEN '2.' || {_n('l_partkey % 4')} || '.0' END",
    "r_fixed": f"CASE WHEN l_partkey % 6 = 4 THEN '2.' || {_n('(l_partkey + 1) % 4')} || '.0' WHEN l_partkey % 6 IN (1, 2) THEN '2.' || {_n('l_partkey % 4')} || '.0' END",
    "r_two": "l_partkey % 6 = 4",
}

def _pick(of: str, values: str) -> str:
    """SQL that takes a letter of ``values`` by a number."""
    return f"substr('{values}', CAST({of} % {len(values)} AS INT) + 1, 1)"


def _vector(head: str, n: str, minor: str = "") -> str:
    """SQL of a vector whose metrics follow from the number ``n`` at different strides."""
    return f"'{head}' || {minor}" + " || ".join(
        f"'{'/' if i else ''}{name}:' || {_pick(f'({n} + CAST(floor({n} / {stride}) AS BIGINT))', values)}"
        for i, (name, values, stride) in enumerate((("AV", "NALP", 3), ("AC", "LH", 5), ("PR", "NLH", 7), ("UI", "NR", 11), ("S", "UC", 13), ("C", "HLN", 17), ("I", "HLN", 19), ("A", "HLN", 23)))
    )


def _old_vector(n: str) -> str:
    return " || ".join(
        f"'{'/' if i else ''}{name}:' || {_pick(f'({n} + CAST(floor({n} / {stride}) AS BIGINT))', values)}"
        for i, (name, values, stride) in enumerate((("AV", "LAN", 3), ("AC", "HML", 5), ("Au", "MSN", 7), ("C", "NPC", 11), ("I", "NPC", 13), ("A", "NPC", 17)))
    )


#: Score vectors of both sides: of version 3 with either minor number, of version 2, and some that lack a metric or are null.
VECTORS = {
    "l_vector": f"CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN {_old_vector('o_orderkey')} ELSE "
    + _vector("CVSS:3.", "o_orderkey", "CAST(o_orderkey % 2 AS STRING) || '/' || ") + " END",
    "r_vector": "CASE WHEN l_linenumber % 7 = 6 THEN 'CVSS:3.1/AV:N/AC:L' WHEN l_linenumber % 7 = 5 THEN " + _old_vector("(o_orderkey + l_partkey % 3)")
    + " ELSE " + _vector("CVSS:3.1/", "(o_orderkey + l_partkey % 3)") + " END",
    "l_score": "CAST(o_orderkey % 101 AS DOUBLE) / 10",
}
#: The scalars of each side that its links and its affected spans are made of.
LINKS = {"nvd": ("l_ref1", "l_ref2"), "ghsa": ("r_ref1", "r_ref2", "r_ref3")}
SPANS = {"nvd": ("l_start", "l_end_in", "l_end_ex", "l_version"), "ghsa": ("r_start", "r_end", "r_fixed", "r_two")}
WEAKNESSES = {"nvd": ("l_cwe1", "l_cwe2"), "ghsa": ("r_cwe1", "r_cwe2")}
KEYS = ("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _present(*columns: str) -> Column:
    return F.array_compact(F.array(*[F.col(c) for c in columns]))


def _references(*columns: str) -> Column:
    return references(F.transform(_present(*columns), lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("array<string>").alias("tags"))))


def _severity(label: str) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(none.alias("metric_key"), F.lit(None).cast("double").alias("score"), F.col(label).alias("label"), none.alias("vector"), none.alias("source"))


def _list(when: Column, *items: Column) -> Column:
    return F.when(when, F.array(*items)).otherwise(F.array().cast(f"array<{AFFECTED}>"))


def _record(df: DataFrame, source: str, source_id: Column, published: str, cwe: Column, refs: Column, label: str, summary: str, affected: Column, path: Column, beside: tuple[str, ...] = ()) -> DataFrame:
    return _shaped(
        df,
        beside,
        source=F.lit(source),
        source_id=source_id,
        cve_id=F.col("cve_id"),
        aliases=F.array("cve_id"),
        summary=F.col(summary),
        published=F.col(published),
        last_modified=F.col(published),
        severity=_severity(label),
        cwe_ids=cwe,
        references=refs,
        affected=affected,
        source_specific=_specific(relative_path=path),
    )


def _left_columns() -> dict:
    affected = _list(
        F.coalesce("l_start", "l_end_in", "l_end_ex", "l_version").isNotNull(),
        _affected(
            source_type=F.lit("cpe"), product=F.lit("left"), package_name=F.lit(" Left "), version=F.col("l_version"), introduced=F.col("l_start"),
            version_start_including=F.col("l_start"), version_end_including=F.col("l_end_in"), version_end_excluding=F.col("l_end_ex"), vulnerable=F.lit(True),
        ),
    )
    return {"source": "nvd", "source_id": F.col("cve_id"), "published": "l_pub", "cwe": _present("l_cwe1", "l_cwe2"), "refs": _references("l_ref1", "l_ref2"),
            "label": "l_label", "summary": "l_summary", "affected": affected, "path": F.lit(None).cast("string")}


def _right_columns() -> dict:
    def item(start: Column, end: Column, fixed: Column) -> Column:
        return _affected(source_type=F.lit("ghsa"), product=F.lit("right"), version_start_including=start, introduced=start, version_end_excluding=end, fixed=fixed, vulnerable=F.lit(True))

    one = item(F.col("r_start"), F.col("r_end"), F.col("r_fixed"))
    two = item(F.lit("3.0.0"), F.lit("3.1.0"), F.lit("3.1.0"))
    affected = F.when(F.col("r_two"), F.array(one, two)).otherwise(_list(F.col("r_start").isNotNull(), one))
    place = F.format_string("%03d/%012d/%012d/%020.4f", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return {"source": "ghsa", "source_id": place, "published": "r_pub", "cwe": _present("r_cwe1", "r_cwe2"), "refs": _references("r_ref1", "r_ref2", "r_ref3"),
            "label": "r_label", "summary": "r_summary", "affected": affected, "path": place}


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def left_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared records of all orders."""
    orders, _ = _tables(spark, sf_dir)
    return _record(orders.selectExpr("*", f"{CVE_ID} AS cve_id", *[f"{v} AS {k}" for k, v in LEFT.items()]), **_left_columns())


def right_records(spark: SparkSession, sf_dir: str, *beside: str) -> DataFrame:
    """Shared records of all lines, and columns ``beside`` them."""
    orders, lines = _tables(spark, sf_dir)
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return _record(joined.selectExpr("*", f"{CVE_ID} AS cve_id", *[f"{v} AS {k}" for k, v in RIGHT.items()]), **_right_columns(), beside=beside)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its order."""
    orders, lines = _tables(spark, sf_dir)
    # one narrow shuffle spreads the rows: what follows is a map stage that costs far more than it reads
    # (a number of parts is not reduced by their size)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(parts, "l_orderkey").join(orders, lines["l_orderkey"] == orders["o_orderkey"])


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its order and the scalars of both."""
    scalars = {**LEFT, **RIGHT}
    return joined(spark, sf_dir).selectExpr("*", f"{CVE_ID} AS cve_id", *[f"{v} AS {k}" for k, v in scalars.items()])


def raw_values(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Scalars, named in ``names``, of all orders or of all lines; such as follow from one of these tables alone."""
    orders, lines = _tables(spark, sf_dir)
    table, scalars = (orders, LEFT) if set(names) <= LEFT.keys() else (lines, RIGHT)
    return table.selectExpr(*[f"{scalars[n]} AS {n}" for n in names])


def records_of(raw: DataFrame) -> DataFrame:
    """``raw`` with nvd and ghsa, the shared records that its scalars make; scalars and keys that it lacks are null."""
    kinds = {"cve_id": "string", **dict.fromkeys(KEYS, "bigint"), "l_extendedprice": "double", **dict.fromkeys({**LEFT, **RIGHT}, "string"), "r_two": "boolean"}
    whole = raw.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in raw.columns})

    def struct(parts: dict) -> Column:
        fields = {
            "source": F.lit(parts["source"]), "source_id": parts["source_id"], "cve_id": F.col("cve_id"), "aliases": F.array("cve_id"), "summary": F.col(parts["summary"]),
            "published": F.col(parts["published"]), "last_modified": F.col(parts["published"]), "severity": _severity(parts["label"]), "cwe_ids": parts["cwe"],
            "references": parts["refs"], "affected": parts["affected"], "source_specific": _specific(relative_path=parts["path"]),
        }
        return F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in RECORD])

    return whole.select(*raw.columns, struct(_left_columns()).alias("nvd"), struct(_right_columns()).alias("ghsa"))


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keys, cve_id, nvd, ghsa): every line with its order, as a pair of shared records."""
    return records_of(raw_pairs(spark, sf_dir)).select(*KEYS, "cve_id", "nvd", "ghsa")
