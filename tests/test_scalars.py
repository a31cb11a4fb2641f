"""Scalar functions against Python's own, row by row."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import dates, text, urls, versions


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_normalize_text_strips_unicode_white_space(spark):
    rows = ["  A b ", "", " \t\n", None, " X　", "\x1cY\x1f", "É"]
    expected = [None if x is None or not x.strip() else x.strip().lower() for x in rows]
    assert values(spark, rows, text.normalize_text) == expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        (" ", "https://"),
        ("example.com/a", "https:example.com/a"),
        ("//ex.com/x", "https://ex.com/x"),
        ("http://ex.com/?", "http://ex.com"),
        ("mailto:a@b.c", "mailto:a@b.c"),
        ("HTTP://User@EX.com:80/a//?q=1#f", "http://user@ex.com:80/a?q=1"),
        ("http:/a", "http:///a"),
        ("#frag", "https://"),
        ("http://e\nx.com/a\tb", "http://ex.com/ab"),
        ("", None),
        (None, None),
        ("http://[bad/", "http://[bad"),
    ],
)
def test_canonical_url(spark, url, expected):
    assert values(spark, [url], urls.canonical_url) == [expected]


def test_canonical_url_twice_is_once(spark):
    rows = ["http://A.b/c//", "https://x.y/z?q", "ftp://h/p/#f"]
    once = values(spark, rows, urls.canonical_url)
    assert values(spark, once, urls.canonical_url) == once


def test_parse_iso_agrees_with_python(spark):
    rows = [
        "2023-01-01T00:15:07.380", "2023-01-01T00:15:07Z", "2023-01-01T10:00:00+05:30", "2023-01-01T10", "2023-01-01 10:00", "2023-01-01", "20230101", "2023", "2023-01", "2023-1-1",
        " 2023-01-01", "10:00", "2023-01-01T24:00:00", "2023-02-30", "2023-01-01x10:00", "2023-01-01T10:00:00+0530", "2023-01-01T10:00:00-05", "2023-01-01T10:00:00.123456789", "2023-01-01T10:00:00,5",
        "20230101T101507", "20230101T1015", "20230101 101507.25Z", "20230101T10:15", "2023-01-01T1015", "2023-01-01T10:1507", "2023-W01", "2023-W01-3", "2023W013", "2020-W53-7", "2023-W53-1", "2023-W00-1",
        "2023-W01-8", "2023W01T10:00Z", "2023-W10-2T101500+0200", "20231301", "2023-01-01Z", "20230101Z", "2023-W01-3Z", "2023-W1-3", "20230101T1",
        "n/a", "", None,
    ]

    def python(x):
        try:
            t = datetime.fromisoformat(x.replace("Z", "+00:00"))
        except (ValueError, AttributeError):
            return None
        t = t if t.tzinfo else t.replace(tzinfo=UTC)
        return t.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")

    got = values(spark, rows, lambda x: F.date_format(dates.parse_iso(x), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    assert got == [python(x) for x in rows]


def test_version_keys_order_as_the_public_scheme(spark):
    packaging = pytest.importorskip("packaging.version")
    rng = random.Random(3)
    pieces = ["", "a1", "b", "rc2", ".post1", "-2", ".dev3", "+l.1", "+ab", "a1.dev2", "rc1.post2.dev3", "_beta_2", ".preview"]
    rows = [f"{rng.choice(['', '', 'v', '1!'])}{'.'.join(str(rng.choice([0, 0, 1, 2, 10])) for _ in range(rng.randint(1, 4)))}{rng.choice(pieces)}" for _ in range(120)]
    rows += ["1." + "9" * 40, "1." + "0" * 50 + "1" + "0" * 40, f"1.0+{'7' * 45}", f"1.0.dev{'3' * 60}", f"{'8' * 39}!1.0"]
    rows += ["1.x", "1.0.0.RELEASE", "1.0.0-SNAPSHOT", "2023-01-01", "1.0-1", "20230101", "", " 1.0 ", "1.0\n", ""]

    def parsed(x):
        try:
            return packaging.Version(x)
        except packaging.InvalidVersion:
            return None

    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows[:-1])], "i int, x string").select("i", "x", versions.version_key(F.col("x")).alias("k"))
    known = {r["i"]: r["k"] is not None for r in df.collect()}
    assert known == {i: parsed(x) is not None for i, x in enumerate(rows[:-1])}
    pairs = df.alias("a").join(df.alias("b"), F.col("a.i") < F.col("b.i")).where("a.k is not null and b.k is not null")
    for r in pairs.select("a.x", F.col("b.x").alias("y"), (F.col("a.k") < F.col("b.k")).alias("lt"), (F.col("a.k") == F.col("b.k")).alias("eq")).collect():
        a, b = parsed(r["x"]), parsed(r["y"])
        assert (r["lt"], r["eq"]) == (a < b, a == b), (r["x"], r["y"])


def test_small_helpers(spark):
    assert values(spark, ["CVE-2023-1", "CVE-2023", "X-1", None, "CVE-2024-1-2"], text.cve_year) == ["2023", "unknown", "unknown", "unknown", "2024"]
    assert values(spark, ["1.2.3", "1", "1..2", None, "a.b"], text.major_minor) == ["1.2", None, "1.2", None, "a.b"]
    assert values(spark, ["2024-01-01", "2024-1-1", None], text.date_like) == [True, False, False]
    assert values(spark, ["cpe:2.3:a:v:p:1.0:*", "cpe:2.3:a:v", None, "cpe:2.3:a::p"], lambda c: text.cpe_part(c, 3)) == ["v", "v", None, None]
    assert values(spark, [[" cwe-79 ", "CWE-79", "", None], None], text.cwe_set, "array<string>") == [["CWE-79"], []]


def test_ratio_is_guarded(spark):
    row = spark.range(1).select(text.ratio(F.lit(1), F.lit(0)).alias("a"), text.ratio(F.lit(1), F.lit(3)).alias("b")).first()
    assert tuple(row) == (0.0, 0.333333)
