"""The study operators on odd rows and against plain Python."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions.versions import effective, spans, version_key
from fieldweave.operators import cvss, evaluation, evidence, history, ranges, sampling, taxonomy
from fieldweave.schemas import AFFECTED_FIELDS


# --- ranges -----------------------------------------------------------------------
def spans_of(spark, sides):
    """One row for each pair of lists of (start_in, start_ex, end_in, end_ex, version)."""
    names = ("version_start_including", "version_start_excluding", "version_end_including", "version_end_excluding", "version")
    kind = "array<struct<" + ", ".join(f"{f}: string" for f in AFFECTED_FIELDS if f != "vulnerable") + ">>"
    rows = [(i, *([dict(zip(names, s, strict=True)) for s in side] if side is not None else None for side in pair)) for i, pair in enumerate(sides)]
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}")
    told = df.select("i", ranges.compared(effective(spans(F.col("a"))), effective(spans(F.col("b")))).alias("r"))
    spelled = [ranges.spelled(F.col(f"r.{c}")).alias(c) for c in ("shared", "left_only", "right_only", "union")]
    return [tuple(r)[1:] for r in told.select("i", "r.relation", *spelled, ranges.spelled(ranges.gaps(F.col("r.union"))), "r.unreadable").orderBy("i").collect()]


def span(lo=None, hi=None, open_lo=False, closed_hi=False):
    return (None if open_lo else lo, lo if open_lo else None, hi if closed_hi else None, None if closed_hi else hi, None)


def test_ranges(spark):
    point = (None, None, None, None, "1.5")
    cases = {
        ((span("1", "2"),), (span("1.0", "2.0.0"),)): ("equal", "[1,2)", "", "", "[1,2)", "", 0),
        ((span("1", "2"),), (span("2", "3"),)): ("disjoint", "", "[1,2)", "[2,3)", "[1,3)", "", 0),
        ((span("1", "2", closed_hi=True),), (span("2", "3"),)): ("overlap", "[2,2]", "[1,2)", "(2,3)", "[1,3)", "", 0),
        ((span("1", "2"),), (span("2", "3", open_lo=True),)): ("disjoint", "", "[1,2)", "(2,3)", "[1,2)|(2,3)", "[2,2]", 0),
        ((point,), (span("1", "2"),)): ("subset", "[1.5,1.5]", "", "[1,1.5)|(1.5,2)", "[1,2)", "", 0),
        ((span(None, "2"),), (span("1", None),)): ("overlap", "[1,2)", "(,1)", "[2,)", "(,)", "", 0),
        ((span("1", "3"), span("2", "4"), span("7", "8")), (span("1", "4"),)): ("superset", "[1,4)", "[7,8)", "", "[1,4)|[7,8)", "[4,7)", 0),
        ((span("nonsense!", "2"), span("1", "2")), (span("1", "2"),)): ("equal", "[1,2)", "", "", "[1,2)", "", 1),
        ((span("3", "2"),), (span("1", "2"),)): ("empty", "", "", "[1,2)", "[1,2)", "", 0),
        ((), ()): ("empty", "", "", "", "", "", 0),
        (None, (span("1rc1", "1"),)): ("empty", "", "", "[1rc1,1)", "[1rc1,1)", "", 0),
    }
    got = spans_of(spark, list(cases))
    assert dict(zip(cases, got, strict=True)) == cases


def test_sweep_against_points(spark):
    """Random sets of ranges over ten versions, checked at each and between."""
    rng = random.Random(5)
    one = lambda: span(*map(str, sorted(rng.sample(range(1, 11), 2), key=int)), rng.random() < 0.5, rng.random() < 0.5)
    cases = [(tuple(one() for _ in range(rng.randint(1, 4))), tuple(one() for _ in range(rng.randint(1, 4)))) for _ in range(60)]
    halves = [x / 2 for x in range(24)]

    def holds(side, x):
        return any((float(s[0]) <= x if s[0] else float(s[1]) < x) and (x <= float(s[2]) if s[2] else x < float(s[3])) for s in side)

    def told(text, x):
        parts = [(p[0], *map(float, p[1:-1].split(",")), p[-1]) for p in filter(None, text.split("|"))]
        return any((lo <= x if a == "[" else lo < x) and (x <= hi if b == "]" else x < hi) for a, lo, hi, b in parts)

    for (left, right), (relation, shared, left_only, right_only, union, *_) in zip(cases, spans_of(spark, cases), strict=True):
        a, b = [holds(left, x) for x in halves], [holds(right, x) for x in halves]
        assert [told(shared, x) for x in halves] == [x and y for x, y in zip(a, b, strict=True)]
        assert [told(left_only, x) for x in halves] == [x and not y for x, y in zip(a, b, strict=True)]
        assert [told(right_only, x) for x in halves] == [y and not x for x, y in zip(a, b, strict=True)]
        assert [told(union, x) for x in halves] == [x or y for x, y in zip(a, b, strict=True)]
        assert (relation == "equal") == (not left_only and not right_only) and (relation == "disjoint") == (not shared)


def test_plain_versions_have_the_keys_of_others(spark):
    versions = ["1", "1.0", "01.2", "1.2.0", "v1.2", "1.2 ", "0", "0.0", "1.10", "99999999999999999999.1", "1.2rc1", "", None, "x"]
    keys = {r["v"]: r["k"] for r in spark.createDataFrame([(v,) for v in versions], "v string").select("v", version_key(F.col("v")).alias("k")).collect()}
    assert keys["1"] == keys["1.0"] and keys["01.2"] == keys["1.2.0"] == keys["v1.2"] == keys["1.2 "] and keys["0"] == keys["0.0"]
    assert keys["1.2rc1"] != keys["1.2.0"] and keys["x"] is keys[""] is keys[None] is None


# --- taxonomy ---------------------------------------------------------------------
def test_closure_and_relations(spark):
    rng = random.Random(2)
    edges = [(str(c), str(p)) for c in range(1, 40) for p in {rng.randrange(c), rng.randrange(c)} if c % 13] + [("5", "5"), (None, "1"), ("1", None)]
    up = {str(i): {str(i): 0} for i in range(40)}
    changed = True
    while changed:
        changed = False
        for c, p in edges:
            if None not in (c, p) and c != p:
                for a, d in list(up[p].items()):
                    if up[c].get(a, 99) > d + 1:
                        up[c][a], changed = d + 1, True
    df = spark.createDataFrame(edges, "child string, parent string")
    got = {(r["descendant"], r["ancestor"]): r["depth"] for r in taxonomy.closure(df).collect()}
    assert got == {(c, a): d for c, x in up.items() for a, d in x.items() if a != c}
    pairs = [*combinations(map(str, range(40)), 2), ("3", "3"), ("3", None), ("unknown", "3")]
    rows = taxonomy.related(spark.createDataFrame(pairs + [("4", "7")], "left string, right string"), df).collect()
    assert len(rows) == len(pairs) + 1
    for r in rows:
        a, b = up.get(r["left"], {r["left"]: 0}), up.get(r["right"], {r["right"]: 0})
        common = sorted((a[x] + b[x], x, a[x], b[x]) for x in a.keys() & b.keys()) if r["right"] else []
        want = "unrelated"
        if common:
            n, _, x, y = common[0]
            sibling = any(a[c] == b[c] == 1 for c in a.keys() & b.keys())
            want = "same" if n == 0 else "ancestor" if x == 0 else "descendant" if y == 0 else "sibling" if sibling else "cousin"
            assert (r["distance"], r["common"]) == common[0][:2]
        assert r["relation"] == want, r
    assert taxonomy.closure(df.limit(0)).count() == 0


def test_closure_goes_on_from_the_longest_paths_only(spark, monkeypatch):
    """A chain of 32 steps: rounds double, and what a round meets is at most what is news and what was known."""
    rounds, stage = [], taxonomy.stage
    monkeypatch.setattr(taxonomy, "stage", lambda df: rounds.append(stage(df)) or rounds[-1])
    chain = spark.range(32).selectExpr("cast(id as string) child", "cast(id + 1 as string) parent")
    assert taxonomy.closure(chain).count() == 32 * 33 // 2
    assert [r.agg(F.max("depth")).first()[0] for r in rounds] == [1, 2, 4, 8, 16, 32, 32]


def _shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_pairs_do_not_move_with_ancestors(spark):
    """A comb of 100 steps and teeth without order: beside the closure, 10,000 pairs of teeth shuffle a few bytes each, not their ancestors."""
    rng = random.Random(5)
    names = [f"{rng.getrandbits(60):015x}" for _ in range(100)]
    teeth = [f"t{rng.getrandbits(60):015x}" for _ in range(100)]
    edges = spark.createDataFrame([*zip(names, names[1:], strict=False), *((t, rng.choice(names[:20])) for t in teeth)], "child string, parent string")
    pairs = spark.createDataFrame([(a, b) for a in teeth for b in teeth], "left string, right string").localCheckpoint()
    closed = _shuffled(spark)
    taxonomy.closure(edges)
    before = _shuffled(spark)
    got = taxonomy.related(pairs, edges).groupBy("relation").count().collect()
    assert sum(r["count"] for r in got) == 10_000 and "unrelated" not in {r["relation"] for r in got}
    assert _shuffled(spark) - before < before - closed + 15 * 10_000


@pytest.mark.parametrize("settings", [{}, {"LEAST_PAIRS": 1}, {"LEAST_PAIRS": 1, "HELD": 20}, {"PAIRS": 50, "HELD": 100}])
def test_relations_in_many_cells(spark, monkeypatch, settings):
    """However pairs are dealt, with a heavy left end, few pairs or many, other columns, numbers as nodes: what brute force finds."""
    for name, value in settings.items():
        monkeypatch.setattr(taxonomy, name, value)
    rng = random.Random(7)
    edges = [(c, p) for c in range(1, 60) for p in {rng.randrange(c), rng.randrange(c)} if c % 17] + [(70, 71), (71, 70)]
    up = {i: {i: 0} for i in range(80)}
    for _ in range(60):
        for c, p in edges:
            for a, d in list(up[p].items()):
                up[c][a] = min(up[c].get(a, 99), d + 1)
    known = spark.createDataFrame(edges, "child long, parent long")
    for many in (2000, 9):
        ends = [(rng.choice([5, None, *range(80)]) if i % 3 else 59, rng.choice([None, *range(80)]), i) for i in range(many)] + [(70, 71, -1), (99, 99, -2), (99, 98, -3)]
        pairs = spark.createDataFrame(ends, "a long, b long, kind int").selectExpr("a", "b", "kind", "array(kind, null) cell", "timestamp_seconds(kind) at", "named_struct('x', cast(a as string)) node")
        rows = taxonomy.related(pairs, known, "a", "b").collect()
        assert sorted(r["kind"] for r in rows) == sorted(e[2] for e in ends)
        for r in rows:
            a, b = ({} if x is None else up.get(x, {x: 0}) for x in (r["a"], r["b"]))
            common = min(((a[x] + b[x], x) for x in a.keys() & b.keys()), default=(None, None))
            assert (r["distance"], r["common"]) == common, r
            assert r["cell"] == [r["kind"], None] and r["node"]["x"] == (None if r["a"] is None else str(r["a"]))
            n, x = common
            shared = any(a[c] == b[c] == 1 for c in a.keys() & b.keys())
            want = "unrelated" if n is None else "same" if n == 0 else "ancestor" if x == r["a"] else "descendant" if x == r["b"] else "sibling" if shared else "cousin"
            assert r["relation"] == want, r


# --- scores -----------------------------------------------------------------------
def test_base_scores_of_known_vectors(spark):
    known = {
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1,
        "CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H": 7.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0, "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N/E:P/RL:O": 5.9,
        "AV:N/AC:L/Au:N/C:C/I:C/A:C": 10.0, "(AV:N/AC:M/Au:N/C:N/I:P/A:N)": 4.3, "AV:L/AC:L/Au:N/C:N/I:N/A:N": 0.0, "AV:N/AC:L/Au:N/C:P/I:P/A:P": 7.5,
        "CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N": None, "CVSS:3.1/AV:N/AC:L": None, "CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None,
        "CVSS:3.1/AV:N/AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(v,) for v in known], "v string").select("v", cvss.base_score(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in rows} == known


def test_differing_metrics(spark):
    df = spark.createDataFrame([("CVSS:3.1/AV:N/AC:L/S:U", "CVSS:3.1/AV:L/AC:L"), ("AV:N", None)], "a string, b string")
    assert [r["d"] for r in df.select(cvss.differing(cvss.metrics(F.col("a")), cvss.metrics(F.col("b"))).alias("d")).collect()] == [["AV:N>L", "S:U>-"], None]


def test_common_vectors_are_scored_as_all_others(spark):
    """Scores and differences go on from column to column for common vectors, and are those of the general expressions for every vector."""
    vectors = [
        None, "", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.0/AV:A/AC:H/PR:L/UI:R/S:C/C:L/I:N/A:H", "CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:C/C:L/I:L/A:L",
        "CVSS:3.0/AV:L/AC:L/PR:N/UI:N/S:C/C:N/I:N/A:N", "CVSS:3.1/AV:N/AC:L", "CVSS:3.1/AV:N", "CVSS:3.1/AV:x/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/",
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H\n", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H/E:P", "CVSS:3.1/AC:L/AV:N/PR:N/UI:N/S:U/C:H/I:H/A:H",
        "CVSS:3.1/AV:N/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:NN/AC:L", "CVSS:4.0/AV:N/AC:L/AT:N", "CVSS:3.2/AV:N/AC:L", "AV:N/AC:L/Au:N/C:P/I:P/A:P", "AV:L/AC:H/Au:M/C:N/I:N/A:N",
        "(AV:N/AC:L/Au:N/C:C/I:C/A:C)", "AV:N/AC:L/Au:N", "AV:N/AC:L/Au:X/C:C/I:C/A:C", "AV:P/AC:L/Au:N/C:C/I:C/A:C", "AV:N/AC:L", "no vector",
    ]
    one = spark.createDataFrame([(v,) for v in vectors], "v string")
    pairs = one.select(F.col("v").alias("a")).crossJoin(one.select(F.col("v").alias("b")))
    told = cvss.consistency(pairs, "a", "b")
    assert told.columns == ["a", "b", "left_base", "right_base", "differing"]
    rows = told.select("*", cvss.base_score(F.col("a")).alias("x"), cvss.base_score(F.col("b")).alias("y"), cvss.differing(cvss.metrics(F.col("a")), cvss.metrics(F.col("b"))).alias("d")).collect()
    assert len(rows) == len(vectors) ** 2
    assert [r for r in rows if (r["left_base"], r["right_base"], r["differing"]) != (r["x"], r["y"], r["d"])] == []
    assert {r["left_base"] for r in rows if r["a"] == vectors[2]} == {9.8}


# --- histories --------------------------------------------------------------------
def test_update_gaps_of_a_hot_key(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2]), rng.choice(["l", "r"]), 1_700_000_000 + rng.randrange(90) * 86_400, str(rng.randrange(3))) for _ in range(400)]
    odd = [(None, "l", 1_700_000_000, "x"), (3, "r", None, "x"), (4, "l", 1_700_000_000, None), (4, "z", 1_700_000_000, "x")]
    df = spark.createDataFrame(rows + odd, "key int, side string, s long, value string").withColumn("time", F.timestamp_seconds("s"))
    got = sorted((r["key"], r["s"], r["side"], r["value"], r["lag_seconds"], r["other_value"], r["gap"]) for r in history.update_gaps(df, ("l", "r"), span="week").collect() if r["value"])
    want, last = [], {}
    for key, s, side, value in sorted((k, s, side, v) for k, side, s, v in rows):
        other = last.get((key, "r" if side == "l" else "l"))
        last[key, side] = (s, value)
        want.append((key, s, side, value, s - other[0] if other else None, other[1] if other else None, "first" if not other else "level" if other[1] == value else "behind"))
    assert got == sorted(want, key=lambda x: x[:4])
    assert history.update_gaps(df.limit(0), ("l", "r")).count() == 0


# --- samples and figures ------------------------------------------------------------
def test_samples_are_the_same_at_any_partitioning(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("s"))
    samples = {n: sorted(map(tuple, sampling.bottom_k(df.repartition(n), ["s"], 7, ["id"]).collect())) for n in (1, 5, 16)}
    assert samples[1] == samples[5] == samples[16] and len(samples[1]) == 21
    assert samples[1] != sorted(map(tuple, sampling.bottom_k(df, ["s"], 7, ["id"], seed="other").collect()))
    assert sampling.bottom_k(df.where("id < 4"), ["s"], 7, ["id"]).count() == 4
    plan = sampling.bottom_k(df, ["s"], 7, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_kappa_and_f1(spark):
    labels = ("a", "b", "c")
    cells = [[20, 5, 0], [10, 15, 3], [0, 2, 9]]
    rows = [(labels[g], labels[p], "f") for g in range(3) for p in range(3) for _ in range(cells[g][p])] + [("a", "other", "f")]
    got = {r["field"]: r for r in evaluation.typing_metrics(spark.createDataFrame(rows, "gold string, predicted string, field string"), labels=labels).collect()}
    m = np.array(cells, float)
    n, g, p = m.sum(), m.sum(1), m.sum(0)
    w = np.array([[(i - j) ** 2 for j in range(3)] for i in range(3)])
    for r in (got["f"], got["all"]):
        assert r["n"] == n and r["accuracy"] == pytest.approx(np.trace(m) / n, abs=1e-6)
        assert r["kappa"] == pytest.approx((np.trace(m) / n - g @ p / n**2) / (1 - g @ p / n**2), abs=1e-6)
        assert r["weighted_kappa"] == pytest.approx(1 - (w * m).sum() * n / (w * np.outer(g, p)).sum(), abs=1e-6)
        assert r["macro_f1"] == pytest.approx(np.mean([2 * m[i, i] / (g[i] + p[i]) for i in range(3)]), abs=1e-6)
    none = evaluation.typing_metrics(spark.createDataFrame([], "gold string, predicted string, field string"), labels=labels).collect()
    assert [r["accuracy"] for r in none] in ([], [0.0])


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_risk_coverage_counts_on_across_ranges(spark, rows):
    rng = random.Random(4)
    data = [(i, rng.choice([0.5, 0.5, 0.5, rng.random()]), rng.random() < 0.3) for i in range(rows)]
    df = spark.createDataFrame(data, "id long, conf double, bad boolean").repartition(3)
    got = sorted((r["rank"], r["id"], r["errors"], r["coverage"], r["risk"]) for r in evaluation.risk_coverage(df, [F.desc("conf"), F.asc("id")], F.col("bad")).collect())
    want, errors = [], 0
    for k, (i, _, bad) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1):
        errors += bad
        want.append((k, i, errors, pytest.approx(k / rows, abs=1e-6), pytest.approx(errors / k, abs=1e-6)))
    assert got == want


# --- evidence ---------------------------------------------------------------------
def test_decisions(spark):
    rows = [
        ("1", "f", "x", "good", "2024-01-01", 0), ("1", "f", "y", "poor", "2024-01-31", 0),  # the older, better source
        ("2", "f", "x", "good", "2024-01-01", 3),  # nobody else
        ("3", "f", "x", "good", "2024-01-01", 0), ("3", "f", "y", "good", "2024-01-01", 0),  # a tie
        ("4", "f", "x", "unheard", None, 0), ("4", "f", None, "good", "2024-01-01", 9),  # no known source or time
        (None, "f", "x", "good", "2024-01-01", 0),
        ("1", "f", "x", "good", "2024-01-01", 0),  # repeated
    ]
    df = spark.createDataFrame(rows, "cve_id string, field string, value string, source string, seen string, refs int").withColumn("seen", F.col("seen").cast("timestamp"))
    found = evidence.features(df, {"good": 0.9, "poor": 0.2})
    got = {r["cve_id"]: r for r in evidence.decide(evidence.scored(found)).collect()}
    assert (got["1"]["winner"], got["1"]["abstained"], got["1"]["by_priority"], got["1"]["by_freshness"]) == ("x", False, "x", "y")
    assert got["1"]["score"] == pytest.approx(0.4 * 0.9 + 0.2 * 0.5 + 0.25 * 0.5) and got["1"]["margin"] == pytest.approx(got["1"]["score"] - (0.4 * 0.2 + 0.2 + 0.25 * 0.5))
    assert (got["2"]["kind"], got["2"]["abstained"], got["2"]["confidence"]) == ("agreed", False, "high")
    assert (got["3"]["kind"], got["3"]["margin"], got["3"]["abstained"], got["3"]["winner"]) == ("disputed", 0.0, True, "x")
    assert got["4"]["abstained"] and got["4"]["score"] == pytest.approx(0.25) and got[None]["winner"] == "x"
    sure = {r["cve_id"]: r["abstained"] for r in evidence.decide(evidence.under_variants(found, {"all": evidence.ABLATIONS["no_abstention"]}), None).collect()}
    assert not any(sure.values())
    assert evidence.decide(evidence.scored(evidence.features(df.limit(0), {"good": 1.0}))).count() == 0


def test_decisions_under_policies_join_nothing_and_move_claims_once(spark):
    rng = random.Random(6)
    rows = [(str(rng.randrange(9)), rng.choice("fg"), rng.choice("xyz"), rng.choice(["good", "poor", "odd"]), f"2024-01-{rng.randrange(10, 29)}", rng.randrange(3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "cve_id string, field string, value string, source string, seen string, refs int").withColumn("seen", F.col("seen").cast("timestamp"))
    found = evidence.features(df, {"good": 0.9, "poor": 0.2})
    one = evidence.decide_under(found, evidence.ABLATIONS)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    other = evidence.decide(evidence.under_variants(found, evidence.ABLATIONS), None, ("variant", "cve_id", "field")).select(*one.columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.count() == 18 * len(evidence.ABLATIONS)
