"""Whitening and hard-negative mining against plain arithmetic."""

import random
from pathlib import Path

import numpy as np
import pytest

from fieldweave.llm import hard_negatives, queries, whitening

SF = "/root/testdata/sf0.001"
ODD = [(None, [0.5, None]), (2, [3.0, float("nan")]), (3, []), (4, None), (6, [1e30, 1.0]), (7, [1.0])]


def whitened_by_hand(x):
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return centred @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n), [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_registered_whitening(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [r for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    white, explained, away = whitened_by_hand(np.floor(np.array([r["embedding"] for r in rows], np.float64) * 1024) + 100_000)
    got = {(r["vec_id"], r["component"]): r for r in queries.op11_whitening(spark, SF).collect()}
    assert len(got) == 8 * len(rows)
    for k in range(8):
        mine = np.array([got[r["vec_id"], k + 1]["whitened"] for r in rows])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-9
    for r, d in zip(rows, away, strict=True):
        one = got[r["vec_id"], 1]
        assert (one["deviation"], one["n"]) == (d, len(rows)) and abs(one["explained"] / explained[0] - 1) < 1e-9 and one["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (5, [0.0, 1.0]), (None, [4.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in good + ODD], "vec_id long, embedding array<float>, whitened double")
    rows = whitening.by_component(whitening.whiten(df)).collect()
    assert sorted(str((r["vec_id"], r["component"])) for r in rows) == sorted(str((i, c)) for i, _ in good for c in (1, 2))
    assert {r["n"] for r in rows} == {4}
    for few in (df.limit(0), df.limit(1)):  # nothing varies
        assert whitening.by_component(whitening.whiten(few)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.by_component(whitening.whiten(line)).collect()} == {1}  # one direction


def test_whitening_is_exact_beyond_longs(spark):
    x = [(i, [float((i * 7919) % 1000) * 1e5, float(i)]) for i in range(1000)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark.createDataFrame(x, "vec_id long, embedding array<double>")).collect()}
    whole = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    assert got == {i: sum((1000 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(whole)}
    assert max(got.values()) > 2**63


def mined_by_hand(rows, dim):
    fit = [(i, label, np.floor(np.array(v) * 256).astype(int)) for i, v, label in rows if None not in (i, label, v) and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x, out = np.array([v for _, _, v in fit]), []
    for at, (i, label, v) in enumerate(fit):
        if i % 100:
            continue
        order = sorted((-int(s), fit[j][0], j) for j, s in enumerate(x @ v) if j != at)
        for p, pid, _ in [o for o in order if fit[o[2]][1] == label][:5]:
            negatives = [o for o in order if fit[o[2]][1] != label and 80 * -p <= 100 * -o[0] <= 100 * -p][:5]
            out += [(i, pid, k, o[1], -p, -o[0]) for k, o in enumerate(negatives, 1)]
    return sorted(out)


@pytest.mark.parametrize("slices", [(64, 8, 300), (4096, 4096, 4096)])
def test_mining(spark, slices):
    """Clusters, a third of all rows equal, repeated ids, repeated rows, ties, and rows that take no part."""
    rng = random.Random(3)
    hot = [0.5, 1.0, 0.25, 0.1, -0.5, 1.0]
    rows = [(i % 500, [rng.gauss(rng.choice([0, 2, 4]), 0.5) for _ in range(6)], rng.randrange(3)) for i in range(700)]
    rows += [(1000 + i, hot, rng.choice([0, 0, 1])) for i in range(400)] + [(100, hot, 0), (100, hot, 0), (0, [0.0] * 6, 1), (200, [-1.0] * 6, 2)]
    rows += [(None, hot, 1), (7, None, 1), (8, hot, None), (9, [float("nan")] * 6, 1), (300, [1.0], 1), (400, [None, *hot[1:]], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, pid string")
    sizes = dict(zip(("slice_rows", "block_rows", "sample_rows"), slices, strict=True))
    got = sorted(tuple(r) for r in hard_negatives.mine(df, **sizes).collect())
    assert got == mined_by_hand(rows, 6) and len(got) > 100


def test_mining_of_nothing(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label")
    assert hard_negatives.mine(df.limit(0)).collect() == []
    lone = spark.createDataFrame([(100, [1.0, 1.0], 1), (200, [2.0, 1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(lone).collect() == []  # no positives


def test_intervals_hold():
    rng = np.random.default_rng(5)
    x, y = rng.integers(-300, 300, (90, 5)).astype(float), rng.integers(-300, 300, (200, 5)).astype(float)
    one, two = hard_negatives.Ball(x, 8), hard_negatives.Ball(y, 8)
    for a, (lo, hi) in enumerate(one.bounds):
        low, high = hard_negatives.intervals(one, a, two, list(range(len(two.bounds))))
        for b, (lo2, hi2) in enumerate(two.bounds):
            s = x[one.order[lo:hi]] @ y[two.order[lo2:hi2]].T
            assert low[b] <= s.min() and s.max() <= high[b]


def test_groups_are_pruned_at_once():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1, (64, 4)) for c in (-50, 50)])
    one, two = hard_negatives.Ball(x, 8), hard_negatives.Ball(np.concatenate([rng.normal(c, 1, (256, 4)) for c in (-50, 0, 50)]), 8)
    seen = []
    hard_negatives.walk(one, two, np.full(len(x), 9000.0), np.full(len(x), np.inf), lambda a, b: seen.append((a, b)))
    leaves = sum(not c for c in one.children) * sum(not c for c in two.children)
    assert 0 < len(seen) < leaves / 2
