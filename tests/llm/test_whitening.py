"""Whitening against exact rational arithmetic, and its edge cases."""
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from spanweave.llm.whitening import Whitening, _exact, polarised, whiten

SCHEMA = "vec_id bigint, embedding array<float>, component string, n string, x string"


def vectors(n=60, d=7, seed=4):
    rng = random.Random(seed)
    rows = [[float(np.float32(rng.gauss(0, 1 + j) + (i % 3))) for j in range(d)] for i in range(n)]
    return rows + rows[:20]  # repeated vectors under other ids


def brute(rows):
    x = [[math.floor(64 * c) + 1000000 for c in r] for r in rows]
    fit = sorted({tuple(r) for r in x})
    n, d = len(fit), len(fit[0])
    s = [sum(r[j] for r in fit) for j in range(d)]
    mean = [Fraction(a, n) for a in s]
    cov = [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in fit) / n for j in range(d)] for i in range(d)]
    return x, n, s, cov


def test_equals_exact_arithmetic(spark):
    rows = vectors()
    x, n, s, cov = brute(rows)
    df = spark.createDataFrame([(i, r, "c", "n", "x") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = whiten(df, components=5).collect()
    assert len(got) == 5 * len(rows)
    values, axes = np.linalg.eigh(np.array([[float(v) for v in r] for r in cov]))
    trace = float(sum(cov[i][i] for i in range(7)))
    mean = np.array([float(Fraction(a, n)) for a in s])
    for r in got:
        i, k = r["vec_id"], r["component"]
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["deviation"] == r["deviation_wide"] == sum((n * a - b) ** 2 for a, b in zip(x[i], s))
        assert r["explained"] == pytest.approx(values[-k] / trace, rel=1e-9)
        want = (np.array(x[i]) - mean) @ axes[:, -k] / math.sqrt(values[-k])
        assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-6, abs=1e-9)


def test_polarised_covariance_is_exact():
    rng = random.Random(1)
    rows = [[rng.randrange(-10**9, 10**9) for _ in range(4)] for _ in range(33)]
    n, sums = len(rows), [sum(c) for c in zip(*rows)]
    whole = [a // n for a in sums]
    y = [[a - w for a, w in zip(r, whole)] for r in rows]
    own = [sum(r[i] ** 2 for r in y) for i in range(4)]
    pairs = [sum((r[i] + r[j]) ** 2 for r in y) for i in range(4) for j in range(i + 1, 4)]
    got = polarised(n, [a - n * w for a, w in zip(sums, whole)], own, pairs)
    for i in range(4):
        for j in range(4):
            want = sum((Fraction(r[i]) - Fraction(sums[i], n)) * (Fraction(r[j]) - Fraction(sums[j], n)) for r in rows) / n
            assert got[i, j] == float(want)


def test_large_values_stay_exact():
    big = np.array([[2**40, -2**40 + 1]], np.int64)
    assert int((_exact(big, 4) ** 2).sum()) == 2**80 + (2**40 - 1) ** 2
    m = Whitening(10**9, [0, 0], [1, 2], np.eye(2), np.eye(2), np.ones(2))
    assert m.deviations(big) == [(10**9 * 2**40 - 1) ** 2 + (10**9 * (1 - 2**40) - 2) ** 2]


def test_unusable_rows_and_wide_sums(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0]),
            (None, [3.0, 5.0]), (8, [3.0, 5.0]), (8, [3.0, 5.0]), (9, [2e10, -7.0])]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)
    got = whiten(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got if r["component"] == 1) == [(False, 1), (False, 8), (False, 8), (False, 9), (True, 0)]
    assert {r["n"] for r in got} == {3}
    x, n, s, _ = brute([[1.0, 2.0], [3.0, 5.0], [float(np.float32(2e10)), -7.0]])
    for r in got:
        at = {1: 0, 9: 2}.get(r["vec_id"], 1)
        want = sum((n * a - b) ** 2 for a, b in zip(x[at], s))
        assert int(r["deviation_wide"]) == want and r["deviation"] == (want if want < 2**63 else None)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance_nothing_comes_out(spark, rows):
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)
    out = whiten(df)
    assert out.collect() == [] and out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_dependent_dimensions_give_fewer_components(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, float(i * i)], "", "", "") for i in range(9)], SCHEMA)
    got = whiten(df).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9
