"""Small solves in the JVM against numpy, and the convex search against all mixtures on a fine grid."""

from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourpanel.functions import linear
from hourpanel.operators import fusion, solve


@pytest.mark.parametrize("k", [1, 2, 6])
def test_elimination_equals_numpy(spark, k):
    rng = np.random.default_rng(k)
    rows = []
    for n in range(30):
        x = rng.normal(50, 10, (40, k))
        rows.append((n, (x.T @ x + np.eye(k)).ravel().tolist(), (x.T @ x @ rng.normal(0.2, 0.3, k)).tolist()))
    df = spark.createDataFrame(rows, "n int, g array<double>, b array<double>")
    found = linear.solution(lambda r, c: F.get("g", (r * k + c).cast("int")), lambda r: F.get("b", r), k)
    got = {r.n: r.w for r in df.select("n", found.alias("w")).collect()}
    for n, g, b in rows:
        np.testing.assert_allclose(got[n], np.linalg.solve(np.array(g).reshape(k, k), b), rtol=1e-8, atol=1e-10)


def test_a_singular_system_gives_nulls(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0], [1.0, 2.0])], "g array<double>, b array<double>")
    w = df.select(linear.solution(lambda r, c: F.get("g", (r * 2 + c).cast("int")), lambda r: F.get("b", r), 2).alias("w")).first().w
    assert None in w


@pytest.mark.parametrize("method", ["ridge", "ridge_intercept", "ridge_projected"])
def test_ridge_fits_equal_numpy_and_skip_broken_groups(spark, method):
    rng, k, alpha = np.random.default_rng(3), 4, 0.7
    rows = []
    for n in range(12):
        x, y = rng.normal(60, 15, (30, k)), rng.normal(60, 15, 30)
        rows.append((n, (x.T @ x).ravel().tolist(), (x.T @ y).tolist(), x.sum(axis=0).tolist(), float(y.sum()), 30.0))
    rows += [(50, None, None, None, None, None), (51, [float("nan")] * 16, [0.0] * 4, [0.0] * 4, 0.0, 3.0), (52, [1.0] * 16, [1.0] * 4, [0.0] * 4, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, g array<double>, b array<double>, s array<double>, sy double, n double")
    got = {r.i: r.w for r in df.select("i", solve.fit_column(method, k, alpha=alpha)("g", "b", "s", "sy", "n").alias("w")).collect()}
    assert got[50] is got[51] is got[52] is None
    for i, g, b, s, sy, n in rows[:12]:
        g, b, s = np.array(g).reshape(k, k), np.array(b), np.array(s)
        if method == "ridge":
            want = np.linalg.solve(g + alpha * np.eye(k), b)
        else:
            want = np.linalg.solve(g - np.outer(s, s) / n + alpha * np.eye(k), b - s * sy / n)
            if method == "ridge_intercept":
                want = np.append(want, (sy - want @ s) / n)
            else:
                assert abs(sum(got[i]) - 1) < 1e-8 and min(got[i]) >= -0.5 and max(got[i]) <= 1.2
                continue
        np.testing.assert_allclose(got[i], want, rtol=1e-8, atol=1e-9)


def test_ridge_plan_has_no_python(spark):
    df = spark.createDataFrame([], "g array<double>, b array<double>, s array<double>, sy double, n double")
    plan = df.select(solve.fit_column("ridge_projected", 5)("g", "b", "s", "sy", "n"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan




@pytest.mark.parametrize("seed", [1])
def test_search_is_not_above_any_mixture_of_a_fine_grid(make, seed):
    """Models of opposite sign make several minima: predictions that cancel, and single ones that fit half of the rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(4):
        y = rng.normal(0, 150, 40)
        half = rng.random(40) < 0.5
        rows += [(g, t, y[t], np.where(half, y, -3 * y)[t], np.where(half, -2 * y, y)[t], rng.normal(60, 90)) for t in range(40)]
    pdf = pd.DataFrame(rows, columns=["g", "t", "y_true", "a", "b", "c"])
    found = {r.g: r for r in fusion.convex_search(make(pdf), ["g"], ["a", "b", "c"]).collect()}
    grid = np.array([w for w in product(range(41), repeat=3) if sum(w) == 40]) / 40
    for g, part in pdf.groupby("g"):
        x, y = part[["a", "b", "c"]].to_numpy(), part.y_true.to_numpy()
        raised = np.maximum(y, 50)
        loss = lambda w: np.mean(np.abs(np.maximum(x @ w, 50) - raised) / ((raised + np.maximum(x @ w, 50)) / 2))  # noqa: B023, E731
        best = min(map(loss, grid))
        fit = loss(np.array(found[g].weights))
        assert fit <= best * 1.01, (g, fit, best)
        assert abs(sum(found[g].weights) - 1) < 1e-6 and min(found[g].weights) > -1e-9


def test_search_takes_the_callers_starts(make, spark):
    rng = np.random.default_rng(9)
    y = rng.normal(100, 40, 60)
    pdf = pd.DataFrame({"g": 1, "y_true": y, "a": y + 5, "b": y - 5})
    starts = spark.createDataFrame([(1, [0.5, 0.5])], "g bigint, weights array<double>")
    got = fusion.convex_search(make(pdf), ["g"], ["a", "b"], starts=starts).first()
    np.testing.assert_allclose(got.weights, [0.5, 0.5], atol=1e-6)
    assert got.loss < 1e-6
