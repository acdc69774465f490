"""k x k solves on grouped statistics.

Spark sums the cross products, so a group is one row of k*k numbers however many rows it was fitted on. Ridge fits and the
projection are folds over these arrays (``functions.linear``); only the fits under inequalities go to numpy, in batches of
groups inside tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear


def gram(wide: DataFrame, by: Sequence[str], x: Sequence[str], y: str = "y_true", weight: Column | None = None, fill: float | None = None) -> DataFrame:
    """Cross products per group: g (k*k), b (k), s (k), sy, yy, n; rows with gaps are skipped or filled."""
    if fill is not None:
        wide = wide.withColumns({c: F.coalesce(F.col(c), F.lit(float(fill))) for c in x})
    else:
        wide = wide.na.drop(subset=[*x, y])
    w = F.lit(1.0) if weight is None else weight
    k = len(x)
    cells = {f"_g{i}_{j}": F.sum(w * F.col(x[i]) * F.col(x[j])) for i in range(k) for j in range(i, k)}
    cells.update({f"_b{i}": F.sum(w * F.col(x[i]) * F.col(y)) for i in range(k)})
    cells.update({f"_s{i}": F.sum(w * F.col(x[i])) for i in range(k)})
    agg = wide.groupBy(*by).agg(
        *[c.alias(n) for n, c in cells.items()],
        F.sum(w * F.col(y)).alias("sy"),
        F.sum(w * F.col(y) * F.col(y)).alias("yy"),
        F.sum(w).alias("n"),
    )
    return pack(agg, by, k)


def pack(agg: DataFrame, by: Sequence[str], k: int, extra: Sequence[str] = ()) -> DataFrame:
    return agg.select(
        *by,
        F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]).alias("g"),
        F.array(*[F.col(f"_b{i}") for i in range(k)]).alias("b"),
        F.array(*[F.col(f"_s{i}") for i in range(k)]).alias("s"),
        "sy",
        "yy",
        "n",
        *extra,
    )


def box_minimum(a: np.ndarray, b: np.ndarray, lo: float = 0.0, hi: float = np.inf, total: float | None = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """Minimum of w'aw/2 - b'w with lo <= w <= hi and, unless ``total`` is None, sum w = total: a primal active-set method.

    Every step moves to the minimum over the free entries or to the first bound on the way; at such a minimum the entry
    whose multiplier has the wrong sign most is set free.
    """
    k = len(b)
    scale = max(float(np.abs(np.diag(a)).max()), 1e-12)
    a, b = a / scale + 1e-12 * np.eye(k), b / scale
    w = np.full(k, max(lo, 0.0)) if total is None else np.full(k, total / k)
    if start is not None:
        w = start.astype(float)
    w = np.clip(w, lo, hi)
    if total is not None and abs(w.sum() - total) > 1e-9:
        w = project_box(w / total, lo / total, hi / total) * total
    side = np.where(w <= lo + 1e-12, -1, np.where(w >= hi - 1e-12, 1, 0))
    for _ in range(60 * k):
        free = np.flatnonzero(side == 0)
        slope = a @ w - b
        step, level = np.zeros(k), 0.0
        if len(free):
            n = len(free)
            kkt, right = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
            kkt[:n, :n], right[:n] = a[np.ix_(free, free)], -slope[free]
            if total is None:
                kkt[n, n] = 1.0
            else:
                kkt[:n, n] = kkt[n, :n] = 1.0
            found = np.linalg.lstsq(kkt, right, rcond=None)[0]
            step[free], level = found[:n], -found[n] if total is not None else 0.0
        elif total is not None:
            up, down = np.flatnonzero(side == -1), np.flatnonzero(side == 1)
            level = slope[down].max() if len(down) else slope[up].min()
        if np.abs(step).max() > 1e-11:
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(step > 0, (hi - w) / step, np.where(step < 0, (lo - w) / step, np.inf))
            t = min(1.0, max(0.0, float(room.min())))
            w = w + t * step
            if t < 1.0:
                i = int(room.argmin())
                side[i] = 1 if step[i] > 0 else -1
                w[i] = hi if step[i] > 0 else lo
            continue
        wrong = np.where(side == -1, level - slope, np.where(side == 1, slope - level, 0.0))
        i = int(wrong.argmax())
        if wrong[i] <= 1e-10:
            break
        side[i] = 0
        if not len(free) and total is not None:  # a single free entry cannot move: free the one that sets the level too
            others = np.flatnonzero(side == 1) if (side == 1).any() else np.flatnonzero(side == -1)
            side[others[np.argmax(slope[others]) if (side == 1).any() else np.argmin(slope[others])]] = 0
    return w


def project_box(v: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Nearest vector with entries in [lo, hi] and sum 1."""
    k = len(v)
    if k == 1:
        return np.ones(1)
    v = np.clip(v, lo, min(hi, 1e12))
    if abs(v.sum() - 1.0) <= 1e-9:
        return v
    a, b = v.min() - min(hi, 1 - (k - 1) * lo), v.max() - lo
    for _ in range(100):
        mid = (a + b) / 2
        if np.clip(v - mid, lo, hi).sum() > 1.0:
            a = mid
        else:
            b = mid
    return np.clip(v - (a + b) / 2, lo, hi)


def ridge_column(method: str, k: int, alpha: float, n_models: int, bounds: tuple[float, float]):
    """Column of ridge weights over (g, b, s, sy, n), from elimination in the JVM."""

    def fit(g: str, b: str, s: str, sy: str, n: str) -> Column:
        g, b, s, sy, n = map(F.col, (g, b, s, sy, n))
        at = lambda r, c: F.get(g, (r * k + c).cast("int")) + F.when(r == c, float(alpha)).otherwise(0.0)
        if method == "ridge":
            found = linear.solution(at, lambda r: F.get(b, r), k)
        else:
            centred = linear.solution(lambda r, c: at(r, c) - F.get(s, r) * F.get(s, c) / n, lambda r: F.get(b, r) - F.get(s, r) * sy / n, k)
            if method == "ridge_intercept":
                found = linear.let(centred, lambda w: F.concat(w, F.array((sy - linear.dot(w, s)) / n)))
            else:
                found = linear.pin_and_share(F.slice(centred, 1, n_models), *bounds)
        known = (n > 0) & ~F.exists(g, lambda v: v.isNull() | F.isnan(v))
        return F.when(known, found)

    return fit


def fit_column(method: str, k: int, alpha: float = 1.0, n_models: int | None = None, bounds: tuple[float, float] = (-0.5, 1.2), anchor: int = 0, anchor_weight: float = 0.9, strict_fix: bool = False):
    """Function of the columns (g, b, s, sy, n) giving an array of weights.

    Methods: convex, ridge, ridge_nonnegative, ridge_intercept (k coefficients
    and the intercept), ridge_projected (intercept fit, first ``n_models``
    coefficients projected by the published rule, with ``strict_fix`` to the nearest vector), anchor.
    """
    m = n_models or k
    if method in ("ridge", "ridge_intercept", "ridge_projected") and not strict_fix:
        return ridge_column(method, k, alpha, m, bounds)

    def one(g, b, s, sy, n):
        a, b, s = np.asarray(g, float).reshape(k, k), np.asarray(b, float), np.asarray(s, float)
        if method == "convex":
            return box_minimum(a, b) if k > 1 else np.ones(1)
        if method == "ridge_nonnegative":
            return box_minimum(a + alpha * np.eye(k), b, total=None)
        if method == "ridge_projected":
            coef = np.linalg.lstsq(a - np.outer(s, s) / n + alpha * np.eye(k), b - s * sy / n, rcond=None)[0]
            return project_box(coef[:m], *bounds)
        if method == "anchor":
            rest = [i for i in range(k) if i != anchor]
            w = np.zeros(k)
            w[anchor] = anchor_weight if rest else 1.0
            if rest:
                w[rest] = (1 - anchor_weight) * (box_minimum(a[np.ix_(rest, rest)], b[rest]) if len(rest) > 1 else 1.0)
            return w
        raise ValueError(f"unknown method {method!r}")

    def batch(g: pd.Series, b: pd.Series, s: pd.Series, sy: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for row in zip(g, b, s, sy, n):
            if row[0] is None or row[4] is None or not row[4] > 0 or any(v is None or v != v for v in row[0]):
                out.append(None)
            else:
                out.append(one(*row).tolist())
        return pd.Series(out)

    return F.pandas_udf(batch, "array<double>")


def solve(stats: DataFrame, by: Sequence[str], models: Sequence[str], method: str, keep: Sequence[str] = (), **kw) -> DataFrame:
    """Weights table (by, model_name, weight) from packed statistics."""
    udf = fit_column(method, len(models), **kw)
    names = F.array(*[F.lit(m) for m in models])
    none = F.array(*[F.lit(None).cast("double")] * len(models))
    w = stats.withColumn("_w", F.coalesce(udf("g", "b", "s", "sy", "n"), none))
    return w.select(*by, *keep, F.explode(F.arrays_zip(names.alias("model_name"), F.col("_w").alias("weight"))).alias("_z")).select(
        *by, *keep, F.col("_z.model_name").alias("model_name"), F.col("_z.weight").alias("weight")
    )
