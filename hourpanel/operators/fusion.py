"""Fit, project, apply and compare fusion weights on the long prediction table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, linear, scores
from ..functions.numeric import clip, flag
from ..session import materialise
from . import quantile, solve

POINT = ("task", "target_day", "ds", "period", "hour_business")
GROUP = ("task", "period")

# Bounds of free weights, tolerance of renormalisation, least error.
BOUNDS = (-0.5, 1.2)
RENORM_TOL = 0.01
MIN_WEIGHT_SUM = 1e-9
MIN_ERROR = 1e-6


def truth_conflicts(df: DataFrame, point: Sequence[str]) -> DataFrame:
    """Points whose rows disagree on the truth."""
    return (
        df.groupBy(*point)
        .agg(F.min("y_true").alias("lowest"), F.max("y_true").alias("highest"), F.count(F.lit(1)).alias("rows"))
        .where(~F.col("lowest").eqNullSafe(F.col("highest")))
    )


def wide_frame(df: DataFrame, point: Sequence[str], models: Sequence[str], extras: Sequence[str] = ()) -> DataFrame:
    """One row per point, truth and extras first, one column per model from a fixed list."""
    return df.groupBy(*point).agg(
        F.max("y_true").alias("y_true"),
        *[F.max(e).alias(e) for e in extras],
        *[F.max(F.when(F.col("model_name") == m, F.col("y_pred"))).alias(m) for m in models],
    )


def complete_points(df: DataFrame, point: Sequence[str], count: int) -> DataFrame:
    """Rows of points where ``count`` models predict; a point holds a handful of rows."""
    w = W.partitionBy(*point)
    return df.withColumn("_k", F.count("y_pred").over(w)).where(F.col("_k") >= count).drop("_k")


def coverage(df: DataFrame, by: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Share of the group's points each model predicts; eligible at the threshold."""
    cells = df.groupBy(*by, "target_day", "ds", "hour_business", "model_name").agg(
        F.count(F.when(F.col("y_pred").isNull(), 1)).alias("_nulls")
    )
    expected = cells.groupBy(*by).agg(F.count_distinct("target_day", "ds", "hour_business").alias("expected_rows"))
    have = cells.groupBy(*by, "model_name").agg(F.count(F.lit(1)).alias("available_rows"), F.sum("_nulls").alias("null_count"))
    share = F.col("available_rows") / F.col("expected_rows")
    return have.join(expected, list(by)).withColumns({"coverage": F.round(share, 4), "eligible": share >= threshold})


def normalised(df: DataFrame, by: Sequence[str], score: str = "score", out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.col(score) / F.sum(score).over(W.partitionBy(*by)))


def inverse_mae(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weights proportional to 1/MAE per group: one row per model after map-side aggregation."""
    err = df.groupBy(*by, "model_name").agg(
        scores.mae("y_true", "y_pred").alias("mae"), F.count(F.lit(1)).alias("sample_count")
    )
    err = err.where(F.col("mae").isNotNull()).withColumn("score", 1 / F.greatest("mae", F.lit(MIN_ERROR)))
    return normalised(err, by).drop("score")


def softmax(df: DataFrame, by: Sequence[str], score: str, out: str = "weight") -> DataFrame:
    w = W.partitionBy(*by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def error_sums(df: DataFrame, by: Sequence[str], point: Sequence[str]) -> DataFrame:
    """Per group and model, sums that give the error with gaps counted as 0.

    A missing prediction of 0 costs y^2, so over all points the squared error is
    sum(y^2) plus, over present rows, (y-p)^2 - y^2; no spine of gaps is built.
    """
    y, p = F.col("y_true"), F.col("y_pred")
    have = df.groupBy(*by, "model_name").agg(F.sum((y - p) * (y - p) - y * y).alias("adjust"))
    pts = df.groupBy(*dict.fromkeys([*by, *point])).agg(F.max("y_true").alias("_y"))
    total = pts.groupBy(*by).agg(F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.count(F.lit(1)).alias("points"))
    return have.join(total, list(by))


def softmax_rmse(df: DataFrame, by: Sequence[str], point: Sequence[str] = POINT, temperature: float = 0.1) -> DataFrame:
    """Softmax of -RMSE, scaled by the largest RMSE of the group."""
    s = error_sums(df, by, point).withColumn("rmse", F.sqrt(F.greatest(F.col("adjust") + F.col("yy"), F.lit(0.0)) / F.col("points")))
    s = s.withColumn("_z", -F.col("rmse") / (F.max("rmse").over(W.partitionBy(*by)) + 1e-10) / temperature)
    return softmax(s, by, "_z").select(*by, "model_name", "rmse", "weight")


def equal_weights(df: DataFrame, by: Sequence[str]) -> DataFrame:
    m = df.select(*by, "model_name").distinct()
    return m.withColumn("weight", 1 / F.count(F.lit(1)).over(W.partitionBy(*by)))


def explicit_weights(weights: Mapping[str, float], df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Given weights scaled to sum 1, for every group of the frame."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must sum to a positive number")
    cells = F.array(*[F.struct(F.lit(m).alias("model_name"), F.lit(w / total).alias("weight")) for m, w in weights.items()])
    return df.select(*by).distinct().select(*by, F.explode(cells).alias("_w")).select(*by, "_w.*")


def anchor_blend(df: DataFrame, keys: Sequence[str], anchor: str, weight: float = 0.9) -> DataFrame:
    """weight x anchor + rest x mean of the others; each stands in for the other when absent."""
    g = df.groupBy(*keys).agg(
        F.max(F.when(F.col("model_name") == anchor, F.col("y_pred"))).alias("_a"),
        F.avg(F.when(F.col("model_name") != anchor, F.col("y_pred"))).alias("_o"),
        F.max("y_true").alias("y_true"),
    )
    a, o = F.coalesce("_a", "_o"), F.coalesce("_o", "_a")
    return g.withColumn("y_fused", weight * a + (1 - weight) * o).drop("_a", "_o")


def project_weights(weights: DataFrame, by: Sequence[str], lo: float = BOUNDS[0], hi: float = BOUNDS[1], steps: int = 60, strict_fix: bool = False) -> DataFrame:
    """Weights within the bounds that sum to 1, by the published rule (``linear.pin_and_share``).

    ``strict_fix`` gives the nearest such weights instead, by bisection inside an array fold. A group is an array of its
    few models either way.
    """
    arr = weights.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("model_name", "weight"))).alias("_m"))
    if not strict_fix:
        shared = arr.select(*by, "_m", linear.pin_and_share(F.col("_m.weight"), lo, hi).alias("_w"))
        both = F.explode(F.arrays_zip(F.col("_m.model_name").alias("model_name"), F.col("_w").alias("weight")))
        return shared.select(*by, both.alias("_z")).select(*by, "_z.model_name", "_z.weight")
    v = F.transform("_m", lambda m: F.least(F.greatest(m["weight"], F.lit(float(lo))), F.lit(float(hi))))
    arr = arr.withColumn("_v", v)

    def total(shift):
        return F.aggregate(
            "_v", F.lit(0.0), lambda acc, x: acc + F.least(F.greatest(x - shift, F.lit(float(lo))), F.lit(float(hi)))
        )

    start = F.struct((F.array_min("_v") - hi).alias("a"), (F.array_max("_v") - lo).alias("b"))

    def halve(acc, _):
        mid = (acc["a"] + acc["b"]) / 2
        over = total(mid) > 1.0
        return F.struct(F.when(over, mid).otherwise(acc["a"]).alias("a"), F.when(over, acc["b"]).otherwise(mid).alias("b"))

    arr = arr.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve))
    shift = (F.col("_s.a") + F.col("_s.b")) / 2
    keep = F.abs(F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x) - 1.0) <= 1e-9
    out = F.when(keep, F.col("_v")).otherwise(
        F.transform("_v", lambda x: F.least(F.greatest(x - shift, F.lit(float(lo))), F.lit(float(hi))))
    )
    arr = arr.withColumn("_w", out)
    zipped = F.explode(F.arrays_zip(F.col("_m.model_name").alias("model_name"), F.col("_w").alias("weight")))
    return arr.select(*by, zipped.alias("_z")).select(*by, "_z.model_name", "_z.weight")


def scale_weights(weights: DataFrame, by: Sequence[str], lo: float = BOUNDS[0], hi: float = BOUNDS[1]) -> DataFrame:
    """Clip, divide by the sum, clip and divide again; equal weights when the sum vanishes."""
    w = W.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    df = weights.withColumn("_c", clip(F.coalesce("weight", F.lit(0.0)), lo, hi))
    df = df.withColumn("_t", F.sum("_c").over(w))
    df = df.withColumn("_d", F.when(F.abs("_t") > MIN_WEIGHT_SUM, clip(F.col("_c") / F.col("_t"), lo, hi)).otherwise(1 / n))
    df = df.withColumn("_u", F.sum("_d").over(w))
    final = F.when(F.abs(F.col("_t") - 1) < MIN_WEIGHT_SUM, F.col("_c")).when(
        F.abs("_u") < MIN_WEIGHT_SUM, 1 / n
    ).otherwise(F.col("_d") / F.col("_u"))
    return df.withColumn("weight", final).drop("_c", "_t", "_d", "_u")


def fill_weights(weights: DataFrame, spine: DataFrame, by: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Complete (group, model) combinations; absent ones get 1/n."""
    cells = F.explode(F.array(*[F.lit(m) for m in models]))
    full = spine.select(*by).distinct().withColumn("model_name", cells)
    return full.join(weights.select(*by, "model_name", "weight"), [*by, "model_name"], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(1.0 / len(models)))
    )


MISSING_RULES = ("propagate", "renorm_tol", "renorm_group", "renorm_row", "zero", "renorm_used")


def fuse(
    df: DataFrame,
    weights: DataFrame,
    by: Sequence[str] = GROUP,
    point: Sequence[str] = POINT,
    missing: str = "renorm_tol",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Weighted sum of the models per point; ``missing`` names the rule for gaps.

    * propagate: any weighted model missing gives null
    * renorm_tol: divide by the used weights only if off 1 by more than 0.01
    * renorm_group: scale over the models seen in the (group, day), then skip gaps
    * renorm_row: always divide by the used weights, equal weights if they vanish
    * zero: a gap counts as 0
    * renorm_used: divide by the used weights, null if they vanish

    Groups without any weights fall back to the mean (``regime`` = fallback_mean).
    """
    return fuse_rules(df, weights, by, point, [missing], carry).drop("rule")


def fuse_rules(
    df: DataFrame,
    weights: DataFrame,
    by: Sequence[str] = GROUP,
    point: Sequence[str] = POINT,
    rules: Sequence[str] = MISSING_RULES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``fuse`` under several rules for gaps: a row per point and ``rule``, from one pass over the panel."""
    unknown = [r for r in rules if r not in MISSING_RULES]
    if unknown or not rules:
        raise ValueError(f"unknown rule {unknown}; some of {MISSING_RULES}")
    by, point = list(by), list(point)
    per_group = weights.groupBy(*by).agg(F.count(F.lit(1)).alias("_nw"))
    ok = F.col("y_pred").isNotNull()
    j = df.join(weights.select(*by, "model_name", F.col("weight").alias("_w")), [*by, "model_name"], "left")
    j = j.join(per_group, by, "left")
    scaled = []
    if "renorm_group" in rules:
        day = list(dict.fromkeys([*by, "target_day"]))
        seen = j.groupBy(*day, "model_name").agg(F.max("_w").alias("_gw"))
        seen = seen.groupBy(*day).agg(F.sum(F.coalesce("_gw", F.lit(0.0))).alias("_tot"), F.count(F.lit(1)).alias("_nm"))
        j = j.join(seen, day, "left")
        j = j.withColumn("_s", F.when(F.col("_tot") < MIN_WEIGHT_SUM, 1 / F.col("_nm")).otherwise(F.col("_w") / F.col("_tot")))
        scaled = [F.sum(F.when(ok, F.col("_s") * F.col("y_pred"))).alias("_sv")]
    g = j.groupBy(*point).agg(
        F.max("y_true").alias("y_true"),
        *[F.max(c).alias(c) for c in carry],
        F.sum(F.when(ok, F.col("_w") * F.col("y_pred"))).alias("_v"),
        F.sum(F.when(ok, F.col("_w"))).alias("_u"),
        F.avg("y_pred").alias("_mean"),
        F.count(F.when(ok & F.col("_w").isNotNull(), 1)).alias("_used"),
        F.max("_nw").alias("_nw"),
        *scaled,
    )
    vv, uu = F.coalesce("_v", F.lit(0.0)), F.coalesce("_u", F.lit(0.0))
    value = {
        "propagate": F.when(F.col("_used") == F.col("_nw"), vv),
        "renorm_tol": F.when((uu > MIN_WEIGHT_SUM) & (F.abs(uu - 1) > RENORM_TOL), vv / uu).otherwise(vv),
        "renorm_group": F.coalesce("_sv", F.lit(0.0)) if scaled else None,
        "renorm_row": F.when(uu > 0, vv / uu).otherwise(F.col("_mean")),
        "zero": vv,
        "renorm_used": F.when(uu > 0, vv / uu),
    }
    none = F.col("_nw").isNull()
    cells = [F.struct(F.lit(r).alias("rule"), F.when(none, F.col("_mean")).otherwise(value[r]).alias("y_fused")) for r in rules]
    out = g.withColumn("regime", F.when(none, "fallback_mean").otherwise("weights")).withColumn("_r", F.explode(F.array(*cells)))
    return out.select(*point, "y_true", *carry, "_r.y_fused", "regime", "_r.rule")


def mean_fusion(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("y_pred").alias("y_fused"), F.max("y_true").alias("y_true"))


def multi_run_mean(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean prediction over runs; null keys form groups of their own."""
    return df.groupBy(*keys).agg(F.avg("y_pred").alias("y_pred"), F.count(F.lit(1)).alias("runs"))


def rolling_weights(
    df: DataFrame,
    series: Sequence[str],
    models: Sequence[str],
    method: str = "softmax",
    window_days: int = 30,
    min_history_days: int = 10,
    temperature: float = 0.1,
    alpha: float = 1.0,
    anchor: str | None = None,
    anchor_weight: float = 0.9,
) -> DataFrame:
    """Weights for every day D fitted on [D-window, D-1]; equal weights without enough history.

    Daily sums are added up over a range window of day numbers, so a day costs
    the same however long the window is, and no training row is read twice.
    Gaps count as 0, as in the compared results.
    """
    series = list(series)
    k = len(models)
    wide = wide_frame(df, [*series, "business_day", "hour_business"], models)
    x = [F.coalesce(F.col(m), F.lit(0.0)) for m in models]
    cells = {f"_g{i}_{j}": F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)}
    cells.update({f"_b{i}": F.sum(x[i] * F.col("y_true")) for i in range(k)})
    cells.update({f"_s{i}": F.sum(x[i]) for i in range(k)})
    daily = wide.groupBy(*series, "business_day").agg(
        *[c.alias(n) for n, c in cells.items()],
        F.sum("y_true").alias("sy"),
        F.sum(F.col("y_true") * F.col("y_true")).alias("yy"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    past = W.partitionBy(*series).orderBy(clock.day_number("business_day")).rangeBetween(-window_days, -1)
    names = [*cells, "sy", "yy", "n"]
    rolled = daily.select(
        *series, "business_day", *[F.sum(c).over(past).alias(c) for c in names], F.count(F.lit(1)).over(past).alias("days")
    )
    stats = solve.pack(rolled, [*series, "business_day"], k, ["days"])
    enough = (F.col("days") >= min(min_history_days, window_days // 2)) & (F.col("n") >= min_history_days * 4)
    stats = stats.withColumn("_ok", F.coalesce(enough, F.lit(False)))
    key = [*series, "business_day"]
    if method == "softmax":
        sq = [F.col("yy") - 2 * F.col("b")[i] + F.col("g")[i * k + i] for i in range(k)]
        rm = F.array(*[F.sqrt(F.greatest(e, F.lit(0.0)) / F.col("n")) for e in sq])
        names_col = F.array(*[F.lit(m) for m in models])
        out = stats.select(
            *key, "_ok", F.explode(F.arrays_zip(names_col.alias("model_name"), rm.alias("rmse"))).alias("_z")
        ).select(*key, "_ok", F.col("_z.model_name").alias("model_name"), F.col("_z.rmse").alias("rmse"))
        top = F.max("rmse").over(W.partitionBy(*key)) + 1e-10
        out = softmax(out.withColumn("_z", -F.col("rmse") / top / temperature), key, "_z").drop("_z", "rmse")
    elif method == "equal":
        out = stats.select(*key, "_ok", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_name")).withColumn("weight", F.lit(1.0 / k))
    else:
        kw = {"anchor": models.index(anchor), "anchor_weight": anchor_weight} if method == "anchor" else {}
        out = solve.solve(stats, key, models, method, keep=["_ok"], alpha=alpha, **kw)
    return out.withColumn("weight", F.when(F.col("_ok"), F.col("weight")).otherwise(1.0 / k)).select(*key, "model_name", "weight")


def _loss(kind: str, y: Column, p: Column) -> Column:
    if kind == "mae":
        return F.abs(y - p)
    if kind == "composite":
        base = scores.smape_row("fraction", y, p)
        return 0.6 * base + 0.3 * F.abs(y - p) / F.greatest(F.abs(y), F.lit(1e-6)) + 0.1 * F.when(F.col("_peak"), F.abs(y - p)).otherwise(0.0)
    return scores.smape_row("floor50", y, p)


def _descend(k: int, reg: float, bounds: tuple[float, float]):
    """UDF: the next weights of a group from its sums at the present ones."""
    lo, hi = bounds

    def one(g, b, n, w, best, prior, better):
        w, best, prior = (np.asarray(v, float) for v in (w, best, prior))
        if not better:
            return (w + best) / 2  # too far: half the way back
        a = np.asarray(g, float).reshape(k, k) / n + 2 * reg * np.eye(k)
        return solve.box_minimum(a, np.asarray(b, float) / n + 2 * reg * prior, lo, hi, 1.0, w)

    @F.pandas_udf("array<double>")
    def step(g: pd.Series, b: pd.Series, n: pd.Series, w: pd.Series, best: pd.Series, prior: pd.Series, better: pd.Series) -> pd.Series:
        return pd.Series([one(*row).tolist() if row[2] and row[2] > 0 else list(row[3]) for row in zip(g, b, n, w, best, prior, better, strict=True)])

    return step


def convex_search(
    wide: DataFrame,
    by: Sequence[str],
    models: Sequence[str],
    loss: str = "floor50",
    reg: float = 0.0,
    prior: DataFrame | None = None,
    bounds: tuple[float, float] = (0.0, 1.0),
    rounds: int = 25,
    tolerance: float = 1e-5,
    weight: str | None = None,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Weights of sum 1 within ``bounds`` with the least mean loss plus reg x squared distance to a prior.

    Iteratively reweighted least squares: at the present weights a row's loss is replaced by a parabola of the same slope,
    so a group needs k x k sums from one grouped pass, whatever its size, and its next weights are an exact small
    constrained solve. A step that does not lower the objective is halved.

    The losses have the prediction in a denominator, so a group may have several minima. It starts from the prior, equal
    weights, every single model, every two models at halves, and the caller's ``starts`` (by, weights); all starts go down
    together, as more rows of the small state, so one pass serves them all, and the least objective is taken. It is never
    above that of any start. A start that has not gained more than ``tolerance`` in two passes rests, and takes no part in
    later passes; ends when all rest, or after ``rounds``. Result: by, weights, loss, objective.
    """
    by, k = list(by), len(models)
    rows = wide.na.drop(subset=["y_true", *models]).withColumn("_x", F.array(*[F.col(m).cast("double") for m in models]))
    keep = [*by, "y_true", "_x"]
    if loss == "composite":
        cut = quantile.quantiles(rows, by, "y_true", {"_q90": 0.90})
        rows = rows.join(cut, by).withColumn("_peak", F.col("y_true") >= F.col("_q90"))
        keep.append("_peak")
    rows = rows.withColumn("_gate", F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0))
    rows = materialise(rows.select(*keep, "_gate"), "search")
    state = rows.groupBy(*by).agg((F.avg(F.abs("y_true")) * 1e-5 + 1e-9).alias("_e"))
    equal = F.array(*[F.lit(1.0 / k)] * k)
    if prior is not None:
        pr = prior.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("model_name", "weight"))).alias("_p"))
        pr = pr.select(*by, F.array(*[F.coalesce(F.try_element_at("_p", F.lit(m)), F.lit(0.0)) for m in models]).alias("_prior"))
        state = state.join(pr, by, "left").withColumn("_prior", F.coalesce("_prior", equal))
    else:
        state = state.withColumn("_prior", equal)
    lo, hi = bounds
    inside = F.pandas_udf(lambda s: s.map(lambda v: solve.project_box(np.asarray(v, float), lo, hi).tolist()), "array<double>")
    corners = [equal, *[F.array(*[F.lit(float(m in pair) / len(pair)) for m in range(k)]) for pair in [*[(i,) for i in range(k)], *combinations(range(k), 2)]]]
    own = state.select(*by, F.posexplode(F.array("_prior", *corners)).alias("_start", "_w"))
    if starts is not None:
        given = starts.select(*by, F.col("weights").alias("_w"))
        own = own.unionByName(given.join(state.select(*by), by).withColumn("_start", F.lit(-1)))
    state = own.join(state, by).withColumn("_w", inside("_w"))
    state = state.groupBy(*by, "_w").agg(F.min("_start").alias("_start"), *[F.first(c).alias(c) for c in ("_e", "_prior")])  # equal starts once
    state = state.withColumns({"_best": F.col("_w"), "_obj": F.lit(float("inf")), "loss": F.lit(float("inf")), "_idle": F.lit(0)})
    state = materialise(state.select(*by, "_start", "_e", "_prior", "_w", "_best", "_obj", "loss", "_idle"), "state")
    resting = None
    step, pairs = _descend(k, reg, bounds), [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(rounds):
        dot = F.aggregate(F.zip_with("_w", "_x", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        at = rows.join(state.select(*by, "_start", "_w", "_e"), by).withColumn("_f", dot).withColumn("_d", F.col("_f") - F.col("y_true"))
        y, f, e = F.col("y_true"), F.col("_f"), F.col("_e")
        near = F.abs("_d") < e  # at the kink: the parabola through the loss at distance e
        off = F.when(near, y + e).otherwise(f)
        at = at.withColumn("_l", _loss(loss, y, f)).withColumn("_q", _loss(loss, y, off) / ((off - y) * (off - y)))
        slope = (_loss(loss, y, f + e / 4) - _loss(loss, y, f - e / 4)) / (e / 2)
        at = at.withColumn("_s", F.when(near, F.lit(0.0)).otherwise(slope - F.col("_q") * F.col("_d")))
        q, target = F.col("_gate") * F.col("_q"), F.col("_gate") * (F.col("_q") * y - F.col("_s"))
        sums = at.groupBy(*by, "_start").agg(
            *[F.sum(q * F.col("_x")[i] * F.col("_x")[j]).alias(f"_g{i}_{j}") for i, j in pairs],
            *[F.sum(target * F.col("_x")[i]).alias(f"_b{i}") for i in range(k)],
            F.sum("_gate").alias("_n"), scores.weighted_mean(F.col("_l"), F.col("_gate")).alias("_now"),
        )
        g = F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
        pull = F.aggregate(F.zip_with("_w", "_prior", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
        new = state.join(sums, [*by, "_start"]).withColumn("_o", F.coalesce(F.col("_now") + reg * pull, F.lit(float("inf"))))
        better = F.col("_o") < F.col("_obj")
        gained = better & (F.col("_obj") - F.col("_o") > tolerance * F.abs("_o"))
        new = new.withColumns({"_better": better, "_idle": F.when(gained, 0).otherwise(F.col("_idle") + 1)})
        new = new.withColumns({c: F.when(F.col("_better"), F.col(v)).otherwise(F.col(c)) for c, v in (("_best", "_w"), ("loss", "_now"), ("_obj", "_o"))})
        new = new.withColumn("_w", step(g, F.array(*[F.col(f"_b{i}") for i in range(k)]), "_n", "_w", "_best", "_prior", "_better"))
        state = materialise(new.select(*by, "_start", "_e", "_prior", "_w", "_best", "_obj", "loss", "_idle"), "state")
        done = state.where("_idle >= 3")
        resting = done if resting is None else resting.unionByName(done)
        state = state.where("_idle < 3")
        if not state.take(1):
            break
    ends = state if resting is None else resting.unionByName(state)
    least = ends.groupBy(*by).agg(F.min_by(F.struct("_best", "loss", "_obj"), F.struct("_obj", "_start")).alias("_m"))
    return least.select(*by, F.col("_m._best").alias("weights"), F.col("_m.loss").alias("loss"), F.col("_m._obj").alias("objective"))


def as_long(found: DataFrame, by: Sequence[str], models: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(m) for m in models])
    z = F.explode(F.arrays_zip(names.alias("model_name"), F.col("weights").alias("weight")))
    return found.select(*by, z.alias("_z")).select(*by, F.col("_z.model_name").alias("model_name"), F.col("_z.weight").alias("weight"))


# Spike probabilities between which base weights are kept.
SPIKE_HIGH = 0.6
SPIKE_LOW = 0.2


def interpolation(prob: Column) -> dict[str, Column]:
    """alpha_up rises from 0 at 0.6 to 1 at 1; alpha_down from 0 at 0.2 to 1 at 0; regime."""
    p = F.coalesce(prob, F.lit(0.5))
    return {
        "alpha_up": F.when(p >= SPIKE_HIGH, F.least(F.lit(1.0), (p - SPIKE_HIGH) / (1 - SPIKE_HIGH))).otherwise(0.0),
        "alpha_down": F.when(p <= SPIKE_LOW, F.greatest(F.lit(0.0), 1 - p / SPIKE_LOW)).otherwise(0.0),
        "spike_regime": F.when(p >= SPIKE_HIGH, "spike_heavy").when(p <= SPIKE_LOW, "calm_heavy").otherwise("neutral"),
    }


def fuse_spike_aware(
    df: DataFrame, weights: DataFrame, templates: DataFrame, by: Sequence[str] = GROUP, point: Sequence[str] = POINT, prob: str = "spike_prob"
) -> DataFrame:
    """renorm_tol fusion whose 9_16 weights move towards templates with the spike probability.

    ``templates``: by, model_name, up, down. Weights are formed per row of the
    long table over all models of the group and normalised inside the point.
    """
    by, point = list(by), list(point)
    pts = df.groupBy(*point).agg(F.max("y_true").alias("y_true"), F.max(prob).alias("_p"), F.avg("y_pred").alias("_mean"))
    pts = pts.withColumns(interpolation(F.col("_p")))
    table = weights.join(templates, [*by, "model_name"], "left")
    full = pts.join(table, by)
    mid = F.col("period") == "9_16"
    w = F.col("weight")
    moved = w + F.col("alpha_up") * (F.coalesce("up", w) - w)
    moved = moved + F.col("alpha_down") * (F.coalesce("down", F.lit(0.0)) - w)
    active = mid & ((F.col("alpha_up") > 0) | (F.col("alpha_down") > 0))
    full = full.withColumns({"_active": active, "_base": w, "weight": F.when(active, moved).otherwise(w)})
    scaled = scale_weights(full, point)
    scaled = scaled.withColumn("weight", F.when(F.col("_active"), F.col("weight")).otherwise(F.col("_base")))
    preds = df.select(*point, "model_name", F.col("y_pred").alias("_y"))
    j = scaled.join(preds, [*point, "model_name"], "left")
    g = j.groupBy(*point).agg(
        F.max("y_true").alias("y_true"), F.max("spike_regime").alias("spike_regime"),
        F.sum(F.when(F.col("_y").isNotNull(), F.col("weight") * F.col("_y"))).alias("_v"),
        F.sum(F.when(F.col("_y").isNotNull(), F.col("weight"))).alias("_u"),
    )
    off = (F.col("_u") > MIN_WEIGHT_SUM) & (F.abs(F.col("_u") - 1) > RENORM_TOL)
    g = g.withColumn("y_fused", F.when(off, F.col("_v") / F.col("_u")).otherwise(F.coalesce("_v", F.lit(0.0))))
    out = pts.select(*point, F.col("y_true").alias("_t"), "_mean").join(g.drop("y_true", "_v", "_u"), point, "left")
    none = F.col("spike_regime").isNull()
    return out.select(
        *point,
        F.col("_t").alias("y_true"),
        F.when(none, F.col("_mean")).otherwise(F.col("y_fused")).alias("y_fused"),
        F.when(none, "fallback_mean").when(~mid, "neutral").otherwise(F.col("spike_regime")).alias("spike_regime"),
    )


def mix_router(base: DataFrame, router: DataFrame, by: Sequence[str], alpha: Column | float) -> DataFrame:
    """base + alpha (router - base), scaled to sum 1."""
    r = router.select(*by, "model_name", F.col("weight").alias("_r"))
    j = base.join(r, [*by, "model_name"], "left")
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return scale_weights(j.withColumn("weight", F.col("weight") + a * (F.coalesce("_r", F.lit(0.0)) - F.col("weight"))).drop("_r"), by)


# Grid of the affine search.
SCALES = (0.70, 0.80, 0.90, 0.95, 1.00, 1.05, 1.10, 1.20)
BIASES = (-30.0, -15.0, -5.0, 0.0, 5.0, 15.0, 30.0)
AFFINE_MIN_ROWS = 4


def affine_search(df: DataFrame, by: Sequence[str], pred: str = "y_fused") -> DataFrame:
    """Scale and bias with the lowest sMAPE among 56 pairs, the first on ties."""
    pairs = [(s, b) for s in SCALES for b in BIASES]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("scale"), F.lit(b).alias("bias")) for i, (s, b) in enumerate(pairs)])
    g = (
        df.where(F.col("y_true").isNotNull() & F.col(pred).isNotNull())
        .select(*by, "y_true", F.col(pred).alias("_f"), F.explode(cells).alias("_c"))
        .groupBy(*by, "_c")
        .agg(scores.smape("floor50", F.col("y_true"), F.col("_c.scale") * F.col("_f") + F.col("_c.bias")).alias("smape"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") >= AFFINE_MIN_ROWS)
    )
    best = g.groupBy(*by).agg(F.min_by(F.struct("_c", "smape", "rows"), F.struct("smape", "_c.i")).alias("_b"))
    return best.select(*by, F.col("_b._c.scale").alias("scale"), F.col("_b._c.bias").alias("bias"), F.col("_b.smape").alias("smape"), F.col("_b.rows").alias("rows"))


def apply_affine(df: DataFrame, fit: DataFrame, by: Sequence[str], pred: str = "y_fused") -> DataFrame:
    j = df.join(fit.select(*by, "scale", F.col("bias").alias("_b")), list(by), "left")
    return j.withColumn(pred, F.coalesce("scale", F.lit(1.0)) * F.col(pred) + F.coalesce("_b", F.lit(0.0))).drop("scale", "_b")


def override_segment(base: DataFrame, alt: DataFrame, keys: Sequence[str], task: str, period: str = "9_16", pred: str = "y_pred") -> DataFrame:
    """Take one segment of one task from another table where it has a value."""
    side = alt.select(*keys, F.col(pred).alias("_a"))
    hit = (F.col("task") == task) & (F.col("period") == period) & F.col("_a").isNotNull()
    return base.join(side, list(keys), "left").withColumn(pred, F.when(hit, F.col("_a")).otherwise(F.col(pred))).drop("_a")


def add_residual(base: DataFrame, residual: DataFrame, keys: Sequence[str], period: str = "9_16", pred: str = "y_pred") -> DataFrame:
    """Add a residual to one period; hours without one stay."""
    side = residual.select(*keys, F.col("residual").alias("_r"))
    add = F.when(F.col("period") == period, F.coalesce("_r", F.lit(0.0))).otherwise(0.0)
    return base.join(side, list(keys), "left").withColumn(pred, F.col(pred) + add).drop("_r")


def backtest(
    df: DataFrame, series: Sequence[str], split_day: str, truth: DataFrame | None = None, missing: str = "renorm_tol"
) -> tuple[DataFrame, DataFrame]:
    """Weights on days before the split, applied from it on; truth optionally from the source."""
    from . import joins

    d = F.lit(split_day).cast("date")
    by = [*series, *GROUP]
    w = inverse_mae(df.where(F.col("target_day") < d), by)
    test = df.where(F.col("target_day") >= d)
    if truth is not None:
        test = joins.overwrite_truth(test, truth, series)
    return w, fuse(test, w, by, [*series, *POINT], missing)
