"""Accuracy measures as aggregate expressions.

Eleven sMAPE-like formulas look alike and give different numbers; each has a
name here and none is the default. ``smape_row`` is the per-row term and
``smape`` its mean. Rows where either value is null are skipped, except in
``row_capped`` where they count as the cap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, clip

# Floor for prices, cap for row errors, and the epsilons of each formula.
PRICE_FLOOR = 50.0
ROW_CAP = 50.0
EPS_FLOOR50 = 1e-6
EPS_RAW = 1e-6
EPS_REGIME = 1e-10

SMAPE_VARIANTS = (
    "floor50",
    "raw",
    "capped",
    "denom50",
    "eval_raw",
    "eval_clip50",
    "fraction",
    "row_capped",
    "regime",
    "absfloor_capped",
    "raw_capped",
    "denom_absfloor",
)


def _floor(c: Column, floor: float = PRICE_FLOOR) -> Column:
    return clip(c, lo=floor)


def _abs_floor(c: Column) -> Column:
    return clip(F.abs(c), lo=PRICE_FLOOR)


def smape_row(variant: str, y_true: Column | str, y_pred: Column | str) -> Column:
    t, p = as_col(y_true).cast("double"), as_col(y_pred).cast("double")
    gap = F.abs(p - t)
    if variant in ("floor50", "fraction", "row_capped"):
        ct, cp = _floor(t), _floor(p)
        ratio = F.abs(cp - ct) / clip((F.abs(ct) + F.abs(cp)) / 2, lo=EPS_FLOOR50)
        if variant == "fraction":
            return ratio
        if variant == "floor50":
            return 100 * ratio
        return F.coalesce(clip(100 * ratio, hi=ROW_CAP), F.lit(ROW_CAP))
    if variant == "raw":
        return 200 * gap / (F.abs(t) + F.abs(p) + EPS_RAW)
    if variant == "capped":
        return smape_row("raw", _floor(t), _floor(p))
    if variant == "denom50":
        return 100 * gap / clip((F.abs(t) + F.abs(p)) / 2, lo=PRICE_FLOOR)
    if variant == "eval_raw":
        return 200 * gap / clip(F.abs(t) + F.abs(p), lo=EPS_RAW)
    if variant == "eval_clip50":
        return smape_row("eval_raw", _floor(t), _floor(p))
    if variant == "regime":
        return 100 * 2 * gap / (F.abs(p) + F.abs(t) + EPS_REGIME)
    if variant == "absfloor_capped":
        at, ap = _abs_floor(t), _abs_floor(p)
        return clip(100 * F.abs(at - ap) / ((at + ap) / 2), hi=ROW_CAP)
    if variant == "raw_capped":
        half = (F.abs(t) + F.abs(p)) / 2
        return clip(F.when(half > EPS_REGIME, 100 * gap / half).when(half.isNotNull(), F.lit(0.0)), hi=ROW_CAP)
    if variant == "denom_absfloor":
        return 2 * gap / (_abs_floor(t) + _abs_floor(p))
    raise ValueError(f"unknown sMAPE variant {variant!r}; one of {SMAPE_VARIANTS}")


def smape(variant: str, y_true: Column | str, y_pred: Column | str, cond: Column | None = None) -> Column:
    row = smape_row(variant, y_true, y_pred)
    return F.avg(row if cond is None else F.when(cond, row))


def mae(y_true: Column | str, y_pred: Column | str, cond: Column | None = None) -> Column:
    gap = F.abs(as_col(y_true) - as_col(y_pred))
    return F.avg(gap if cond is None else F.when(cond, gap))


def mse(y_true: Column | str, y_pred: Column | str) -> Column:
    d = as_col(y_true) - as_col(y_pred)
    return F.avg(d * d)


def rmse(y_true: Column | str, y_pred: Column | str) -> Column:
    return F.sqrt(mse(y_true, y_pred))


def bias_mean(y_true: Column | str, y_pred: Column | str) -> Column:
    return F.avg(as_col(y_pred) - as_col(y_true))


def mape_floor50(y_true: Column | str, y_pred: Column | str) -> Column:
    t = as_col(y_true)
    return 100 * F.avg(F.abs(t - as_col(y_pred)) / clip(F.abs(t), lo=PRICE_FLOOR))


def r2(y_true: Column | str, y_pred: Column | str) -> Column:
    """1 - SSE/SST from one pass of mergeable sums; null on constant truth."""
    t, d = as_col(y_true), as_col(y_true) - as_col(y_pred)
    t = F.when(d.isNotNull(), t)
    sst = F.var_pop(t) * F.count(t)
    return F.when(sst > 0, 1 - F.sum(d * d) / sst)


def weighted_mean(value: Column, weight: Column, min_weight: float = 1e-9) -> Column:
    """Weighted mean; plain mean when the weights vanish."""
    w = F.when(value.isNotNull(), weight)
    total = F.sum(w)
    return F.when(total < min_weight, F.avg(value)).otherwise(F.sum(w * value) / total)
