"""Alarms with memory and event detection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import flag
from . import quantile, rowblocks


def hysteresis(df: DataFrame, series: Sequence[str], prob: str, on: float, out: str = "alarm", keep: float = 0.8) -> DataFrame:
    """On at p >= on, stays on while p >= keep * on.

    The state is the last decisive value: certainly on, certainly off, or
    undecided in between - a forward fill of a three-valued signal.
    """
    p = F.col(prob)
    state = F.when(p >= on, F.lit(True)).when(p < keep * on, F.lit(False))
    return rowblocks.forward_fill(df, series, {out: state}).withColumn(out, F.coalesce(out, F.lit(False)))


def momentum(df: DataFrame, series: Sequence[str], prob: str, threshold: float, boost: float = 1.15, out: str = "boosted") -> DataFrame:
    """Raise a probability by ``boost`` (at most to 1) while the previous, already raised one is at the threshold.

    A row ends up at or above the threshold for sure when its own p is, for sure
    not when even the raised p is below; otherwise it copies its predecessor.
    """
    p = F.col(prob)
    state = F.when(p >= threshold, F.lit(True)).when(p * boost < threshold, F.lit(False))
    df = rowblocks.forward_fill(df, series, {"_on": state}, strict=True)
    return df.withColumn(out, F.when(F.coalesce("_on", F.lit(False)), F.least(p * boost, F.lit(1.0))).otherwise(p)).drop("_on")


def event_thresholds(df: DataFrame, keys: Sequence[str], rt: str, da: str, high: float = 0.95, low: float = 0.05, spread: float = 0.95) -> DataFrame:
    """high_spike, low_valley and spread_extreme limits per key."""
    gap = F.abs(F.col(rt) - F.col(da))
    return quantile.column_quantiles(
        df, keys, {"high_spike": (rt, high), "low_valley": (rt, low), "spread_extreme": (gap, spread)}
    )


def detect_events(df: DataFrame, limits: DataFrame, keys: Sequence[str], rt: str, da: str) -> DataFrame:
    """One row per event; an hour may raise several."""
    d = df.join(limits, list(keys))
    gap = F.abs(F.col(rt) - F.col(da))

    def event(name: str, cond: Column, value: Column):
        return F.when(
            cond, F.struct(F.lit(name).alias("event_type"), F.round(name, 2).alias("threshold"), F.round(value, 2).alias("value"))
        )

    hits = F.array_compact(
        F.array(
            event("high_spike", F.col(rt) > F.col("high_spike"), F.col(rt)),
            event("low_valley", F.col(rt) < F.col("low_valley"), F.col(rt)),
            event("spread_extreme", gap > F.col("spread_extreme"), gap),
        )
    )
    return d.withColumn("_e", F.explode(hits)).select(*df.columns, "_e.*")


def residual_events(df: DataFrame, by: Sequence[str], y_true: str, y_pred: str, q: float = 0.90) -> DataFrame:
    """Under- and overestimates beyond their own upper quantile."""
    r = F.col(y_true) - F.col(y_pred)
    d = df.join(quantile.column_quantiles(df, by, {"_under": (r, q), "_over": (-r, q)}), list(by))
    hits = F.array_compact(
        F.array(
            F.when(r > F.col("_under"), F.struct(F.lit("residual_underestimate").alias("event_type"), F.round("_under", 2).alias("threshold"), F.round(r, 2).alias("value"))),
            F.when(-r > F.col("_over"), F.struct(F.lit("residual_overestimate").alias("event_type"), F.round("_over", 2).alias("threshold"), F.round(-r, 2).alias("value"))),
        )
    )
    return d.withColumn("_e", F.explode(hits)).select(*df.columns, "_e.*")


def monthly_spikes(events: DataFrame, by: Sequence[str], rt: str) -> DataFrame:
    spike = events.where(F.col("event_type") == "high_spike")
    return spike.groupBy(*by, F.date_format("ds", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg(rt).alias("avg_price"),
        F.max(rt).alias("max_price"),
        F.sum(flag(F.col("period") == "9_16")).alias("n_9_16"),
        F.avg((F.col("period") == "9_16").cast("double")).alias("p9_16_ratio"),
    )


EVENT_TYPES = ("high_spike", "low_valley", "spread_extreme", "residual_underestimate", "residual_overestimate")


def period_events(events: DataFrame, by: Sequence[str], rt: str) -> DataFrame:
    return events.groupBy(*by, "period").agg(
        F.count(F.lit(1)).alias("total_events"),
        *[F.sum(flag(F.col("event_type") == e)).alias(e) for e in EVENT_TYPES],
        F.avg(rt).alias("avg_true_price"),
    )


# Quantiles between the five price regimes.
REGIME_PROBS = {"regime_p10": 0.10, "regime_p25": 0.25, "regime_p75": 0.75, "regime_p90": 0.90}


def classify_regime(df: DataFrame, by: Sequence[str], price: str) -> DataFrame:
    q = quantile.quantiles(df, by, price, REGIME_PROBS)
    v = F.col(price)
    return df.join(q, list(by)).withColumn(
        "regime",
        F.when(v > F.col("regime_p90"), "extreme_high")
        .when(v > F.col("regime_p75"), "high")
        .when(v >= F.col("regime_p25"), "normal")
        .when(v >= F.col("regime_p10"), "low")
        .otherwise("extreme_low"),
    )


def regime_performance(df: DataFrame, by: Sequence[str], y_true: str, y_pred: str) -> DataFrame:
    from ..functions import scores

    return df.groupBy(*by, "regime").agg(
        F.count(F.lit(1)).alias("count"),
        scores.smape("regime", y_true, y_pred).alias("smape"),
        scores.mae(y_true, y_pred).alias("mae"),
        F.avg(y_true).alias("price_mean"),
        F.stddev_samp(y_true).alias("price_std"),
    )


def worst_cases(df: DataFrame, size: str, n: int, tie: Sequence[str]) -> DataFrame:
    """Global top n; each task keeps its own n before the merge."""
    return df.orderBy(F.col(size).desc(), *tie).limit(n)


def latest_rows(df: DataFrame, by: Sequence[str], n: int, order: str = "ds") -> DataFrame:
    """Newest n rows per group; tasks keep n rows per group before the shuffle."""
    from .dedupe import top_per_key

    return top_per_key(df, by, [F.col(order).desc()], n)
