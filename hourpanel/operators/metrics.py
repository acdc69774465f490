"""Accuracy scorecards: one grouped pass each, thresholds joined back by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numeric import flag, mean_if, safe_div
from . import quantile, rowblocks


def with_overall(df: DataFrame, keys: Sequence[str], detail: str, aggs: Mapping[str, Column], label: str = "overall") -> DataFrame:
    """Metrics per (keys, detail) plus one row per keys labelled ``overall``."""
    cols = [F.col(k) for k in keys]
    sets = [[*cols, F.col(detail)], cols]
    out = df.groupingSets(sets, *cols, F.col(detail)).agg(
        *[a.alias(n) for n, a in aggs.items()], F.grouping(detail).alias("_g")
    )
    return out.withColumn(detail, F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(detail).cast("string"))).drop("_g")


def standard_aggs(y_true: str = "y_true", y_pred: str = "y_pred", variant: str = "floor50") -> dict[str, Column]:
    return {
        "rows": F.count(F.lit(1)),
        "smape": scores.smape(variant, y_true, y_pred),
        "mae": scores.mae(y_true, y_pred),
        "rmse": scores.rmse(y_true, y_pred),
        "bias_mean": scores.bias_mean(y_true, y_pred),
    }


def full_metrics(df: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """MAE to weighted peak MAE per group.

    Order statistics (median bias, median truth, q90, q95) come from the exact
    distributed quantiles; all averages from one pass over the joined rows.
    """
    by = list(by)
    df = df.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    df = df.withColumns({"_w": w, "_bias": F.col("y_pred") - F.col("y_true"), "_abs_t": F.abs("y_true")})
    side = quantile.column_quantiles(
        df, by, {"_q90": ("y_true", 0.90), "_q95": ("y_true", 0.95), "bias_median": ("_bias", 0.5), "_med_abs": ("_abs_t", 0.5)}
    )
    gap = F.abs(F.col("_bias"))
    peak = F.col("y_true") >= F.col("_q90")
    return (
        df.join(side, by)
        .groupBy(*by)
        .agg(
            *[a.alias(n) for n, a in standard_aggs().items()],
            F.first("bias_median").alias("bias_median"),
            F.avg(F.when(peak, gap)).alias("q90_mae"),
            F.avg(F.when(F.col("y_true") >= F.col("_q95"), gap)).alias("q95_mae"),
            scores.weighted_mean(gap / F.greatest("_med_abs", F.lit(1e-6)), F.col("_w")).alias("weighted_norm_mae"),
            scores.weighted_mean(F.when(peak, gap), F.col("_w")).alias("weighted_peak_mae"),
        )
    )


def error_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        scores.mae("y_true", "y_pred").alias("mae"),
        scores.mse("y_true", "y_pred").alias("mse"),
        scores.rmse("y_true", "y_pred").alias("rmse"),
        scores.r2("y_true", "y_pred").alias("r2"),
        scores.mape_floor50("y_true", "y_pred").alias("mape"),
    )


def tail_metrics(df: DataFrame, by: Sequence[str], probs: Sequence[float] = (0.90, 0.95)) -> DataFrame:
    """Errors where the true delta is large: columns delta_target, delta_hat, rt_actual, rt_hat."""
    by = list(by)
    df = df.withColumn("_mag", F.abs("delta_target"))
    names = {f"_q{i}": p for i, p in enumerate(probs)}
    cuts = quantile.quantiles(df, by, "_mag", names)
    tails = F.explode(
        F.array(*[F.struct(F.lit(p).alias("tail_quantile"), F.col(n).alias("threshold_abs_delta")) for n, p in names.items()])
    )
    cuts = cuts.select(*by, tails.alias("_t")).select(*by, "_t.*")
    hit = df.join(cuts, by).where(F.col("_mag") >= F.col("threshold_abs_delta"))
    return hit.groupBy(*by, "tail_quantile", "threshold_abs_delta").agg(
        F.count(F.lit(1)).alias("count"),
        scores.mae("delta_target", "delta_hat").alias("tail_delta_mae"),
        scores.smape("raw", "rt_actual", "rt_hat").alias("tail_rt_smape"),
        F.avg(((F.col("delta_target") > 0) == (F.col("delta_hat") > 0)).cast("double")).alias("tail_direction_accuracy"),
    )


def delta_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spread metrics incl. direction accuracy and recall of positive moves."""
    up, up_hat = F.col("delta_target") > 0, F.col("delta_hat") > 0
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        scores.smape("raw", "rt_actual", "rt_hat").alias("rt_smape"),
        scores.smape("capped", "rt_actual", "rt_hat").alias("rt_capped_smape"),
        scores.mae("rt_actual", "rt_hat").alias("rt_mae"),
        scores.rmse("rt_actual", "rt_hat").alias("rt_rmse"),
        scores.mae("delta_target", "delta_hat").alias("delta_mae"),
        scores.rmse("delta_target", "delta_hat").alias("delta_rmse"),
        F.avg((up == up_hat).cast("double")).alias("direction_accuracy"),
        F.avg(F.when(up, up_hat.cast("double"))).alias("positive_direction_recall"),
    )


def step_sign_agreement(df: DataFrame, series: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Share of hour-to-hour moves with the same sign in truth and prediction."""
    rb = rowblocks.RowBlocks(df.select(*series, "ds", y_true, y_pred), series, before=1)
    moves = rb.add(
        {
            "_dt": F.signum(F.col(y_true) - rowblocks.lag(rb, y_true, 1)),
            "_dp": F.signum(F.col(y_pred) - rowblocks.lag(rb, y_pred, 1)),
        }
    )
    return moves.groupBy(*series).agg(F.avg((F.col("_dt") == F.col("_dp")).cast("double")).alias("scr"))


def arbitrage(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Profit of selling day-ahead when the forecast beats the true day-ahead price.

    Needs y_true_rt, y_true_da, y_pred_rt, y_pred_da.
    """
    base = F.col("y_pred_da") > F.col("y_true_da")
    better = base & (F.col("y_pred_rt") > F.col("y_pred_da"))
    spread = F.col("y_true_rt") - F.col("y_true_da")
    out = df.groupBy(*by).agg(
        F.sum(F.when(base, spread).otherwise(0.0)).alias("total_profit"),
        F.sum(flag(base)).alias("total_volume"),
        F.sum(F.when(better, spread).otherwise(0.0)).alias("improved_total_profit"),
        F.sum(flag(better)).alias("improved_total_volume"),
    )
    return out.withColumns(
        {
            "unit_profit": safe_div("total_profit", "total_volume"),
            "improved_unit_profit": safe_div("improved_total_profit", "improved_total_volume"),
        }
    )


def price_buckets(df: DataFrame, by: Sequence[str], y_true: str = "y_true") -> DataFrame:
    """Add ``bucket``: negative (<= 0), spike (>= p95 of the group), normal."""
    by = list(by)
    cut = quantile.quantiles(df, by, y_true, {"_p95": 0.95})
    return (
        df.join(cut, by)
        .withColumn(
            "bucket",
            F.when(F.col(y_true) <= 0, "negative").when(F.col(y_true) >= F.col("_p95"), "spike").otherwise("normal"),
        )
        .drop("_p95")
    )


def bucket_metrics(df: DataFrame, by: Sequence[str], y_pred: str = "y_pred") -> DataFrame:
    return (
        price_buckets(df, by)
        .groupBy(*by, "bucket")
        .agg(scores.smape("denom_absfloor", "y_true", y_pred).alias("smape"), F.count(F.lit(1)).alias("rows"))
    )


# Thresholds of the correction scorecards.
LOW_VALLEY = 50.0
HIGH_SPIKE = 150.0
OVERESTIMATE = 30.0
STACK_SEVERE = 100.0
SEVERE_GAP = 200.0
DATA_LIMIT = 5


def _gain(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round((before - after) / before * 100, 2)).otherwise(0.0)


def correction_scorecard(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Before/after scorecard over y_true, base_pred, final_pred, hour_business, high_spike_applied.

    ``false_lift_rate`` here is the share of lifted rows whose final value does
    not exceed the truth, unlike in ``spike_scorecard``.
    """
    t, b, a = F.col("y_true"), F.col("base_pred"), F.col("final_pred")
    neg, low, spike = t < 0, t <= LOW_VALLEY, t > HIGH_SPIKE
    normal = ~F.col("hour_business").between(9, 16)
    gap_b, gap_a = F.abs(t - b), F.abs(t - a)

    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    lifted = F.col("high_spike_applied")
    g = df.groupBy(*by).agg(
        F.sum(flag(neg)).alias("negative_count"),
        F.sum(flag(low)).alias("low_valley_count"),
        F.sum(flag(spike)).alias("high_spike_count"),
        F.sum(flag(t - b > STACK_SEVERE)).alias("severe_underestimate"),
        zero(mean_if(neg, gap_b)).alias("negative_mae_before"),
        zero(mean_if(neg, gap_a)).alias("negative_mae_after"),
        zero(mean_if(low, gap_b)).alias("low_valley_mae_before"),
        zero(mean_if(low, gap_a)).alias("low_valley_mae_after"),
        F.sum(flag(neg & (b >= 0))).alias("negative_miss_before"),
        F.sum(flag(neg & (a >= 0))).alias("negative_miss_after"),
        F.sum(flag(low & (b - t >= OVERESTIMATE))).alias("low_valley_overestimate_before"),
        F.sum(flag(low & (a - t >= OVERESTIMATE))).alias("low_valley_overestimate_after"),
        scores.smape("denom50", t, b).alias("smape_before"),
        scores.smape("denom50", t, a).alias("smape_after"),
        zero(mean_if(spike, gap_b)).alias("high_spike_mae_before"),
        zero(mean_if(spike, gap_a)).alias("high_spike_mae_after"),
        F.round(1 - zero(F.avg(F.when(lifted, (a > t).cast("double")))), 4).alias("_lift"),
        F.sum(flag(lifted)).alias("_lifted"),
        scores.smape("denom50", t, b, normal).alias("normal_smape_before"),
        scores.smape("denom50", t, a, normal).alias("normal_smape_after"),
    )
    return g.withColumns(
        {
            "negative_mae_improvement": _gain(F.col("negative_mae_before"), F.col("negative_mae_after")),
            "low_valley_mae_improvement": _gain(F.col("low_valley_mae_before"), F.col("low_valley_mae_after")),
            "high_spike_mae_improvement": _gain(F.col("high_spike_mae_before"), F.col("high_spike_mae_after")),
            "smape_improvement": F.round(F.col("smape_before") - F.col("smape_after"), 4),
            "normal_degradation": F.coalesce(F.round(F.col("normal_smape_after") - F.col("normal_smape_before"), 4), F.lit(0.0)),
            "false_lift_rate": F.when(F.col("_lifted") > 0, F.col("_lift")).otherwise(0.0),
            "data_limited": F.col("negative_count") < DATA_LIMIT,
        }
    ).drop("_lift", "_lifted")


def spike_scorecard(df: DataFrame, by: Sequence[str], variant: str = "raw_capped") -> DataFrame:
    """Timestamp-level spike scorecard over base_fused_pred, final_pred, lift_applied, reason_code, high_spike_flag."""
    t, b, a = F.col("y_true"), F.col("base_fused_pred"), F.col("final_pred")
    spike = F.col("high_spike_flag") == 1
    lifted = F.col("lift_applied") > 0
    mid = F.col("period") == "9_16"
    g = df.groupBy(*by).agg(
        scores.smape(variant, t, a).alias("smape"),
        scores.smape(variant, t, b).alias("base_smape"),
        scores.smape(variant, t, a, mid).alias("smape_9_16"),
        scores.smape(variant, t, b, mid).alias("base_smape_9_16"),
        F.sum(flag(t - a > SEVERE_GAP)).alias("severe"),
        F.sum(flag(t - b > SEVERE_GAP)).alias("base_severe"),
        mean_if(spike, F.abs(t - a)).alias("spike_mae"),
        mean_if(spike, F.abs(t - b)).alias("base_spike_mae"),
        F.sum(flag(~spike)).alias("_quiet"),
        F.sum(flag(~spike & (a > b) & lifted)).alias("_quiet_lifted"),
        F.sum(flag(spike)).alias("_spikes"),
        F.sum(flag(spike & lifted)).alias("_spikes_lifted"),
        F.sum(flag(lifted)).alias("lift_applied_count"),
        F.count(F.lit(1)).alias("total_hours"),
        scores.smape(variant, t, b, ~mid).alias("normal_before"),
        scores.smape(variant, t, a, ~mid).alias("normal_after"),
        *[
            F.sum(flag(F.col("reason_code") == code)).alias(name)
            for code, name in (
                ("GUARDRAIL_CLIPPED", "lift_capped_count"),
                ("NO_CORRECTION_LOW_PROB", "rejected_low_prob"),
                ("NO_CORRECTION_NEGATIVE_BASE", "rejected_negative_base"),
                ("NO_CORRECTION_NORMAL_HOUR", "rejected_normal_hour"),
            )
        ],
    )
    one = F.lit(1)
    return g.withColumns(
        {
            "false_lift_rate": F.col("_quiet_lifted") / F.greatest(F.col("_quiet"), one),
            "spike_recall": F.col("_spikes_lifted") / F.greatest(F.col("_spikes"), one),
            "spike_precision": F.col("_spikes_lifted") / F.greatest(F.col("lift_applied_count"), one),
            "normal_degradation": F.col("normal_after") - F.col("normal_before"),
        }
    ).drop("_quiet", "_quiet_lifted", "_spikes", "_spikes_lifted")


def timestamp_metrics(df: DataFrame, series: Sequence[str], y_pred: str, variant: str = "absfloor_capped") -> DataFrame:
    """Per day and overall, after reducing to one row per hour: error, severe count, 9_16 share of severe."""
    from . import dedupe

    pts = dedupe.keep_one(
        df.select(*series, "business_day", "hour_business", "period", "y_true", y_pred),
        [*series, "business_day", "hour_business"],
        ["period", "y_true", y_pred],
    )
    severe = F.col("y_true") - F.col(y_pred) > SEVERE_GAP
    return with_overall(
        pts,
        list(series),
        "business_day",
        {
            "rows": F.count(F.lit(1)),
            "smape": scores.smape(variant, "y_true", y_pred),
            "smape_9_16": scores.smape(variant, "y_true", y_pred, F.col("period") == "9_16"),
            "severe": F.sum(flag(severe)),
            "severe_9_16": F.sum(flag(severe & (F.col("period") == "9_16"))),
        },
    )
