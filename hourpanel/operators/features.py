"""Feature columns: calendar, lags, rolling windows, arithmetic, history rates.

Row-ordered features run over ``RowBlocks``; lags count rows, not hours, so a
gap shortens the real span, as in the compared results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numeric import as_col, clip, flag, mean_of
from ..session import materialise
from . import quantile, rowblocks
from .rowblocks import RowBlocks, lag, lead, rolling

# Hour sets and small constants.
PEAK_HOURS = (7, 8, 9, 16, 17, 18)
RISK_HOURS = (9, 10, 15)
NOON_HOURS = (11, 12, 13, 14)
NOON_SPACE = 23000.0
RATIO_EPS = 1e-5
SEASONS = ("winter", "spring", "summer", "autumn")


def calendar_features(df: DataFrame, ts: str = "ds", hour: str = "hour_business") -> DataFrame:
    t, h = F.col(ts), F.col(hour)
    dom = F.dayofmonth(t)
    angle = 2 * F.pi() * h / 24
    return df.withColumns(
        {
            "month": F.month(t),
            "day_of_week": F.weekday(t),
            "day_of_month": dom,
            "is_weekend": (F.weekday(t) >= 5).cast("int"),
            "season": F.element_at(F.array(*[F.lit(s) for s in SEASONS]), ((F.month(t) % 12) / 3).cast("int") + 1),
            "is_month_start": (dom <= 3).cast("int"),
            "is_month_end": (dom >= 28).cast("int"),
            "is_peak_hour": h.isin(*PEAK_HOURS).cast("int"),
            "is_solar_hour": h.between(9, 16).cast("int"),
            "hour_sin": F.sin(angle),
            "hour_cos": F.cos(angle),
        }
    )


def lag_features(df: DataFrame, series: Sequence[str], columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    rb = RowBlocks(df, series, before=max(lags))
    return rb.add({f"{c}_lag_{k}": lag(rb, c, k) for c in columns for k in lags})


def ramp_features(df: DataFrame, series: Sequence[str], columns: Sequence[str], steps: Sequence[int] = (1,)) -> DataFrame:
    """Differences over ``steps`` rows and the relative one-row change."""
    rb = RowBlocks(df, series, before=max(*steps, 1))
    new = {f"{c}_ramp_{k}": F.col(c) - lag(rb, c, k) for c in columns for k in steps}
    new.update({f"{c}_pct_ramp": (F.col(c) - lag(rb, c, 1)) / (lag(rb, c, 1) + RATIO_EPS) for c in columns})
    return rb.add(new)


def price_position_features(df: DataFrame, series: Sequence[str], da: str = "da", rt: str = "rt") -> DataFrame:
    """Spread and day-ahead level, volatility and place inside the weekly 5-95 % band."""
    rb = RowBlocks(df.withColumn("spread", F.col(rt) - F.col(da)), series, before=168)
    out = rb.add(
        {
            "da_ramp_24": F.col(da) - lag(rb, da, 24),
            "da_ma_24": rolling(rb, da, 24, min_rows=1),
            "da_std_24": rolling(rb, da, 24, F.stddev_samp, min_rows=1),
            "da_ma_168": rolling(rb, da, 168, min_rows=1),
            "da_q95_168": rolling(rb, da, 168, lambda c: F.percentile(c, 0.95), min_rows=1),
            "da_q05_168": rolling(rb, da, 168, lambda c: F.percentile(c, 0.05), min_rows=1),
            "spread_ma_24": rolling(rb, "spread", 24, min_rows=1),
            "spread_std_24": rolling(rb, "spread", 24, F.stddev_samp, min_rows=1),
            "spread_ramp_1": F.col("spread") - lag(rb, "spread", 1),
            "da_min_24": rolling(rb, da, 24, F.min, min_rows=1),
            "da_max_24": rolling(rb, da, 24, F.max, min_rows=1),
        }
    )
    band = F.col("da_q95_168") - F.col("da_q05_168") + RATIO_EPS
    return out.withColumns(
        {
            "da_volatility": F.col("da_std_24") / (F.abs("da_ma_24") + RATIO_EPS),
            "da_position": clip((F.col(da) - F.col("da_q05_168")) / band, 0.0, 2.0),
        }
    )


def delta_history(df: DataFrame, series: Sequence[str], delta: str = "delta_target") -> DataFrame:
    """Leakage-safe history of a delta: everything looks at least 24 rows back."""
    rb = RowBlocks(df, series, before=24 + 168)
    d = F.col(delta)

    def safe(n, fn=F.avg, k=None, x=d):
        return rolling(rb, x, n, fn, min_rows=k, shift=24)

    lagged = lag(rb, delta, 24)
    out = rb.add(
        {
            "delta_lag_24": lagged,
            "delta_roll_mean_6": safe(6, k=1),
            "delta_roll_mean_24": safe(24, k=1),
            "delta_roll_std_24": safe(24, F.stddev_samp, 2),
            "delta_abs_roll_mean_24": safe(24, k=1, x=F.abs(d)),
            "tf_delta_lowfreq_mean_12": safe(12, k=4),
            "tf_delta_lowfreq_mean_24": safe(24, k=8),
            "tf_delta_vol_12": safe(12, F.stddev_samp, 4),
            "tf_delta_ramp_3": lagged - lag(rb, delta, 27),
            "tf_delta_ramp_6": lagged - lag(rb, delta, 30),
            "delta_lag_168": lag(rb, delta, 168),
            "delta_roll_mean_168": safe(168, k=24),
        }
    )
    return out.withColumn("tf_delta_highfreq_resid_12", F.col("delta_lag_24") - F.col("tf_delta_lowfreq_mean_12"))


def target_history(df: DataFrame, series: Sequence[str], y: str) -> DataFrame:
    """Target lags and previous-day statistics, filled forward and then with 0.

    ``target_lag`` takes last week on weekdays and two days ago on weekends.
    """
    rb = RowBlocks(df, series, before=336)
    lagged = {f"lag_{k}h": lag(rb, y, k) for k in (24, 48, 72, 168, 336)}
    out = rb.add(
        {
            **lagged,
            "target_lag": F.when(F.weekday("ds") < 5, lagged["lag_168h"]).otherwise(lagged["lag_48h"]),
            "prevday_mean_target": rolling(rb, y, 24, min_rows=1, shift=24),
            "prevday_std_target": F.coalesce(rolling(rb, y, 24, F.stddev_samp, 1, shift=24), F.lit(0.0)),
        },
        keep_index=True,
    )
    fill = [*lagged, "target_lag", "prevday_mean_target"]
    out = rowblocks.forward_fill(out, series, {c: F.col(c) for c in fill})
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in fill})
    return out.withColumn(
        "target_lag_da", 0.60 * F.col("lag_24h") + 0.25 * F.col("lag_168h") + 0.15 * F.col("lag_336h")
    )


def period_history(df: DataFrame, series: Sequence[str], y: str, period_rows: int = 8) -> DataFrame:
    """Same-period anchors: rows of one period only, so ``period_rows`` rows are one day."""
    keys = [*series, "period"]
    n = period_rows
    rb = RowBlocks(df, keys, before=7 * n)
    out = rb.add(
        {
            "period_lag_d1": lag(rb, y, n),
            "period_lag_d2": lag(rb, y, 2 * n),
            "period_lag_w1": lag(rb, y, 7 * n),
            "period_prevday_mean": rolling(rb, y, n, min_rows=1, shift=n),
            "period_prevday_std": rolling(rb, y, n, F.stddev_samp, 1, shift=n),
        },
        keep_index=True,
    ).withColumn(
        "period_mix_anchor",
        0.50 * F.col("period_lag_d1") + 0.30 * F.col("period_lag_w1") + 0.20 * F.col("period_lag_d2"),
    )
    fill = [c for c in out.columns if c.startswith("period_") and c != "period"]
    out = rowblocks.forward_fill(out, keys, {c: F.col(c) for c in fill})
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in fill})


def same_hour_history(df: DataFrame, series: Sequence[str], value: str, days: int = 7, prefix: str | None = None) -> DataFrame:
    """Mean, deviation and absolute mean of the same hour over the last rows of that hour, today excluded."""
    p = prefix or value
    keys = [*series, "hour_business"]
    rb = RowBlocks(df, keys, before=days, bucket=F.trunc("ds", "month"))
    return rb.add(
        {
            f"{p}_same_hour_lag_1d": lag(rb, value, 1),
            f"{p}_same_hour_mean": rolling(rb, value, days, min_rows=2, shift=1),
            f"{p}_same_hour_std": rolling(rb, value, days, F.stddev_samp, 3, shift=1),
            f"{p}_same_hour_abs_mean": rolling(rb, F.abs(F.col(value)), days, min_rows=2, shift=1),
            f"{p}_same_hour_any_mean": rolling(rb, value, days, min_rows=1, shift=1),
        }
    )


def water_level(df: DataFrame, series: Sequence[str], space: str) -> DataFrame:
    """Bidding space against its mean over the last seven same hours."""
    out = same_hour_history(df, series, space, prefix="space")
    return out.withColumn("space_level_ratio", F.col(space) / (F.col("space_same_hour_any_mean") + RATIO_EPS))


def supply_features(df: DataFrame, load: str, wind: str, solar: str, interconnect: str, da: str) -> DataFrame:
    """Net load, bidding space, ratios, pressure terms and interactions."""
    l, w, s, i, p = (F.col(c) for c in (load, wind, solar, interconnect, da))
    safe = F.when(l == 0, F.lit(1.0)).otherwise(l)
    renew = w + s
    net = l - w - s
    space = net - i
    supply = i + renew
    gap = supply - l
    return df.withColumns(
        {
            "net_load": net,
            "supply_sum": supply,
            "bidding_space": space,
            "solar_ratio": s / safe,
            "wind_ratio": w / safe,
            "renewable_penetration": renew / safe,
            "space_ratio": space / safe,
            "net_load_sq": (net / 1000) * (net / 1000),
            "pressure_ratio": space / (F.abs(renew) + 1.0),
            "renewable_share": renew / (F.abs(l) + 1.0),
            "supply_demand_gap": gap,
            "space_x_da": space * p,
            "gap_x_da": gap * p,
            "renewable_space": renew * space / 1000.0,
            "group_da_pressure_gap": p - space,
            "group_pressure_x_riskhour": space * F.col("hour_business").isin(*RISK_HOURS).cast("int"),
            "renewable_share_x_hour": renew / (F.abs(l) + 1.0) * F.col("hour_business"),
        }
    )


def forecast_residuals(df: DataFrame, series: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(actual - forecast) one day back and its mean over the day before that row."""
    df = df.withColumns({f"{n}_resid": F.col(a) - F.col(f) for n, (a, f) in pairs.items()})
    rb = RowBlocks(df, series, before=48)
    new = {}
    for n in pairs:
        new[f"hist_{n}_resid_lag24"] = lag(rb, f"{n}_resid", 24)
        new[f"hist_{n}_resid_mean_24"] = rolling(rb, f"{n}_resid", 24, min_rows=6, shift=24)
    return rb.add(new)


def morning_stats(df: DataFrame, series: Sequence[str], y: str) -> DataFrame:
    """Yesterday's morning: mean and deviation of hours 1-15, minimum and move of hours 11-15.

    Grouped per day first; only the day table is ordered. A day without
    yesterday's values keeps the last known ones and is not ``fresh``.
    """
    am = df.where(F.col("hour_business").between(1, 15))
    noon = F.col("hour_business").between(11, 15)
    key = [*series, "business_day"]
    days = am.groupBy(*key).agg(
        F.avg(y).alias("morning_mean"),
        F.stddev_samp(y).alias("morning_std"),
        F.min(F.when(noon, F.col(y))).alias("noon_min"),
        F.when(
            F.count(F.when(noon, 1)) > 0,
            F.max_by(y, F.when(noon, F.col("ds"))) - F.min_by(y, F.when(noon, F.col("ds"))),
        ).alias("morning_trend"),
    )
    cols = ["morning_mean", "noon_min", "morning_std", "morning_trend"]
    w = W.partitionBy(*series).orderBy("business_day")
    days = days.withColumns({c: F.lag(c).over(w) for c in cols})
    days = days.withColumn("is_info_fresh", F.col("morning_mean").isNotNull().cast("int"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    days = days.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0.0)) for c in cols})
    return df.join(days, key, "left")


def da_linkage(df: DataFrame, series: Sequence[str], da: str = "da", window: int = 24) -> DataFrame:
    """Day-ahead value today, tomorrow and before, its ramps, filled both ways and then with 0."""
    rb = RowBlocks(df, series, before=48, after=24)
    x = F.col(da)
    step = F.abs(x - lag(rb, da, 1))
    rb.df = rb.df.withColumn("_step", step)
    recent = rolling(rb, da, 8, min_rows=1)
    out = rb.add(
        {
            "da_pred_today": x,
            "da_pred_tomorrow": lead(rb, da, 24),
            "da_pred_24h_lag": lag(rb, da, 24),
            "da_pred_48h_lag": lag(rb, da, 48),
            "da_error_24h": rolling(rb, "_step", window, min_rows=1),
            "da_ramp_first_8": recent - rolling(rb, da, 8, min_rows=1, shift=8),
            "da_ramp_mid_8": recent - lag(rb, da, 8),
            "da_ramp_pred_to_actual": x - lag(rb, da, 24),
        },
        keep_index=True,
    ).drop("_step")
    cols = [c for c in out.columns if c.startswith(("da_pred_", "da_ramp_")) or c == "da_error_24h"]
    out = rowblocks.nearest_known(
        out, series, {f"{c}_p": F.col(c) for c in cols}, {f"{c}_f": F.col(c) for c in cols}
    )
    filled = {c: F.coalesce(f"{c}_p", f"{c}_f", F.lit(0.0)) for c in cols}
    return out.withColumns(filled).drop(*[f"{c}_{d}" for c in cols for d in "pf"])


def disagreement(panel: DataFrame, keys: Sequence[str], pred: str = "y_pred") -> DataFrame:
    """Spread of the models per time point, on the long table: sample and population deviation, range, count."""
    return panel.groupBy(*keys).agg(
        F.stddev_samp(pred).alias("std_sample"),
        F.stddev_pop(pred).alias("prediction_spread"),
        (F.max(pred) - F.min(pred)).alias("model_disagreement"),
        F.count(pred).alias("n_models"),
    )


def low_price_rates(df: DataFrame, history: DataFrame, series: Sequence[str], pred: str = "base_fused_pred") -> DataFrame:
    """Historic rates by hour and by period mapped onto rows, 0 where history is silent."""
    p, low = F.col(pred), F.col("y_true") <= 50
    by_hour = history.groupBy(*series, "hour_business").agg(
        F.avg((p < 0).cast("double")).alias("recent_negative_rate_by_hour"),
        F.avg((p <= 50).cast("double")).alias("recent_low_price_rate_by_hour"),
        F.avg(F.when(low, F.col("y_true") - p)).alias("recent_mean_low_residual_by_hour"),
        F.min(p).alias("min_pred_last_24h"),
    )
    by_period = history.groupBy(*series, "period").agg(
        F.avg((p < 0).cast("double")).alias("recent_negative_rate_by_period"),
        F.avg((p <= 50).cast("double")).alias("recent_low_price_rate_by_period"),
    )
    out = df.join(by_hour, [*series, "hour_business"], "left").join(by_period, [*series, "period"], "left")
    new = [c for c in (*by_hour.columns, *by_period.columns) if c.startswith(("recent_", "min_pred"))]
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in new})


def naive_baselines(df: DataFrame, series: Sequence[str], y: str = "y_true", da: str = "da") -> DataFrame:
    """Long pack of four naive models with error and flags; missing ones are left out."""
    from ..functions import scores

    rb = RowBlocks(df, series, before=168)
    wide = rb.add({"naive_lag1": lag(rb, y, 24), "naive_lag7": lag(rb, y, 168), "dayahead_proxy": F.col(da)})
    wide = wide.withColumn("baseline_fusion", mean_of([F.col("naive_lag1"), F.col("naive_lag7"), F.col("dayahead_proxy")]))
    names = ("naive_lag1", "naive_lag7", "dayahead_proxy", "baseline_fusion")
    cells = F.array(*[F.struct(F.lit(n).alias("model_name"), F.round(F.col(n), 4).alias("y_pred")) for n in names])
    long = wide.select(
        *series, "business_day", "hour_business", "ds",
        clock.label_hours("hour_business", clock.DAY_PART_BOUNDS).alias("period"),
        F.round(y, 4).alias("y_true"), F.round("baseline_fusion", 4).alias("base_fused_pred"), F.explode(cells).alias("_m"),
    ).select("*", "_m.*").drop("_m").where(F.col("y_pred").isNotNull())
    return long.withColumns(
        {
            "residual": F.col("y_true") - F.col("y_pred"),
            "abs_error": F.abs(F.col("y_true") - F.col("y_pred")),
            "smape_floor50": F.round(scores.smape_row("row_capped", F.coalesce("y_true", F.lit(50.0)), F.col("y_pred")), 4),
            "high_spike_flag": flag(F.col("y_true") > F.col("y_pred") + 200),
            "severe_underestimate_flag": flag(F.col("y_true") - F.col("y_pred") > 200),
        }
    )


def interpolate(df: DataFrame, series: Sequence[str], value: str) -> DataFrame:
    """Fill inner gaps linearly by row position, outer gaps with the nearest value."""
    rb = RowBlocks(df, series)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(rowblocks.IDX).alias("i"), F.col(value).alias("v")))
    df = rowblocks.nearest_known(
        rb.add({"_pos": F.col(rowblocks.IDX)}, keep_index=True), series, {"_prev": known}, {"_next": known}
    )
    slope = (F.col("_next.v") - F.col("_prev.v")) / (F.col("_next.i") - F.col("_prev.i"))
    inner = F.col("_prev.v") + slope * (F.col("_pos") - F.col("_prev.i"))
    return df.withColumn(
        value,
        F.coalesce(
            F.col(value),
            F.when(F.col("_prev").isNotNull() & F.col("_next").isNotNull(), inner),
            F.col("_prev.v"),
            F.col("_next.v"),
        ),
    ).drop("_pos", "_prev", "_next")


def strip_leading_nulls(df: DataFrame, series: Sequence[str], value: str) -> DataFrame:
    """Drop the rows before each series' first known value: one aggregate and a join, no ordering."""
    first = df.where(F.col(value).isNotNull()).groupBy(*series).agg(F.min("ds").alias("_first"))
    return df.join(first, list(series)).where(F.col("ds") >= F.col("_first")).drop("_first")


def complete_days(df: DataFrame, series: Sequence[str], hours: int = 24, value: str | None = None) -> DataFrame:
    """(series, business_day) with all hours present."""
    counted = F.count(value) if value else F.count_distinct("hour_business")
    return df.groupBy(*series, "business_day").agg(counted.alias("_n")).where(F.col("_n") == hours).drop("_n")


def past_windows(
    df: DataFrame, series: Sequence[str], days: DataFrame, columns: Sequence[str], seq_len: int, cutoff_hour: int
) -> DataFrame:
    """The last ``seq_len`` rows up to D-1 ``cutoff_hour``:00 for each target day D, as long rows.

    Rows are indexed once; a day's window touches at most two index buckets of
    ``seq_len`` rows, so the join is an equi-join on (series, bucket). Days with
    too little history drop out. ``pos`` runs from 0 (oldest).
    """
    keys = list(series)
    rows = rowblocks.with_row_index(df.select(*keys, "ds", *columns), keys, ["ds"], F.to_date("ds"), "_i", staged=True)
    rows = materialise(rows, "indexed")
    rows = rows.withColumn("_b", F.floor(F.col("_i") / seq_len))
    # Position of the cutoff row: the last index on or before the cutoff, found per calendar day and carried on.
    ends = rows.groupBy(*keys, F.to_date("ds").alias("_d")).agg(
        F.max(F.when(F.hour("ds") <= cutoff_hour, F.col("_i"))).alias("_to_cut"),
        F.min("_i").alias("_lo"),
        F.max("_i").alias("_hi"),
    )
    want = days.select(*keys, F.date_sub("business_day", 1).alias("_d"), F.col("business_day").alias("target_day"))
    spine = ends.join(want, [*keys, "_d"], "full")
    w = W.partitionBy(*keys).orderBy("_d").rowsBetween(W.unboundedPreceding, -1)
    spine = spine.withColumn("_prior", F.max("_hi").over(w))
    cut = spine.where(F.col("target_day").isNotNull()).withColumn(
        "_c", F.coalesce("_to_cut", F.col("_lo") - 1, F.col("_prior"))
    )
    cut = cut.where(F.col("_c") >= seq_len - 1).select(
        *keys,
        "target_day",
        "_c",
        F.explode(
            F.sequence(F.floor((F.col("_c") - seq_len + 1) / seq_len), F.floor(F.col("_c") / seq_len))
        ).alias("_b"),
    )
    return (
        rows.join(cut, [*keys, "_b"])
        .where((F.col("_i") <= F.col("_c")) & (F.col("_i") > F.col("_c") - seq_len))
        .withColumn("pos", (F.col("_i") - F.col("_c") + seq_len - 1).cast("int"))
        .drop("_i", "_c", "_b")
    )


def window_features(windows: DataFrame, series: Sequence[str], target: str, load: str, wind: str, solar: str) -> DataFrame:
    """Features that depend on the window itself: ramps, short and long means, percent rank.

    Each (series, target day) holds ``seq_len`` rows, so plain windows are bounded here.
    """
    part = W.partitionBy(*series, "target_day")
    w = part.orderBy("pos")
    y, l = F.col(target), F.when(F.col(load) != 0, F.col(load))

    def roll(c, n, fn=F.avg):
        return fn(c).over(w.rowsBetween(-(n - 1), 0))

    ties = F.count(F.lit(1)).over(W.partitionBy(*series, "target_day", target))
    rank = F.rank().over(part.orderBy(target))
    zero = F.lit(0.0)
    return windows.withColumns(
        {
            "ramp": F.coalesce(y - F.lag(y).over(w), zero),
            "mean_3": roll(y, 3),
            "mean_6": roll(y, 6),
            "mean_24": roll(y, 24),
            "std_24": F.coalesce(roll(y, 24, F.stddev_samp), zero),
            "load_mean_24": roll(F.col(load), 24),
            "diff_24": F.coalesce(y - F.lag(y, 24).over(w), zero),
            "diff_168": F.coalesce(y - F.lag(y, 168).over(w), zero),
            "from_mean_168": y - roll(y, 168),
            "pct_rank": (rank + (ties - 1) / 2) / F.count(F.lit(1)).over(part),
            "net_load": F.coalesce(l - F.col(wind) - F.col(solar), zero),
            "renewable_share": F.coalesce((F.col(wind) + F.col(solar)) / l, zero),
        }
    )


def as_sequences(windows: DataFrame, series: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One array of feature structs per (series, target day), oldest first; length is bounded by ``seq_len``."""
    cell = F.struct("pos", *columns)
    return windows.groupBy(*series, "target_day").agg(F.array_sort(F.collect_list(cell)).alias("past"))


def future_rows(df: DataFrame, series: Sequence[str], days: DataFrame) -> DataFrame:
    """Known-ahead features of the target days, with the load ramp inside the day."""
    day = df.join(days, [*series, "business_day"], "left_semi")
    w = W.partitionBy(*series, "business_day").orderBy("ds")
    h = F.col("hour_business")
    return day.withColumns(
        {
            "ramp_load": F.coalesce(F.col("load_forecast") - F.lag("load_forecast").over(w), F.lit(0.0)),
            "is_peak": ((h >= 17) | (h <= 8)).cast("int"),
            "is_solar": h.between(9, 16).cast("int"),
            "hour_sin": F.sin(2 * F.pi() * h / 24),
            "hour_cos": F.cos(2 * F.pi() * h / 24),
        }
    )
