"""Feature, as-of and fold queries."""

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import asof, features, folds, joins, rowblocks
from .registry import query

W = "PARTITION BY series_id ORDER BY ds"
DMARKET = "dm AS (SELECT *, rt - da AS delta_target FROM market)"


def roll(expr, n, k, fn="avg", shift=0, part=W):
    fr = f"OVER ({part} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({expr}) {fr} >= {k} THEN {fn}({expr}) {fr} END"


def lagsql(c, k, part=W):
    return f"lag({c}, {k}) OVER ({part})"


@query(
    "calendar_features",
    "series_id:i ds:t month:i day_of_week:i day_of_month:i is_weekend:i season:s is_month_start:i is_month_end:i is_peak_hour:i is_solar_hour:i hour_sin:d hour_cos:d",
    """SELECT series_id, ds, month(ds) AS month, isodow(ds) - 1 AS day_of_week, day(ds) AS day_of_month, CAST(isodow(ds) >= 6 AS INT) AS is_weekend,
       CASE WHEN month(ds) IN (12, 1, 2) THEN 'winter' WHEN month(ds) <= 5 THEN 'spring' WHEN month(ds) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
       CAST(day(ds) <= 3 AS INT) AS is_month_start, CAST(day(ds) >= 28 AS INT) AS is_month_end,
       CAST(hour_business IN (7, 8, 9, 16, 17, 18) AS INT) AS is_peak_hour, CAST(hour_business BETWEEN 9 AND 16 AS INT) AS is_solar_hour,
       sin(2 * pi() * hour_business / 24) AS hour_sin, cos(2 * pi() * hour_business / 24) AS hour_cos FROM market""",
)
def _(t):
    return features.calendar_features(t.market)


@query(
    "lag_features",
    "series_id:i ds:t rt_lag_1:d rt_lag_24:d rt_lag_48:d rt_lag_168:d da_lag_1:d da_lag_24:d da_lag_48:d da_lag_168:d",
    "SELECT series_id, ds, " + ", ".join(f"{lagsql(c, k)} AS {c}_lag_{k}" for c in ("rt", "da") for k in (1, 24, 48, 168)) + " FROM market",
)
def _(t):
    return features.lag_features(t.market, ["series_id"], ["rt", "da"], [1, 24, 48, 168])


@query(
    "ramp_features",
    "series_id:i ds:t load_forecast_ramp_1:d load_forecast_ramp_3:d load_forecast_ramp_24:d load_forecast_pct_ramp:d",
    "SELECT series_id, ds, " + ", ".join(f"load_forecast - {lagsql('load_forecast', k)} AS load_forecast_ramp_{k}" for k in (1, 3, 24))
    + f", (load_forecast - {lagsql('load_forecast', 1)}) / ({lagsql('load_forecast', 1)} + 1e-5) AS load_forecast_pct_ramp FROM market",
)
def _(t):
    return features.ramp_features(t.market, ["series_id"], ["load_forecast"], [1, 3, 24])


@query(
    "price_position",
    "series_id:i ds:t da_ramp_24:d da_ma_24:d da_std_24:d da_ma_168:d da_q95_168:d da_q05_168:d spread_ma_24:d spread_std_24:d spread_ramp_1:d da_min_24:d da_max_24:d da_volatility:d da_position:d",
    "SELECT *, da_std_24 / (abs(da_ma_24) + 1e-5) AS da_volatility, least(greatest((da - da_q05_168) / (da_q95_168 - da_q05_168 + 1e-5), 0), 2) AS da_position FROM ("
    f"SELECT series_id, ds, da, da - {lagsql('da', 24)} AS da_ramp_24, {roll('da', 24, 1)} AS da_ma_24, {roll('da', 24, 1, 'stddev_samp')} AS da_std_24, {roll('da', 168, 1)} AS da_ma_168, "
    f"quantile_cont(da, 0.95) OVER ({W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS da_q95_168, quantile_cont(da, 0.05) OVER ({W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS da_q05_168, "
    f"{roll('(rt - da)', 24, 1)} AS spread_ma_24, {roll('(rt - da)', 24, 1, 'stddev_samp')} AS spread_std_24, (rt - da) - {lagsql('(rt - da)', 1)} AS spread_ramp_1, "
    f"{roll('da', 24, 1, 'min')} AS da_min_24, {roll('da', 24, 1, 'max')} AS da_max_24 FROM market)",
)
def _(t):
    return features.price_position_features(t.market, ["series_id"])


@query(
    "delta_history",
    "series_id:i ds:t delta_lag_24:d delta_roll_mean_6:d delta_roll_mean_24:d delta_roll_std_24:d delta_abs_roll_mean_24:d tf_delta_lowfreq_mean_12:d tf_delta_lowfreq_mean_24:d tf_delta_vol_12:d tf_delta_ramp_3:d tf_delta_ramp_6:d delta_lag_168:d delta_roll_mean_168:d tf_delta_highfreq_resid_12:d",
    "SELECT *, delta_lag_24 - tf_delta_lowfreq_mean_12 AS tf_delta_highfreq_resid_12 FROM ("
    f"SELECT series_id, ds, {lagsql('delta_target', 24)} AS delta_lag_24, {roll('delta_target', 6, 1, shift=24)} AS delta_roll_mean_6, {roll('delta_target', 24, 1, shift=24)} AS delta_roll_mean_24, "
    f"{roll('delta_target', 24, 2, 'stddev_samp', 24)} AS delta_roll_std_24, {roll('abs(delta_target)', 24, 1, shift=24)} AS delta_abs_roll_mean_24, {roll('delta_target', 12, 4, shift=24)} AS tf_delta_lowfreq_mean_12, "
    f"{roll('delta_target', 24, 8, shift=24)} AS tf_delta_lowfreq_mean_24, {roll('delta_target', 12, 4, 'stddev_samp', 24)} AS tf_delta_vol_12, {lagsql('delta_target', 24)} - {lagsql('delta_target', 27)} AS tf_delta_ramp_3, "
    f"{lagsql('delta_target', 24)} - {lagsql('delta_target', 30)} AS tf_delta_ramp_6, {lagsql('delta_target', 168)} AS delta_lag_168, {roll('delta_target', 168, 24, shift=24)} AS delta_roll_mean_168 FROM dm)",
    DMARKET,
)
def _(t):
    return features.delta_history(t.market.withColumn("delta_target", F.col("rt") - F.col("da")), ["series_id"])


HOURLY = "PARTITION BY series_id, hour_business ORDER BY ds"


@query(
    "same_hour_history",
    "series_id:i ds:t d_same_hour_lag_1d:d d_same_hour_mean:d d_same_hour_std:d d_same_hour_abs_mean:d",
    f"SELECT series_id, ds, {lagsql('delta_target', 1, HOURLY)} AS d_same_hour_lag_1d, {roll('delta_target', 7, 2, shift=1, part=HOURLY)} AS d_same_hour_mean, "
    f"{roll('delta_target', 7, 3, 'stddev_samp', 1, HOURLY)} AS d_same_hour_std, {roll('abs(delta_target)', 7, 2, shift=1, part=HOURLY)} AS d_same_hour_abs_mean FROM dm",
    DMARKET,
)
def _(t):
    return features.same_hour_history(t.market.withColumn("delta_target", F.col("rt") - F.col("da")), ["series_id"], "delta_target", prefix="d")


@query(
    "water_level",
    "series_id:i ds:t space_level_ratio:d",
    f"SELECT series_id, ds, load_forecast / ({roll('load_forecast', 7, 1, shift=1, part=HOURLY)} + 1e-5) AS space_level_ratio FROM market",
)
def _(t):
    return features.water_level(t.market, ["series_id"], "load_forecast")


@query(
    "supply_features",
    "series_id:i ds:t net_load:d supply_sum:d bidding_space:d solar_ratio:d wind_ratio:d renewable_penetration:d space_ratio:d net_load_sq:d pressure_ratio:d renewable_share:d supply_demand_gap:d space_x_da:d gap_x_da:d renewable_space:d group_da_pressure_gap:d group_pressure_x_riskhour:d renewable_share_x_hour:d",
    """SELECT *, i + w + s AS supply_sum, s / safe AS solar_ratio, w / safe AS wind_ratio, (w + s) / safe AS renewable_penetration, bidding_space / safe AS space_ratio,
       (net_load / 1000) * (net_load / 1000) AS net_load_sq, bidding_space / (abs(w + s) + 1) AS pressure_ratio, (w + s) / (abs(l) + 1) AS renewable_share,
       i + w + s - l AS supply_demand_gap, bidding_space * da AS space_x_da, (i + w + s - l) * da AS gap_x_da, (w + s) * bidding_space / 1000 AS renewable_space,
       da - bidding_space AS group_da_pressure_gap, CASE WHEN hour_business IN (9, 10, 15) THEN bidding_space ELSE 0 END AS group_pressure_x_riskhour,
       (w + s) / (abs(l) + 1) * hour_business AS renewable_share_x_hour FROM (
       SELECT series_id, ds, da, hour_business, load_forecast AS l, wind_forecast AS w, solar_forecast AS s, interconnect_forecast AS i, CASE WHEN load_forecast = 0 THEN 1 ELSE load_forecast END AS safe,
       load_forecast - wind_forecast - solar_forecast AS net_load, load_forecast - wind_forecast - solar_forecast - interconnect_forecast AS bidding_space FROM market)""",
)
def _(t):
    return features.supply_features(t.market, "load_forecast", "wind_forecast", "solar_forecast", "interconnect_forecast", "da")


@query(
    "forecast_residual_history",
    "series_id:i ds:t hist_load_resid_lag24:d hist_load_resid_mean_24:d hist_wind_resid_lag24:d hist_wind_resid_mean_24:d",
    "SELECT series_id, ds, " + ", ".join(
        f"{lagsql(f'({q}_actual - {q}_forecast)', 24)} AS hist_{q}_resid_lag24, {roll(f'({q}_actual - {q}_forecast)', 24, 6, shift=24)} AS hist_{q}_resid_mean_24" for q in ("load", "wind")
    ) + " FROM market",
)
def _(t):
    return features.forecast_residuals(
        t.market, ["series_id"], {"load": ("load_actual", "load_forecast"), "wind": ("wind_actual", "wind_forecast")}
    )


def ffill0(c):
    return f"coalesce(last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"


TARGET_CTE = (
    "th AS (SELECT *, CASE WHEN isodow(ds) <= 5 THEN l168 ELSE l48 END AS tl FROM (SELECT series_id, ds, "
    + ", ".join(f"{lagsql('y', k)} AS l{k}" for k in (24, 48, 72, 168, 336))
    + f", {roll('y', 24, 1, shift=24)} AS pm, coalesce({roll('y', 24, 1, 'stddev_samp', 24)}, 0) AS ps FROM tsrc))"
)
TARGET_SQL = (
    "SELECT *, 0.6 * lag_24h + 0.25 * lag_168h + 0.15 * lag_336h AS target_lag_da FROM (SELECT series_id, ds, "
    + ", ".join(f"{ffill0(f'l{k}')} AS lag_{k}h" for k in (24, 48, 72, 168, 336))
    + f", {ffill0('tl')} AS target_lag, {ffill0('pm')} AS prevday_mean_target, ps AS prevday_std_target FROM th)"
)
TARGET_SPEC = "series_id:i ds:t lag_24h:d lag_48h:d lag_72h:d lag_168h:d lag_336h:d target_lag:d prevday_mean_target:d prevday_std_target:d target_lag_da:d"


@query("target_history", TARGET_SPEC, TARGET_SQL, "tsrc AS (SELECT series_id, ds, CASE WHEN hour_business = 7 THEN NULL ELSE rt END AS y FROM market), " + TARGET_CTE)
def _(t):
    return features.target_history(t.market.withColumn("rt", F.when(F.col("hour_business") != 7, F.col("rt"))), ["series_id"], "rt")


@query(
    "masked_history",
    TARGET_SPEC,
    TARGET_SQL,
    "tsrc AS (SELECT series_id, ds, CASE WHEN ds > TIMESTAMP '2024-01-20 14:00:00' THEN da ELSE rt END AS y FROM market), " + TARGET_CTE,
)
def _(t):
    return asof.masked_history(t.market, "2024-01-20 14:00:00", ["series_id"])


PW = "PARTITION BY series_id, period ORDER BY ds"


def pfill(c):
    return f"coalesce(last_value({c} IGNORE NULLS) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"


@query(
    "period_history",
    "series_id:i ds:t period_lag_d1:d period_lag_d2:d period_lag_w1:d period_prevday_mean:d period_prevday_std:d period_mix_anchor:d",
    "SELECT series_id, ds, " + ", ".join(f"{pfill(c)} AS {n}" for c, n in (
        ("a", "period_lag_d1"), ("b", "period_lag_d2"), ("c", "period_lag_w1"), ("m", "period_prevday_mean"), ("s", "period_prevday_std"), ("(0.5 * a + 0.3 * c + 0.2 * b)", "period_mix_anchor")
    )) + f" FROM (SELECT series_id, period, ds, {lagsql('rt', 8, PW)} AS a, {lagsql('rt', 16, PW)} AS b, {lagsql('rt', 56, PW)} AS c, {roll('rt', 8, 1, shift=8, part=PW)} AS m, {roll('rt', 8, 1, 'stddev_samp', 8, PW)} AS s FROM market)",
)
def _(t):
    return features.period_history(t.market, ["series_id"], "rt")


@query(
    "morning_stats",
    "series_id:i ds:t morning_mean:d morning_std:d noon_min:d morning_trend:d is_info_fresh:i",
    """SELECT m.series_id, m.ds, d.* EXCLUDE (series_id, business_day) FROM market m LEFT JOIN (
       SELECT series_id, business_day, CAST(a IS NOT NULL AS INT) AS is_info_fresh,
         coalesce(last_value(a IGNORE NULLS) OVER w, 0) AS morning_mean, coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS morning_std,
         coalesce(last_value(c IGNORE NULLS) OVER w, 0) AS noon_min, coalesce(last_value(d IGNORE NULLS) OVER w, 0) AS morning_trend FROM (
         SELECT series_id, business_day, lag(a) OVER w AS a, lag(b) OVER w AS b, lag(c) OVER w AS c, lag(d) OVER w AS d FROM (
           SELECT series_id, business_day, avg(rt) AS a, stddev_samp(rt) AS b, min(rt) FILTER (hour_business >= 11) AS c,
             max_by(rt, ds) FILTER (hour_business >= 11) - min_by(rt, ds) FILTER (hour_business >= 11) AS d FROM market WHERE hour_business <= 15 GROUP BY ALL)
         WINDOW w AS (PARTITION BY series_id ORDER BY business_day))
       WINDOW w AS (PARTITION BY series_id ORDER BY business_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) d ON m.series_id = d.series_id AND m.business_day = d.business_day""",
)
def _(t):
    return features.morning_stats(t.stored_market, ["series_id"], "rt")


def both0(c):
    return (
        f"coalesce({c}, last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)"
    )


LINK = ("da_pred_tomorrow", "da_pred_24h_lag", "da_pred_48h_lag", "da_error_24h", "da_ramp_first_8", "da_ramp_mid_8", "da_ramp_pred_to_actual")


@query(
    "da_linkage",
    "series_id:i ds:t da_pred_today:d " + " ".join(f"{c}:d" for c in LINK),
    f"SELECT series_id, ds, da AS da_pred_today, {', '.join(f'{both0(c)} AS {c}' for c in LINK)} FROM ("
    f"SELECT series_id, ds, da, lead(da, 24) OVER ({W}) AS da_pred_tomorrow, {lagsql('da', 24)} AS da_pred_24h_lag, {lagsql('da', 48)} AS da_pred_48h_lag, {roll('step', 24, 1)} AS da_error_24h, "
    f"{roll('da', 8, 1)} - {roll('da', 8, 1, shift=8)} AS da_ramp_first_8, {roll('da', 8, 1)} - {lagsql('da', 8)} AS da_ramp_mid_8, da - {lagsql('da', 24)} AS da_ramp_pred_to_actual "
    f"FROM (SELECT *, abs(da - {lagsql('da', 1)}) AS step FROM market))",
)
def _(t):
    return features.da_linkage(t.market, ["series_id"])


@query(
    "model_disagreement",
    "series_id:i ds:t std_sample:d prediction_spread:d model_disagreement:d n_models:i",
    "SELECT series_id, ds, stddev_samp(y_pred) AS std_sample, stddev_pop(y_pred) AS prediction_spread, max(y_pred) - min(y_pred) AS model_disagreement, count(*) AS n_models FROM panel GROUP BY ALL",
)
def _(t):
    return features.disagreement(t.panel, ["series_id", "ds"])


@query(
    "low_price_rates",
    "series_id:i ds:t recent_negative_rate_by_hour:d recent_low_price_rate_by_hour:d recent_mean_low_residual_by_hour:d min_pred_last_24h:d recent_negative_rate_by_period:d recent_low_price_rate_by_period:d",
    """SELECT m.series_id, m.ds, coalesce(a, 0) AS recent_negative_rate_by_hour, coalesce(b, 0) AS recent_low_price_rate_by_hour, coalesce(c, 0) AS recent_mean_low_residual_by_hour,
       coalesce(d, 0) AS min_pred_last_24h, coalesce(e, 0) AS recent_negative_rate_by_period, coalesce(f, 0) AS recent_low_price_rate_by_period FROM market m
       LEFT JOIN (SELECT series_id, hour_business, avg(CAST(da < 0 AS DOUBLE)) AS a, avg(CAST(da <= 50 AS DOUBLE)) AS b, avg(rt - da) FILTER (rt <= 50) AS c, min(da) AS d FROM market WHERE business_day <= DATE '2024-01-20' GROUP BY ALL) h
         ON m.series_id = h.series_id AND m.hour_business = h.hour_business
       LEFT JOIN (SELECT series_id, period, avg(CAST(da < 0 AS DOUBLE)) AS e, avg(CAST(da <= 50 AS DOUBLE)) AS f FROM market WHERE business_day <= DATE '2024-01-20' GROUP BY ALL) p
         ON m.series_id = p.series_id AND m.period = p.period""",
)
def _(t):
    m = t.stored_market.withColumns({"base_fused_pred": F.col("da"), "y_true": F.col("rt")})
    return features.low_price_rates(m, m.where(F.col("business_day") <= F.lit("2024-01-20").cast("date")), ["series_id"])


@query(
    "naive_baselines",
    "series_id:i ds:t model_name:s period:s y_pred:d base_fused_pred:d residual:d smape_floor50:d high_spike_flag:i",
    """SELECT *, y_true - y_pred AS residual, CAST(y_true > y_pred + 200 AS INT) AS high_spike_flag,
       round(least(100 * abs(greatest(y_true, 50) - greatest(y_pred, 50)) / ((greatest(y_true, 50) + greatest(y_pred, 50)) / 2), 50), 4) AS smape_floor50 FROM (
       SELECT series_id, ds, CASE WHEN hour_business <= 8 THEN 'night' WHEN hour_business <= 16 THEN '9_16' ELSE 'evening' END AS period, round(rt, 4) AS y_true, round(bf, 4) AS base_fused_pred,
         unnest(['naive_lag1', 'naive_lag7', 'dayahead_proxy', 'baseline_fusion']) AS model_name, round(unnest([l1, l7, da, bf]), 4) AS y_pred FROM (
         SELECT *, (coalesce(l1, 0) + coalesce(l7, 0) + da) / (1 + CAST(l1 IS NOT NULL AS INT) + CAST(l7 IS NOT NULL AS INT)) AS bf FROM (
           SELECT *, lag(rt, 24) OVER w AS l1, lag(rt, 168) OVER w AS l7 FROM market WINDOW w AS (PARTITION BY series_id ORDER BY ds)))) WHERE y_pred IS NOT NULL""",
)
def _(t):
    return features.naive_baselines(t.market, ["series_id"], "rt", "da")


@query(
    "interpolated_series",
    "series_id:i ds:t v:d",
    """SELECT series_id, ds, coalesce(v, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) / (ni - pi) * (i - pi) END, pv, nv) AS v FROM (
       SELECT series_id, ds, i, v, last_value(v IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi,
         first_value(v IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni FROM (
         SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i, CASE WHEN high_spike_prob > 0.05 AND ds > TIMESTAMP '2024-01-01 03:00:00' THEN rt END AS v FROM market)
       WINDOW a AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
)
def _(t):
    known = (F.col("high_spike_prob") > 0.05) & (F.col("ds") > F.lit("2024-01-01 03:00:00").cast("timestamp_ntz"))
    return features.interpolate(t.market.select("series_id", "ds", F.when(known, F.col("rt")).alias("v")), ["series_id"], "v")


@query(
    "leading_nulls_stripped",
    "series_id:i rows:i first_ds:t",
    """SELECT m.series_id, count(*) AS rows, min(ds) AS first_ds FROM market m JOIN (SELECT series_id, min(ds) AS f FROM market WHERE high_spike_prob > 0.2 GROUP BY ALL) k
       ON m.series_id = k.series_id AND m.ds >= k.f GROUP BY ALL""",
)
def _(t):
    m = t.stored_market.withColumn("v", F.when(F.col("high_spike_prob") > 0.2, F.col("rt")))
    return features.strip_leading_nulls(m, ["series_id"], "v").groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.min("ds").alias("first_ds"))


@query(
    "past_window_features",
    "series_id:i target_day:t rows:i newest:t mean_y:d ramp_abs:d mean_3:d mean_24:d std_24:d load_mean_24:d diff_24:d diff_168:d from_mean_168:d rank_y:d net_load:d",
    """SELECT series_id, target_day, count(*) AS rows, max(ds) AS newest, avg(rt) AS mean_y, sum(abs(ramp)) AS ramp_abs, avg(mean_3) AS mean_3, avg(mean_24) AS mean_24, avg(std_24) AS std_24,
       avg(load_mean_24) AS load_mean_24, sum(abs(diff_24)) AS diff_24, sum(abs(diff_168)) AS diff_168, avg(abs(from_mean_168)) AS from_mean_168, sum(pct_rank * rt) AS rank_y, avg(net_load) AS net_load FROM (
       SELECT *, coalesce(rt - lag(rt) OVER w, 0) AS ramp, avg(rt) OVER (w ROWS 2 PRECEDING) AS mean_3, avg(rt) OVER (w ROWS 23 PRECEDING) AS mean_24,
         coalesce(stddev_samp(rt) OVER (w ROWS 23 PRECEDING), 0) AS std_24, avg(load_forecast) OVER (w ROWS 23 PRECEDING) AS load_mean_24, coalesce(rt - lag(rt, 24) OVER w, 0) AS diff_24,
         coalesce(rt - lag(rt, 168) OVER w, 0) AS diff_168, rt - avg(rt) OVER (w ROWS 167 PRECEDING) AS from_mean_168,
         (rank() OVER (PARTITION BY series_id, target_day ORDER BY rt) + (count(*) OVER (PARTITION BY series_id, target_day, rt) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY series_id, target_day) AS pct_rank,
         coalesce(nullif(load_forecast, 0) - wind_forecast - solar_forecast, 0) AS net_load FROM win
       WINDOW w AS (PARTITION BY series_id, target_day ORDER BY ds)) GROUP BY ALL""",
    """days AS (SELECT series_id, business_day FROM market GROUP BY ALL HAVING count(DISTINCT hour_business) = 24),
     win AS (SELECT * FROM (SELECT m.*, d.business_day AS target_day, row_number() OVER (PARTITION BY m.series_id, d.business_day ORDER BY m.ds DESC) AS r,
         count(*) OVER (PARTITION BY m.series_id, d.business_day) AS c FROM market m JOIN days d ON m.series_id = d.series_id AND m.ds <= CAST(d.business_day AS TIMESTAMP) - INTERVAL 10 HOUR) WHERE r <= 200 AND c >= 200)""",
)
def _(t):
    m = t.stored_market
    days = features.complete_days(m, ["series_id"])
    win = features.past_windows(m, ["series_id"], days, ["rt", "load_forecast", "wind_forecast", "solar_forecast"], 200, 14)
    f = features.window_features(win, ["series_id"], "rt", "load_forecast", "wind_forecast", "solar_forecast")
    return f.groupBy("series_id", "target_day").agg(
        F.count(F.lit(1)).alias("rows"), F.max("ds").alias("newest"), F.avg("rt").alias("mean_y"), F.sum(F.abs("ramp")).alias("ramp_abs"),
        F.avg("mean_3").alias("mean_3"), F.avg("mean_24").alias("mean_24"), F.avg("std_24").alias("std_24"), F.avg("load_mean_24").alias("load_mean_24"),
        F.sum(F.abs("diff_24")).alias("diff_24"), F.sum(F.abs("diff_168")).alias("diff_168"), F.avg(F.abs("from_mean_168")).alias("from_mean_168"),
        F.sum(F.col("pct_rank") * F.col("rt")).alias("rank_y"), F.avg("net_load").alias("net_load"),
    )


@query(
    "past_sequences",
    "series_id:i target_day:t length:i oldest:d newest:d",
    """SELECT series_id, target_day, count(*) AS length, min_by(rt, ds) AS oldest, max_by(rt, ds) AS newest FROM (
       SELECT * FROM (SELECT m.series_id, m.ds, m.rt, d.business_day AS target_day, row_number() OVER (PARTITION BY m.series_id, d.business_day ORDER BY m.ds DESC) AS r,
         count(*) OVER (PARTITION BY m.series_id, d.business_day) AS c FROM market m JOIN days d ON m.series_id = d.series_id AND m.ds <= CAST(d.business_day AS TIMESTAMP) - INTERVAL 10 HOUR) WHERE r <= 48 AND c >= 48) GROUP BY ALL""",
    "days AS (SELECT series_id, business_day FROM market GROUP BY ALL HAVING count(DISTINCT hour_business) = 24)",
)
def _(t):
    m = t.stored_market
    days = features.complete_days(m, ["series_id"])
    seq = features.as_sequences(features.past_windows(m, ["series_id"], days, ["rt"], 48, 14), ["series_id"], ["rt"])
    return seq.select("series_id", "target_day", F.size("past").alias("length"), F.col("past")[0]["rt"].alias("oldest"), F.element_at("past", -1)["rt"].alias("newest"))


@query(
    "future_rows",
    "series_id:i ds:t ramp_load:d is_peak:i is_solar:i hour_sin:d",
    """SELECT m.series_id, m.ds, coalesce(load_forecast - lag(load_forecast) OVER (PARTITION BY m.series_id, m.business_day ORDER BY m.ds), 0) AS ramp_load,
       CAST(hour_business >= 17 OR hour_business <= 8 AS INT) AS is_peak, CAST(hour_business BETWEEN 9 AND 16 AS INT) AS is_solar, sin(2 * pi() * hour_business / 24) AS hour_sin
       FROM market m JOIN days d ON m.series_id = d.series_id AND m.business_day = d.business_day""",
    "days AS (SELECT series_id, business_day FROM market GROUP BY ALL HAVING count(DISTINCT hour_business) = 24)",
)
def _(t):
    return features.future_rows(t.stored_market, ["series_id"], features.complete_days(t.stored_market, ["series_id"]))


@query(
    "asof_cutoff",
    "series_id:i ds:t rt:d da:d",
    "SELECT series_id, ds, CASE WHEN ds > TIMESTAMP '2024-01-15 10:00:00' THEN da ELSE rt END AS rt, da FROM market",
)
def _(t):
    return asof.cutoff_target(t.market, "2024-01-15 10:00:00", "realtime", "rt", "da")


@query(
    "visible_frame",
    "series_id:i decision_day:t rows:i blocked:i visible_sum:d load_sum:d",
    """SELECT m.series_id, d.business_day AS decision_day, count(*) AS rows, count(*) FILTER (bl) AS blocked, sum(CASE WHEN bl THEN da + coalesce(b.q, 0) ELSE rt END) AS visible_sum,
       sum(CASE WHEN bl THEN load_forecast ELSE load_actual END) AS load_sum
       FROM (SELECT m.*, d.business_day AS dd, m.business_day = d.business_day AND m.ds > CAST(d.business_day AS TIMESTAMP) + INTERVAL 10 HOUR AS bl FROM market m
             JOIN (SELECT DISTINCT series_id, business_day FROM market) d
             ON m.series_id = d.series_id AND m.business_day BETWEEN d.business_day - 3 AND d.business_day) m
       JOIN (SELECT DISTINCT series_id, business_day FROM market) d ON m.series_id = d.series_id AND m.dd = d.business_day
       LEFT JOIN (SELECT series_id, period, median(rt - da) AS q FROM market WHERE hour_business > 10 GROUP BY ALL) b ON m.series_id = b.series_id AND m.period = b.period GROUP BY ALL""",
)
def _(t):
    m = t.stored_market
    bias = asof.fill_bias(m.withColumn("delta_target", F.col("rt") - F.col("da")), 10, ["series_id", "period"])
    days = m.select("series_id", "business_day").distinct()
    v = asof.visible_frame(m, days, 10, ["series_id"], 3, pairs={"load_actual": "load_forecast"}, bias=bias, bias_keys=["series_id", "period"])
    return v.groupBy("series_id", "decision_day").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("blocked").cast("int")).alias("blocked"), F.sum("visible_rt").alias("visible_sum"), F.sum("visible_load_actual").alias("load_sum")
    )


@query(
    "fill_bias_map",
    "series_id:i period:s fill_bias:d",
    "SELECT series_id, period, median(rt - da) AS fill_bias FROM market WHERE hour_business > 10 GROUP BY ALL",
)
def _(t):
    return asof.fill_bias(t.stored_market.withColumn("delta_target", F.col("rt") - F.col("da")), 10, ["series_id", "period"])


@query(
    "month_fold_rows",
    "fold_id:i train_start:t train_end:t test_start:t test_end:t target_month:s orders:i train_orders:i",
    """SELECT f.*, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN f.test_start AND f.test_end) AS orders,
       (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN f.train_start AND f.train_end) AS train_orders FROM (
       SELECT i AS fold_id, greatest(DATE '1997-01-01', CAST(m - INTERVAL 180 DAY AS DATE)) AS train_start, CAST(m - INTERVAL 1 DAY AS DATE) AS train_end, CAST(m AS DATE) AS test_start,
         last_day(m) AS test_end, strftime(m, '%Y-%m') AS target_month FROM (SELECT i, DATE '1997-04-01' + to_months(CAST(i AS INT)) AS m FROM range(9) r(i))) f""",
)
def _(t):
    f = folds.month_folds(t.spark, "1997-04", "1997-12", "1997-01-01", expanding=False)
    daily = t.table("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spread = f.withColumn("day", F.explode(F.sequence("train_start", "test_end")))  # days of a fold, so the join is on equality
    tested = daily.join(spread, "day")
    hit = F.col("day") >= F.col("test_start")
    return tested.groupBy(*f.columns).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("orders"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("train_orders")
    )


TAPF = """fd AS (SELECT s.series_id, i AS tap_fold_id, 9 - i AS age_block, CAST(s.d - CAST(31 - 3 * i AS INT) AS DATE) AS train_end FROM (SELECT series_id, max(business_day) + 1 AS d FROM panel GROUP BY ALL) s, range(10) r(i))"""


@query(
    "tap_fold_specs",
    "series_id:i tap_fold_id:i age_block:i train_start:t train_end:t test_start:t test_end:t rows:i",
    """SELECT f.series_id, f.tap_fold_id, f.age_block, make_date(year(date_trunc('month', train_end) - INTERVAL 6 MONTH), month(date_trunc('month', train_end) - INTERVAL 6 MONTH), least(day(train_end), 28)) AS train_start,
       train_end, train_end + 1 AS test_start, train_end + 3 AS test_end, count(p.ds) AS rows FROM fd f LEFT JOIN panel p ON f.series_id = p.series_id AND p.business_day BETWEEN train_end + 1 AND train_end + 3 GROUP BY ALL""",
    TAPF,
)
def _(t):
    p = t.stored_panel
    days = p.groupBy("series_id").agg(F.date_add(F.max("business_day"), 1).alias("predict_date"))
    spec = folds.tap_folds(days)
    rows = folds.assign_tap_folds(p.join(days, "series_id"), F.col("predict_date")).groupBy("series_id", "tap_fold_id").agg(F.count(F.lit(1)).alias("rows"))
    return spec.join(rows, ["series_id", "tap_fold_id"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


@query(
    "tap_fold_assignment",
    "series_id:i business_day:t tap_fold_id:i age_block:i age_days:i horizon_day:i rows:i",
    """SELECT series_id, business_day, (30 - a) // 3 AS tap_fold_id, 9 - (30 - a) // 3 AS age_block, a AS age_days, ((29 - a) % 3 + 3) % 3 + 1 AS horizon_day, count(*) AS rows
       FROM (SELECT *, DATE '2024-01-31' - business_day AS a FROM panel) WHERE a BETWEEN 1 AND 30 GROUP BY ALL""",
)
def _(t):
    f = folds.assign_tap_folds(t.panel, "2024-01-31")
    return f.groupBy("series_id", "business_day", "tap_fold_id", "age_block", "age_days", "horizon_day").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "chronological_split",
    "series_id:i part:s rows:i first_ds:t",
    """SELECT series_id, CASE WHEN i < n - v THEN 'train' ELSE 'val' END AS part, count(*) AS rows, min(ds) AS first_ds FROM (
       SELECT *, least(greatest(floor(n * 0.25), 100), n - 1) AS v FROM (SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM market)) GROUP BY ALL""",
)
def _(t):
    s = folds.chronological_split(t.market, ["series_id"], 0.25, 100)
    return s.groupBy("series_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("ds").alias("first_ds"))


@query(
    "decision_split",
    "series_id:i part:s rows:i",
    "SELECT series_id, CASE WHEN business_day < DATE '2024-01-18' THEN 'train' ELSE 'val' END AS part, count(*) AS rows FROM market WHERE business_day < DATE '2024-01-25' GROUP BY ALL",
)
def _(t):
    return folds.decision_split(t.market, "2024-01-25", 7).groupBy("series_id", "part").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "contiguous_folds",
    "series_id:i fold:i rows:i first_ds:t last_ds:t",
    "SELECT series_id, fold, count(*) AS rows, min(ds) AS first_ds, max(ds) AS last_ds FROM (SELECT series_id, ds, ntile(5) OVER (PARTITION BY series_id ORDER BY ds) - 1 AS fold FROM market) GROUP BY ALL",
)
def _(t):
    f = folds.contiguous_folds(t.market, ["series_id"], 5)
    return f.groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


@query(
    "seasonal_replay_days",
    "o_orderpriority:s rule:s days:i first_day:t last_day:t",
    """SELECT o_orderpriority, 'exact_1998' AS rule, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day
       FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-10' GROUP BY ALL""",
)
def _(t):
    days = t.table("orders").select("o_orderpriority", F.to_date("o_orderdate").alias("business_day"))
    r = folds.replay_days(days, "2001-03-01", "2001-03-10", 2001, 0, ["o_orderpriority"])
    return r.groupBy("o_orderpriority", "rule").agg(F.count(F.lit(1)).alias("days"), F.min("business_day").alias("first_day"), F.max("business_day").alias("last_day"))


@query(
    "hysteresis_alarm",
    "series_id:i ds:t alarm:b",
    """SELECT series_id, ds, coalesce(last_value(CASE WHEN p >= 0.25 THEN true WHEN p < 0.8 * 0.25 THEN false END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS alarm
       FROM (SELECT series_id, ds, high_spike_prob AS p FROM market)""",
)
def _(t):
    from ..operators import events

    return events.hysteresis(t.market, ["series_id"], "high_spike_prob", 0.25, "alarm")


@query(
    "momentum_boost",
    "series_id:i ds:t boosted:d",
    """SELECT series_id, ds, CASE WHEN prev THEN least(p * 1.15, 1) ELSE p END AS boosted FROM (
       SELECT series_id, ds, p, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prev FROM (
         SELECT series_id, ds, high_spike_prob AS p, CASE WHEN high_spike_prob >= 0.2 THEN true WHEN high_spike_prob * 1.15 < 0.2 THEN false END AS s FROM market))""",
)
def _(t):
    from ..operators import events

    return events.momentum(t.market, ["series_id"], "high_spike_prob", 0.2, 1.15, "boosted")
