"""Accuracy, scorecard and report queries."""

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import dedupe, joins, metrics, reports
from .registry import query

SMAPE_SQL = {
    "floor50": "100 * abs(greatest({p}, 50) - greatest({t}, 50)) / greatest((greatest({p}, 50) + greatest({t}, 50)) / 2, 1e-6)",
    "raw": "200 * abs({p} - {t}) / (abs({t}) + abs({p}) + 1e-6)",
    "capped": "200 * abs(greatest({p}, 50) - greatest({t}, 50)) / (greatest({t}, 50) + greatest({p}, 50) + 1e-6)",
    "denom50": "100 * abs({t} - {p}) / greatest((abs({t}) + abs({p})) / 2, 50)",
    "eval_raw": "200 * abs({p} - {t}) / greatest(abs({t}) + abs({p}), 1e-6)",
    "eval_clip50": "200 * abs(greatest({p}, 50) - greatest({t}, 50)) / greatest(greatest({t}, 50) + greatest({p}, 50), 1e-6)",
    "fraction": "abs(greatest({p}, 50) - greatest({t}, 50)) / greatest((greatest({p}, 50) + greatest({t}, 50)) / 2, 1e-6)",
    "row_capped": "coalesce(least(100 * abs(greatest({p}, 50) - greatest({t}, 50)) / greatest((greatest({p}, 50) + greatest({t}, 50)) / 2, 1e-6), 50), 50)",
    "regime": "200 * abs({p} - {t}) / (abs({p}) + abs({t}) + 1e-10)",
    "absfloor_capped": "least(100 * abs(greatest(abs({t}), 50) - greatest(abs({p}), 50)) / ((greatest(abs({t}), 50) + greatest(abs({p}), 50)) / 2), 50)",
    "raw_capped": "least(CASE WHEN (abs({t}) + abs({p})) / 2 > 1e-10 THEN 100 * abs({t} - {p}) / ((abs({t}) + abs({p})) / 2) ELSE 0 END, 50)",
    "denom_absfloor": "2 * abs({t} - {p}) / (greatest(abs({t}), 50) + greatest(abs({p}), 50))",
}


def smape_sql(variant: str, t: str = "y_true", p: str = "y_pred", cond: str = "") -> str:
    flt = f" FILTER ({cond})" if cond else ""
    return f"avg({SMAPE_SQL[variant].format(t=t, p=p)}){flt}"


@query(
    "smape_variants",
    "series_id:i period:s " + " ".join(f"{v}:d" for v in scores.SMAPE_VARIANTS),
    f"SELECT series_id, period, {', '.join(f'{smape_sql(v, 'rt', 'da')} AS {v}' for v in scores.SMAPE_VARIANTS)} FROM market GROUP BY ALL",
)
def _(t):
    return t.market.groupBy("series_id", "period").agg(
        *[scores.smape(v, "rt", "da").alias(v) for v in scores.SMAPE_VARIANTS]
    )


@query(
    "error_metrics_by_model",
    "series_id:i model_name:s mae:d mse:d rmse:d r2:d mape:d",
    """SELECT series_id, model_name, avg(abs(y_true - y_pred)) AS mae, avg((y_true - y_pred) ** 2) AS mse,
       sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
       1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) AS r2,
       100 * avg(abs(y_true - y_pred) / greatest(abs(y_true), 50)) AS mape
       FROM panel GROUP BY ALL""",
)
def _(t):
    return metrics.error_metrics(t.panel, ["series_id", "model_name"])


@query(
    "full_metrics_by_segment",
    "series_id:i task:s period:s rows:i smape:d mae:d rmse:d bias_mean:d bias_median:d q90_mae:d q95_mae:d weighted_norm_mae:d weighted_peak_mae:d",
    f"""SELECT p.series_id, p.task, p.period, count(*) AS rows, {smape_sql('floor50')} AS smape, avg(abs(y_pred - y_true)) AS mae,
       sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(y_pred - y_true) AS bias_mean, any_value(bm) AS bias_median,
       avg(abs(y_pred - y_true)) FILTER (y_true >= q90) AS q90_mae,
       avg(abs(y_pred - y_true)) FILTER (y_true >= q95) AS q95_mae,
       sum(n * abs(y_pred - y_true) / greatest(ma, 1e-6)) / sum(n) AS weighted_norm_mae,
       sum(n * abs(y_pred - y_true)) FILTER (y_true >= q90) / sum(n) FILTER (y_true >= q90) AS weighted_peak_mae
       FROM panel p JOIN q ON p.series_id = q.series_id AND p.task = q.task AND p.period = q.period GROUP BY ALL""",
    """q AS (SELECT series_id, task, period, quantile_cont(y_true, 0.9) AS q90, quantile_cont(y_true, 0.95) AS q95,
       median(abs(y_true)) AS ma, median(y_pred - y_true) AS bm FROM panel GROUP BY ALL)""",
)
def _(t):
    return metrics.full_metrics(t.stored_panel, ["series_id", "task", "period"], weight="n")


@query(
    "metrics_by_period_with_overall",
    "series_id:i task:s period:s rows:i smape:d mae:d rmse:d bias_mean:d",
    f"""SELECT series_id, task, coalesce(period, 'overall') AS period, count(*) AS rows, {smape_sql('floor50')} AS smape,
       avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(y_pred - y_true) AS bias_mean
       FROM panel GROUP BY GROUPING SETS ((series_id, task, period), (series_id, task))""",
)
def _(t):
    return metrics.with_overall(t.panel, ["series_id", "task"], "period", metrics.standard_aggs())


@query(
    "metrics_by_hour",
    "series_id:i hour_business:s rows:i smape:d",
    f"""SELECT series_id, coalesce(CAST(hour_business AS VARCHAR), 'overall') AS hour_business, count(*) AS rows, {smape_sql('denom_absfloor')} AS smape
       FROM panel GROUP BY GROUPING SETS ((series_id, hour_business), (series_id))""",
)
def _(t):
    return metrics.with_overall(
        t.panel,
        ["series_id"],
        "hour_business",
        {"rows": F.count(F.lit(1)), "smape": scores.smape("denom_absfloor", "y_true", "y_pred")},
    )


DELTA_CTE = """dl AS (SELECT series_id, business_day, period, ds, rt AS rt_actual, da, rt - da AS delta_target,
  high_spike_prob * 300 - 100 AS delta_hat, da + (high_spike_prob * 300 - 100) AS rt_hat FROM market)"""


def delta_frame(t):
    return t.stored_market.select(
        "series_id", "business_day", "period", "ds", "da", F.col("rt").alias("rt_actual"),
        (F.col("rt") - F.col("da")).alias("delta_target"),
        (F.col("high_spike_prob") * 300 - 100).alias("delta_hat"),
        (F.col("da") + (F.col("high_spike_prob") * 300 - 100)).alias("rt_hat"),
    )


@query(
    "tail_metrics",
    "series_id:i tail_quantile:d threshold_abs_delta:d count:i tail_delta_mae:d tail_rt_smape:d tail_direction_accuracy:d",
    f"""SELECT d.series_id, tail_quantile, threshold_abs_delta, count(*) AS count, avg(abs(delta_target - delta_hat)) AS tail_delta_mae,
       {smape_sql('raw', 'rt_actual', 'rt_hat')} AS tail_rt_smape,
       avg(CAST((delta_target > 0) = (delta_hat > 0) AS DOUBLE)) AS tail_direction_accuracy
       FROM dl d JOIN q ON d.series_id = q.series_id AND abs(d.delta_target) >= q.threshold_abs_delta GROUP BY ALL""",
    DELTA_CTE + """, q AS (SELECT series_id, p AS tail_quantile, CASE WHEN p = 0.9 THEN q90 ELSE q95 END AS threshold_abs_delta
       FROM (SELECT series_id, quantile_cont(abs(delta_target), 0.9) AS q90, quantile_cont(abs(delta_target), 0.95) AS q95 FROM dl GROUP BY ALL),
            (VALUES (0.9), (0.95)) v(p))""",
)
def _(t):
    return metrics.tail_metrics(delta_frame(t), ["series_id"])


@query(
    "direction_metrics",
    "series_id:i period:s count:i rt_smape:d rt_capped_smape:d rt_mae:d rt_rmse:d delta_mae:d delta_rmse:d direction_accuracy:d positive_direction_recall:d",
    f"""SELECT series_id, period, count(*) AS count, {smape_sql('raw', 'rt_actual', 'rt_hat')} AS rt_smape,
       {smape_sql('capped', 'rt_actual', 'rt_hat')} AS rt_capped_smape, avg(abs(rt_actual - rt_hat)) AS rt_mae,
       sqrt(avg((rt_actual - rt_hat) ** 2)) AS rt_rmse, avg(abs(delta_target - delta_hat)) AS delta_mae,
       sqrt(avg((delta_target - delta_hat) ** 2)) AS delta_rmse,
       avg(CAST((delta_target > 0) = (delta_hat > 0) AS DOUBLE)) AS direction_accuracy,
       avg(CAST(delta_hat > 0 AS DOUBLE)) FILTER (delta_target > 0) AS positive_direction_recall FROM dl GROUP BY ALL""",
    DELTA_CTE,
)
def _(t):
    return metrics.delta_metrics(delta_frame(t), ["series_id", "period"])


@query(
    "step_sign_agreement",
    "series_id:i scr:d",
    """SELECT series_id, avg(CAST(a = b AS DOUBLE)) AS scr FROM (
       SELECT series_id, sign(rt - lag(rt) OVER w) AS a, sign(da - lag(da) OVER w) AS b FROM market
       WINDOW w AS (PARTITION BY series_id ORDER BY ds)) GROUP BY ALL""",
)
def _(t):
    return metrics.step_sign_agreement(t.market, ["series_id"], "rt", "da")


@query(
    "arbitrage_by_month",
    "series_id:i period:s total_profit:d total_volume:i unit_profit:d improved_total_profit:d improved_total_volume:i improved_unit_profit:d",
    """SELECT *, total_profit / nullif(total_volume, 0) AS unit_profit, improved_total_profit / nullif(improved_total_volume, 0) AS improved_unit_profit FROM (
       SELECT series_id, period, coalesce(sum(rt - da) FILTER (pda > da), 0) AS total_profit, count(*) FILTER (pda > da) AS total_volume,
       coalesce(sum(rt - da) FILTER (pda > da AND prt > pda), 0) AS improved_total_profit, count(*) FILTER (pda > da AND prt > pda) AS improved_total_volume
       FROM a GROUP BY ALL)""",
    "a AS (SELECT series_id, period, rt, da, load_actual / 3 AS pda, high_spike_prob * 400 AS prt FROM market)",
)
def _(t):
    df = t.market.select(
        "series_id", "period", F.col("rt").alias("y_true_rt"), F.col("da").alias("y_true_da"),
        (F.col("load_actual") / 3).alias("y_pred_da"), (F.col("high_spike_prob") * 400).alias("y_pred_rt"),
    )
    return metrics.arbitrage(df, ["series_id", "period"])


@query(
    "price_bucket_metrics",
    "series_id:i bucket:s smape:d rows:i",
    f"""SELECT m.series_id, CASE WHEN rt <= 0 THEN 'negative' WHEN rt >= q THEN 'spike' ELSE 'normal' END AS bucket,
       {smape_sql('denom_absfloor', 'rt', 'da')} AS smape, count(*) AS rows
       FROM market m JOIN (SELECT series_id, quantile_cont(rt, 0.95) AS q FROM market GROUP BY ALL) q ON m.series_id = q.series_id GROUP BY ALL""",
)
def _(t):
    df = t.stored_market.select("series_id", F.col("rt").alias("y_true"), F.col("da").alias("y_pred"))
    return metrics.bucket_metrics(df, ["series_id"])


def corrected_frame(t):
    """A stand-in for a corrected pack: lift when risk is high, lower when base is near zero."""
    m = t.stored_market
    lift = F.when(F.col("high_spike_prob") > 0.3, F.col("high_spike_prob") * 60).otherwise(0.0)
    drop = F.when((F.col("da") < 80) & (F.col("high_spike_prob") < 0.05), F.lit(-12.5)).otherwise(0.0)
    return m.select(
        "series_id", "business_day", "hour_business", "period", F.col("rt").alias("y_true"),
        F.col("da").alias("base_pred"), F.col("da").alias("base_fused_pred"),
        (F.col("da") + lift + drop).alias("final_pred"), lift.alias("lift_applied"),
        (lift > 0).alias("high_spike_applied"),
        F.when(F.col("rt") > 260, 1).otherwise(0).alias("high_spike_flag"),
        F.when(F.col("high_spike_prob") < 0.05, "NO_CORRECTION_LOW_PROB")
        .when(F.col("da") < 0, "NO_CORRECTION_NEGATIVE_BASE")
        .when(F.col("period") != "9_16", "NO_CORRECTION_NORMAL_HOUR")
        .when(lift > 25, "GUARDRAIL_CLIPPED")
        .otherwise("LIFT").alias("reason_code"),
    )


CORRECTED_CTE = """corr AS (SELECT *, base_pred + lift_applied + drp AS final_pred, lift_applied > 0 AS high_spike_applied,
   CASE WHEN hp < 0.05 THEN 'NO_CORRECTION_LOW_PROB' WHEN base_pred < 0 THEN 'NO_CORRECTION_NEGATIVE_BASE'
        WHEN period != '9_16' THEN 'NO_CORRECTION_NORMAL_HOUR' WHEN lift_applied > 25 THEN 'GUARDRAIL_CLIPPED' ELSE 'LIFT' END AS reason_code
   FROM (SELECT series_id, business_day, hour_business, period, rt AS y_true, da AS base_pred, da AS base_fused_pred, high_spike_prob AS hp,
   CASE WHEN high_spike_prob > 0.3 THEN high_spike_prob * 60 ELSE 0.0 END AS lift_applied,
   CASE WHEN da < 80 AND high_spike_prob < 0.05 THEN -12.5 ELSE 0.0 END AS drp,
   CASE WHEN rt > 260 THEN 1 ELSE 0 END AS high_spike_flag FROM market))"""

SCORECARD_SQL = f"""SELECT *, CASE WHEN nb > 0 THEN round((nb - na) / nb * 100, 2) ELSE 0 END AS negative_mae_improvement,
   CASE WHEN lb > 0 THEN round((lb - la) / lb * 100, 2) ELSE 0 END AS low_valley_mae_improvement,
   CASE WHEN sb > 0 THEN round((sb - sa) / sb * 100, 2) ELSE 0 END AS high_spike_mae_improvement,
   round(smape_before - smape_after, 4) AS smape_improvement, round(n_after - n_before, 4) AS normal_degradation,
   CASE WHEN lifted > 0 THEN round(1 - good, 4) ELSE 0 END AS false_lift_rate, negative_count < 5 AS data_limited FROM (
   SELECT series_id, count(*) FILTER (y_true < 0) AS negative_count, count(*) FILTER (y_true <= 50) AS low_valley_count,
   count(*) FILTER (y_true > 150) AS high_spike_count, count(*) FILTER (y_true - base_pred > 100) AS severe_underestimate,
   avg(abs(y_true - base_pred)) FILTER (y_true < 0) AS nb, avg(abs(y_true - final_pred)) FILTER (y_true < 0) AS na,
   avg(abs(y_true - base_pred)) FILTER (y_true <= 50) AS lb, avg(abs(y_true - final_pred)) FILTER (y_true <= 50) AS la,
   avg(abs(y_true - base_pred)) FILTER (y_true > 150) AS sb, avg(abs(y_true - final_pred)) FILTER (y_true > 150) AS sa,
   count(*) FILTER (y_true < 0 AND base_pred >= 0) AS negative_miss_before, count(*) FILTER (y_true < 0 AND final_pred >= 0) AS negative_miss_after,
   count(*) FILTER (y_true <= 50 AND base_pred - y_true >= 30) AS low_valley_overestimate_before,
   {smape_sql('denom50', 'y_true', 'base_pred')} AS smape_before, {smape_sql('denom50', 'y_true', 'final_pred')} AS smape_after,
   {smape_sql('denom50', 'y_true', 'base_pred', 'hour_business NOT BETWEEN 9 AND 16')} AS n_before,
   {smape_sql('denom50', 'y_true', 'final_pred', 'hour_business NOT BETWEEN 9 AND 16')} AS n_after,
   avg(CAST(final_pred > y_true AS DOUBLE)) FILTER (high_spike_applied) AS good, count(*) FILTER (high_spike_applied) AS lifted
   FROM corr GROUP BY ALL)"""


@query(
    "correction_scorecard",
    "series_id:i negative_count:i low_valley_count:i high_spike_count:i severe_underestimate:i negative_miss_before:i negative_miss_after:i "
    "low_valley_overestimate_before:i smape_before:d smape_after:d smape_improvement:d negative_mae_improvement:d low_valley_mae_improvement:d "
    "high_spike_mae_improvement:d normal_degradation:d false_lift_rate:d data_limited:b",
    SCORECARD_SQL,
    CORRECTED_CTE,
)
def _(t):
    return metrics.correction_scorecard(corrected_frame(t), ["series_id"])


@query(
    "stack_verdict",
    "series_id:i verdict:s",
    """SELECT series_id, CASE WHEN data_limited THEN 'DATA-LIMITED' WHEN why = '' THEN 'GO' ELSE 'NO-GO: ' || why END AS verdict FROM (
       SELECT *, concat_ws('; ',
         CASE WHEN smape_improvement < -0.3 THEN printf('sMAPE worse by %.2f (limit 0.3)', abs(smape_improvement)) END,
         CASE WHEN high_spike_mae_improvement < -3 THEN printf('high_spike_MAE worse by %.1f%% (limit 3%%)', abs(high_spike_mae_improvement)) END,
         CASE WHEN low_valley_mae_improvement < 0 THEN printf('low_valley_MAE worse by %.2f%%', abs(low_valley_mae_improvement)) END,
         CASE WHEN normal_degradation > 0.5 THEN printf('normal_degradation %.2f > 0.5', normal_degradation) END) AS why FROM sc)""",
    CORRECTED_CTE + f", sc AS ({SCORECARD_SQL})",
)
def _(t):
    return reports.stack_verdict(metrics.correction_scorecard(corrected_frame(t), ["series_id"]))


@query(
    "spike_scorecard",
    "series_id:i smape:d base_smape:d smape_9_16:d severe:i base_severe:i spike_mae:d base_spike_mae:d false_lift_rate:d spike_recall:d "
    "spike_precision:d normal_degradation:d lift_applied_count:i lift_capped_count:i rejected_low_prob:i rejected_negative_base:i rejected_normal_hour:i total_hours:i verdict:s",
    f"""SELECT *, CASE WHEN smape <= 22.02 AND severe < 80 AND false_lift_rate <= 0.15 AND normal_degradation <= 0.5 THEN 'GO'
         WHEN smape <= 22.5 AND severe < 80 AND false_lift_rate <= 0.2 AND normal_degradation <= 1 THEN 'CONDITIONAL' ELSE 'NO-GO' END AS verdict FROM (
       SELECT series_id, {smape_sql('raw_capped', 'y_true', 'final_pred')} AS smape, {smape_sql('raw_capped', 'y_true', 'base_pred')} AS base_smape,
       {smape_sql('raw_capped', 'y_true', 'final_pred', "period = '9_16'")} AS smape_9_16,
       count(*) FILTER (y_true - final_pred > 200) AS severe, count(*) FILTER (y_true - base_pred > 200) AS base_severe,
       avg(abs(y_true - final_pred)) FILTER (high_spike_flag = 1) AS spike_mae, avg(abs(y_true - base_pred)) FILTER (high_spike_flag = 1) AS base_spike_mae,
       count(*) FILTER (high_spike_flag = 0 AND final_pred > base_pred AND lift_applied > 0) / greatest(count(*) FILTER (high_spike_flag = 0), 1) AS false_lift_rate,
       count(*) FILTER (high_spike_flag = 1 AND lift_applied > 0) / greatest(count(*) FILTER (high_spike_flag = 1), 1) AS spike_recall,
       count(*) FILTER (high_spike_flag = 1 AND lift_applied > 0) / greatest(count(*) FILTER (lift_applied > 0), 1) AS spike_precision,
       {smape_sql('raw_capped', 'y_true', 'final_pred', "period != '9_16'")} - {smape_sql('raw_capped', 'y_true', 'base_pred', "period != '9_16'")} AS normal_degradation,
       count(*) FILTER (lift_applied > 0) AS lift_applied_count, count(*) FILTER (reason_code = 'GUARDRAIL_CLIPPED') AS lift_capped_count,
       count(*) FILTER (reason_code = 'NO_CORRECTION_LOW_PROB') AS rejected_low_prob,
       count(*) FILTER (reason_code = 'NO_CORRECTION_NEGATIVE_BASE') AS rejected_negative_base,
       count(*) FILTER (reason_code = 'NO_CORRECTION_NORMAL_HOUR') AS rejected_normal_hour, count(*) AS total_hours
       FROM corr GROUP BY ALL)""",
    CORRECTED_CTE,
)
def _(t):
    sc = metrics.spike_scorecard(corrected_frame(t), ["series_id"])
    return sc.withColumn(
        "verdict",
        reports.profile_verdict(F.col("smape"), F.col("severe"), F.col("false_lift_rate"), F.col("normal_degradation"), F.lit(False)),
    )


@query(
    "config_comparison",
    "series_id:i metric:s base:d corrected:d",
    f"""SELECT series_id, metric, max(v) FILTER (config = 'base') AS base, max(v) FILTER (config = 'corrected') AS corrected FROM (
       SELECT series_id, config, unnest(['mae', 'severe', 'smape']) AS metric, unnest([mae, severe, smape]) AS v FROM (
         SELECT series_id, 'base' AS config, avg(abs(y_true - base_pred)) AS mae, CAST(count(*) FILTER (y_true - base_pred > 200) AS DOUBLE) AS severe, {smape_sql('absfloor_capped', 'y_true', 'base_pred')} AS smape FROM corr GROUP BY ALL
         UNION ALL
         SELECT series_id, 'corrected', avg(abs(y_true - final_pred)), CAST(count(*) FILTER (y_true - final_pred > 200) AS DOUBLE), {smape_sql('absfloor_capped', 'y_true', 'final_pred')} FROM corr GROUP BY ALL)) GROUP BY ALL""",
    CORRECTED_CTE,
)
def _(t):
    cells = [F.struct(F.lit(c).alias("config"), F.col(p).alias("y_pred")) for c, p in (("base", "base_pred"), ("corrected", "final_pred"))]
    long = corrected_frame(t).select("series_id", "y_true", F.explode(F.array(*cells)).alias("c")).select("series_id", "y_true", "c.*")
    sc = long.groupBy("series_id", "config").agg(
        scores.mae("y_true", "y_pred").alias("mae"),
        F.count(F.when(F.col("y_true") - F.col("y_pred") > 200, 1)).alias("severe"),
        scores.smape("absfloor_capped", "y_true", "y_pred").alias("smape"),
    )
    return reports.compare_configs(sc, ["base", "corrected"], ["mae", "severe", "smape"], ["series_id"])


@query(
    "stage_deltas",
    "series_id:i stage:i smape:d delta:d",
    f"""SELECT series_id, stage, smape, smape - lag(smape) OVER (PARTITION BY series_id ORDER BY stage) AS delta FROM (
       SELECT series_id, 1 AS stage, {smape_sql('denom_absfloor', 'y_true', 'base_pred')} AS smape FROM corr GROUP BY ALL
       UNION ALL SELECT series_id, 2, {smape_sql('denom_absfloor', 'y_true', '(base_pred + lift_applied)')} FROM corr GROUP BY ALL
       UNION ALL SELECT series_id, 3, {smape_sql('denom_absfloor', 'y_true', 'final_pred')} FROM corr GROUP BY ALL)""",
    CORRECTED_CTE,
)
def _(t):
    stages = F.array(
        F.struct(F.lit(1).alias("stage"), F.col("base_pred").alias("p")),
        F.struct(F.lit(2).alias("stage"), (F.col("base_pred") + F.col("lift_applied")).alias("p")),
        F.struct(F.lit(3).alias("stage"), F.col("final_pred").alias("p")),
    )
    long = corrected_frame(t).select("series_id", "y_true", F.explode(stages).alias("s")).select("series_id", "y_true", "s.*")
    g = long.groupBy("series_id", "stage").agg(scores.smape("denom_absfloor", "y_true", "p").alias("smape"))
    return reports.stage_deltas(g, ["series_id"], "stage", "smape")


@query(
    "timestamp_metrics",
    "series_id:i business_day:s rows:i smape:d smape_9_16:d severe:i severe_9_16:i",
    f"""SELECT series_id, coalesce(CAST(business_day AS VARCHAR), 'overall') AS business_day, count(*) AS rows, {smape_sql('absfloor_capped')} AS smape,
       {smape_sql('absfloor_capped', cond="period = '9_16'")} AS smape_9_16, count(*) FILTER (y_true - y_pred > 200) AS severe,
       count(*) FILTER (y_true - y_pred > 200 AND period = '9_16') AS severe_9_16
       FROM (SELECT series_id, business_day, hour_business, any_value(period) AS period, min(y_true * 8) AS y_true, min(y_true * 6 + 40) AS y_pred FROM panel GROUP BY 1, 2, 3)
       GROUP BY GROUPING SETS ((series_id, business_day), (series_id))""",
)
def _(t):
    df = t.panel.withColumns({"y_true": F.col("y_true") * 8, "y_pred": F.col("y_true") * 6 + 40})
    return metrics.timestamp_metrics(df, ["series_id"], "y_pred")


@query(
    "risk_summary",
    "series_id:i mean:d std:d p95:d rate_20:d rate_30:d rate_40:d rate_50:d",
    """SELECT series_id, avg(high_spike_prob) AS mean, stddev_samp(high_spike_prob) AS std, quantile_cont(high_spike_prob, 0.95) AS p95,
       avg(CAST(high_spike_prob > 0.2 AS DOUBLE)) AS rate_20, avg(CAST(high_spike_prob > 0.3 AS DOUBLE)) AS rate_30,
       avg(CAST(high_spike_prob > 0.4 AS DOUBLE)) AS rate_40, avg(CAST(high_spike_prob > 0.5 AS DOUBLE)) AS rate_50 FROM market GROUP BY ALL""",
)
def _(t):
    return reports.risk_summary(t.stored_market, ["series_id"], "high_spike_prob")


@query(
    "target_gaps",
    "series_id:i model_name:s smape:d gap_to_15:d gap_to_20:d gap_to_reference:d",
    f"""SELECT *, pct - 15 AS gap_to_15, pct - 20 AS gap_to_20, pct - 22.02 AS gap_to_reference FROM (
       SELECT *, CASE WHEN smape < 1 THEN smape * 100 ELSE smape END AS pct FROM (
       SELECT series_id, model_name, {smape_sql('fraction')} AS smape FROM panel GROUP BY ALL))""",
)
def _(t):
    g = t.panel.groupBy("series_id", "model_name").agg(scores.smape("fraction", "y_true", "y_pred").alias("smape"))
    return reports.target_gaps(g, "smape", 22.02)


PROFILE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_LONG = "ll AS (SELECT l_returnflag, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS field, unnest([CAST(l_quantity AS DOUBLE), l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)"


@query(
    "column_profile",
    "l_returnflag:s field:s n_total:i n_non_null:i n_unique:i mean:d std:d cv:d min:d q25:d q50:d q75:d max:d zero_ratio:d missing_rate:d low_variance:b",
    """SELECT l_returnflag, field, count(*) AS n_total, count(value) AS n_non_null, count(DISTINCT value) AS n_unique, avg(value) AS mean,
       stddev_samp(value) AS std, stddev_samp(value) / abs(avg(value)) AS cv, min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
       quantile_cont(value, 0.75) AS q75, max(value) AS max, avg(CAST(value = 0 AS DOUBLE)) AS zero_ratio, 1 - count(value) / count(*) AS missing_rate,
       stddev_samp(value) / abs(avg(value)) < 0.01 AS low_variance FROM ll GROUP BY ALL""",
    LINE_LONG,
)
def _(t):
    return reports.column_profile(t.table("lineitem"), PROFILE_COLUMNS, ["l_returnflag"])


@query(
    "association",
    "l_returnflag:s feature:s target:s n_pairs:i pearson:d spearman:d",
    """SELECT l_returnflag, feature, 'l_extendedprice' AS target, count(*) AS n_pairs, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM (
       SELECT l_returnflag, feature, x, y,
         rank() OVER (PARTITION BY l_returnflag, feature ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, feature, x) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (PARTITION BY l_returnflag, feature ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, feature, y) - 1) / 2.0::DOUBLE AS ry
       FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_discount']) AS feature, unnest([CAST(l_quantity AS DOUBLE), l_discount]) AS x, l_extendedprice AS y FROM lineitem)) GROUP BY ALL""",
)
def _(t):
    return reports.association(t.table("lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice"], ["l_returnflag"])


@query(
    "leak_alarm",
    "series_id:i forecast:s actual:s identical:d verdict:s",
    """SELECT *, CASE WHEN identical > 0.5 THEN 'HIGH' WHEN identical > 0.1 THEN 'MED' ELSE 'OK' END AS verdict FROM (
       SELECT series_id, f AS forecast, a AS actual, avg(CAST(x = y AS DOUBLE)) AS identical FROM (
       SELECT series_id, unnest(['wind_forecast', 'solar_forecast', 'da']) AS f, unnest(['wind_actual', 'solar_actual', 'rt']) AS a,
              unnest([wind_forecast, solar_forecast, da]) AS x, unnest([wind_actual, solar_actual, rt]) AS y FROM market) GROUP BY ALL)""",
)
def _(t):
    return reports.leak_alarm(t.market, {"wind_forecast": "wind_actual", "solar_forecast": "solar_actual", "da": "rt"}, ["series_id"])


@query(
    "availability_by_hour",
    "series_id:i hour:i rows:i available:b",
    "SELECT series_id, hour(ds) AS hour, count(rt) AS rows, hour(ds) <= 14 AS available FROM market GROUP BY ALL",
)
def _(t):
    return reports.availability_by_hour(t.market, "rt", by=["series_id"])


@query(
    "train_length_choice",
    "series_id:i task:s train_months:i smape_mean:d smape_std:d mean_abs_hist_delta:d fail_count:i score:d chosen:b",
    """SELECT *, row_number() OVER (PARTITION BY series_id, task ORDER BY score, train_months) = 1 AS chosen FROM (
       SELECT series_id, task, train_months, avg(s) AS smape_mean, stddev_pop(s) AS smape_std, avg(abs(s - 30)) AS mean_abs_hist_delta,
       count(*) FILTER (s >= 35) AS fail_count, avg(s) + 0.5 * stddev_pop(s) + 0.25 * count(*) FILTER (s >= 35) + 0.2 * avg(abs(s - 30)) AS score FROM sm GROUP BY ALL)""",
    f"sm AS (SELECT series_id, task, length(model_name) AS train_months, business_day, {smape_sql('floor50')} AS s FROM panel GROUP BY ALL)",
)
def _(t):
    s = t.panel.groupBy("series_id", "task", F.length("model_name").alias("train_months"), "business_day").agg(
        scores.smape("floor50", "y_true", "y_pred").alias("overall_smape")
    )
    s = s.withColumns({"delta_vs_historical": F.col("overall_smape") - 30, "pass_flag": F.col("overall_smape") < 35})
    return reports.select_train_length(s, ["series_id", "task"])


@query(
    "reason_counts_and_worst",
    "series_id:i reason_code:s business_day:t hour_business:i gap:d",
    """SELECT * FROM (SELECT series_id, reason_code, business_day, hour_business, y_true - final_pred AS gap,
       row_number() OVER (PARTITION BY series_id, reason_code ORDER BY y_true - final_pred DESC, business_day, hour_business) AS r FROM corr) WHERE r <= 5""",
    CORRECTED_CTE,
)
def _(t):
    df = corrected_frame(t).withColumn("gap", F.col("y_true") - F.col("final_pred"))
    return reports.worst_per_reason(df, ["series_id", "reason_code"], F.col("gap"), 5, ["business_day", "hour_business"])


@query(
    "policy_counts",
    "series_id:i reason_code:s rows:i",
    "SELECT series_id, reason_code, count(*) AS rows FROM corr GROUP BY ALL",
    CORRECTED_CTE,
)
def _(t):
    from ..operators import intraday

    return intraday.value_counts(corrected_frame(t), "reason_code", ["series_id"])


@query(
    "leaderboard_append",
    "series_id:i run:s mae:d",
    """SELECT series_id, 'run1' AS run, avg(abs(y_true - base_pred)) AS mae FROM corr GROUP BY ALL
       UNION ALL SELECT series_id, 'run2', avg(abs(y_true - final_pred)) FROM corr GROUP BY ALL""",
    CORRECTED_CTE,
)
def _(t):
    df = corrected_frame(t)
    a = df.groupBy("series_id").agg(F.lit("run1").alias("run"), scores.mae("y_true", "base_pred").alias("mae"))
    b = df.groupBy("series_id").agg(F.lit("run2").alias("run"), scores.mae("y_true", "final_pred").alias("mae"))
    return reports.append_leaderboard(reports.append_leaderboard(None, a), b)


@query(
    "midday_diagnosis",
    "series_id:i business_day:t smape:d mean_true:d max_true:d max_under_err:d spike_hours:i solar_mean:d solar_drop:d load_mean:d load_ramp:d",
    f"""SELECT series_id, business_day, {smape_sql('floor50', 'rt', 'da')} AS smape, avg(rt) AS mean_true, max(rt) AS max_true, max(rt - da) AS max_under_err,
       count(*) FILTER (rt > 500 OR coalesce(jump, 0) > 200) AS spike_hours, avg(solar_actual) AS solar_mean, max(solar_actual) - min(solar_actual) AS solar_drop,
       avg(load_actual) AS load_mean, max(load_actual) - min(load_actual) AS load_ramp
       FROM (SELECT *, abs(rt - lag(rt) OVER (PARTITION BY series_id, business_day ORDER BY ds)) AS jump FROM market WHERE period = '9_16') GROUP BY ALL""",
)
def _(t):
    df = t.market.withColumns({"y_true": F.col("rt"), "y_pred": F.col("da")})
    return reports.midday_diagnosis(df, ["series_id"], "load_actual", "solar_actual")


@query(
    "landing_months",
    "series_id:i month:s rows:i rt_smape:d rt_capped_smape:d rt_mae:d delta_mae:d top10_capped_smape:d top10_raw_smape:d target_met:b",
    f"""SELECT *, rt_capped_smape < 25 AS target_met FROM (SELECT d.series_id, d.month, count(*) AS rows, {smape_sql('raw', 'rt_actual', 'rt_hat')} AS rt_smape,
       {smape_sql('capped', 'rt_actual', 'rt_hat')} AS rt_capped_smape, avg(abs(rt_actual - rt_hat)) AS rt_mae, avg(abs(delta_target - delta_hat)) AS delta_mae,
       {smape_sql('capped', 'rt_actual', 'rt_hat', 'abs(delta_target) >= q')} AS top10_capped_smape,
       {smape_sql('raw', 'rt_actual', 'rt_hat', 'abs(delta_target) >= q')} AS top10_raw_smape
       FROM (SELECT *, strftime(business_day, '%Y-%m') AS month FROM dl) d JOIN (
       SELECT series_id, strftime(business_day, '%Y-%m') AS month, quantile_cont(abs(delta_target), 0.9) AS q FROM dl GROUP BY ALL) q ON d.series_id = q.series_id AND d.month = q.month GROUP BY ALL)""",
    DELTA_CTE,
)
def _(t):
    return reports.landing_months(delta_frame(t), ["series_id"])


@query(
    "landing_segments",
    "series_id:i month:s period:s rows:i rt_smape:d rt_capped_smape:d rt_mae:d delta_mae:d target_met:b",
    f"""SELECT *, CASE WHEN period = '9_16' THEN rt_capped_smape < 30 END AS target_met FROM (
       SELECT series_id, strftime(business_day, '%Y-%m') AS month, period, count(*) AS rows, {smape_sql('raw', 'rt_actual', 'rt_hat')} AS rt_smape,
       {smape_sql('capped', 'rt_actual', 'rt_hat')} AS rt_capped_smape, avg(abs(rt_actual - rt_hat)) AS rt_mae, avg(abs(delta_target - delta_hat)) AS delta_mae FROM dl GROUP BY ALL)""",
    DELTA_CTE,
)
def _(t):
    return reports.landing_segments(delta_frame(t), ["series_id"])


@query(
    "metric_differences",
    "series_id:i metric:s computed:d stored:d difference:d",
    """SELECT series_id, 'mae' AS metric, avg(abs(rt - da)) AS computed, round(avg(abs(rt - da)), 1) AS stored, avg(abs(rt - da)) - round(avg(abs(rt - da)), 1) AS difference FROM market GROUP BY ALL""",
)
def _(t):
    g = t.stored_market.groupBy("series_id").agg(scores.mae("rt", "da").alias("mae"))
    a = reports.long_metrics(g, ["series_id"], ["mae"])
    b = a.withColumn("value", F.round("value", 1))
    return reports.metric_differences(a, b, ["series_id"])


@query(
    "best_model_per_day",
    "series_id:i business_day:t model_name:s mae:d",
    """SELECT series_id, business_day, model_name, mae FROM (SELECT *, row_number() OVER (PARTITION BY series_id, business_day ORDER BY mae, model_name) AS r FROM (
       SELECT series_id, business_day, model_name, avg(abs(y_true - y_pred)) AS mae FROM panel GROUP BY ALL)) WHERE r = 1""",
)
def _(t):
    g = t.panel.groupBy("series_id", "business_day", "model_name").agg(scores.mae("y_true", "y_pred").alias("mae"))
    return reports.best_candidate(g, ["series_id", "business_day"], ["mae", "model_name"])


@query(
    "family_board",
    "series_id:i family:s name:s metric:d delta:d decision:s",
    f"""SELECT *, CASE WHEN delta <= -2 THEN 'KEEP' WHEN delta <= -0.5 THEN 'RETRY' ELSE 'REJECT' END AS decision FROM (
       SELECT b.series_id, b.family, b.name, b.metric, b.metric - k.metric AS delta FROM (
       SELECT *, row_number() OVER (PARTITION BY series_id, family ORDER BY metric, name) AS r FROM bd WHERE name != 'baseline') b
       JOIN bd k ON b.series_id = k.series_id AND k.name = 'baseline' WHERE r = 1)""",
    f"""bd AS (SELECT series_id, CASE WHEN model_name IN ('click', 'view') THEN 'A' ELSE 'B' END AS family,
       CASE WHEN model_name = 'error' THEN 'baseline' ELSE model_name END AS name, {smape_sql('capped')} AS metric FROM panel GROUP BY ALL)""",
)
def _(t):
    board = t.panel.groupBy("series_id", "model_name").agg(scores.smape("capped", "y_true", "y_pred").alias("metric"))
    board = board.select(
        "series_id",
        F.when(F.col("model_name").isin("click", "view"), "A").otherwise("B").alias("family"),
        F.when(F.col("model_name") == "error", "baseline").otherwise(F.col("model_name")).alias("name"),
        "metric",
    )
    return reports.family_board(board, ["series_id"], "metric")


@query(
    "month_audit",
    "series_id:i month:s field:s rows:i n:i missing:i outliers:i outlier_ratio:d mean:d std:d min:d median:d max:d mean_shift:d",
    """SELECT a.series_id, a.month, a.field, count(*) AS rows, count(value) AS n, count(*) - count(value) AS missing,
       count(*) FILTER (abs((value - m) / s) > 3 AND c >= 10) AS outliers, count(*) FILTER (abs((value - m) / s) > 3 AND c >= 10) / count(value) AS outlier_ratio,
       any_value(m) AS mean, any_value(s) AS std, min(value) AS min, median(value) AS median, max(value) AS max, any_value(m) - any_value(fm) AS mean_shift
       FROM lg a JOIN (SELECT series_id, month, field, avg(value) AS m, stddev_samp(value) AS s, count(value) AS c FROM lg GROUP BY ALL) b
         ON a.series_id = b.series_id AND a.month = b.month AND a.field = b.field
       JOIN (SELECT series_id, field, avg(value) AS fm FROM lg GROUP BY ALL) f ON a.series_id = f.series_id AND a.field = f.field GROUP BY ALL""",
    """lg AS (SELECT series_id, strftime(ds, '%Y-%m') AS month, unnest(['rt', 'da', 'wind_actual']) AS field, unnest([rt, da, wind_actual]) AS value
       FROM (SELECT series_id, ds, CASE WHEN hour(ds) = 5 THEN NULL ELSE rt END AS rt, da, wind_actual FROM market))""",
)
def _(t):
    df = t.stored_market.withColumn("rt", F.when(F.hour("ds") != 5, F.col("rt")))
    return reports.month_audit(df, ["rt", "da", "wind_actual"], ["series_id"])


@query(
    "monthly_policy",
    "series_id:i month:t policy:s reason:s val_delta:d val_full_day_delta:d worst_val_period_delta:d improved_days:i harmed_days:i",
    """SELECT m.series_id, m.month, CASE WHEN v.d3 >= 0.3 AND harmed <= improved AND least(v.d1, v.d2, v.d3) >= -1 AND v.full_d >= -0.3 THEN 'candidate' ELSE 'base' END AS policy,
       CASE WHEN v.d3 IS NULL THEN 'cold_start_no_prior_val_month' WHEN v.d3 >= 0.3 AND harmed <= improved AND least(v.d1, v.d2, v.d3) >= -1 AND v.full_d >= -0.3 THEN 'candidate_passed_val_guardrails' ELSE 'base_kept_due_to_guardrail' END AS reason,
       v.d3 AS val_delta, v.full_d AS val_full_day_delta, least(v.d1, v.d2, v.d3) AS worst_val_period_delta, coalesce(improved, 0) AS improved_days, coalesce(harmed, 0) AS harmed_days
       FROM mo m LEFT JOIN (SELECT mo.*, dd.improved, dd.harmed FROM mo JOIN (
         SELECT series_id, month, count(*) FILTER (c < b) AS improved, count(*) FILTER (c > b) AS harmed FROM (
           SELECT series_id, month, business_day, avg(be) FILTER (stage = 'stage3') AS b, avg(ce) FILTER (stage = 'stage3') AS c FROM hr GROUP BY ALL) GROUP BY ALL) dd
         ON mo.series_id = dd.series_id AND mo.month = dd.month) v ON m.series_id = v.series_id AND m.month = CAST(v.month + INTERVAL 1 MONTH AS DATE)""",
    f"""hr AS (SELECT series_id, business_day, CAST(date_trunc('month', business_day + INTERVAL 15 DAY) AS DATE) AS month,
         CASE period WHEN '1_8' THEN 'stage1' WHEN '9_16' THEN 'stage2' ELSE 'stage3' END AS stage,
         {SMAPE_SQL['row_capped'].format(t='rt', p='da')} AS be, {SMAPE_SQL['row_capped'].format(t='rt', p='(da * 0.5 + 40)')} AS ce FROM market),
       mo AS (SELECT series_id, month, avg(be) - avg(ce) AS full_d, avg(be) FILTER (stage = 'stage1') - avg(ce) FILTER (stage = 'stage1') AS d1,
         avg(be) FILTER (stage = 'stage2') - avg(ce) FILTER (stage = 'stage2') AS d2, avg(be) FILTER (stage = 'stage3') - avg(ce) FILTER (stage = 'stage3') AS d3 FROM hr GROUP BY ALL)""",
)
def _(t):
    m = t.stored_market
    hours = m.select(
        "series_id",
        F.trunc(F.date_add("business_day", 15), "month").alias("month"),
        F.col("business_day").alias("day"),
        F.when(F.col("period") == "1_8", "stage1").when(F.col("period") == "9_16", "stage2").otherwise("stage3").alias("stage"),
        scores.smape_row("row_capped", "rt", "da").alias("base_err"),
        scores.smape_row("row_capped", F.col("rt"), F.col("da") * 0.5 + 40).alias("cand_err"),
    )
    return reports.monthly_policy(hours, ["series_id"])
