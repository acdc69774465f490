"""Normalisation, dedupe, join, source, ledger, intraday and check queries."""

from pyspark.sql import functions as F

from .. import fixed
from ..functions import clock
from ..operators import checks, dedupe, folds, fusion, intraday, joins, ledger, metrics, normalize, plugins, reports
from ..sources import adapters, tables
from .queries_metrics import smape_sql
from .registry import query

S = ["series_id"]
KEY = ["series_id", "ds", "model_name"]


@query(
    "alias_rename",
    "series_id:i ds:t da_price:d rt_price:d wind_forecast:d",
    "SELECT series_id, ds, da AS da_price, rt AS rt_price, wind_forecast FROM market",
)
def _(t):
    raw = t.market.select("series_id", F.col("ds").alias(" Timestamp "), F.col("da").alias("日前电价"), F.col("rt").alias("REALTIME_PRICE"), F.col("wind_forecast").alias("风电总加预测值"))
    return normalize.rename_aliases(raw, fixed.MARKET_ALIASES)


@query(
    "task_words",
    "word:s task:s rows:i",
    """SELECT word, CASE word WHEN 'DA ' THEN 'dayahead' WHEN '实时' THEN 'realtime' WHEN 'RT' THEN 'realtime' WHEN 'dayahead' THEN 'dayahead' END AS task, count(*) AS rows
       FROM (SELECT CASE user_id % 5 WHEN 0 THEN 'DA ' WHEN 1 THEN '实时' WHEN 2 THEN 'RT' WHEN 3 THEN 'dayahead' ELSE 'other' END AS word FROM events) GROUP BY ALL""",
)
def _(t):
    k = F.col("user_id") % 5
    word = F.when(k == 0, "DA ").when(k == 1, "实时").when(k == 2, "RT").when(k == 3, "dayahead").otherwise("other")
    df = t.table("events").select(word.alias("word"))
    return df.groupBy("word", normalize.task_of("word").alias("task")).agg(F.count(F.lit(1)).alias("rows"))


def dirty(t):
    """The panel as text with gaps, as it comes from files."""
    n, h = F.col("n"), F.col("hour_business")
    return t.panel.select(
        "series_id",
        F.when(F.col("task") == "dayahead", "DA").otherwise("实时").alias("task"),
        F.concat(F.lit(" "), F.col("model_name")).alias("model_name"),
        F.col("target_day").cast("string").alias("target_day"),
        F.col("ds").cast("string").alias("ds"),
        F.when(h % 3 == 0, "nan").when(h % 3 == 1, "").otherwise(F.col("period")).alias("period"),
        h.cast("string").alias("hour_business"),
        F.when(n == 4, "nan").otherwise(F.col("y_true").cast("string")).alias("y_true"),
        F.when(n == 3, F.lit("x")).otherwise(F.col("y_pred").cast("string")).alias("y_pred"),
    )


CONTRACT_SPEC = "series_id:i task:s model_name:s target_day:t ds:t period:s hour_business:i y_true:d y_pred:d"


@query("standard_predictions", CONTRACT_SPEC, "SELECT * FROM panel WHERE n NOT IN (3, 4)")
def _(t):
    return normalize.standardise_predictions(dirty(t))[0]


@query(
    "prediction_violations",
    "check_name:s rows:i",
    "SELECT CASE n WHEN 4 THEN 'missing_y_true' ELSE 'missing_y_pred' END AS check_name, count(*) AS rows FROM panel WHERE n IN (3, 4) GROUP BY ALL",
)
def _(t):
    return normalize.standardise_predictions(dirty(t))[1].groupBy("check_name").agg(F.count(F.lit(1)).alias("rows"))


@query("normalised_oof", CONTRACT_SPEC + " business_day:t", "SELECT * FROM panel WHERE n NOT IN (3, 4)")
def _(t):
    return normalize.normalise_oof(dirty(t).drop("hour_business", "period"))


@query("normalised_forecast", "series_id:i task:s model_name:s ds:t period:s hour_business:i y_pred:d", "SELECT series_id, task, model_name, ds, period, hour_business, CASE WHEN n = 3 THEN NULL ELSE y_pred END AS y_pred FROM panel")
def _(t):
    return normalize.normalise_forecast(dirty(t).drop("y_true", "hour_business"))


@query(
    "fold_stamped_table",
    "task:s model_name:s fold_id:i train_end:s business_day:t hour_business:i period:s y_true:d y_pred:d",
    "SELECT 'realtime' AS task, 'm1' AS model_name, 3 AS fold_id, '2023-12-31' AS train_end, business_day, hour_business, period, y_true, y_pred FROM panel WHERE model_name = 'view'",
)
def _(t):
    raw = t.panel.where("model_name = 'view'").select(F.col("ds").alias("时刻"), F.col("y_true").alias("actual"), F.col("y_pred").alias("prediction"))
    return normalize.stamp_fold(raw, "realtime", "m1", {"fold_id": 3, "train_start": "2023-07-01", "train_end": "2023-12-31", "test_start": "2024-01-01", "test_end": "2024-01-31"})


@query(
    "normalised_tap",
    "series_id:i model_name:s business_day:t ds:t horizon_day:i age_days:i tap_source:s source_confidence:d cutoff_date:s",
    """SELECT series_id, model_name, business_day, ds, least(greatest(CAST(ds AS DATE) - (CASE WHEN business_day <= DATE '2024-01-15' THEN DATE '2024-01-13' ELSE DATE '2024-01-16' END) + 1, 1), 3) AS horizon_day,
       DATE '2024-01-31' - CAST(ds AS DATE) AS age_days, 'rolling_cutoff' AS tap_source, 1.0 AS source_confidence, '2024-01-12' AS cutoff_date FROM panel""",
)
def _(t):
    raw = t.panel.select("series_id", "task", "model_name", "ds", F.col("y_pred").alias("pred"), F.when(F.col("business_day") <= F.lit("2024-01-15").cast("date"), "2024-01-13").otherwise("2024-01-16").alias("test_start"), F.lit("2024-01-12").alias("train_end"))
    return normalize.normalise_tap(raw, predict_date="2024-01-31", series=S)


def external(t):
    return t.stored_panel.select(
        "series_id", "model_name", F.col("target_day"), F.when(F.col("hour_business") == 24, 0).otherwise(F.col("hour_business")).alias("hour_business"), "ds",
        F.col("y_pred").cast("string").alias("y_pred"), F.when(F.col("n") > 5, "DA").when(F.col("n") > 4, "bad").otherwise("rt").alias("prediction_mode"),
        F.when(F.col("n") == 6, "no").otherwise(" TRUE").alias("leakage_safe"),
    )


@query(
    "external_standardised",
    "series_id:i model_name:s business_day:t hour_business:i timestamp:t period:s y_pred:d prediction_mode:s leakage_safe:s source_file:s",
    "SELECT series_id, model_name, business_day, hour_business, ds AS timestamp, period, y_pred, CASE WHEN n > 5 THEN 'dayahead' WHEN n > 4 THEN NULL ELSE 'realtime' END AS prediction_mode, CASE WHEN n = 6 THEN 'no' ELSE 'true' END AS leakage_safe, 'f1' AS source_file FROM panel",
)
def _(t):
    return adapters.external_predictions(external(t), source_file="f1")


@query(
    "external_violations",
    "check_name:s rows:i",
    "SELECT 'leakage_unsafe' AS check_name, count(*) AS rows FROM panel WHERE n = 6 HAVING count(*) > 0 UNION ALL SELECT 'bad_prediction_mode', count(*) FROM panel WHERE n = 5 HAVING count(*) > 0 UNION ALL SELECT 'duplicate_key', count(*) FROM panel WHERE model_name = 'view' AND hour_business = 3 HAVING count(*) > 0",
)
def _(t):
    df = adapters.external_predictions(external(t), source_file="f1")
    df = df.unionByName(df.where("model_name = 'view' AND hour_business = 3").withColumns({"leakage_safe": F.lit("true"), "prediction_mode": F.lit("realtime")}))
    return normalize.external_violations(df, series=S).groupBy("check_name").agg(F.count(F.lit(1)).alias("rows"))


def intraday_raw(t):
    """Corrections derived from click events: several cutoffs per (day, hour)."""
    return t.events.where("model_name = 'click'").select(
        "series_id", "event_id", *[c.alias(n) for c, n in zip(clock.business_clock("ds"), ("business_day", "target_hour"))],
        (F.col("user_id") % 5 + 10).alias("cutoff_hour"), (F.col("cents") / 10000.0).alias("intraday_confidence"),
        (F.col("cents") % 7 / 20.0).alias("fusion_weight"), (F.col("cents") / 50.0).alias("intraday_corrected_pred"),
        (F.col("event_id") % 6).alias("n_observed"), (F.col("cents") % 300).cast("double").alias("residual_std_today"),
        F.when(F.col("event_id") % 4 == 0, "LOW_WEIGHT").when(F.col("event_id") % 4 == 1, "SHADOW_ONLY").when(F.col("event_id") % 9 == 2, "DISABLED").otherwise("HIGH_WEIGHT").alias("policy_decision"),
        F.when(F.col("event_id") % 11 == 0, "FULL_DAY").otherwise("INTRADAY").alias("mode"),
        F.when(F.col("event_id") % 5 == 0, "cap").otherwise("").alias("guardrail_reason"),
    )


INTRA = """ir AS (SELECT series_id, event_id, CASE WHEN hour(ds) = 0 THEN CAST(ds AS DATE) - 1 ELSE CAST(ds AS DATE) END AS business_day, CASE WHEN hour(ds) = 0 THEN 24 ELSE hour(ds) END AS target_hour,
  user_id % 5 + 10 AS cutoff_hour, cents / 10000.0::DOUBLE AS conf, cents % 7 / 20.0::DOUBLE AS fw, cents / 50.0::DOUBLE AS cp, event_id % 6 AS nobs, CAST(cents % 300 AS DOUBLE) AS rs,
  CASE WHEN event_id % 4 = 0 THEN 'LOW_WEIGHT' WHEN event_id % 4 = 1 THEN 'SHADOW_ONLY' WHEN event_id % 9 = 2 THEN 'DISABLED' ELSE 'HIGH_WEIGHT' END AS pd, CASE WHEN event_id % 11 = 0 THEN 'FULL_DAY' ELSE 'INTRADAY' END AS mode,
  CASE WHEN event_id % 5 = 0 THEN 'cap' ELSE '' END AS gr FROM ev WHERE model_name = 'click'),
dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, business_day, target_hour ORDER BY cutoff_hour DESC, event_id DESC) AS r FROM ir) WHERE r = 1),
gt AS (SELECT *, CASE WHEN z THEN 0 ELSE least(greatest(CASE WHEN dec = 'LOW_WEIGHT' THEN least(fw, 0.12) ELSE fw END, 0), 0.25) END AS w FROM (SELECT *, 
  CASE WHEN off OR pd = 'DISABLED' THEN 'DISABLED' WHEN cutoff_hour < 12 OR (wt AND (conf < 0.35 OR rs > 180)) THEN 'SHADOW_ONLY' WHEN pd = 'HIGH_WEIGHT' AND (cutoff_hour < 14 OR conf < 0.55) THEN 'LOW_WEIGHT' ELSE pd END AS dec,
  off OR (pd != 'DISABLED' AND (cutoff_hour < 12 OR (wt AND (conf < 0.35 OR rs > 180)))) AS z FROM (SELECT *, mode != 'INTRADAY' OR nobs < 3 AS off, pd IN ('LOW_WEIGHT', 'HIGH_WEIGHT') AS wt FROM dk)))"""


def intraday_pack(t):
    raw = intraday_raw(t)
    kept = dedupe.keep_one(raw, ["series_id", "business_day", "target_hour"], ["cutoff_hour", "event_id"], last=True)
    return normalize.normalise_intraday_pack(kept, "pack", S)


@query(
    "intraday_pack_normalised",
    "series_id:i business_day:t target_hour:i hour_business:i cutoff_hour:i intraday_confidence:d fusion_weight:d policy_decision:s mode:s bias_direction:s shadow_only_flag:b source_pack_path:s",
    "SELECT series_id, business_day, target_hour, target_hour AS hour_business, cutoff_hour, conf AS intraday_confidence, fw AS fusion_weight, pd AS policy_decision, mode, '' AS bias_direction, false AS shadow_only_flag, 'pack' AS source_pack_path FROM dk",
    INTRA,
)
def _(t):
    return intraday_pack(t)


@query(
    "intraday_latest_cutoff",
    "series_id:i rows_in:i rows_kept:i removed:i",
    "SELECT series_id, count(*) AS rows_in, count(DISTINCT (business_day, target_hour)) AS rows_kept, count(*) - count(DISTINCT (business_day, target_hour)) AS removed FROM ir GROUP BY ALL",
    INTRA,
)
def _(t):
    return dedupe.removed_counts(intraday_raw(t), ["series_id", "business_day", "target_hour"], S)


@query("intraday_gate", "series_id:i business_day:t target_hour:i policy_decision:s fusion_weight:d", "SELECT series_id, business_day, target_hour, dec AS policy_decision, w AS fusion_weight FROM gt", INTRA)
def _(t):
    return intraday.gate(intraday_pack(t))


@query(
    "intraday_checks",
    "series_id:i check_name:s severity:s bad_rows:i passed:b",
    """SELECT series_id, check_name, severity, bad_rows, bad_rows = 0 AS passed FROM (SELECT series_id, unnest(['mode_intraday', 'target_after_cutoff', 'cutoff_below_10', 'cutoff_10_11_not_shadow', 'fusion_weight_range', 'confidence_range', 'no_truth_online', 'unique_key']) AS check_name,
       unnest(['error', 'error', 'warning', 'warning', 'error', 'error', 'error', 'error']) AS severity, unnest([a, b, 0, c, d, e, 0, 0]) AS bad_rows FROM (SELECT series_id, count(*) FILTER (mode != 'INTRADAY') AS a, count(*) FILTER (target_hour <= cutoff_hour) AS b,
       count(*) FILTER (cutoff_hour BETWEEN 10 AND 11 AND pd NOT IN ('SHADOW_ONLY', 'DISABLED')) AS c, count(*) FILTER (fw NOT BETWEEN 0 AND 0.3) AS d, count(*) FILTER (conf NOT BETWEEN 0 AND 1) AS e FROM dk GROUP BY ALL))""",
    INTRA,
)
def _(t):
    return intraday.pack_checks(intraday_pack(t), by=S)


def applied(t, mode):
    base = t.market.select("series_id", "business_day", "hour_business", "ds", F.col("da").alias("rt_pred"), F.col("da").alias("y_fused"))
    return intraday.apply_pack(base, intraday_pack(t), mode, series=S)


@query(
    "intraday_applied",
    "series_id:i ds:t intraday_available:b intraday_applied:b intraday_policy_decision:s intraday_fusion_weight:d rt_pred:d y_fused_before_intraday:d y_fused_after_intraday:d intraday_shadow_delta:d intraday_updated_columns:s",
    """SELECT *, CASE WHEN intraday_applied THEN 'rt_pred,y_fused' ELSE '' END AS intraday_updated_columns, rt_pred AS y_fused_after_intraday FROM (SELECT m.series_id, m.ds, g.cp IS NOT NULL AS intraday_available, coalesce(dec NOT IN ('DISABLED', 'SHADOW_ONLY'), false) AS intraday_applied, coalesce(dec, 'DISABLED') AS intraday_policy_decision,
       coalesce(w, 0) AS intraday_fusion_weight, CASE WHEN dec NOT IN ('DISABLED', 'SHADOW_ONLY') THEN (1 - w) * da + w * cp ELSE da END AS rt_pred, da AS y_fused_before_intraday, cp - da AS intraday_shadow_delta
       FROM market m LEFT JOIN gt g ON m.series_id = g.series_id AND m.business_day = g.business_day AND m.hour_business = g.target_hour)""",
    INTRA,
)
def _(t):
    return applied(t, "low_weight")


@query(
    "intraday_stats",
    "series_id:i mode:s matched_rows:i applied_rows:i shadow_rows:i disabled_rows:i avg_fusion_weight:d avg_confidence:d",
    """SELECT series_id, 'low_weight' AS mode, count(cp) AS matched_rows, count(*) FILTER (dec NOT IN ('DISABLED', 'SHADOW_ONLY')) AS applied_rows, count(*) FILTER (dec = 'SHADOW_ONLY') AS shadow_rows, count(*) FILTER (cp IS NULL OR dec = 'DISABLED') AS disabled_rows,
       avg(w) AS avg_fusion_weight, avg(conf) AS avg_confidence FROM (SELECT m.series_id, g.* EXCLUDE (series_id) FROM market m LEFT JOIN gt g ON m.series_id = g.series_id AND m.business_day = g.business_day AND m.hour_business = g.target_hour) GROUP BY ALL
       UNION ALL SELECT m.series_id, 'shadow', count(cp), 0, count(cp), count(*) - count(cp), avg(w), avg(conf) FROM market m LEFT JOIN gt g ON m.series_id = g.series_id AND m.business_day = g.business_day AND m.hour_business = g.target_hour GROUP BY ALL""",
    INTRA,
)
def _(t):
    out = None
    for mode in ("low_weight", "shadow"):
        one = intraday.apply_stats(applied(t, mode), mode, S).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "intraday_cutoff_metrics",
    "series_id:i cutoff_hour:s rows:i smape:d",
    f"""SELECT m.series_id, coalesce(CAST(cutoff_hour AS VARCHAR), 'overall') AS cutoff_hour, count(*) AS rows, {smape_sql('denom_absfloor', 'rt', 'da')} AS smape FROM market m JOIN dk g ON m.series_id = g.series_id AND m.business_day = g.business_day AND m.hour_business = g.target_hour
       GROUP BY GROUPING SETS ((m.series_id, cutoff_hour), (m.series_id))""",
    INTRA,
)
def _(t):
    from ..functions import scores

    pack = intraday_pack(t).select("series_id", "business_day", "hour_business", "cutoff_hour")
    j = t.market.join(pack, ["series_id", "business_day", "hour_business"])
    return metrics.with_overall(j, S, "cutoff_hour", {"rows": F.count(F.lit(1)), "smape": scores.smape("denom_absfloor", "rt", "da")})


@query(
    "feature_selection",
    "feature:s family:s varied:b",
    "SELECT f AS feature, fam AS family, v AS varied FROM (VALUES ('high_spike_prob', 'calendar', true), ('load_forecast', 'calendar', true), ('wind_forecast', 'calendar', true), ('da_flat', 'price', false)) x(f, fam, v)",
)
def _(t):
    m = normalize.drop_leaking_columns(t.market).withColumn("da_flat", F.lit(1.0))
    cols = ["high_spike_prob", "load_forecast", "wind_forecast", "da_flat"]
    fam = dict(normalize.feature_manifest(cols))
    names = F.create_map(*[F.lit(x) for kv in fam.items() for x in kv])
    return normalize.informative_columns(m, cols).withColumn("family", names[F.col("feature")])


@query(
    "range_filters",
    "kind:s rows:i",
    """SELECT 'between' AS kind, count(*) AS rows FROM market WHERE ds BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 12:00:00'
       UNION ALL SELECT 'months', count(*) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-03-01' UNION ALL SELECT 'midday', count(*) FROM market WHERE period = '9_16'""",
)
def _(t):
    a = normalize.between_times(t.stored_market, "2024-01-05 00:00:00", "2024-01-07 12:00:00").agg(F.lit("between").alias("kind"), F.count(F.lit(1)).alias("rows"))
    b = normalize.months_back(t.table("orders"), "1998-03-01 00:00:00", 2, "o_orderdate").agg(F.lit("months").alias("kind"), F.count(F.lit(1)).alias("rows"))
    c = t.stored_market.where(F.col("period") == "9_16").agg(F.lit("midday").alias("kind"), F.count(F.lit(1)).alias("rows"))
    return a.unionByName(b).unionByName(c)


@query(
    "month_chunks",
    "month_start:t month_end:t chunk_start:t chunk_end:t orders:i",
    """SELECT m AS month_start, last_day(m) AS month_end, CAST(c AS DATE) AS chunk_start, least(CAST(c AS DATE) + 9, last_day(m)) AS chunk_end, n AS orders FROM (SELECT m, n, unnest(generate_series(CAST(m AS TIMESTAMP), CAST(last_day(m) AS TIMESTAMP), INTERVAL 10 DAY)) AS c FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY ALL))""",
)
def _(t):
    a, b = normalize.month_bounds(F.to_date("o_orderdate"))
    g = t.table("orders").groupBy(a.alias("month_start"), b.alias("month_end")).agg(F.count(F.lit(1)).alias("orders"))
    return g.select("month_start", "month_end", "orders", F.explode(normalize.day_chunks("month_start", "month_end", 10)).alias("c")).select("*", "c.*")


@query(
    "first_and_last_per_key",
    "series_id:i hour_business:i first_model:s last_model:s",
    "SELECT series_id, hour_business, arg_min(model_name, (ds, model_name)) AS first_model, arg_max(model_name, (ds, model_name)) AS last_model FROM panel GROUP BY ALL",
)
def _(t):
    p = t.stored_panel.select("series_id", "hour_business", "ds", "model_name")
    a = dedupe.keep_one(p, ["series_id", "hour_business"], ["ds", "model_name"]).select("series_id", "hour_business", F.col("model_name").alias("first_model"))
    b = dedupe.keep_one(p, ["series_id", "hour_business"], ["ds", "model_name"], last=True).select("series_id", "hour_business", F.col("model_name").alias("last_model"))
    return a.join(b, ["series_id", "hour_business"])


LED = """lg0 AS (SELECT series_id, business_day AS forecast_date, hour_business, task AS target, model_name, y_pred, n FROM panel)"""


def ledger_rows(t):
    return t.stored_panel.select("series_id", F.col("business_day").alias("run_date"), F.col("business_day").alias("forecast_date"), "hour_business", F.col("task").alias("target"), "model_name", "y_pred", "n", "ds", "period")


@query(
    "ledger_append",
    "mode:s series_id:i rows:i y_sum:d",
    """SELECT 'skip' AS mode, series_id, count(*) AS rows, sum(y_pred) AS y_sum FROM lg0 GROUP BY ALL
       UNION ALL SELECT 'force', series_id, count(*), sum(CASE WHEN forecast_date >= DATE '2024-01-10' THEN y_pred + 1 ELSE y_pred END) FROM lg0 GROUP BY ALL""",
    LED,
)
def _(t):
    rows = ledger_rows(t)
    key = ["series_id", *fixed.LEDGER_KEY]
    cut = F.lit("2024-01-20").cast("date")
    old = rows.where(F.col("forecast_date") < cut)
    new = rows.where(F.col("forecast_date") >= F.lit("2024-01-10").cast("date"))
    out = None
    for mode, force in (("skip", False), ("force", True)):
        batch = new.withColumn("y_pred", F.col("y_pred") + 1) if force else new
        done = ledger.append_rows(old, batch, force, key)
        g = done.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("y_pred").alias("y_sum")).withColumn("mode", F.lit(mode))
        out = g if out is None else out.unionByName(g)
    return out


@query(
    "ledger_rows",
    "series_id:i forecast_date:t hour_business:i timestamp:t model_name:s y_pred:d base_fused_pred:d spike_corrected_pred:d final_pred:d period:s target:s",
    """SELECT h.series_id, h.business_day AS forecast_date, h.hour_business, h.ds AS timestamp, m.model_name, p.y_pred, f.fu AS base_fused_pred, CASE WHEN h.period = '9_16' THEN h.da END AS spike_corrected_pred, h.da AS final_pred, h.period, 'realtime' AS target
       FROM market h JOIN (SELECT DISTINCT series_id, model_name FROM panel) m ON h.series_id = m.series_id LEFT JOIN panel p ON p.series_id = h.series_id AND p.ds = h.ds AND p.model_name = m.model_name
       LEFT JOIN (SELECT series_id, ds, avg(y_pred) AS fu FROM panel GROUP BY ALL) f ON f.series_id = h.series_id AND f.ds = h.ds""",
)
def _(t):
    p, m = t.stored_panel, t.stored_market
    fused = p.groupBy("series_id", "business_day", "hour_business").agg(F.avg("y_pred").alias("y_fused"))
    final = m.select("series_id", "business_day", "hour_business", F.col("da").alias("final_pred"))
    corrected = m.where("period = '9_16'").select("series_id", "business_day", "hour_business", F.col("da").alias("y_fused_corrected"))
    return ledger.build_rows("realtime", "2024-01-31", p, fused, final, corrected, series=S)


@query(
    "ledger_quality",
    "series_id:i target:s check_name:s bad_rows:i",
    """SELECT series_id, target, unnest(['days_not_24_rows', 'duplicate_key', 'null_y_pred', 'hour24_timestamp', 'hour_out_of_range']) AS check_name, unnest([a, 0, b, c, 0]) AS bad_rows FROM (SELECT series_id, task AS target, sum(CAST(k != 24 AS INT)) AS a, sum(b) AS b, sum(c) AS c FROM (
       SELECT series_id, task, business_day, model_name, count(*) AS k, count(*) FILTER (n = 3) AS b, count(*) FILTER (hour_business = 24 AND n = 2) AS c FROM panel GROUP BY ALL) GROUP BY ALL)""",
)
def _(t):
    df = ledger_rows(t).withColumn("timestamp", F.when(F.col("n") == 2, F.to_date("ds").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(5))).otherwise(F.col("ds")))
    df = df.withColumns({"y_pred": F.when(F.col("n") != 3, F.col("y_pred")), "final_pred": F.lit(1.0), "pipeline_version": F.lit("v"), "created_at": F.lit("now")})
    q = ledger.quality(df, ["series_id", "target"])
    return q.where(F.col("check_name").isin("days_not_24_rows", "duplicate_key", "null_y_pred", "hour24_timestamp", "hour_out_of_range"))


@query(
    "ledger_missing_models",
    "target:s forecast_date:t model_name:s",
    "SELECT d.task AS target, d.business_day AS forecast_date, m AS model_name FROM (SELECT DISTINCT task, business_day FROM panel) d, (VALUES ('view'), ('other')) v(m) WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.task = d.task AND p.business_day = d.business_day AND p.model_name = m)",
)
def _(t):
    return ledger.missing_models(ledger_rows(t), ["view", "other"])


@query(
    "cache_merge",
    "series_id:i ds:t p:d",
    "SELECT series_id, ds, CASE WHEN ds >= TIMESTAMP '2024-01-10' THEN high_spike_prob + 1 ELSE high_spike_prob END AS p FROM market",
)
def _(t):
    m = t.stored_market.select("series_id", "ds", F.col("high_spike_prob").alias("p"))
    old = m.where(F.col("ds") < F.lit("2024-01-20").cast("timestamp_ntz"))
    new = m.where(F.col("ds") >= F.lit("2024-01-10").cast("timestamp_ntz")).withColumn("p", F.col("p") + 1)
    return dedupe.merge_cache(old, new, ["series_id", "ds"])


@query(
    "cache_missing_hours",
    "series_id:i ds:t",
    "SELECT s.series_id, h AS ds FROM (SELECT DISTINCT series_id FROM market) s, (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-20', INTERVAL 1 HOUR)) AS h) g WHERE NOT EXISTS (SELECT 1 FROM market m WHERE m.series_id = s.series_id AND m.ds = h)",
)
def _(t):
    return dedupe.missing_hours(t.stored_market, S, "2024-01-02 00:00:00", "2024-01-20 00:00:00")


@query(
    "truth_frame",
    "series_id:i task:s ds:t target_day:t period:s hour_business:i y_true:d",
    "SELECT series_id, unnest(['dayahead', 'realtime']) AS task, ds, business_day AS target_day, period, hour_business, unnest([da, rt]) AS y_true FROM market",
)
def _(t):
    return joins.truth_frame(t.market, {"dayahead": "da", "realtime": "rt"}, S)


@query(
    "truth_overwritten",
    "series_id:i ds:t model_name:s y_true:d",
    "SELECT p.series_id, p.ds, model_name, CASE WHEN task = 'dayahead' THEN da ELSE rt END AS y_true FROM panel p JOIN market m ON p.series_id = m.series_id AND p.ds = m.ds",
)
def _(t):
    return joins.overwrite_truth(t.stored_panel, joins.truth_frame(t.stored_market, {"dayahead": "da", "realtime": "rt"}, S), S)


@query(
    "truth_filled",
    "series_id:i model_name:s rows:i with_truth:i coverage:d passed:b y_sum:d",
    """SELECT p.series_id, model_name, count(*) AS rows, count(coalesce(y, rt)) AS with_truth, count(coalesce(y, rt)) / count(*) AS coverage, count(coalesce(y, rt)) / count(*) >= 0.95 AS passed, sum(coalesce(y, rt)) AS y_sum
       FROM (SELECT *, CASE WHEN n > 1 THEN y_true END AS y FROM panel) p LEFT JOIN market m ON p.series_id = m.series_id AND p.ds = m.ds AND m.hour_business NOT IN (3, 4) GROUP BY ALL""",
)
def _(t):
    pred = t.stored_panel.withColumn("y_true", F.when(F.col("n") > 1, F.col("y_true")))
    truth = t.stored_market.where(~F.col("hour_business").isin(3, 4)).select("series_id", "business_day", "hour_business", F.col("rt").alias("y_true"))
    filled = joins.fill_truth(pred, truth, ["series_id", "business_day", "hour_business"])
    sums = filled.groupBy("series_id", "model_name").agg(F.sum("y_true").alias("y_sum"))
    return joins.truth_coverage(filled, ["series_id", "model_name"]).join(sums, ["series_id", "model_name"])


@query(
    "extras_attached",
    "series_id:i ds:t model_name:s period:s period_right:s high_spike_prob:d",
    "SELECT p.series_id, p.ds, model_name, p.period, m.period AS period_right, high_spike_prob FROM panel p LEFT JOIN (SELECT * FROM market WHERE hour_business < 20) m ON p.series_id = m.series_id AND p.ds = m.ds",
)
def _(t):
    side = t.stored_market.where("hour_business < 20").select("series_id", "ds", "period", "high_spike_prob")
    return joins.attach(t.stored_panel.select("series_id", "ds", "model_name", "period"), side, ["series_id", "ds"])


@query(
    "price_pair_join",
    "series_id:i ds:t y_pred_da:d y_pred_rt:d",
    "SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.ds, b.ds) AS ds, a.y_pred AS y_pred_da, b.y_pred AS y_pred_rt FROM (SELECT * FROM panel WHERE model_name = 'view') a FULL JOIN (SELECT * FROM panel WHERE model_name = 'click') b ON a.series_id = b.series_id AND a.ds = b.ds",
)
def _(t):
    p = t.stored_panel
    return joins.price_pair(p.where("model_name = 'view'"), p.where("model_name = 'click'"), ["series_id", "ds"], ["y_pred"], "full")


@query(
    "classifier_merge",
    "series_id:i ds:t y_fused_corrected:d",
    "SELECT series_id, ds, CASE WHEN high_spike_prob < 0.05 AND da <= 100 THEN -80 ELSE da END AS y_fused_corrected FROM market",
)
def _(t):
    m = t.stored_market
    clf = m.where("hour_business > 0").select("series_id", "ds", F.when(F.col("high_spike_prob") < 0.05, 1).otherwise(0).alias("final_pred"))
    return joins.merge_classifier(m.select("series_id", "ds", F.col("da").alias("y_fused")), clf, ["series_id", "ds"])


@query(
    "key_alignment",
    "series_id:i status:s keys:i aligned:i",
    """SELECT series_id, status, count(*) AS keys, any_value(al) AS aligned FROM (SELECT coalesce(a.series_id, b.series_id) AS series_id, CASE WHEN a.ds IS NULL THEN 'extra' WHEN b.ds IS NULL THEN 'missing' ELSE 'matched' END AS status FROM
       (SELECT DISTINCT series_id, ds FROM panel WHERE model_name = 'view') a FULL JOIN (SELECT DISTINCT series_id, ds FROM panel WHERE model_name = 'click') b ON a.series_id = b.series_id AND a.ds = b.ds) x
       JOIN (SELECT p.series_id AS sid, count(*) AS al FROM panel p JOIN (SELECT series_id, ds FROM panel WHERE model_name = 'view') v ON p.series_id = v.series_id AND p.ds = v.ds WHERE model_name = 'click' GROUP BY ALL) y ON x.series_id = y.sid GROUP BY ALL""",
)
def _(t):
    p = t.stored_panel
    a, b = p.where("model_name = 'view'"), p.where("model_name = 'click'")
    g = joins.key_sides(a, b, ["series_id", "ds"]).groupBy("series_id", "status").agg(F.count(F.lit(1)).alias("keys"))
    al = joins.align_pack(a, b, ["series_id", "ds"]).groupBy("series_id").agg(F.count(F.lit(1)).alias("aligned"))
    return g.join(al, "series_id")


@query(
    "external_injection",
    "series_id:i ds:t da:d",
    "SELECT m.series_id, m.ds, CASE WHEN p.y_pred IS NOT NULL AND m.ds > TIMESTAMP '2024-01-15 10:00:00' THEN p.y_pred ELSE da END AS da FROM market m LEFT JOIN (SELECT * FROM panel WHERE model_name = 'view') p ON m.series_id = p.series_id AND m.ds = p.ds",
)
def _(t):
    ext = t.stored_panel.where("model_name = 'view'").select("series_id", "ds", "y_pred")
    return joins.inject(t.stored_market, ext, ["series_id", "ds"], "da", F.col("ds") > F.lit("2024-01-15 10:00:00").cast("timestamp_ntz"))


@query(
    "lag_blend_baseline",
    "series_id:i ds:t blend:d",
    """SELECT m.series_id, m.ds, coalesce((coalesce(0.6 * a.rt, 0) + coalesce(0.25 * b.rt, 0) + coalesce(0.15 * c.rt, 0)) / nullif(CASE WHEN a.rt IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b.rt IS NULL THEN 0 ELSE 0.25 END + CASE WHEN c.rt IS NULL THEN 0 ELSE 0.15 END, 0), m.da) AS blend FROM market m
       LEFT JOIN market a ON a.series_id = m.series_id AND a.ds = m.ds - INTERVAL 1 DAY LEFT JOIN market b ON b.series_id = m.series_id AND b.ds = m.ds - INTERVAL 7 DAY LEFT JOIN market c ON c.series_id = m.series_id AND c.ds = m.ds - INTERVAL 14 DAY""",
)
def _(t):
    return joins.lag_blend(t.stored_market, S, "rt", {1: 0.60, 7: 0.25, 14: 0.15}, fallback="da")


@query(
    "evaluation_join",
    "series_id:i rows:i smape_raw:d smape_clip:d mae:d",
    f"SELECT p.series_id, count(*) AS rows, {smape_sql('eval_raw', 'm.rt', 'p.y_pred')} AS smape_raw, {smape_sql('eval_clip50', 'm.rt', 'p.y_pred')} AS smape_clip, avg(abs(m.rt - p.y_pred)) AS mae FROM panel p JOIN market m ON p.series_id = m.series_id AND p.ds = m.ds GROUP BY ALL",
)
def _(t):
    from ..functions import scores

    pred = tables.ensure_prediction_frame(t.stored_panel.select("series_id", F.col("ds").alias("timestamp"), F.col("y_pred").alias("prediction")))
    j = pred.join(t.stored_market.select("series_id", "ds", "rt"), ["series_id", "ds"])
    return j.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), scores.smape("eval_raw", "rt", "y_pred").alias("smape_raw"), scores.smape("eval_clip50", "rt", "y_pred").alias("smape_clip"), scores.mae("rt", "y_pred").alias("mae")
    )


@query(
    "calendar_dimension",
    "series_id:i ds:t weekday:i is_weekend:i holiday:i term:s",
    """SELECT m.series_id, m.ds, isodow(business_day) - 1 AS weekday, CAST(isodow(business_day) >= 6 AS INT) AS is_weekend, holiday, term FROM market m LEFT JOIN (
       SELECT d, CAST(n > 300 AS INT) AS holiday, last_value(CASE WHEN day(d) % 7 = 1 THEN 'term' || day(d) END IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS term FROM (SELECT business_day AS d, count(*) AS n FROM panel GROUP BY ALL)) c ON c.d = m.business_day""",
)
def _(t):
    cal = t.stored_panel.groupBy("business_day").agg(F.count(F.lit(1)).alias("n"))
    d = F.dayofmonth("business_day")
    cal = cal.select("business_day", (F.col("n") > 300).cast("int").alias("holiday"), F.when(d % 7 == 1, F.concat(F.lit("term"), d.cast("string"))).alias("term"))
    return joins.calendar_days(t.stored_market, cal, carry=["term"])


@query(
    "submission_table",
    "series_id:i ds:t dayahead_pred:d realtime_pred:d y_fused_corrected:d",
    """SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.ds, b.ds) AS ds, a.y_pred AS dayahead_pred, b.y_pred AS realtime_pred, m.da AS y_fused_corrected FROM (SELECT * FROM panel WHERE model_name = 'view') a
       FULL JOIN (SELECT * FROM panel WHERE model_name = 'click') b ON a.series_id = b.series_id AND a.ds = b.ds LEFT JOIN (SELECT * FROM market WHERE period = '9_16') m ON m.series_id = coalesce(a.series_id, b.series_id) AND m.ds = coalesce(a.ds, b.ds)""",
)
def _(t):
    p = t.stored_panel.withColumnRenamed("y_pred", "y_fused")
    corr = t.stored_market.where("period = '9_16'").select("series_id", "ds", F.col("da").alias("y_fused_corrected"))
    return joins.submission(p.where("model_name = 'view'"), p.where("model_name = 'click'"), corr, ["series_id", "ds"])


@query(
    "market_loaded",
    "series_id:i ds:t da_price:d rt_price:d wind_forecast:d",
    """SELECT series_id, ds, da AS da_price, rt AS rt_price, coalesce(last_value(CASE WHEN hour_business % 4 != 0 THEN wind_forecast END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS wind_forecast FROM market""",
)
def _(t):
    m = t.market
    raw = m.select("series_id", F.col("ds").cast("string").alias("时刻"), F.col("da").cast("string").alias("日前电价"), F.col("rt").cast("string").alias("实时电价"), F.when(F.col("hour_business") % 4 == 0, "nan").otherwise(F.col("wind_forecast").cast("string")).alias("风电总加预测值"))
    twice = raw.unionByName(raw.where(F.length("日前电价") % 2 == 0))
    return tables.load_market(twice, ["wind_forecast"], S, ["ds", "da_price", "rt_price"])


@query(
    "adapted_predictions",
    "series_id:i model_name:s task:s target_day:t ds:t period:s hour_business:i y_true:d y_pred:d",
    """SELECT series_id, 'boosted_trees' AS model_name, 'realtime' AS task, business_day AS target_day, ds, period, hour_business, rt AS y_true, da AS y_pred FROM market
       UNION ALL SELECT series_id, 'spike_net', 'dayahead', business_day, ds, period, hour_business, da, rt FROM market
       UNION ALL SELECT series_id, 'delta_net', 'realtime', business_day, ds, period, hour_business, rt, da + 1 FROM market
       UNION ALL SELECT series_id, 'mixer', 'realtime', business_day, ds, period, hour_business, rt, da + 2 FROM market WHERE hour_business < 20
       UNION ALL SELECT series_id, 'zero_shot', 'realtime', business_day, ds, period, hour_business, rt, da + 3 FROM market""",
)
def _(t):
    m = t.stored_market
    day, hour = F.col("business_day"), F.col("hour_business")
    truth = joins.truth_frame(m, {"dayahead": "da", "realtime": "rt"}, S)
    raw = {
        "boosted_trees": (m.select("series_id", "ds", hour.alias("hour"), day.alias("target_day"), F.col("rt").alias("y"), F.col("da").alias("pred_y")), "realtime"),
        "spike_net": (m.select("series_id", F.col("ds").alias("时刻"), F.col("da").alias("日前电价"), F.col("rt").alias("预测日前电价")), "dayahead"),
        "delta_net": (m.select("series_id", F.col("ds").alias("timestamp"), day.alias("target_day"), F.col("rt").alias("rt_actual"), (F.col("da") + 1).alias("rt_hat")), "realtime"),
        "mixer": (m.select("series_id", day.alias("target_day"), hour, F.to_date("ds").cast("timestamp_ntz").alias("ds"), (hour < 20).alias("official_test"), F.lit(False).alias("test_window_complete"), F.col("rt").alias("realtime_price"), (F.col("da") + 2).alias("pred_realtime_price")), "realtime"),
        "zero_shot": (m.select("series_id", F.col("ds").alias("时刻"), (F.col("da") + 3).alias("预测值")), "realtime"),
    }
    return adapters.union_manifest([adapters.adapt(df, adapters.SPECS[n], task, truth, S) for n, (df, task) in raw.items()])


@query(
    "source_columns",
    "series_id:i ds:t 日前电价:d 风电总加预测值:d",
    "SELECT series_id, ds, da AS 日前电价, wind_forecast AS 风电总加预测值 FROM market",
)
def _(t):
    t.market.createOrReplaceTempView("hourpanel_market_source")
    return tables.read_database(t.spark, "hourpanel_market_source", {"series_id": "series_id", "ds": "ds", "da": "日前电价", "wind_forecast": "风电总加预测值"})


@query(
    "coverage_and_gaps",
    "l_returnflag:s rows:i days:i complete_days:i first_day:t last_day:t gaps:i",
    """SELECT *, 31 - (SELECT count(DISTINCT CAST(l_shipdate AS DATE)) FROM lineitem l WHERE l.l_returnflag = x.l_returnflag AND CAST(l_shipdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-31') AS gaps FROM (
       SELECT l_returnflag, sum(n) AS rows, count(*) AS days, count(*) FILTER (n >= 24) AS complete_days, min(d) AS first_day, max(d) AS last_day FROM (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL) x""",
)
def _(t):
    df = t.table("lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("business_day"))
    gaps = tables.coverage_gaps(df, ["l_returnflag"], "1998-03-01", "1998-03-31").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("gaps"))
    return tables.coverage_report(df, ["l_returnflag"]).join(gaps, "l_returnflag", "left").na.fill(0, ["gaps"])


@query(
    "data_coverage",
    "series_id:i latest_ts:t latest_complete_day:t latest_safe_day:t covers:b",
    """SELECT series_id, max(ds) AS latest_ts, CASE WHEN hour(max(ds)) = 0 THEN CAST(max(ds) AS DATE) - 1 ELSE CAST(max(ds) AS DATE) END AS latest_complete_day,
       CASE WHEN hour(max(ds)) = 0 THEN CAST(max(ds) AS DATE) - 3 WHEN hour(max(ds)) = 23 THEN CAST(max(ds) AS DATE) ELSE CAST(max(ds) AS DATE) - 1 END AS latest_safe_day,
       min(ds) <= TIMESTAMP '2024-01-02 01:00:00' AND max(ds) >= TIMESTAMP '2024-01-30 00:00:00' AS covers FROM market GROUP BY ALL""",
)
def _(t):
    m = t.stored_market
    return tables.data_coverage(m, S).join(tables.covers_range(m, "2024-01-02", "2024-01-29", S).select("series_id", "covers"), "series_id")


AUD = "ad AS (SELECT *, CASE WHEN n = 5 THEN NULL ELSE y_pred * 8 END AS yp FROM panel)"


def audited(t):
    return checks.audit(t.panel.withColumn("y_pred", F.when(F.col("n") != 5, F.col("y_pred") * 8)), ["series_id", "model_name", "task"])


AUDIT_SQL = """SELECT series_id, model_name, task, check_name, passed, CASE WHEN passed THEN 'info' ELSE sev END AS severity, bad FROM (SELECT series_id, model_name, task, unnest(['24h_per_day', 'duplicate_ds', 'border_hours', 'hour_range', 'period_labels', 'business_day', 'y_pred_null', 'y_pred_outliers', 'coverage']) AS check_name,
   unnest([bd = 0, true, h24 > 0 AND h1 > 0, true, true, true, nu = 0, o = 0, n / (days * 24) * 100 >= 99.9]) AS passed,
   unnest(['error', 'error', 'error', 'error', 'warning', 'warning', CASE WHEN nu / n > 0.1 THEN 'error' ELSE 'warning' END, 'warning', CASE WHEN n / (days * 24) * 100 < 90 THEN 'error' ELSE 'warning' END]) AS sev,
   unnest([bd::DOUBLE, 0, CAST(h24 = 0 AS INT) + CAST(h1 = 0 AS INT), 0, 0, 0, nu, o, n / (days * 24) * 100]) AS bad FROM (
   SELECT series_id, model_name, task, count(*) FILTER (k != 24) AS bd, sum(k) AS n, count(*) AS days, sum(h24) AS h24, sum(h1) AS h1, sum(nu) AS nu, sum(o) AS o FROM (
   SELECT series_id, model_name, task, target_day, count(*) AS k, count(*) FILTER (hour_business = 24) AS h24, count(*) FILTER (hour_business = 1) AS h1, count(*) FILTER (yp IS NULL) AS nu, count(*) FILTER (yp > 1000 OR yp < -500) AS o FROM ad GROUP BY ALL) GROUP BY ALL))"""


@query("prediction_audit", "series_id:i model_name:s task:s check_name:s passed:b severity:s bad:d", AUDIT_SQL, AUD)
def _(t):
    return audited(t)


@query(
    "audit_risk",
    "series_id:i model_name:s task:s errors:i warnings:i overall_risk:s",
    f"""SELECT *, CASE WHEN errors > 0 THEN 'high' WHEN warnings > 2 THEN 'medium' ELSE 'low' END AS overall_risk FROM (SELECT series_id, model_name, task, count(*) FILTER (NOT passed AND severity = 'error') AS errors, count(*) FILTER (NOT passed AND severity = 'warning') AS warnings FROM ({AUDIT_SQL}) GROUP BY ALL)""",
    AUD,
)
def _(t):
    return checks.overall_risk(audited(t), ["series_id", "model_name", "task"])


@query(
    "day_shape_checks",
    "series_id:i business_day:t check_name:s passed:b bad:d",
    """SELECT series_id, business_day, unnest(['rows_24', 'period_8', 'hours_1_24']) AS check_name, unnest([n = 24, a = 8 AND b = 8 AND c = 8, h = 24]) AS passed, unnest([n, greatest(abs(a - 8), abs(b - 8), abs(c - 8)), 24 - h])::DOUBLE AS bad FROM (
       SELECT series_id, business_day, count(*) AS n, count(DISTINCT hour_business) AS h, count(*) FILTER (period = '1_8') AS a, count(*) FILTER (period = '9_16') AS b, count(*) FILTER (period = '17_24') AS c FROM market GROUP BY ALL)""",
)
def _(t):
    return checks.day_shape(t.market, ["series_id", "business_day"])


BY = ["series_id", "task", "period"]


@query(
    "weight_checks",
    "series_id:i task:s period:s check_name:s passed:b bad:d",
    """SELECT series_id, task, period, unnest(['non_negative', 'sum_one']) AS check_name, unnest([ng = 0, abs(s - 1) < 0.02]) AS passed, unnest([ng::DOUBLE, s]) AS bad FROM (SELECT series_id, task, period, count(*) FILTER (w < -1e-9) AS ng, sum(w) AS s FROM (
       SELECT series_id, task, period, model_name, avg(y_pred - 40) / 50 AS w FROM panel GROUP BY ALL) GROUP BY ALL)""",
)
def _(t):
    w = t.panel.groupBy(*BY, "model_name").agg((F.avg(F.col("y_pred") - 40) / 50).alias("weight"))
    return checks.weight_checks(w, BY)


@query(
    "routing_checks",
    "series_id:i task:s period:s check_name:s passed:b bad:d",
    """SELECT s.series_id, ta AS task, pe AS period, unnest(['routing_present', 'routing_unique']) AS check_name, unnest([n >= 1, n <= 1]) AS passed, unnest([n, n])::DOUBLE AS bad FROM (SELECT s.series_id, ta, pe, count(r.k) AS n FROM (SELECT DISTINCT series_id FROM panel) s, (VALUES ('dayahead'), ('realtime')) a(ta), (VALUES ('1_8'), ('9_16'), ('17_24')) b(pe)
       LEFT JOIN (SELECT DISTINCT series_id, task, period, n >= 3 AS k FROM panel WHERE NOT (task = 'dayahead' AND period = '1_8') AND n BETWEEN 2 AND 3) r ON r.series_id = s.series_id AND r.task = ta AND r.period = pe GROUP BY ALL) s""",
)
def _(t):
    r = t.stored_panel.where("NOT (task = 'dayahead' AND period = '1_8') AND n BETWEEN 2 AND 3").select(*BY, (F.col("n") >= 3).alias("k")).distinct()
    return checks.routing_checks(r, S, expected=t.stored_panel)


@query(
    "row_count_match",
    "series_id:i passed:b bad:d",
    "SELECT m.series_id, a = b AS passed, CAST(a - b AS DOUBLE) AS bad FROM (SELECT series_id, count(*) AS a FROM market GROUP BY ALL) m JOIN (SELECT series_id, count(*) AS b FROM panel GROUP BY ALL) p ON m.series_id = p.series_id",
)
def _(t):
    return checks.row_count_match(t.stored_market, t.stored_panel, S)


@query(
    "model_alignment",
    "series_id:i task:s model_name:s passed:b bad:d",
    "SELECT a.series_id, a.task, model_name, count(*) = any_value(al) AS passed, CAST(any_value(al) - count(*) AS DOUBLE) AS bad FROM panel a JOIN (SELECT series_id, task, count(DISTINCT ds) AS al FROM panel GROUP BY ALL) b ON a.series_id = b.series_id AND a.task = b.task GROUP BY ALL",
)
def _(t):
    return checks.model_alignment(t.stored_panel, ["series_id", "task"])


@query(
    "tap_table_checks",
    "series_id:i check_name:s passed:b bad:d",
    """SELECT series_id, unnest(['date_span', 'fold_count', 'fold_days', 'horizons', 'age_blocks']) AS check_name, unnest([a = DATE '2024-01-01' AND b = DATE '2024-01-30', f = 10, sh = 0, h = 3, g = 10]) AS passed, unnest([b - a + 1, f, sh, h, g])::DOUBLE AS bad FROM (
       SELECT series_id, min(a) AS a, max(b) AS b, count(*) AS f, count(*) FILTER (d != 3) AS sh, max(h) AS h, count(*) AS g FROM (SELECT series_id, (30 - (DATE '2024-01-31' - business_day)) // 3 AS fid, min(business_day) AS a, max(business_day) AS b, count(DISTINCT business_day) AS d, 3 AS h
         FROM panel WHERE business_day >= DATE '2024-01-01' GROUP BY ALL) GROUP BY ALL)""",
)
def _(t):
    return checks.tap_checks(folds.assign_tap_folds(t.stored_panel, "2024-01-31"), "2024-01-31", S)


@query(
    "model_completeness",
    "series_id:i task:s model_name:s check_name:s passed:b bad:d",
    """SELECT series_id, task, m AS model_name, unnest(['present', 'enough_rows', 'truth_coverage']) AS check_name, unnest([n > 0, n >= 200, tc >= 0.95]) AS passed, unnest([n::DOUBLE, n, tc]) AS bad FROM (SELECT s.series_id, s.task, m, count(p.ds) AS n, coalesce(avg(CAST(p.n != 4 AS DOUBLE)), 0) AS tc FROM
       (SELECT DISTINCT series_id, task FROM panel) s CROSS JOIN (VALUES ('view'), ('click'), ('other')) v(m) LEFT JOIN panel p ON p.series_id = s.series_id AND p.task = s.task AND p.model_name = m GROUP BY ALL)""",
)
def _(t):
    p = t.stored_panel.withColumn("y_true", F.when(F.col("n") != 4, F.col("y_true")))
    return checks.model_completeness(p, ["series_id", "task"], ["view", "click", "other"], 200)


@query(
    "window_checks",
    "series_id:i check_name:s passed:b severity:s bad:d",
    """SELECT series_id, check_name, bad = 0 AS passed, CASE WHEN bad = 0 THEN 'info' ELSE sev END AS severity, bad FROM (SELECT series_id, unnest(['duplicate_timestamp', 'missing_timestamp', 'label_complete', 'business_day_filled', 'feature_wind_forecast']) AS check_name, unnest(['error', 'error', 'error', 'error', 'warning']) AS sev,
       unnest([0::DOUBLE, 0, a, 0, b]) AS bad FROM (SELECT series_id, count(*) FILTER (hour_business = 5) AS a, count(*) FILTER (hour_business = 6) AS b FROM market GROUP BY ALL))""",
)
def _(t):
    df = t.market.withColumns({"rt": F.when(F.col("hour_business") != 5, F.col("rt")), "wind_forecast": F.when(F.col("hour_business") != 6, F.col("wind_forecast"))})
    return checks.window_checks(df, S, "rt", ["wind_forecast"])


@query(
    "split_audit",
    "target_month:s check_name:s passed:b",
    """SELECT mo AS target_month, unnest(['boundaries_present', 'split_order', 'full_test_month']) AS check_name, unnest([true, a < va AND va <= vb AND vb < ts AND ts <= te, ts = CAST(date_trunc('month', ts) AS DATE) AND te = last_day(ts)]) AS passed FROM (
       SELECT strftime(o_orderdate, '%Y-%m') AS mo, CAST(min(o_orderdate) AS DATE) AS ts, CAST(max(o_orderdate) AS DATE) AS te, CAST(min(o_orderdate) AS DATE) - 40 AS a, CAST(min(o_orderdate) AS DATE) - 30 AS va, CAST(min(o_orderdate) AS DATE) - CASE WHEN month(min(o_orderdate)) = 2 THEN 0 ELSE 1 END AS vb FROM orders GROUP BY 1)""",
)
def _(t):
    d = F.to_date("o_orderdate")
    g = t.table("orders").groupBy(F.date_format(d, "yyyy-MM").alias("target_month")).agg(F.min(d).alias("test_start"), F.max(d).alias("test_end"))
    g = g.withColumns({"train_end": F.date_sub("test_start", 40), "val_start": F.date_sub("test_start", 30), "val_end": F.date_sub("test_start", F.when(F.month("test_start") == 2, 0).otherwise(1))})
    return checks.split_audit(g)


FOLD_AUDIT = AUDIT_SQL.replace("series_id, model_name, task", "series_id, model_name, task, tap_fold_id")


@query(
    "pool_audit",
    "series_id:i check_name:s passed:b bad:d",
    f"""SELECT series_id, unnest(['non_empty', 'no_failed_fold']) AS check_name, unnest([f > 0, h = 0]) AS passed, unnest([f, h])::DOUBLE AS bad FROM (SELECT series_id, count(*) AS f, count(*) FILTER (e > 0) AS h FROM (
       SELECT series_id, tap_fold_id, count(*) FILTER (NOT passed AND severity = 'error') AS e FROM ({FOLD_AUDIT}) GROUP BY ALL) GROUP BY ALL)""",
    "ad AS (SELECT *, y_pred AS yp, (30 - (DATE '2024-01-31' - business_day)) // 3 AS tap_fold_id FROM panel WHERE business_day >= DATE '2024-01-01')",
)
def _(t):
    df = folds.assign_tap_folds(t.panel, "2024-01-31")
    return checks.pool_audit(checks.audit(df, ["series_id", "model_name", "task", "tap_fold_id"]), S)


@query(
    "plugin_pipeline",
    "series_id:i monitor:s metric:s value:d",
    """SELECT series_id, 'level' AS monitor, 'mean' AS metric, avg(greatest(da + 10, 0)) AS value FROM market GROUP BY ALL UNION ALL SELECT series_id, 'level', 'rows', CAST(count(*) AS DOUBLE) FROM market GROUP BY ALL""",
)
def _(t):
    c = plugins.Corrections()
    c.register("shift", lambda d: d.withColumn("da", F.col("da") + 10))
    c.register("floor", lambda d: d.withColumn("da", F.greatest("da", F.lit(0.0))))
    m = plugins.Monitors()
    m.register("level", lambda d: reports.long_metrics(d.groupBy("series_id").agg(F.avg("da").alias("mean"), F.count(F.lit(1)).alias("rows")), S, ["mean", "rows"]))
    half = t.stored_market
    return plugins.run_pipeline([half.where("hour_business <= 12"), half.where("hour_business > 12")], c, m)[1]
