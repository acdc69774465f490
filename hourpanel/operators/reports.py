"""Reports on top of scorecards: verdicts, leaderboards, profiles, diagnoses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numeric import clip, flag
from ..session import materialise
from . import dedupe, quantile, rowblocks


def stage_deltas(stages: DataFrame, by: Sequence[str], order: str, metric: str) -> DataFrame:
    """Change of a metric against the previous stage; one row per stage, so the window is tiny."""
    w = W.partitionBy(*by).orderBy(order)
    return stages.withColumn("delta", F.col(metric) - F.lag(metric).over(w))


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(*keys, F.explode(F.array(*cells)).alias("_m")).select(*keys, "_m.metric", "_m.value")


def compare_configs(df: DataFrame, configs: Sequence[str], metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """metric x config table from one scorecard row per config."""
    return long_metrics(df, [*keys, "config"], metrics).groupBy(*keys, "metric").pivot("config", list(configs)).agg(F.first("value"))


# Limits of the stack verdict.
VERDICT_SMAPE_WORSE = -0.3
VERDICT_SEVERE = 63
VERDICT_SPIKE_WORSE = -3.0
VERDICT_NORMAL = 0.5


def stack_verdict(df: DataFrame, run_status: str = "official") -> DataFrame:
    """GO, NO-GO with reasons, DATA-LIMITED or DATA-MISSING from a correction scorecard row."""
    if run_status == "data_missing":
        return df.withColumn("verdict", F.lit("DATA-MISSING"))
    severe_before = F.col("severe_before") if "severe_before" in df.columns else F.col("severe_underestimate")

    def why(cond: Column, text: str, *args: Column) -> Column:
        return F.when(cond, F.format_string(text, *args))

    reasons = F.array_compact(
        F.array(
            why(F.col("smape_improvement") < VERDICT_SMAPE_WORSE, "sMAPE worse by %.2f (limit 0.3)", F.abs("smape_improvement")),
            why(
                (F.col("severe_underestimate") > VERDICT_SEVERE) & (F.col("severe_underestimate") > severe_before),
                "severe %d > 63 and worsened",
                F.col("severe_underestimate"),
            ),
            why(
                F.col("high_spike_mae_improvement") < VERDICT_SPIKE_WORSE,
                "high_spike_MAE worse by %.1f%% (limit 3%%)",
                F.abs("high_spike_mae_improvement"),
            ),
            why(F.col("low_valley_mae_improvement") < 0, "low_valley_MAE worse by %.2f%%", F.abs("low_valley_mae_improvement")),
            why(F.col("normal_degradation") > VERDICT_NORMAL, "normal_degradation %.2f > 0.5", F.col("normal_degradation")),
        )
    )
    return df.withColumn(
        "verdict",
        F.when(F.col("data_limited"), "DATA-LIMITED")
        .when(F.size(reasons) > 0, F.concat(F.lit("NO-GO: "), F.concat_ws("; ", reasons)))
        .otherwise("GO"),
    )


def intraday_verdict(low_gain: Column, negative_gain: Column, overall_gain: Column) -> Column:
    """GO needs half a point from the low-weight run without harm below zero."""
    return (
        F.when((overall_gain <= 0) | (negative_gain < -1.0), "NO-GO")
        .when((low_gain >= 0.5) & (negative_gain >= 0), "GO")
        .otherwise("SHADOW_ONLY")
    )


def profile_verdict(smape: Column, severe: Column, false_lift: Column, degradation: Column, relaxed: Column) -> Column:
    """GO / CONDITIONAL / NO-GO; a relaxed run is conditional at best."""
    loose = (smape <= 22.50) & (severe < 80) & (false_lift <= 0.20) & (degradation <= 1.0)
    tight = (smape <= 22.02) & (severe < 80) & (false_lift <= 0.15) & (degradation <= 0.5)
    return (
        F.when(relaxed & loose, "CONDITIONAL (relaxed)")
        .when(relaxed, "NO-GO")
        .when(tight, "GO")
        .when(loose, "CONDITIONAL")
        .otherwise("NO-GO")
    )


def risk_policy(source: Column, allow_synthetic: bool = False) -> Column:
    """run_status of a risk source: real_prob, calibrated_prob, synthetic_flag, missing."""
    return (
        F.when(source.isin("real_prob", "calibrated_prob"), "official")
        .when((source == "synthetic_flag") & F.lit(allow_synthetic), "dry_run")
        .otherwise("data_missing")
    )


def risk_source(df_columns: Sequence[str], has_risk_table: bool = False) -> str:
    if has_risk_table:
        return "real_prob"
    if "high_spike_prob" in df_columns:
        return "calibrated_prob"
    return "synthetic_flag" if "high_spike_flag" in df_columns else "missing"


def tagged_verdict(run_status: Column, verdict: Column) -> Column:
    return F.when(run_status == "data_missing", "[data-missing] n/a").otherwise(
        F.concat(F.lit("["), run_status, F.lit("] "), verdict)
    )


# Trigger levels of the risk summary.
RISK_TRIGGERS = (0.2, 0.3, 0.4, 0.5)


def risk_summary(df: DataFrame, by: Sequence[str], risk: str) -> DataFrame:
    q = quantile.quantiles(df, by, risk, {"p95": 0.95})
    stats = df.groupBy(*by).agg(
        F.avg(risk).alias("mean"),
        F.stddev_samp(risk).alias("std"),
        *[F.avg((F.col(risk) > t).cast("double")).alias(f"rate_{int(t * 100)}") for t in RISK_TRIGGERS],
    )
    return stats.join(q, list(by))


# sMAPE targets in percent.
TARGETS = (15.0, 20.0)


def target_gaps(df: DataFrame, smape: str, reference: float | None = None) -> DataFrame:
    """Points above each target; values below 1 are ratios and scaled to percent."""
    pct = F.when(F.col(smape) < 1, F.col(smape) * 100).otherwise(F.col(smape))
    cols = {f"gap_to_{int(t)}": pct - t for t in TARGETS}
    if reference is not None:
        cols["gap_to_reference"] = pct - reference
    return df.withColumns(cols)


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "field", value: str = "value") -> DataFrame:
    cells = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*keys, F.explode(F.array(*cells)).alias("_u")).select(*keys, f"_u.{name}", f"_u.{value}")


CV_LIMIT = 0.01


PROFILE_QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def column_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Nulls, distinct values, moments and quartiles per column (and group).

    The input is read once and reduced to a table of (column, value, count), which is written; everything else comes from
    running counts over that table, so a column costs what its distinct values cost.
    """
    key = ["_g"]  # one struct, so that null groups meet in joins
    long = unpivot(df, by, columns).select(F.struct(*by, "field").alias("_g"), "value")
    counted = materialise(long.groupBy("_g", "value").agg(F.count(F.lit(1)).alias("_c")), "values")
    n, v = F.col("n"), F.col("value")
    curve = quantile.cumulative_counts(counted, key, "value", {"n": F.col("_c"), "s": F.col("_c") * v}, distinct=True)
    mean = F.col("all_s") / F.col("all_n")
    picks = []
    for name, p in PROFILE_QUARTILES.items():
        rank = F.floor(F.lit(p) * (F.col("all_n") - 1))
        picks += [F.min(F.when(F.col("cum_n") > rank + i, v)).alias(f"_{name}_{i}") for i in (0, 1)]
    known = curve.groupBy(*key).agg(
        F.sum("n").alias("n_non_null"),
        F.count(F.lit(1)).alias("n_unique"),
        F.max(mean).alias("mean"),
        F.sqrt(F.sum(n * (v - mean) * (v - mean)) / F.nullif(F.max("all_n") - 1, F.lit(0))).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("_zeros"),
        *picks,
    )
    out = counted.groupBy(*key).agg(F.sum("_c").alias("n_total")).join(known, key, "left").select("_g.*", "*").drop("_g")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_non_null", "n_unique", "_zeros")})
    for name, p in PROFILE_QUARTILES.items():
        at, low = F.lit(p) * (F.col("n_non_null") - 1), F.col(f"_{name}_0")
        out = out.withColumn(name, low + (at - F.floor(at)) * (F.coalesce(f"_{name}_1", low) - low)).drop(f"_{name}_0", f"_{name}_1")
    cv = F.when(F.abs("mean") > 1e-10, F.col("std") / F.abs("mean"))
    return out.withColumns(
        {
            "missing_rate": 1 - F.col("n_non_null") / F.col("n_total"),
            "unique_ratio": F.col("n_unique") / F.col("n_total"),
            "zero_ratio": F.col("_zeros") / F.col("n_total"),
            "cv": cv,
            "low_variance": F.coalesce(cv < CV_LIMIT, F.lit(False)),
        }
    ).drop("_zeros")


MIN_PAIRS = 10


def _correlation(x: str, y: str) -> Column:
    """Null for a constant column, where the built-in one divides by zero."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def association(df: DataFrame, features: Sequence[str], targets: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson and Spearman correlation for each (feature, target) on the rows that have both.

    A column is ranked once, and once more for each partner with nulls, among the rows where that one is there
    (``quantile.with_ranks``). The ranks stay on their rows, so one pass with map-side sums gives all pairs.
    """
    by = list(by)
    columns = list(dict.fromkeys([*features, *targets]))
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    holes = rows.select(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first().asDict()  # one row
    ranked = {}

    def rank_of(column: str, partner: str) -> str:
        name = f"_r_{column}|{partner}" if holes[partner] and partner != column else f"_r_{column}"
        ranked[name] = F.when(F.col(f"`{partner}`").isNotNull(), F.col(f"`{column}`")) if "|" in name else F.col(f"`{column}`")
        return name

    names = {(f, t): (rank_of(f, t), rank_of(t, f)) for f in features for t in targets}
    keyed = rows if by else rows.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    wide = quantile.with_ranks(keyed, keys, ranked)
    cells = [
        F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f"`{f}`").alias("x"), F.col(f"`{t}`").alias("y"), F.col(f"`{rx}`").alias("rx"), F.col(f"`{ry}`").alias("ry"))
        for (f, t), (rx, ry) in names.items()
    ]
    long = wide.select(*keys, F.explode(F.array(*cells)).alias("_p")).select(*keys, "_p.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    g = long.groupBy(*keys, "feature", "target").agg(F.count(F.lit(1)).alias("n_pairs"), _correlation("x", "y").alias("pearson"), _correlation("rx", "ry").alias("spearman"))
    enough = F.col("n_pairs") >= MIN_PAIRS
    return g.withColumns({c: F.when(enough, F.col(c)) for c in ("pearson", "spearman")}).drop("_all")


def leak_alarm(df: DataFrame, pairs: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows where a forecast equals its actual: HIGH > 0.5, MED > 0.1, else OK."""
    cells = [F.struct(F.lit(f).alias("forecast"), F.lit(a).alias("actual"), F.col(f).alias("x"), F.col(a).alias("y")) for f, a in pairs.items()]
    long = df.select(*by, F.explode(F.array(*cells)).alias("_p")).select(*by, "_p.*")
    long = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    g = long.groupBy(*by, "forecast", "actual").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("identical"))
    return g.withColumn("verdict", F.when(F.col("identical") > 0.5, "HIGH").when(F.col("identical") > 0.1, "MED").otherwise("OK"))


def availability_by_hour(df: DataFrame, value: str, cutoff_hour: int = 14, by: Sequence[str] = (), ts: str = "ds") -> DataFrame:
    return df.groupBy(*by, F.hour(ts).alias("hour")).agg(F.count(value).alias("rows")).withColumn(
        "available", F.col("hour") <= cutoff_hour
    )


def select_train_length(summary: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """Score train lengths on stability; ``chosen`` marks the best per task, ties to the shorter."""
    g = summary.groupBy(*by, "train_months").agg(
        F.avg("overall_smape").alias("smape_mean"),
        F.stddev_pop("overall_smape").alias("smape_std"),
        F.avg(F.abs("delta_vs_historical")).alias("mean_abs_hist_delta"),
        F.sum(flag(~F.col("pass_flag"))).alias("fail_count"),
    )
    score = (
        F.col("smape_mean") + 0.5 * F.col("smape_std") + 0.25 * F.col("fail_count")
        + F.coalesce(0.2 * F.col("mean_abs_hist_delta"), F.lit(0.0))
    )
    rank = F.row_number().over(W.partitionBy(*by).orderBy("score", "train_months"))
    return g.withColumn("score", score).withColumn("chosen", rank == 1)


def worst_per_reason(df: DataFrame, by: Sequence[str], size: Column, n: int, tie: Sequence[str]) -> DataFrame:
    return dedupe.top_per_key(df, by, [size.desc(), *[F.col(t) for t in tie]], n)


def append_leaderboard(old: DataFrame | None, run: DataFrame) -> DataFrame:
    return run if old is None else old.unionByName(run, allowMissingColumns=True)


def monthly_policy(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Candidate or base per month, decided on the previous month.

    ``days`` holds hourly rows with month (first day), day, stage
    (stage1..stage3), base_err and cand_err (row errors in percent). The
    candidate wins with stage-3 gain >= 0.3, no more harmed than improved days,
    no period worse by over 1 point and the full day not worse by over 0.3.
    """
    def avg_if(c: str, stage: str) -> Column:
        return F.avg(F.when(F.col("stage") == stage, F.col(c)))

    daily = days.groupBy(*by, "month", "day").agg(
        *[F.sum(F.when(F.col("stage") == s, F.col(c))).alias(f"{c}_{s}") for c in ("base_err", "cand_err") for s in ("stage1", "stage2", "stage3")],
        *[F.count(F.when(F.col("stage") == s, 1)).alias(f"n_{s}") for s in ("stage1", "stage2", "stage3")],
    )
    b3, c3 = F.col("base_err_stage3") / F.col("n_stage3"), F.col("cand_err_stage3") / F.col("n_stage3")

    def mean(c: str, stages: Sequence[str]) -> Column:
        num = sum((F.sum(F.coalesce(f"{c}_{s}", F.lit(0.0))) for s in stages), F.lit(0.0))
        den = sum((F.sum(f"n_{s}") for s in stages), F.lit(0))
        return num / den

    every = ("stage1", "stage2", "stage3")
    monthly = daily.groupBy(*by, "month").agg(
        (mean("base_err", every) - mean("cand_err", every)).alias("full_day_delta"),
        *[(mean("base_err", [s]) - mean("cand_err", [s])).alias(f"delta_{s}") for s in every],
        F.sum(flag(c3 < b3)).alias("improved_days"),
        F.sum(flag(c3 > b3)).alias("harmed_days"),
    )
    past = monthly.select(
        *by,
        F.add_months("month", 1).alias("month"),
        F.col("full_day_delta").alias("val_full_day_delta"),
        F.col("delta_stage3").alias("val_delta"),
        F.least("delta_stage1", "delta_stage2", "delta_stage3").alias("worst_val_period_delta"),
        "improved_days",
        "harmed_days",
    )
    out = monthly.select(*by, "month", F.col("full_day_delta").alias("eval_full_day_delta")).join(past, [*by, "month"], "left")
    passed = (
        (F.col("val_delta") >= 0.3)
        & (F.col("harmed_days") <= F.col("improved_days"))
        & (F.col("worst_val_period_delta") >= -1.0)
        & (F.col("val_full_day_delta") >= -0.3)
    )
    return out.withColumns(
        {
            "policy": F.when(passed, "candidate").otherwise("base"),
            "reason": F.when(F.col("val_delta").isNull(), "cold_start_no_prior_val_month")
            .when(passed, "candidate_passed_val_guardrails")
            .otherwise("base_kept_due_to_guardrail"),
            "improved_days": F.coalesce("improved_days", F.lit(0)),
            "harmed_days": F.coalesce("harmed_days", F.lit(0)),
        }
    )


# A spike hour of the midday diagnosis.
DIAGNOSIS_PRICE = 500.0
DIAGNOSIS_JUMP = 200.0


def midday_rows(df: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """9_16 rows with error, hourly jump within the day, and spike flag."""
    mid = df.where(F.col("period") == "9_16")
    w = W.partitionBy(*series, "business_day").orderBy("ds")
    jump = F.abs(F.col("y_true") - F.lag("y_true").over(w))
    return mid.withColumns({"under_err": F.col("y_true") - F.col("y_pred"), "jump": jump}).withColumn(
        "spike_flag", (F.col("y_true") > DIAGNOSIS_PRICE) | (F.coalesce("jump", F.lit(0.0)) > DIAGNOSIS_JUMP)
    )


def midday_diagnosis(df: DataFrame, series: Sequence[str] = (), load: str = "load", solar: str = "solar") -> DataFrame:
    rows = midday_rows(df, series)
    return rows.groupBy(*series, "business_day").agg(
        scores.smape("floor50", "y_true", "y_pred").alias("smape"),
        F.avg("y_true").alias("mean_true"),
        F.avg("y_pred").alias("mean_pred"),
        F.max("y_true").alias("max_true"),
        F.max("y_pred").alias("max_pred"),
        F.avg("under_err").alias("mean_under_err"),
        F.max("under_err").alias("max_under_err"),
        F.sum(flag(F.col("spike_flag"))).alias("spike_hours"),
        F.avg(solar).alias("solar_mean"),
        (F.max(solar) - F.min(solar)).alias("solar_drop"),
        F.avg(load).alias("load_mean"),
        (F.max(load) - F.min(load)).alias("load_ramp"),
    )


def landing_months(df: DataFrame, by: Sequence[str], target: float = 25.0) -> DataFrame:
    """Month table with errors over all rows and over the top tenth of abs delta."""
    key = [*by, "month"]
    df = df.withColumns({"month": F.date_format("business_day", "yyyy-MM"), "_mag": F.abs("delta_target")})
    cut = quantile.quantiles(df, key, "_mag", {"_q90": 0.90})
    top = F.col("_mag") >= F.col("_q90")
    return (
        df.join(cut, key)
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            scores.smape("raw", "rt_actual", "rt_hat").alias("rt_smape"),
            scores.smape("capped", "rt_actual", "rt_hat").alias("rt_capped_smape"),
            scores.mae("rt_actual", "rt_hat").alias("rt_mae"),
            scores.mae("delta_target", "delta_hat").alias("delta_mae"),
            scores.smape("capped", "rt_actual", "rt_hat", top).alias("top10_capped_smape"),
            scores.smape("raw", "rt_actual", "rt_hat", top).alias("top10_raw_smape"),
        )
        .withColumn("target_met", F.col("rt_capped_smape") < target)
    )


def landing_segments(df: DataFrame, by: Sequence[str], segment: str = "period", target: float = 30.0) -> DataFrame:
    """Month x segment table; the target applies to 9_16 alone."""
    g = df.groupBy(*by, F.date_format("business_day", "yyyy-MM").alias("month"), segment).agg(
        F.count(F.lit(1)).alias("rows"),
        scores.smape("raw", "rt_actual", "rt_hat").alias("rt_smape"),
        scores.smape("capped", "rt_actual", "rt_hat").alias("rt_capped_smape"),
        scores.mae("rt_actual", "rt_hat").alias("rt_mae"),
        scores.mae("delta_target", "delta_hat").alias("delta_mae"),
    )
    return g.withColumn("target_met", F.when(F.col(segment) == "9_16", F.col("rt_capped_smape") < target))


def metric_differences(computed: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recomputed minus stored value per (keys, metric)."""
    a = computed.select(*keys, "metric", F.col("value").alias("computed"))
    b = stored.select(*keys, "metric", F.col("value").alias("stored"))
    return a.join(b, [*keys, "metric"], "full").withColumn("difference", F.col("computed") - F.col("stored"))


def best_candidate(scores_df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First candidate per group by the ordered score columns; the last one breaks ties by name."""
    return dedupe.keep_one(scores_df, by, list(order))


FAMILY_KEEP, FAMILY_RETRY = -2.0, -0.5


def family_board(board: DataFrame, by: Sequence[str], metric: str, baseline: str = "baseline") -> DataFrame:
    """Best non-baseline per family with its decision against the baseline."""
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a board has one row per run
    board = board.withColumn("_base", F.min(F.when(F.col("name") == baseline, F.col(metric))).over(part))
    best = dedupe.keep_one(board.where(F.col("name") != baseline), [*by, "family"], [metric, "name"])
    return best.withColumn("delta", F.col(metric) - F.col("_base")).withColumn(
        "decision", F.when(F.col("delta") <= FAMILY_KEEP, "KEEP").when(F.col("delta") <= FAMILY_RETRY, "RETRY").otherwise("REJECT")
    ).drop("_base")


def month_audit(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per month and column: missing share, outliers beyond 3 standard deviations, moments, shift from the whole."""
    long = unpivot(df.withColumn("month", F.date_format("ds", "yyyy-MM")), [*by, "month"], columns)
    key = [*by, "month", "field"]
    stats = long.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    whole = stats.groupBy(*by, "field").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_full"))
    z = F.abs((F.col("value") - F.col("mean")) / F.col("std"))
    out = (
        long.join(stats.select(*key, "mean", "std", "n"), key)
        .groupBy(*key)
        .agg(F.sum(flag((z > 3) & (F.col("n") >= 10))).alias("outliers"))
    )
    q = quantile.quantiles(long, key, "value", {"median": 0.5})
    return (
        stats.join(out, key)
        .join(q, key, "left")
        .join(whole, [*by, "field"])
        .withColumns(
            {
                "missing": F.col("rows") - F.col("n"),
                "missing_rate": 1 - F.col("n") / F.col("rows"),
                "outlier_ratio": F.col("outliers") / F.col("n"),
                "mean_shift": F.col("mean") - F.col("_full"),
            }
        )
        .drop("_full")
    )
