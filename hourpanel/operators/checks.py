"""Quality checks as rows: keys, check_name, passed, severity, bad (count or value).

Each check set is one or two grouped passes; rows never reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import clock
from ..functions.numeric import flag

# Limits of the prediction audit.
PRICE_UPPER, PRICE_LOWER = 1000.0, -500.0
NULL_ERROR_SHARE = 0.10
COVERAGE_OK, COVERAGE_ERROR = 99.9, 90.0
WEIGHT_SUM_TOL = 0.02
TRUTH_GATE = 0.95
TAP_ROWS, FORECAST_ROWS = 600, 24


def as_rows(df: DataFrame, keys: Sequence[str], checks: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    """(name, passed, severity when failed, bad) columns of one row per key to long rows."""
    cells = [
        F.struct(
            F.lit(n).alias("check_name"),
            F.coalesce(ok, F.lit(False)).alias("passed"),
            F.when(F.coalesce(ok, F.lit(False)), "info").otherwise(sev).alias("severity"),
            bad.cast("double").alias("bad"),
        )
        for n, ok, sev, bad in checks
    ]
    return df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")


def audit(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Nine checks per fold, model and task: day length, duplicates, border hours, ranges, labels, nulls, outliers, coverage."""
    by = list(by)
    hour = F.col("hour_business")
    per_ds = df.groupBy(*by, "target_day", "ds").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(flag(hour == 24)).alias("_h24"),
        F.max(flag(hour == 1)).alias("_h1"),
        F.sum(flag(~hour.between(1, 24))).alias("_range"),
        F.sum(flag(hour.isNotNull() & (F.col("period") != clock.period_of("hour_business")))).alias("_label"),
        F.sum(flag(F.col("business_day") > F.col("target_day"))).alias("_day"),
        F.sum(flag(F.col("y_pred").isNull())).alias("_null"),
        F.sum(flag((F.col("y_pred") > PRICE_UPPER) | (F.col("y_pred") < PRICE_LOWER))).alias("_out"),
    )
    sums = ["_h24", "_h1", "_range", "_label", "_day", "_null", "_out"]
    per_day = per_ds.groupBy(*by, "target_day").agg(
        F.sum("_n").alias("_n"), F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("_dup"), *[F.sum(c).alias(c) for c in sums]
    )
    g = per_day.groupBy(*by).agg(
        F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_days"), F.sum(flag(F.col("_n") != 24)).alias("_bad_days"),
        F.sum("_dup").alias("_dup"), *[F.sum(c).alias(c) for c in sums],
    )
    err, warn = F.lit("error"), F.lit("warning")
    share = F.col("_null") / F.col("_n")
    cover = F.col("_n") / (F.col("_days") * 24) * 100

    def zero(c: str) -> Column:
        return F.col(c) == 0

    return as_rows(
        g,
        by,
        [
            ("24h_per_day", zero("_bad_days"), err, F.col("_bad_days")),
            ("duplicate_ds", zero("_dup"), err, F.col("_dup")),
            ("border_hours", (F.col("_h24") > 0) & (F.col("_h1") > 0), err, flag(zero("_h24")) + flag(zero("_h1"))),
            ("hour_range", zero("_range"), err, F.col("_range")),
            ("period_labels", zero("_label"), warn, F.col("_label")),
            ("business_day", zero("_day"), warn, F.col("_day")),
            ("y_pred_null", zero("_null"), F.when(share > NULL_ERROR_SHARE, "error").otherwise("warning"), F.col("_null")),
            ("y_pred_outliers", zero("_out"), warn, F.col("_out")),
            ("coverage", cover >= COVERAGE_OK, F.when(cover < COVERAGE_ERROR, "error").otherwise("warning"), cover),
        ],
    )


def overall_risk(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """high on any error, medium on over two warnings, else low."""
    g = checks.groupBy(*by).agg(
        F.sum(flag(~F.col("passed") & (F.col("severity") == "error"))).alias("errors"),
        F.sum(flag(~F.col("passed") & (F.col("severity") == "warning"))).alias("warnings"),
    )
    return g.withColumn("overall_risk", F.when(F.col("errors") > 0, "high").when(F.col("warnings") > 2, "medium").otherwise("low"))


def day_shape(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per day: 24 rows, 8 per period, hours 1-24 all present."""
    h = F.col("hour_business")
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct("hour_business").alias("_h"),
        *[F.sum(flag(h.between(lo, hi))).alias(f"_p{i}") for i, (_, lo, hi) in enumerate(clock.PERIOD_BOUNDS)],
    )
    err = F.lit("error")
    eight = (F.col("_p0") == 8) & (F.col("_p1") == 8) & (F.col("_p2") == 8)
    return as_rows(
        g,
        keys,
        [
            ("rows_24", F.col("_n") == 24, err, F.col("_n")),
            ("period_8", eight, err, F.greatest(F.abs(F.col("_p0") - 8), F.abs(F.col("_p1") - 8), F.abs(F.col("_p2") - 8))),
            ("hours_1_24", F.col("_h") == 24, err, 24 - F.col("_h")),
        ],
    )


def weight_checks(weights: DataFrame, by: Sequence[str]) -> DataFrame:
    g = weights.groupBy(*by).agg(F.sum(flag(F.col("weight") < -1e-9)).alias("_neg"), F.sum("weight").alias("_sum"))
    err = F.lit("error")
    return as_rows(
        g, by, [("non_negative", F.col("_neg") == 0, err, F.col("_neg")), ("sum_one", F.abs(F.col("_sum") - 1) < WEIGHT_SUM_TOL, err, F.col("_sum"))]
    )


def routing_checks(
    routing: DataFrame, series: Sequence[str] = (), tasks: Sequence[str] = fixed.TASKS, periods: Sequence[str] = fixed.PERIODS,
    expected: DataFrame | None = None,
) -> DataFrame:
    """Exactly one entry per (task, period) of the expected grid.

    The series of the grid are those of ``expected``, so that a series without any entry is reported; without ``expected``
    only those that ``routing`` names.
    """
    cells = F.array(*[F.struct(F.lit(a).alias("task"), F.lit(b).alias("period")) for a in tasks for b in periods])
    known = routing if expected is None else expected
    spine = known.select(*series).distinct() if series else routing.sparkSession.range(1)
    spine = spine.select(*series, F.explode(cells).alias("_k")).select(*series, "_k.*")
    key = [*series, "task", "period"]
    have = routing.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    g = spine.join(have, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    err = F.lit("error")
    return as_rows(g, key, [("routing_present", F.col("_n") >= 1, err, F.col("_n")), ("routing_unique", F.col("_n") <= 1, err, F.col("_n"))])


def row_count_match(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    a = left.groupBy(*by).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*by).agg(F.count(F.lit(1)).alias("_b"))
    g = a.join(b, list(by), "full").na.fill(0, ["_a", "_b"])
    return as_rows(g, by, [("row_count_match", F.col("_a") == F.col("_b"), F.lit("error"), F.col("_a") - F.col("_b"))])


def model_alignment(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hours each model lacks against the union of the group."""
    cells = df.select(*by, "ds", "model_name").distinct()
    total = cells.groupBy(*by).agg(F.count_distinct("ds").alias("_all"))
    g = cells.groupBy(*by, "model_name").agg(F.count(F.lit(1)).alias("_have")).join(total, list(by))
    return as_rows(g, [*by, "model_name"], [("aligned", F.col("_have") == F.col("_all"), F.lit("warning"), F.col("_all") - F.col("_have"))])


def tap_checks(tap: DataFrame, predict_date: str, by: Sequence[str]) -> DataFrame:
    """D-30 .. D-1 covered, ten folds of three days, horizons 1-3, age blocks 0-9."""
    d = F.lit(predict_date).cast("date")
    per_fold = tap.groupBy(*by, "tap_fold_id").agg(F.count_distinct("business_day").alias("_days"))
    folds = per_fold.groupBy(*by).agg(F.count(F.lit(1)).alias("_folds"), F.sum(flag(F.col("_days") != 3)).alias("_short"))
    g = tap.groupBy(*by).agg(
        F.min("business_day").alias("_a"), F.max("business_day").alias("_b"),
        F.array_sort(F.collect_set("horizon_day")).alias("_h"), F.array_sort(F.collect_set("age_block")).alias("_g"),
    ).join(folds, list(by))
    span = (F.col("_a") == F.date_sub(d, 30)) & (F.col("_b") == F.date_sub(d, 1))
    err = F.lit("error")
    return as_rows(
        g,
        by,
        [
            ("date_span", span, err, F.datediff("_b", "_a") + 1),
            ("fold_count", F.col("_folds") == 10, err, F.col("_folds")),
            ("fold_days", F.col("_short") == 0, err, F.col("_short")),
            ("horizons", F.concat_ws(",", F.col("_h").cast("array<string>")) == "1,2,3", err, F.size("_h")),
            ("age_blocks", F.concat_ws(",", F.col("_g").cast("array<string>")) == "0,1,2,3,4,5,6,7,8,9", err, F.size("_g")),
        ],
    )


def model_completeness(df: DataFrame, by: Sequence[str], expected: Sequence[str], min_rows: int = TAP_ROWS, gate: float = TRUTH_GATE) -> DataFrame:
    """Each expected model is there, with enough rows and enough truth."""
    spine = df.select(*by).distinct().withColumn("model_name", F.explode(F.array(*[F.lit(m) for m in expected])))
    have = df.groupBy(*by, "model_name").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("y_true").isNotNull().cast("double")).alias("_t"))
    g = spine.join(have, [*by, "model_name"], "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_t": F.coalesce("_t", F.lit(0.0))})
    err = F.lit("error")
    return as_rows(
        g,
        [*by, "model_name"],
        [
            ("present", F.col("_n") > 0, err, F.col("_n")),
            ("enough_rows", F.col("_n") >= min_rows, err, F.col("_n")),
            ("truth_coverage", F.col("_t") >= gate, err, F.col("_t")),
        ],
    )


def window_checks(df: DataFrame, by: Sequence[str], label: str, features: Sequence[str]) -> DataFrame:
    """Label, features, timestamps and business day of a training window."""
    key = list(dict.fromkeys([*by, "ds"]))
    per_ds = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(flag(F.col(label).isNull())).alias("_label"),
        F.sum(flag(F.col("business_day").isNull())).alias("_day"),
        *[F.sum(flag(F.col(c).isNull())).alias(f"_f_{c}") for c in features],
    )
    g = per_ds.groupBy(*by).agg(
        F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("_dup"), F.sum(F.when(F.col("ds").isNull(), F.col("_n")).otherwise(0)).alias("_nots"),
        F.sum("_label").alias("_label"), F.sum("_day").alias("_day"), *[F.sum(f"_f_{c}").alias(f"_f_{c}") for c in features],
    )
    err, warn = F.lit("error"), F.lit("warning")
    return as_rows(
        g,
        by,
        [
            ("duplicate_timestamp", F.col("_dup") == 0, err, F.col("_dup")),
            ("missing_timestamp", F.col("_nots") == 0, err, F.col("_nots")),
            ("label_complete", F.col("_label") == 0, err, F.col("_label")),
            ("business_day_filled", F.col("_day") == 0, err, F.col("_day")),
            *[(f"feature_{c}", F.col(f"_f_{c}") == 0, warn, F.col(f"_f_{c}")) for c in features],
        ],
    )


def split_audit(folds: DataFrame, keys: Sequence[str] = ("target_month",)) -> DataFrame:
    """train_end < val_start <= val_end < test_start <= test_end, and the test window is the whole month."""
    c = F.col
    order = (c("train_end") < c("val_start")) & (c("val_start") <= c("val_end")) & (c("val_end") < c("test_start")) & (c("test_start") <= c("test_end"))
    whole = (c("test_start") == F.trunc("test_start", "month")) & (c("test_end") == F.last_day("test_start"))
    missing = c("train_end").isNull() | c("val_start").isNull() | c("val_end").isNull() | c("test_start").isNull() | c("test_end").isNull()
    err = F.lit("error")
    return as_rows(
        folds,
        keys,
        [
            ("boundaries_present", ~missing, err, flag(missing)),
            ("split_order", order, err, flag(~F.coalesce(order, F.lit(False)))),
            ("full_test_month", whole, err, flag(~F.coalesce(whole, F.lit(False)))),
        ],
    )


def pool_audit(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """A pool passes when it has folds and none is at high risk."""
    risk = overall_risk(checks, [*by, "tap_fold_id"])
    g = risk.groupBy(*by).agg(F.count(F.lit(1)).alias("_folds"), F.sum(flag(F.col("overall_risk") == "high")).alias("_failed"))
    err = F.lit("error")
    return as_rows(g, by, [("non_empty", F.col("_folds") > 0, err, F.col("_folds")), ("no_failed_fold", F.col("_failed") == 0, err, F.col("_failed"))])
