"""Alignment joins between predictions, truth and side tables.

No broadcast hints: each side's size is known only at run time, where adaptive
execution broadcasts the ones below the threshold and splits skewed ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock


def truth_frame(market: DataFrame, prices: Mapping[str, str], series: Sequence[str] = ()) -> DataFrame:
    """Long truth table from one price column per task."""
    long = market.select(
        *series,
        "ds",
        F.explode(
            F.array(*[F.struct(F.lit(task).alias("task"), F.col(c).cast("double").alias("y_true")) for task, c in prices.items()])
        ).alias("_t"),
    ).select(*series, "_t.task", "ds", "_t.y_true")
    long = clock.with_business_clock(long.where(F.col("y_true").isNotNull()))
    return long.select(
        *series, "task", F.col("business_day").alias("target_day"), "ds",
        clock.period_of("hour_business").alias("period"), "hour_business", "y_true",
    ).dropDuplicates([*series, "task", "ds"])


TRUTH_KEY = ("task", "target_day", "ds", "period", "hour_business")


def overwrite_truth(pred: DataFrame, truth: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Replace y_true by the source's; rows without source truth drop out."""
    key = [*series, *TRUTH_KEY]
    return pred.drop("y_true").join(truth.select(*key, "y_true"), key)


def fill_truth(pred: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill only missing y_true by key."""
    side = truth.select(*keys, F.col("y_true").alias("_y"))
    return (
        pred.join(side, list(keys), "left")
        .withColumn("y_true", F.coalesce("y_true", "_y"))
        .drop("_y")
    )


def truth_coverage(pred: DataFrame, by: Sequence[str], gate: float = 0.95) -> DataFrame:
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("y_true").alias("with_truth"),
        (F.count("y_true") / F.count(F.lit(1))).alias("coverage"),
    ).withColumn("passed", F.col("coverage") >= gate)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Left join; colliding columns of the right side get a suffix."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), list(keys), "left")


def price_pair(dayahead: DataFrame, realtime: DataFrame, keys: Sequence[str], value_columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Day-ahead and realtime side by side, columns suffixed _da and _rt."""
    def side(df, tag):
        return df.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in value_columns])

    return side(dayahead, "da").join(side(realtime, "rt"), list(keys), how)


# Price level up to which a classifier hit counts, and the price it sets.
CLASSIFIER_MAX_PRICE = 100.0
CLASSIFIER_PRICE = -80.0


def merge_classifier(fused: DataFrame, clf: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Classifier hits on low fused prices set the negative price."""
    hit = (F.col("final_pred") == 1) & (F.col("y_fused") <= CLASSIFIER_MAX_PRICE)
    return fused.join(clf.select(*keys, "final_pred"), list(keys), how).withColumn(
        "y_fused_corrected", F.when(F.coalesce(hit, F.lit(False)), F.lit(CLASSIFIER_PRICE)).otherwise(F.col("y_fused"))
    )


def key_sides(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of both tables with status matched, missing (left only) or extra (right only)."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return a.join(b, list(keys), "full").select(
        *keys,
        F.when(F.col("_l") & F.col("_r"), "matched").when(F.col("_l"), "missing").otherwise("extra").alias("status"),
    )


def align_pack(fused: DataFrame, pack: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pack rows whose key exists among the fused rows."""
    return pack.join(fused.select(*keys).distinct(), list(keys), "left_semi")


def inject(df: DataFrame, external: DataFrame, keys: Sequence[str], column: str, after: Column | None = None, value: str = "y_pred") -> DataFrame:
    """Put external values over a column, everywhere or only where ``after`` holds."""
    side = external.groupBy(*keys).agg(F.max_by(value, F.struct(*[c for c in external.columns if c not in keys])).alias("_x"))
    take = F.col("_x").isNotNull() if after is None else F.col("_x").isNotNull() & after
    return df.join(side, list(keys), "left").withColumn(column, F.when(take, F.col("_x")).otherwise(F.col(column))).drop("_x")


def lag_blend(df: DataFrame, series: Sequence[str], value: str, weights: Mapping[int, float], out: str = "blend", fallback: str | None = None) -> DataFrame:
    """Weighted mean of the same hour some days ago; weights renormalise over days present.

    A calendar join on exploded offsets: keys stay (series, hour), so it needs
    neither ordering nor a window over a whole series.
    """
    spec = F.array(*[F.struct(F.lit(d).alias("days"), F.lit(float(w)).alias("w")) for d, w in weights.items()])
    past = (
        df.where(F.col(value).isNotNull())
        .select(*series, "ds", F.col(value).alias("_v"), F.explode(spec).alias("_s"))
        .select(*series, (F.col("ds") + F.make_dt_interval(days=F.col("_s.days"))).alias("ds"), "_v", "_s.w")
        .groupBy(*series, "ds")
        .agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(out))
    )
    res = df.join(past, [*series, "ds"], "left")
    return res.withColumn(out, F.coalesce(out, fallback)) if fallback else res


def calendar_days(df: DataFrame, calendar: DataFrame, day: str = "business_day", carry: Sequence[str] = ()) -> DataFrame:
    """Attach a user calendar (holiday flags, solar terms) by business day.

    Carried columns hold their last known value; the carry runs over the
    calendar table, which has one row per day.
    """
    from pyspark.sql import Window as W

    w = W.orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    cal = calendar.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in carry}) if carry else calendar
    return df.join(cal, [day], "left").withColumns(
        {
            "weekday": F.weekday(day),
            "is_weekend": (F.weekday(day) >= 5).cast("int"),
        }
    )


def submission(dayahead: DataFrame, realtime: DataFrame, corrected: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Final table: day-ahead and realtime outer joined, corrected values attached."""
    out = dayahead.select(*keys, F.col("y_fused").alias("dayahead_pred")).join(
        realtime.select(*keys, F.col("y_fused").alias("realtime_pred")), list(keys), "full"
    )
    if corrected is None:
        return out
    return out.join(corrected.select(*keys, "y_fused_corrected"), list(keys), "left")
