"""Fold calendars and row-to-fold assignment, all by business day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import as_col
from . import rowblocks

# Tap layout.
TAP_FOLDS = 10
TAP_DAYS = 3
BLOCKS = 3
BLOCK_DAYS = 10
TRAIN_MONTHS = 6
HISTORY_DAYS = 30


def _months_before(day: Column, months: int) -> Column:
    """Same day ``months`` earlier, with days after the 28th pulled to the 28th."""
    first = F.add_months(F.trunc(day, "month"), -months)
    return F.date_add(first, F.least(F.dayofmonth(day), F.lit(28)) - 1)


def month_folds(
    spark: SparkSession,
    start_month: str,
    end_month: str,
    data_start: str = "2023-01-01",
    expanding: bool = True,
    train_months: int = 6,
) -> DataFrame:
    """One row per target month with its training range, expanding or sliding by 30-day months."""
    a, b = F.lit(f"{start_month}-01").cast("date"), F.lit(f"{end_month}-01").cast("date")
    months = spark.range(1).select(F.posexplode(F.sequence(a, b, F.make_ym_interval(months=F.lit(1)))).alias("fold_id", "test_start"))
    since = F.lit(data_start).cast("date")
    begin = since if expanding else F.greatest(since, F.date_sub("test_start", train_months * 30))
    return months.select(
        "fold_id",
        begin.alias("train_start"),
        F.date_sub("test_start", 1).alias("train_end"),
        "test_start",
        F.last_day("test_start").alias("test_end"),
        F.date_format("test_start", "yyyy-MM").alias("target_month"),
    )


def _equal_folds(days: DataFrame, count: int, length: int, name: str) -> DataFrame:
    d = F.col("predict_date")
    out = days.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    end = F.date_sub(d, F.lit(HISTORY_DAYS + 1) - F.lit(length) * F.col(name))
    out = out.withColumn("train_end", end)
    return out.withColumns(
        {
            "train_start": _months_before(F.col("train_end"), TRAIN_MONTHS),
            "test_start": F.date_add("train_end", 1),
            "test_end": F.date_add("train_end", length),
            "age_block": F.lit(count - 1) - F.col(name),
        }
    )


def tap_folds(days: DataFrame) -> DataFrame:
    """Ten 3-day folds over D-30 .. D-1 for each ``predict_date``."""
    return _equal_folds(days, TAP_FOLDS, TAP_DAYS, "tap_fold_id")


def tap_blocks(days: DataFrame) -> DataFrame:
    """Three 10-day blocks over D-30 .. D-1."""
    return _equal_folds(days, BLOCKS, BLOCK_DAYS, "block_id")


def assign_tap_folds(df: DataFrame, predict_date: Column | str, day: str = "business_day") -> DataFrame:
    """Fold, age and horizon of each row by arithmetic on its business day; others drop out.

    ``horizon_day`` keeps the published form, which gives 3 for D-30.
    """
    d = F.lit(predict_date).cast("date") if isinstance(predict_date, str) else as_col(predict_date)
    age = F.datediff(d, F.col(day))
    out = df.withColumn("age_days", age).where(F.col("age_days").between(1, HISTORY_DAYS))
    fold = F.floor((F.lit(HISTORY_DAYS) - F.col("age_days")) / TAP_DAYS).cast("int")
    return out.withColumns(
        {
            "tap_fold_id": fold,
            "age_block": F.lit(TAP_FOLDS - 1) - fold,
            "horizon_day": F.pmod(F.lit(HISTORY_DAYS - 1) - F.col("age_days"), F.lit(TAP_DAYS)) + 1,
        }
    )


def chronological_split(df: DataFrame, series: Sequence[str], ratio: float = 0.2, min_rows: int = 168) -> DataFrame:
    """``part`` = train or val: the last rows of each series, at least ``min_rows``, never all."""
    out = rowblocks.with_row_index(df, series, ["ds"], F.to_date("ds"), "_i", total="_n", staged=True)
    val = F.least(F.greatest(F.floor(F.col("_n") * ratio), F.lit(min_rows)), F.greatest(F.col("_n") - 1, F.lit(1)))
    return out.withColumn("part", F.when(F.col("_i") < F.col("_n") - val, "train").otherwise("val")).drop("_i", "_n")


def decision_split(df: DataFrame, decision_day: str, val_days: int) -> DataFrame:
    """Train before the validation days, validation up to the day before the decision; later rows drop."""
    d = F.lit(decision_day).cast("date")
    start = F.date_sub(d, val_days)
    day = F.col("business_day")
    return df.where(day < d).withColumn("part", F.when(day < start, "train").otherwise("val"))


def month_split(df: DataFrame, val_month: str, day: str = "business_day") -> DataFrame:
    m = F.date_format(day, "yyyy-MM")
    return df.where(m <= val_month).withColumn("part", F.when(m == val_month, "val").otherwise("train"))


def contiguous_folds(df: DataFrame, series: Sequence[str], k: int = 5) -> DataFrame:
    """``fold`` 0..k-1 in time order, the first n mod k folds one row longer; no global sort."""
    out = rowblocks.with_row_index(df, series, ["ds"], F.to_date("ds"), "_i", total="_n", staged=True)
    q, r = F.floor(F.col("_n") / k), F.col("_n") % k
    head = r * (q + 1)
    fold = F.when(F.col("_i") < head, F.floor(F.col("_i") / (q + 1))).otherwise(
        r + F.floor((F.col("_i") - head) / F.greatest(q, F.lit(1)))
    )
    return out.withColumn("fold", fold.cast("int")).drop("_i", "_n")


def replay_days(available: DataFrame, block_start: str, block_end: str, base_year: int, block_id: int, series: Sequence[str] = ()) -> DataFrame:
    """Days of earlier years that stand in for a block, by the first rule that has enough.

    Rules in order: same dates in the year (3, 2 or 1 back by block), the whole
    month of that year, the same dates in up to three earlier years. At least
    half the block (ten days for the month rule) must be present.
    """
    import datetime as dt

    a, b = dt.date.fromisoformat(block_start), dt.date.fromisoformat(block_end)
    n = (b - a).days + 1
    year = base_year - (3 - block_id)

    def moved(d: dt.date, y: int) -> dt.date | None:
        try:
            return d.replace(year=y)
        except ValueError:
            return None

    rules = []
    if moved(a, year) and moved(b, year):
        rules.append((1, f"exact_{year}", moved(a, year), moved(b, year), n * 0.5, None))
    first = dt.date(year, a.month, 1)
    last = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    rules.append((2, f"full_month_{year}", first, last, 10.0, n))
    for k in range(1, 4):
        if moved(a, year - k) and moved(b, year - k):
            rules.append((2 + k, f"fallback_{year - k}", moved(a, year - k), moved(b, year - k), n * 0.5, None))
    cells = F.array(
        *[
            F.struct(
                F.lit(p).alias("priority"), F.lit(name).alias("rule"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                F.lit(float(need)).alias("need"), F.lit(cap).cast("int").alias("cap"),
            )
            for p, name, lo, hi, need, cap in rules
        ]
    )
    days = available.select(*series, "business_day").distinct()
    hits = days.withColumn("_r", F.explode(cells)).where(F.col("business_day").between(F.col("_r.lo"), F.col("_r.hi")))
    counts = hits.groupBy(*series, "_r").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= F.col("_r.need"))
    best = counts.groupBy(*series).agg(F.min("_r.priority").alias("priority"))
    from pyspark.sql import Window as W

    chosen = hits.withColumn("priority", F.col("_r.priority")).join(best, [*series, "priority"])
    rank = F.row_number().over(W.partitionBy(*series).orderBy("business_day"))
    return (
        chosen.withColumn("_k", rank)
        .where(F.col("_r.cap").isNull() | (F.col("_k") <= F.col("_r.cap")))
        .select(*series, "business_day", F.col("_r.rule").alias("rule"))
    )
