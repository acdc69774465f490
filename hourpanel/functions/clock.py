"""The business clock: hour 24 of day D is 00:00 of day D+1.

Four modes differ only for timestamps off the full hour:

* ``hour0``          any time within 00:xx belongs to (D-1, 24)
* ``exact_midnight`` only 00:00:00 does; 00:30 is (D, 1)
* ``one_second``     one second earlier, hour + 1: 01:00 is (D, 1), 01:30 is (D, 2)
* ``plain_plus1``    hour + 1 without a day shift
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import as_col

MODES = ("hour0", "exact_midnight", "one_second", "plain_plus1")

# Labels and bounds of the three parts of the business day.
PERIOD_BOUNDS = (("1_8", 1, 8), ("9_16", 9, 16), ("17_24", 17, 24))
SUB_PERIOD_BOUNDS = (("1_8", 1, 8), ("9_12", 9, 12), ("13_16", 13, 16), ("17_24", 17, 24))
# Clock-hour labels used by the naive-baseline pack: 9_16, 17_22 is evening, the rest night.
DAY_PART_BOUNDS = (("night", 1, 8), ("9_16", 9, 16), ("evening", 17, 24))


def hour_floor(ts: Column | str) -> Column:
    """Full hour of a zone-free timestamp, independent of the session zone."""
    t = as_col(ts)
    return F.make_timestamp_ntz(
        F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0).cast("decimal(16,6)")
    )


def business_clock(ts: Column | str, mode: str = "hour0") -> tuple[Column, Column]:
    """(business_day, hour_business) of a timestamp."""
    if mode not in MODES:
        raise ValueError(f"unknown clock mode {mode!r}; one of {MODES}")
    t = as_col(ts)
    day, hour = F.to_date(t), F.hour(t)
    if mode == "plain_plus1":
        return day, (hour + 1).cast("int")
    if mode == "one_second":
        earlier = t - F.make_dt_interval(secs=F.lit(1))
        return F.to_date(earlier), (F.hour(earlier) + 1).cast("int")
    if mode == "hour0":
        rolls_back = hour == 0
    else:
        rolls_back = (hour == 0) & (F.minute(t) == 0) & (F.second(t) == 0)
    return (
        F.when(rolls_back, F.date_sub(day, 1)).otherwise(day),
        F.when(rolls_back, F.lit(24)).otherwise(F.greatest(hour, F.lit(1))).cast("int"),
    )


def with_business_clock(df: DataFrame, ts: str = "ds", mode: str = "hour0") -> DataFrame:
    day, hour = business_clock(ts, mode)
    return df.withColumns({"business_day": day, "hour_business": hour})


def business_timestamp(day: Column | str, hour: Column | str) -> Column:
    """Inverse of the clock: hour 24 lands on the next midnight."""
    return as_col(day).cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=as_col(hour).cast("int"))


def label_hours(hour: Column | str, bounds=PERIOD_BOUNDS, other: str | None = "unknown") -> Column:
    """Label of the band that holds the hour; ``other=None`` gives null outside."""
    h = as_col(hour)
    out = None
    for name, lo, hi in bounds:
        cond = h.between(lo, hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(other).cast("string"))


def period_of(hour: Column | str, other: str | None = "unknown") -> Column:
    return label_hours(hour, PERIOD_BOUNDS, other)


def sub_period_of(hour: Column | str, other: str | None = "unknown") -> Column:
    return label_hours(hour, SUB_PERIOD_BOUNDS, other)


def day_number(day: Column | str) -> Column:
    """Days since the epoch as int, for ``rangeBetween`` frames."""
    return F.datediff(as_col(day), F.lit("1970-01-01").cast("date"))
