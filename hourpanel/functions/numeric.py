"""Null-safe numeric helpers shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Double with NaN turned into null, text that is no number into null."""
    d = as_col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def clean_text(c: Column | str) -> Column:
    """Trimmed text; empty strings and the word ``nan`` become null."""
    t = F.trim(as_col(c).cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def clip(c: Column | str, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """Bound a value; null stays null (``greatest``/``least`` alone would skip it)."""
    x = as_col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def safe_div(num: Column | str, den: Column | str, when_zero: float | None = None) -> Column:
    n, d = as_col(num), as_col(den)
    return F.when(d != 0, n / d).otherwise(F.lit(when_zero).cast("double"))


def mean_of(cols: list[Column]) -> Column:
    """Row mean over the non-null members of ``cols``."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    seen = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(seen > 0, total / seen)


def flag(cond: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def share(cond: Column) -> Column:
    """Aggregate: share of rows for which the condition holds."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def mean_if(cond: Column, value: Column) -> Column:
    return F.avg(F.when(cond, value))


def joined_text(cols: list[Column], sep: str) -> Column:
    return F.concat_ws(sep, *cols)
