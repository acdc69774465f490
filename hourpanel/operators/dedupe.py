"""Keep one row per key, always under an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """First (or last) row per key in ``order``.

    ``min_by``/``max_by`` over a struct combines on the map side, so thousands
    of copies of one key never meet in a single task before being reduced.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), rank)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` leading rows per key; Catalyst prunes each task to n rows before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest_cutoff(pack: DataFrame, keys: Sequence[str] = ("business_day", "target_hour"), tie: Sequence[str] = ()) -> DataFrame:
    """Highest cutoff wins per (day, target hour)."""
    return keep_one(pack, keys, ["cutoff_hour", *tie], last=True)


def removed_counts(pack: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """rows_in, rows_kept and removed per ``by``."""
    per_key = pack.groupBy(*dict.fromkeys([*by, *keys])).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*by).agg(
        F.sum("_n").alias("rows_in"),
        F.count(F.lit(1)).alias("rows_kept"),
        (F.sum("_n") - F.count(F.lit(1))).alias("removed"),
    )


def merge_cache(cache: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two tables where a fresh row replaces a cached one with its key."""
    both = cache.withColumn("_age", F.lit(0)).unionByName(fresh.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, keys, ["_age"], last=True).drop("_age")


def missing_hours(cache: DataFrame, series: Sequence[str], start: str, end: str, ts: str = "ds") -> DataFrame:
    """Hours of the inclusive range that a series lacks; empty means complete."""
    hours = F.sequence(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.make_dt_interval(hours=F.lit(1))
    )
    spine = cache.select(*series).distinct().select(*series, F.explode(hours).alias(ts))
    return spine.join(cache.select(*series, ts).distinct(), [*series, ts], "left_anti")
