"""What was known when: masks after a cutoff, visible frames, fill bias."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from . import features, quantile


def cutoff_target(df: DataFrame, asof: str, target: str, rt: str = "rt_price", da: str = "da_price") -> DataFrame:
    """After ``asof`` the realtime target turns into the day-ahead price, a day-ahead target into null."""
    late = F.col("ds") > F.lit(asof).cast("timestamp_ntz")
    if target == "realtime":
        return df.withColumn(rt, F.when(late, F.col(da)).otherwise(F.col(rt)))
    return df.withColumn(da, F.when(~late, F.col(da)))


def visible_frame(
    df: DataFrame,
    decision_days: DataFrame,
    decision_hour: int,
    series: Sequence[str],
    history_days: int,
    rt: str = "rt",
    da: str = "da",
    pairs: Mapping[str, str] | None = None,
    bias: DataFrame | None = None,
    bias_keys: Sequence[str] = (),
) -> DataFrame:
    """Rows as seen on each decision day D, from D - history_days to D.

    Hours of D after the decision hour show the day-ahead price (plus a fill
    bias) and forecasts in place of actuals. The decision days, a small table,
    name the days they cover, and one equi-join sends each row to those only.
    """
    days = decision_days.select(*series, F.col("business_day").alias("decision_day")).distinct()
    covered = F.explode(F.sequence(F.date_sub("decision_day", history_days), F.col("decision_day")))
    sent = df.join(days.withColumn("business_day", covered), [*series, "business_day"])
    decided = clock.business_timestamp("decision_day", F.lit(decision_hour))
    blocked = (F.col("business_day") == F.col("decision_day")) & (F.col("ds") > decided)
    out = sent.withColumn("blocked", blocked)
    if bias is not None:
        out = out.join(bias, list(bias_keys), "left")
    else:
        out = out.withColumn("fill_bias", F.lit(0.0))
    cols = {"visible_rt": F.when(F.col("blocked"), F.col(da) + F.coalesce("fill_bias", F.lit(0.0))).otherwise(F.col(rt))}
    for actual, forecast in (pairs or {}).items():
        cols[f"visible_{actual}"] = F.when(F.col("blocked"), F.col(forecast)).otherwise(F.col(actual))
    return out.withColumns(cols)


def fill_bias(df: DataFrame, decision_hour: int, keys: Sequence[str], delta: str = "delta_target") -> DataFrame:
    """Median of rt - da over the hours a decision cannot see, by ``keys`` (series, or series and segment)."""
    late = df.where(F.col("hour_business") > decision_hour)
    return quantile.quantiles(late, keys, delta, {"fill_bias": 0.5})


def masked_history(df: DataFrame, asof: str, series: Sequence[str], rt: str = "rt", da: str = "da") -> DataFrame:
    """Target lags recomputed on the masked target, so later truth cannot reach them."""
    return features.target_history(cutoff_target(df, asof, "realtime", rt, da), series, rt)
