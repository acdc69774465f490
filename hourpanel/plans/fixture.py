"""Forecast panels derived from the driver's ``events`` table.

* ``panel``: long prediction table, one row per (series, hour, model); a model
  is an event type, its prediction the mean value of its events in that hour,
  the truth the mean over all types.
* ``market``: one row per (series, hour) with two prices, five forecasts and
  their actuals, and a spike probability.

Sums are taken over integer cents, so both engines see the same doubles. Both
tables come from one grouped aggregate with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..session import materialise

SERIES_COUNT = 3
UNIT = 0.01013791135792
MODELS = ("click", "error", "purchase", "signup", "view")
DA_TYPES = ("view", "click", "purchase")


class Tables:
    """Lazy access to the driver tables and the panels derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._stored: dict[str, DataFrame] = {}

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = materialise(df, name)
        return self._stored[name]

    @property
    def stored_panel(self) -> DataFrame:
        """The panel written once to the shared folder, for plans that pass over it several times."""
        return self._store("panel", self.panel)

    @property
    def stored_market(self) -> DataFrame:
        return self._store("market", self.market)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        """Events with series, hour and integer cents."""
        return self.table("events").select(
            F.pmod("user_id", F.lit(SERIES_COUNT)).cast("int").alias("series_id"),
            clock.hour_floor("ts").alias("ds"),
            F.col("event_type").alias("model_name"),
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
            F.col("ts"),
            F.col("user_id"),
            F.col("event_id"),
        )

    @property
    def panel(self) -> DataFrame:
        cells = self.events.groupBy("series_id", "ds", "model_name").agg(
            F.count(F.lit(1)).alias("n"), F.sum("cents").alias("c")
        )
        point = W.partitionBy("series_id", "ds")
        df = cells.withColumn("y_true", F.sum("c").over(point) * F.lit(UNIT) / F.sum("n").over(point))
        df = df.withColumn("y_pred", F.col("c") * F.lit(UNIT) / F.col("n"))
        df = clock.with_business_clock(df)
        return df.select(
            "series_id",
            F.when(F.day("business_day") % 2 == 0, "dayahead").otherwise("realtime").alias("task"),
            "model_name",
            F.col("business_day").alias("target_day"),
            "business_day",
            "ds",
            clock.period_of("hour_business").alias("period"),
            "hour_business",
            "y_true",
            "y_pred",
            "n",
        )

    @property
    def market(self) -> DataFrame:
        def cents_of(*types):
            return F.sum(F.when(F.col("model_name").isin(*types), F.col("cents")))

        def rows_of(*types):
            return F.count(F.when(F.col("model_name").isin(*types), 1))

        def price(c, n):
            return F.col(c) * F.lit(UNIT) * 8 / F.col(n) - 320

        g = self.events.groupBy("series_id", "ds").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("cents").alias("c"),
            cents_of(*DA_TYPES).alias("c_da"),
            rows_of(*DA_TYPES).alias("n_da"),
            cents_of("error", "signup").alias("c_risk"),
            rows_of("error", "signup").alias("n_risk"),
            F.coalesce(cents_of("view"), F.lit(0)).alias("c_view"),
            rows_of("view").alias("n_view"),
            F.coalesce(cents_of("click"), F.lit(0)).alias("c_click"),
            rows_of("click").alias("n_click"),
            rows_of("error").alias("n_error"),
        )
        g = g.withColumns(
            {
                "rt": price("c", "n"),
                "da": F.coalesce(F.when(F.col("n_da") > 0, price("c_da", "n_da")), price("c", "n")),
                "risk": F.coalesce(F.when(F.col("n_risk") > 0, price("c_risk", "n_risk")), F.lit(0.0)),
            }
        )
        g = clock.with_business_clock(g)
        return g.select(
            "series_id",
            "ds",
            "business_day",
            "hour_business",
            clock.period_of("hour_business").alias("period"),
            "da",
            "rt",
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("risk") / 600)).alias("high_spike_prob"),
            (F.col("n") * 50.0).alias("load_forecast"),
            (F.col("c") * F.lit(UNIT)).alias("load_actual"),
            (F.col("n_view") * 40.0).alias("wind_forecast"),
            (F.col("c_view") * F.lit(UNIT)).alias("wind_actual"),
            (F.col("n_click") * 45.0).alias("solar_forecast"),
            (F.col("c_click") * F.lit(UNIT)).alias("solar_actual"),
            (F.col("n_error") * 10.0).alias("interconnect_forecast"),
        )


BASE_CTES = f"""ev AS (
  SELECT CAST(user_id % {SERIES_COUNT} AS INT) AS series_id, date_trunc('hour', ts) AS ds,
         event_type AS model_name, CAST(round(value * 100) AS BIGINT) AS cents, ts, user_id, event_id
  FROM events),
cells AS (
  SELECT series_id, ds, model_name, count(*) AS n, CAST(sum(cents) AS BIGINT) AS c FROM ev GROUP BY ALL),
points AS (
  SELECT series_id, ds, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS c FROM cells GROUP BY ALL),
panel AS (
  SELECT series_id, CASE WHEN day(business_day) % 2 = 0 THEN 'dayahead' ELSE 'realtime' END AS task,
         model_name, business_day AS target_day, business_day, ds,
         CASE WHEN hour_business <= 8 THEN '1_8' WHEN hour_business <= 16 THEN '9_16' ELSE '17_24' END AS period,
         hour_business, y_true, y_pred, n
  FROM (SELECT x.series_id, x.model_name, x.ds, x.n,
               CASE WHEN hour(x.ds) = 0 THEN CAST(x.ds AS DATE) - 1 ELSE CAST(x.ds AS DATE) END AS business_day,
               CASE WHEN hour(x.ds) = 0 THEN 24 ELSE hour(x.ds) END AS hour_business,
               p.c * {UNIT}::DOUBLE / p.n AS y_true, x.c * {UNIT}::DOUBLE / x.n AS y_pred
        FROM cells x JOIN points p ON x.series_id = p.series_id AND x.ds = p.ds)),
market0 AS (
  SELECT series_id, ds, count(*) AS n, CAST(sum(cents) AS BIGINT) AS c,
         CAST(sum(cents) FILTER (model_name IN ('view', 'click', 'purchase')) AS BIGINT) AS c_da,
         count(*) FILTER (model_name IN ('view', 'click', 'purchase')) AS n_da,
         CAST(sum(cents) FILTER (model_name IN ('error', 'signup')) AS BIGINT) AS c_risk,
         count(*) FILTER (model_name IN ('error', 'signup')) AS n_risk,
         CAST(coalesce(sum(cents) FILTER (model_name = 'view'), 0) AS BIGINT) AS c_view,
         count(*) FILTER (model_name = 'view') AS n_view,
         CAST(coalesce(sum(cents) FILTER (model_name = 'click'), 0) AS BIGINT) AS c_click,
         count(*) FILTER (model_name = 'click') AS n_click,
         count(*) FILTER (model_name = 'error') AS n_error
  FROM ev GROUP BY ALL),
market AS (
  SELECT series_id, ds, business_day, hour_business,
         CASE WHEN hour_business <= 8 THEN '1_8' WHEN hour_business <= 16 THEN '9_16' ELSE '17_24' END AS period,
         coalesce(CASE WHEN n_da > 0 THEN c_da * {UNIT}::DOUBLE * 8 / n_da - 320 END, c * {UNIT}::DOUBLE * 8 / n - 320) AS da,
         c * {UNIT}::DOUBLE * 8 / n - 320 AS rt,
         least(1.0::DOUBLE, greatest(0.0::DOUBLE,
           coalesce(CASE WHEN n_risk > 0 THEN c_risk * {UNIT}::DOUBLE * 8 / n_risk - 320 END, 0.0::DOUBLE) / 600)) AS high_spike_prob,
         n * 50.0::DOUBLE AS load_forecast, c * {UNIT}::DOUBLE AS load_actual,
         n_view * 40.0::DOUBLE AS wind_forecast, c_view * {UNIT}::DOUBLE AS wind_actual,
         n_click * 45.0::DOUBLE AS solar_forecast, c_click * {UNIT}::DOUBLE AS solar_actual,
         n_error * 10.0::DOUBLE AS interconnect_forecast
  FROM (SELECT *, CASE WHEN hour(ds) = 0 THEN CAST(ds AS DATE) - 1 ELSE CAST(ds AS DATE) END AS business_day,
                  CASE WHEN hour(ds) = 0 THEN 24 ELSE hour(ds) END AS hour_business FROM market0))"""
