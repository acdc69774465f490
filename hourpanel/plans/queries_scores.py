"""Clock, market and flagship fusion queries."""

from pyspark.sql import functions as F

from ..functions import clock, scores
from .registry import query


@query(
    "panel_rows",
    "series_id:i model_name:s business_day:t hour_business:i period:s ds:t y_true:d y_pred:d",
    "SELECT * FROM panel",
)
def _(t):
    return t.panel


@query(
    "market_rows",
    "series_id:i business_day:t hour_business:i period:s ds:t da:d rt:d high_spike_prob:d load_forecast:d load_actual:d wind_actual:d solar_actual:d interconnect_forecast:d",
    "SELECT * FROM market",
)
def _(t):
    return t.market


CLOCK_SQL = """
SELECT mode, business_day, hour_business, count(*) AS n FROM (
  SELECT 'hour0' AS mode, CASE WHEN hour(ts) = 0 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS business_day,
         CASE WHEN hour(ts) = 0 THEN 24 ELSE hour(ts) END AS hour_business FROM events
  UNION ALL
  SELECT 'exact_midnight', CASE WHEN hour(ts) = 0 AND minute(ts) = 0 AND second(ts) = 0 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END,
         CASE WHEN hour(ts) = 0 AND minute(ts) = 0 AND second(ts) = 0 THEN 24 ELSE greatest(hour(ts), 1) END FROM events
  UNION ALL
  SELECT 'one_second', CAST(ts - INTERVAL 1 SECOND AS DATE), hour(ts - INTERVAL 1 SECOND) + 1 FROM events
  UNION ALL
  SELECT 'plain_plus1', CAST(ts AS DATE), hour(ts) + 1 FROM events)
GROUP BY ALL"""


@query("clock_modes", "mode:s business_day:t hour_business:i n:i", CLOCK_SQL)
def _(t):
    ev = t.table("events").select("ts")
    cells = [
        F.struct(F.lit(m).alias("mode"), d.alias("business_day"), h.alias("hour_business"))
        for m in clock.MODES
        for d, h in [clock.business_clock("ts", m)]
    ]
    return ev.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.mode", "c.business_day", "c.hour_business").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "clock_round_trip",
    "period:s sub_period:s rows:i back:i",
    """SELECT period, sub_period, count(*) AS rows, sum(CAST(back = ds AS INT)) AS back FROM (
  SELECT ds, period, CASE WHEN hour_business <= 8 THEN '1_8' WHEN hour_business <= 12 THEN '9_12'
         WHEN hour_business <= 16 THEN '13_16' ELSE '17_24' END AS sub_period,
         CAST(business_day AS TIMESTAMP) + hour_business * INTERVAL 1 HOUR AS back FROM panel) GROUP BY ALL""",
)
def _(t):
    df = t.panel.withColumn("back", clock.business_timestamp("business_day", "hour_business"))
    return df.groupBy("period", clock.sub_period_of("hour_business").alias("sub_period")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col("back") == F.col("ds")).cast("int")).alias("back")
    )
