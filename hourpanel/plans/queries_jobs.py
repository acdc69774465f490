"""Learned models, sinks and streaming jobs over the derived panels."""

from pyspark.sql import functions as F

from .. import fixed
from ..functions import clock
from ..operators import ledger, models
from ..session import scratch_path
from ..sources import sinks, tables
from ..streaming import jobs
from .fixture import MODELS, SERIES_COUNT
from .queries_contracts import INTRA
from .registry import query

S = ["series_id"]
FEATURES = ["load_forecast", "wind_forecast", "solar_forecast", "da", "hour_business"]


def labelled(t):
    return t.stored_market.withColumns(
        {"label": (F.col("rt") > 180).cast("int"), "low_valley_prob": F.greatest(F.lit(0.0), 0.7 - F.col("da") / 200), "delta_target": F.col("rt") - F.col("da")}
    )


def before(df, day):
    return df.where(F.col("business_day") < F.lit(day).cast("date"))


def since(df, day):
    return df.where(F.col("business_day") >= F.lit(day).cast("date"))


@query("risk_forest", "series_id:i ds:t risk:d label:i", None)
def _(t):
    df = labelled(t)
    model = models.fit_risk(before(df, "2024-01-20"), FEATURES, "label", trees=20, depth=5)
    return models.risk_probability(model, since(df, "2024-01-20"), FEATURES)


@query("walk_forward_risk", "series_id:i ds:t risk:d risk_source:s", None)
def _(t):
    return models.walk_forward_risk(labelled(t), FEATURES, "label", "2023-12-31", "2024-01-30", step_days=10, trees=10, depth=4)


@query("two_stage_spike_detector", "series_id:i ds:t p1:d spike_prob:d", None)
def _(t):
    df = labelled(t)
    return models.spike_detector(before(df, "2024-01-20"), since(df, "2024-01-20"), FEATURES, "label", S, iterations=5)


@query("segment_regression", "series_id:i ds:t y_hat:d", None)
def _(t):
    df = labelled(t)
    return models.segment_regression(before(df, "2024-01-20"), since(df, "2024-01-20"), FEATURES, "rt", S, iterations=5)


@query("training_window_choice", "series_id:i window_days:i smape:d chosen:b", None)
def _(t):
    return models.choose_window(labelled(t), FEATURES, "rt", S, "2024-01-25", [10, 20], iterations=3, negative=False)


@query("delta_regression", "series_id:i ds:t delta_hat:d rt_hat:d", None)
def _(t):
    df = labelled(t)
    return models.delta_regression(before(df, "2024-01-20"), since(df, "2024-01-20"), FEATURES, by_segment=True, iterations=5)


@query("rolling_delta_regression", "series_id:i ds:t fold_start:s rt_hat:d", None)
def _(t):
    return models.rolling_delta(labelled(t), FEATURES, [("2024-01-15", "2024-01-20"), ("2024-01-21", "2024-01-26")], iterations=5)


@query("out_of_fold_probability", "series_id:i ds:t fold:i oof_prob:d", None)
def _(t):
    return models.out_of_fold_probability(labelled(t), S, FEATURES, "label", k=3, trees=10, depth=4)


@query("boosted_stack", "series_id:i task:s period:s ds:t y_fused:d", None)
def _(t):
    point = ["series_id", "task", "target_day", "ds", "period", "hour_business"]
    return models.boosted_stack(t.panel, point, MODELS, "2024-01-20", iterations=3)


@query("daily_sink", "target:s run_date:t rows:i y_sum:d", "SELECT task AS target, business_day AS run_date, count(*) AS rows, sum(y_pred) + CASE WHEN business_day = DATE '2024-01-03' THEN count(*) ELSE 0 END AS y_sum FROM panel GROUP BY task, business_day")
def _(t):
    """Write all days, rewrite one, read back: only that day's partitions change."""
    path = scratch_path(t.spark, "daily-sink")
    rows = t.panel.select(F.col("task").alias("target"), F.col("business_day").alias("run_date"), "model_name", "ds", "y_pred")
    sinks.write_daily(rows, path)
    sinks.write_daily(rows.where(F.col("run_date") == F.lit("2024-01-03").cast("date")).withColumn("y_pred", F.col("y_pred") + 1), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("target", "run_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("y_pred").alias("y_sum"))


@query("csv_daily_scan", "run_day:t rows:i y_sum:d", "SELECT business_day AS run_day, count(*) AS rows, sum(da) AS y_sum FROM market GROUP BY ALL")
def _(t):
    """CSV folders by date, read back by one glob with the day taken from the path."""
    path = scratch_path(t.spark, "daily-csv")
    sinks.write_daily(t.market.select(F.col("business_day").alias("run_date"), "series_id", "ds", "da"), path, ["run_date"], "csv")
    back = tables.scan_daily(t.spark, f"{path}/run_date=*/*.csv")
    return back.groupBy("run_day").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("da").cast("double")).alias("y_sum"))


@query("csv_marked_files", "run_day:t rows:i y_sum:d marked:b", "SELECT business_day AS run_day, count(*) AS rows, sum(da) AS y_sum, true AS marked FROM market GROUP BY ALL")
def _(t):
    """Daily CSV files that start with a byte order mark, read back under their own column names."""
    path = scratch_path(t.spark, "marked-csv")
    sinks.write_daily(t.market.select(F.col("business_day").alias("run_date"), "series_id", "ds", "da"), path, ["run_date"], "csv", bom=True)
    raw = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)  # files of one day
    marked = raw.groupBy(F.col("run_date").cast("date").alias("run_day")).agg(F.min(F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("marked"))
    back = tables.scan_daily(t.spark, f"{path}/run_date=*/*.csv").select("run_day", "series_id", F.col("da").cast("double").alias("da"))
    return back.groupBy("run_day").agg(F.count("series_id").alias("rows"), F.sum("da").alias("y_sum")).join(marked, "run_day")


NOTES = (("utf-8", "实时电价"), ("gbk", "日前电价"), ("gb18030", "㐀电价"))  # the last one has a character that only its encoding has


@query(
    "csv_encodings",
    "file_encoding:s n_nationkey:i n_name:s note:s",
    "SELECT e.enc AS file_encoding, n_nationkey, n_name, CASE WHEN n_nationkey = (SELECT max(n_nationkey) FROM nation) THEN e.note END AS note FROM nation, (VALUES "
    + ", ".join(f"('{e}', '{n}')" for e, n in NOTES)
    + ") AS e(enc, note)",
)
def _(t):
    """One folder of files in three encodings, the only character outside ASCII in the last row of each."""
    path = scratch_path(t.spark, "encodings")
    nation = t.table("nation").select("n_nationkey", "n_name")
    last = nation.agg(F.max("n_nationkey")).first()[0]
    for enc, note in NOTES:
        as_bytes = note.encode(enc).decode("iso-8859-1")
        rows = nation.select(F.lit(enc).alias("file_encoding"), "n_nationkey", "n_name", F.when(F.col("n_nationkey") == last, F.lit(as_bytes)).alias("note"))
        rows.orderBy("n_nationkey").coalesce(1).write.mode("append").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.read_csv(t.spark, path)


@query(
    "ledger_stream_late_rows",
    "kept:i late_kept:i",
    "SELECT count(*) AS kept, count(*) FILTER (WHERE run_date < (SELECT max(CAST(ts AS DATE)) FROM events) - 3) AS late_kept FROM (SELECT DISTINCT user_id % 3 AS s, CAST(ts AS DATE) AS run_date, CASE WHEN hour(ts) = 0 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS d, CASE WHEN hour(ts) = 0 THEN 24 ELSE hour(ts) END AS h, event_type FROM events)",
)
def _(t):
    """Newest rows first, older ones by a second start of the job: what comes days late is kept."""
    path, source = scratch_path(t.spark, "late"), scratch_path(t.spark, "late-source")
    rows = t.table("events")
    newest = F.to_date(rows["ts"]) >= F.date_sub(F.lit(rows.agg(F.max(F.to_date("ts"))).first()[0]), 3)
    key = ["series_id", *fixed.LEDGER_KEY]
    for part in (newest, ~newest):
        rows.where(part).write.mode("append").parquet(source)
        stream = event_stream(t, source).withColumn("target", F.lit("realtime")).drop("event_id", "user_id").withColumnRenamed("value", "y_pred")
        jobs.ledger_ingest(stream, path, f"{path}-progress", key=key).awaitTermination()
    back = ledger.read_table(t.spark, path)
    late = F.col("run_date") < F.date_sub(F.lit(rows.agg(F.max(F.to_date("ts"))).first()[0]), 3)
    return back.agg(F.count(F.lit(1)).alias("kept"), F.count_if(late).alias("late_kept"))


def event_stream(t, path=None):
    """The events table as a stream of files, with the panel's derived columns."""
    schema = t.table("events").schema
    raw = jobs.read_directory(t.spark, path or f"{t.sf_dir}/event[s].parquet", schema)  # a glob: the table may be a file or a folder
    day, hour = clock.business_clock(clock.hour_floor("ts"))
    return raw.select(
        F.pmod("user_id", F.lit(SERIES_COUNT)).cast("int").alias("series_id"), F.col("ts").cast("timestamp").alias("event_time"), F.to_date("ts").alias("run_date"),
        day.alias("forecast_date"), hour.alias("hour_business"), F.col("event_type").alias("model_name"), "value", "event_id", "user_id",
    )


@query(
    "ledger_stream_ingest",
    "series_id:i forecast_date:t rows:i",
    "SELECT series_id, forecast_date, count(*) AS rows FROM (SELECT DISTINCT series_id, CASE WHEN hour(ds) = 0 THEN CAST(ds AS DATE) - 1 ELSE CAST(ds AS DATE) END AS forecast_date, hour(ds), CAST(ds AS DATE), model_name FROM ev) GROUP BY ALL",
)
def _(t):
    path = scratch_path(t.spark, "ledger")
    rows = event_stream(t).withColumn("target", F.lit("realtime")).drop("event_id", "user_id").withColumnRenamed("value", "y_pred")
    key = ["series_id", *fixed.LEDGER_KEY]
    for run in range(2):  # the second run starts from scratch and must add nothing
        jobs.ledger_ingest(rows, path, f"{path}-progress-{run}", key=key).awaitTermination()
    return ledger.read_table(t.spark, path).groupBy("series_id", "forecast_date").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "ledger_replay",
    "series_id:i forecast_date:t rows:i y_sum:d applied:s",
    "SELECT series_id, forecast_date, count(*) AS rows, sum(y) AS y_sum, 'true,false,true,true' AS applied FROM (SELECT user_id % 3 AS series_id, CASE WHEN hour(ts) NOT IN (0, 13) THEN CAST(ts AS DATE) END AS forecast_date, hour(ts) AS h, CAST(ts AS DATE) AS run_date, event_type, max(value) AS y FROM events GROUP BY ALL) GROUP BY ALL",
)
def _(t):
    """One batch appended with its number, again with the same number, as another source, and forced: null days and all,
    one row a key is left."""
    path = scratch_path(t.spark, "replay")
    rows = t.table("events").groupBy(
        F.pmod("user_id", F.lit(SERIES_COUNT)).cast("int").alias("series_id"), F.when(~F.hour("ts").isin(0, 13), F.to_date("ts")).alias("forecast_date"), F.hour("ts").alias("hour_business"),
        F.to_date("ts").alias("run_date"), F.col("event_type").alias("model_name"), F.lit("realtime").alias("target"),
    ).agg(F.max("value").alias("y_pred"))
    key = ["series_id", *fixed.LEDGER_KEY]
    done = [ledger.append_to_table(t.spark, path, rows, force, key, source, number) for force, source, number in ((False, "a", 0), (False, "a", 0), (False, "b", 0), (True, None, None))]
    back = ledger.read_table(t.spark, path).groupBy("series_id", "forecast_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("y_pred").alias("y_sum"))
    return back.withColumn("applied", F.lit(",".join(str(d).lower() for d in done)))


@query(
    "intraday_stream_latest",
    "series_id:i business_day:t target_hour:i cutoff_hour:i event_id:i",
    "SELECT series_id, business_day, target_hour, cutoff_hour, event_id FROM dk",
    INTRA,
)
def _(t):
    path = scratch_path(t.spark, "intraday")
    pack = event_stream(t).where("model_name = 'click'").select(
        "series_id", F.col("forecast_date").alias("business_day"), F.col("hour_business").alias("target_hour"), (F.col("user_id") % 5 + 10).alias("cutoff_hour"), "event_id"
    )
    jobs.intraday_latest(pack, path, f"{path}-progress", ["series_id", "business_day", "target_hour"], ["event_id"]).awaitTermination()
    return jobs.read_intraday(t.spark, path)
