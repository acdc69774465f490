"""Model output files of differing shape, brought to the prediction contract by a mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numeric import clean
from ..operators import dedupe, normalize
from . import tables


@dataclass(frozen=True)
class AdapterSpec:
    """Which columns hold what, per task where they differ.

    ``prefer`` names flags: rows with the flag set are used when there are any.
    ``hour`` given means hours are trusted; ``rebuild_ds`` derives ds from
    (target_day, hour); ``truth_join`` fills absent truth from a market table.
    """

    model_name: str
    ds: Sequence[str]
    y_pred: Mapping[str, Sequence[str]]
    y_true: Mapping[str, Sequence[str]]
    hour: str | None = None
    target_day: str | None = None
    prefer: Sequence[str] = ()
    rebuild_ds: bool = False
    keep_first: bool = False
    truth_join: bool = False
    drop_incomplete: bool = False
    tasks: Sequence[str] = ("dayahead", "realtime")


def _both(*names: str) -> dict[str, tuple[str, ...]]:
    return {"dayahead": names, "realtime": names}


# Header words of the five output shapes read.
SPECS: dict[str, AdapterSpec] = {
    "boosted_trees": AdapterSpec(
        "boosted_trees", ["ds"], _both("pred_y"), _both("y"), hour="hour", target_day="target_day"
    ),
    "spike_net": AdapterSpec(
        "spike_net",
        ["时刻", "ds"],
        {"dayahead": ("预测日前电价", "y_pred"), "realtime": ("预测实时电价", "y_pred")},
        {"dayahead": ("日前电价", "y_true"), "realtime": ("实时电价", "y_true")},
    ),
    "delta_net": AdapterSpec(
        "delta_net", ["timestamp"], {"realtime": ("rt_hat",)}, {"realtime": ("rt_actual",)},
        target_day="target_day", tasks=("realtime",),
    ),
    "mixer": AdapterSpec(
        "mixer",
        ["ds"],
        {"dayahead": ("pred_day_ahead_price", "y_pred"), "realtime": ("pred_realtime_price", "y_pred")},
        {"dayahead": ("day_ahead_clearing_price", "y_true"), "realtime": ("realtime_price", "y_true")},
        hour="hour_business",
        target_day="target_day",
        prefer=("official_test", "test_window_complete"),
        rebuild_ds=True,
        keep_first=True,
    ),
    "zero_shot": AdapterSpec(
        "zero_shot", ["时刻"], _both("预测值"), _both("真实值"), truth_join=True, drop_incomplete=True
    ),
}


def adapt(
    df: DataFrame,
    spec: AdapterSpec,
    task: str,
    truth: DataFrame | None = None,
    series: Sequence[str] = (),
) -> DataFrame:
    """One output table to the prediction contract."""
    if task not in spec.tasks:
        raise ValueError(f"{spec.model_name} has no {task} output")
    for name in spec.prefer:
        if name in df.columns:
            flagged = df.where(F.col(name).cast("string").isin("true", "True", "1", "t"))
            df = df if flagged.isEmpty() else flagged
    pred = normalize.first_present(df, spec.y_pred[task])
    if pred is None:
        raise ValueError(f"no prediction column: want one of {spec.y_pred[task]}, have {df.columns}")
    ts = normalize.first_present(df, spec.ds)
    if spec.rebuild_ds and spec.target_day in df.columns and spec.hour in df.columns:
        ds = clock.business_timestamp(F.col(spec.target_day), clean(spec.hour).cast("int"))
    elif ts is None:
        raise ValueError(f"no time column: want one of {spec.ds}, have {df.columns}")
    else:
        ds = F.col(ts).cast("timestamp_ntz")
    true = normalize.first_present(df, spec.y_true[task])
    df = df.withColumn("_ds", ds)
    day, hour = clock.business_clock("_ds")
    if spec.hour and spec.hour in df.columns:
        hour = clean(spec.hour).cast("int")
        day = F.to_date("_ds")
    if spec.target_day and spec.target_day in df.columns:
        day = F.col(spec.target_day).cast("date")
    out = df.select(
        *series,
        F.lit(task).alias("task"),
        F.lit(spec.model_name).alias("model_name"),
        day.alias("target_day"),
        F.col("_ds").alias("ds"),
        clock.period_of(hour).alias("period"),
        hour.alias("hour_business"),
        (clean(true) if true else F.lit(None).cast("double")).alias("y_true"),
        clean(pred).alias("y_pred"),
    )
    if true is None and spec.truth_join:
        if truth is None:
            raise ValueError(f"{spec.model_name}: output has no truth column and no truth table was given")
        side = truth.where(F.col("task") == task).select(*series, "ds", F.col("y_true").alias("_t"))
        out = out.join(side, [*series, "ds"], "left").withColumn("y_true", F.col("_t")).drop("_t")
    if spec.drop_incomplete:
        out = out.na.drop(subset=["ds", "y_true", "y_pred"])
    if spec.keep_first:
        out = dedupe.keep_one(out, [*series, "target_day", "ds", "hour_business"], ["y_pred", "y_true"])
    return out


def read_adapted(spark: SparkSession, path: str, spec: AdapterSpec, task: str, **kw) -> DataFrame:
    return adapt(tables.read_csv(spark, path), spec, task, **kw)


def union_manifest(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("the manifest lists no source")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def load_manifest(spark: SparkSession, path: str, truth: DataFrame | None = None) -> DataFrame:
    """Sources listed in a CSV or JSON manifest (adapter, source, task), normalised and united.

    The manifest is a list of files, so reading it on the driver is bounded.
    """
    rows = spark.read.option("multiLine", True).json(path) if path.endswith(".json") else tables.read_csv(spark, path)
    frames = []
    for r in rows.collect():
        rec = {k: v.strip() for k, v in r.asDict().items() if isinstance(v, str) and v.strip()}
        frames.append(read_adapted(spark, rec["source"], SPECS[rec["adapter"]], rec.get("task", "realtime"), truth=truth))
    return union_manifest(frames)


def external_predictions(
    df: DataFrame,
    columns: Mapping[str, str] | None = None,
    overrides: Mapping[str, str] | None = None,
    source_file: str = "",
) -> DataFrame:
    """External table: column mapping, constant overrides, file tag, default flags."""
    if columns:
        df = df.withColumnsRenamed({src: dst for src, dst in columns.items() if src in df.columns})
    if overrides:
        df = df.withColumns({k: F.lit(v) for k, v in overrides.items()})
    return normalize.standardise_external(df, source_file=source_file)
