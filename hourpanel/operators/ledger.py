"""The de-duplicated prediction ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import clock
from ..functions.numeric import clean, flag
from ..sources.versions import VersionedTable, without
from . import normalize


PARTS = ("target", "forecast_date")


def append_rows(old: DataFrame, new: DataFrame, force: bool = False, key: Sequence[str] = fixed.LEDGER_KEY) -> DataFrame:
    """Ledger after the append: known keys are skipped, or replaced when forced. Null key parts equal each other.

    Duplicates inside the batch are kept as they come, like those of the old table.
    """
    if force:
        return without(old, new, key).unionByName(new, allowMissingColumns=True)
    return old.unionByName(without(new, old, key), allowMissingColumns=True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A ledger as last published."""
    return VersionedTable(spark, path, PARTS).read()


def append_to_table(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    force: bool = False,
    key: Sequence[str] = fixed.LEDGER_KEY,
    source: str | None = None,
    number: int | None = None,
) -> bool:
    """Append to a versioned ledger partitioned by target and forecast_date; only the batch's partitions are read.

    Skipping adds the fresh rows, forcing replaces the batch's partitions; either is published as a whole or not at all
    (``sources.versions``), so an interrupted call changes nothing and can be repeated. With ``source`` and ``number`` a
    batch counts once: False if the table already has it.
    """
    return VersionedTable(spark, path, PARTS).upsert(new, key, force, source, number)


def _first_value(df: DataFrame, names: Sequence[str]):
    cols = [clean(c) for c in names if c in df.columns]
    return F.coalesce(*cols) if cols else F.lit(None).cast("double")


def build_rows(
    target: str,
    run_date: str,
    forecast: DataFrame,
    fused: DataFrame | None,
    final: DataFrame,
    corrected: DataFrame | None,
    version: str = "",
    cutoff: str = "",
    source: str = "",
    series: Sequence[str] = (),
) -> DataFrame:
    """One row per (day, hour, model): three lookups by key instead of a scan per row.

    Every hour of ``final`` is crossed with the models of its series, so absent
    model hours show up as null predictions.
    """
    key = [*series, "forecast_date", "hour_business"]

    def keyed(df: DataFrame) -> DataFrame:
        src = normalize.first_present(df, ("forecast_date", "business_day", "target_day", "date"))
        return df.withColumns(
            {"forecast_date": F.col(src).cast("date"), "hour_business": clean("hour_business").cast("int")}
        )

    def lookup(df: DataFrame | None, names: Sequence[str], out: str) -> DataFrame | None:
        if df is None:
            return None
        df = keyed(df)
        return df.groupBy(*key).agg(F.min(_first_value(df, names)).alias(out))

    fc = keyed(forecast)
    preds = fc.groupBy(*key, "model_name").agg(
        F.min(_first_value(fc, ("y_pred", "pred", "prediction", "y"))).alias("y_pred")
    )
    hours = keyed(final).na.drop(subset=["forecast_date", "hour_business"]).select(*key).distinct()
    if series:
        models = fc.groupBy(*series).agg(F.collect_set("model_name").alias("_models"))
        spine = hours.join(models, list(series))
    else:
        names = [r[0] for r in fc.select("model_name").distinct().collect()]  # a handful of model names
        spine = hours.withColumn("_models", F.array(*[F.lit(n) for n in names]))
    rows = spine.select(*key, F.explode("_models").alias("model_name")).join(preds, [*key, "model_name"], "left")
    for df, names, out in (
        (fused, ("y_pred", "y_fused"), "base_fused_pred"),
        (corrected, ("y_fused_corrected", "y_pred", "final_pred"), "spike_corrected_pred"),
        (final, ("y_pred", "y_fused", "final_pred"), "final_pred"),
    ):
        side = lookup(df, names, out)
        rows = rows.withColumn(out, F.lit(None).cast("double")) if side is None else rows.join(side, key, "left")
    rows = rows.withColumns(
        {
            "run_date": F.lit(run_date).cast("date"),
            "timestamp": clock.business_timestamp("forecast_date", "hour_business"),
            "target": F.lit(target),
            "y_true": F.lit(None).cast("double"),
            "period": clock.period_of("hour_business"),
            "available_data_cutoff": F.lit(cutoff),
            "pipeline_version": F.lit(version),
            "source_file": F.lit(source),
            "created_at": F.current_timestamp().cast("string"),
        }
    )
    return rows.select(*series, *fixed.LEDGER_COLUMNS)


def schema_errors(df: DataFrame, strict: bool = True) -> list[str]:
    """Missing columns, told by the schema alone."""
    want = fixed.LEDGER_COLUMNS if strict else fixed.LEDGER_REQUIRED
    missing = [c for c in want if c not in df.columns]
    return [f"missing columns: {missing}"] if missing else []


def quality(df: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """check_name, bad_rows per target from one grouped pass over keys and one over rows."""
    hour = F.col("hour_business")
    expected = clock.business_timestamp("forecast_date", "hour_business")
    nulls = {f"null_{c}": F.col(c).isNull() for c in fixed.LEDGER_REQUIRED if c in df.columns}
    conds = {
        "hour_out_of_range": ~F.coalesce(hour.between(1, 24), F.lit(False)),
        "bad_target": ~F.coalesce(F.col("target").isin(*fixed.TASKS), F.lit(False)),
        "bad_period": ~F.coalesce(F.col("period").isin(*fixed.PERIODS), F.lit(False)),
        "hour24_timestamp": (hour == 24) & ~F.col("timestamp").cast("timestamp_ntz").eqNullSafe(expected),
        **nulls,
    }
    key = list(dict.fromkeys([*by, *fixed.LEDGER_KEY]))
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(flag(c)).alias(n) for n, c in conds.items()])
    per_day = list(dict.fromkeys([*by, "run_date", "forecast_date", "model_name"]))
    daily = per_key.groupBy(*per_day).agg(
        F.sum("_n").alias("_rows"),
        F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("duplicate_key"),
        *[F.sum(n).alias(n) for n in conds],
    )
    total = daily.groupBy(*by).agg(
        F.sum(flag(F.col("_rows") != 24)).alias("days_not_24_rows"),
        F.sum("duplicate_key").alias("duplicate_key"),
        *[F.sum(n).alias(n) for n in conds],
    )
    names = ["days_not_24_rows", "duplicate_key", *conds]
    return total.select(
        *by, F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("bad_rows")) for n in names])).alias("_c")
    ).select(*by, "_c.*")


def missing_models(df: DataFrame, expected: Sequence[str], by: Sequence[str] = ("target", "forecast_date")) -> DataFrame:
    """Expected models without any row per group."""
    want = F.explode(F.array(*[F.lit(m) for m in expected]))
    return df.select(*by).distinct().withColumn("model_name", want).join(
        df.select(*by, "model_name").distinct(), [*by, "model_name"], "left_anti"
    )
