"""Bring any prediction or market table onto a column contract.

Every ``violations`` frame has the columns ``check_name, key, detail`` and is empty
when the input conforms; ``strict=True`` raises instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import clock
from ..functions.numeric import as_col, clean, clean_text, clip


def rename_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Rename known headers, ignoring case and outer blanks; existing names win."""
    lowered = {k.lower(): v for k, v in aliases.items()}
    taken, renames = set(df.columns), {}
    for c in df.columns:
        target = lowered.get(c.lstrip("﻿").strip().lower())
        if target and target not in taken:
            renames[c] = target
            taken.add(target)
    return df.withColumnsRenamed(renames) if renames else df


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; have {df.columns}")


def map_words(c: Column | str, words: Mapping[str, str], what: str = "value", strict: bool = False) -> Column:
    """Case-insensitive lookup; unknown words give null, or an error when strict."""
    text = F.lower(F.trim(as_col(c).cast("string")))
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    found = F.try_element_at(table, text)
    if not strict:
        return found
    return F.when(found.isNotNull(), found).otherwise(
        F.raise_error(F.concat(F.lit(f"unsupported {what}: "), F.coalesce(text, F.lit("null"))))
    )


def task_of(c: Column | str, strict: bool = False) -> Column:
    return map_words(c, fixed.TASK_WORDS, "task", strict)


def prediction_mode_of(c: Column | str, strict: bool = False) -> Column:
    return map_words(c, fixed.PREDICTION_MODE_WORDS, "prediction_mode", strict)


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def filled_clock(df: DataFrame, mode: str = "hour0") -> DataFrame:
    """Add or fill hour_business, business_day, target_day and period from ``ds``."""
    day, hour = clock.business_clock("ds", mode)
    have = df.columns
    df = df.withColumn(
        "hour_business",
        F.coalesce(clean("hour_business").cast("int"), hour) if "hour_business" in have else hour,
    )
    df = df.withColumn(
        "business_day", F.coalesce(F.col("business_day").cast("date"), day) if "business_day" in have else day
    )
    df = df.withColumn(
        "target_day",
        F.coalesce(F.col("target_day").cast("date"), F.col("business_day")) if "target_day" in have else F.col("business_day"),
    )
    inferred = clock.period_of("hour_business")
    return df.withColumn("period", F.coalesce(clean_text("period"), inferred) if "period" in have else inferred)


def _typed(df: DataFrame) -> DataFrame:
    cols = {
        "task": task_of("task"),
        "model_name": F.trim(F.col("model_name").cast("string")),
        "target_day": F.col("target_day").cast("date"),
        "ds": F.col("ds").cast("timestamp_ntz"),
        "hour_business": clean("hour_business").cast("int"),
        "y_pred": clean("y_pred"),
    }
    if "y_true" in df.columns:
        cols["y_true"] = clean("y_true")
    return df.withColumns({k: v for k, v in cols.items() if k in df.columns})


def violation(df: DataFrame, check: str, bad: Column, key: Column, detail: Column | None = None) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(False))).select(
        F.lit(check).alias("check_name"),
        key.cast("string").alias("key"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def violations(df: DataFrame, rules: Mapping[str, Column], key: Column) -> DataFrame:
    """All broken rules of all rows in one scan."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))
    return df.select(F.explode(hits).alias("check_name"), key.cast("string").alias("key"))


def _row_key(df: DataFrame) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in ("task", "model_name", "ds") if c in df.columns])


def prediction_rules() -> dict[str, Column]:
    return {
        "bad_task": F.col("task").isNull(),
        "bad_period": ~F.coalesce(F.col("period"), F.lit("")).isin(*fixed.PERIODS),
        "missing_y_true": F.col("y_true").isNull(),
        "missing_y_pred": F.col("y_pred").isNull(),
    }


def standardise_predictions(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Prediction contract: coerce, fill the period, split off offending rows."""
    require(df, fixed.PREDICTION_COLUMNS)
    out = _typed(df)
    out = out.withColumn("period", F.coalesce(clean_text("period"), clock.period_of("hour_business")))
    rules = prediction_rules()
    bad = violations(out, rules, _row_key(out))
    if strict:
        found = bad.groupBy("check_name").count().collect()
        if found:
            raise ValueError(f"prediction table violates: { {r['check_name']: r['count'] for r in found} }")
    ok = None
    for cond in rules.values():
        ok = ~cond if ok is None else ok & ~cond
    return out.where(ok), bad


OOF_CRITICAL = ("task", "model_name", "target_day", "ds", "period", "hour_business", "y_true", "y_pred")


def normalise_oof(df: DataFrame) -> DataFrame:
    """Out-of-fold contract: fill clock fields, drop rows null in a critical column, pad."""
    require(df, ("task", "model_name", "target_day", "ds", "y_true", "y_pred"))
    out = filled_clock(_typed(df)).na.drop(subset=list(OOF_CRITICAL))
    extra = [c for c in out.columns if c not in fixed.OOF_COLUMNS]
    return out.select(*pad(out, fixed.OOF_COLUMNS), *extra)


def normalise_forecast(df: DataFrame) -> DataFrame:
    """Forecast contract: as the out-of-fold one, but truth is optional and no row drops."""
    require(df, ("task", "model_name", "ds", "y_pred"))
    return filled_clock(_typed(df))


def pad(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]


def stamp_fold(df: DataFrame, task: str, model_name: str, fold: Mapping[str, object]) -> DataFrame:
    """Stamp fold fields on raw model output and project onto the 17 contract columns.

    Alias headers fill a contract column only where that column is absent.
    """
    for src, dst in fixed.LONG_TABLE_ALIASES.items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumn(dst, F.col(src))
    df = df.withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    day, hour = clock.business_clock("ds")
    df = df.withColumns({"hour_business": hour, "business_day": day}).withColumn("period", clock.period_of("hour_business"))
    stamps = {"task": task, "model_name": model_name, **fold}
    df = df.withColumns({k: F.lit(v) for k, v in stamps.items()})
    if "created_at" not in df.columns:
        df = df.withColumn("created_at", F.current_timestamp().cast("string"))
    return df.select(*pad(df, fixed.OOF_COLUMNS))


TAP_BLOCK_DAYS = 3


def normalise_tap(
    df: DataFrame,
    task: str | None = None,
    model_name: str | None = None,
    predict_date: str | None = None,
    by_business_day: bool = False,
    series: Sequence[str] = (),
) -> DataFrame:
    """Tap contract. ``df`` carries its fold's ``test_start`` and other bounds.

    Horizon and age count from the calendar date of ``ds`` as the compared
    results do, so hour 24 lands a day late; ``by_business_day`` repairs that.
    """
    for target, names in (("ds", ("timestamp", "datetime", "time", "date")),
                          ("y_pred", ("pred", "prediction", "y", "price_pred")),
                          ("y_true", ("actual", "y", "price", "price_actual"))):
        src = first_present(df, names)
        if target not in df.columns:
            df = df.withColumn(target, F.col(src) if src else F.lit(None))
    if task:
        df = df.withColumn("task", F.lit(task))
    if model_name:
        df = df.withColumn("model_name", F.lit(model_name))
    df = filled_clock(_typed(df))
    day = F.col("business_day") if by_business_day else F.to_date("ds")
    defaults = {
        "run_mode": F.lit("rolling_3day_validation_tap"),
        "created_at": F.current_timestamp().cast("string"),
        "tap_source": F.lit("rolling_cutoff"),
        "source_confidence": F.lit(1.0),
        "checkpoint_path": F.lit(""),
        "age_days": F.datediff(F.lit(predict_date).cast("date"), day) if predict_date else F.lit(-1),
        "y_true": F.lit(None).cast("double"),
    }
    df = df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})
    horizon = F.datediff(day, F.col("test_start").cast("date")) + 1
    df = df.withColumns(
        {
            "horizon_day": F.least(F.greatest(horizon, F.lit(1)), F.lit(TAP_BLOCK_DAYS)).cast("int"),
            "cutoff_date": F.col("train_end"),
            "source": F.col("model_name"),
        }
    )
    return df.select(*series, *[c for c in fixed.TAP_COLUMNS if c in df.columns])


def standardise_external(
    df: DataFrame,
    source_file: str | None = None,
    prediction_mode: str | None = None,
) -> DataFrame:
    """External contract: aliases, clock in both directions, modes, flags, period."""
    df = rename_aliases(df, fixed.EXTERNAL_ALIASES)
    if "timestamp" not in df.columns and {"business_day", "hour_business"} <= set(df.columns):
        hour = F.coalesce(clean("hour_business").cast("int"), F.lit(1))
        df = df.withColumn("timestamp", clock.business_timestamp("business_day", hour))
    if "timestamp" in df.columns:
        df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
        day, hour = clock.business_clock("timestamp", "exact_midnight")
        given = {"business_day", "hour_business"} <= set(df.columns)
        zero = (clean("hour_business") == 0) if given else F.lit(True)
        df = df.withColumns(
            {
                "business_day": F.when(zero, day).otherwise(F.col("business_day").cast("date")) if given else day,
                "hour_business": F.when(zero, hour).otherwise(
                    F.coalesce(clean("hour_business").cast("int"), F.lit(1))
                )
                if given
                else hour,
            }
        )
    mode = prediction_mode_of("prediction_mode") if "prediction_mode" in df.columns else F.lit(prediction_mode or "external")
    safe = F.lower(F.trim(F.col("leakage_safe").cast("string"))) if "leakage_safe" in df.columns else F.lit("true")
    df = df.withColumns({"prediction_mode": mode, "leakage_safe": safe})
    if source_file is not None and "source_file" not in df.columns:
        df = df.withColumn("source_file", F.lit(source_file))
    for c in ("y_pred", "y_true"):
        if c in df.columns:
            df = df.withColumn(c, clean(c))
    if "hour_business" in df.columns:
        inferred = clock.period_of("hour_business")
        df = df.withColumn("period", F.coalesce(clean_text("period"), inferred) if "period" in df.columns else inferred)
    return df


def external_violations(df: DataFrame, allow_duplicates: bool = False, series: Sequence[str] = ()) -> DataFrame:
    """check_name, key rows for every broken rule of the external contract."""
    missing = [c for c in fixed.EXTERNAL_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    key = [*series, "model_name", "business_day", "hour_business"]
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    rows = violations(
        df,
        {
            "leakage_unsafe": F.coalesce(F.lower(F.trim(F.col("leakage_safe").cast("string"))), F.lit("")) != "true",
            "bad_prediction_mode": ~F.coalesce(F.col("prediction_mode"), F.lit("")).isin(
                *sorted(set(fixed.PREDICTION_MODE_WORDS.values()))
            ),
            "bad_hour": ~F.coalesce(F.col("hour_business").between(1, 24), F.lit(False)),
        },
        text,
    )
    if allow_duplicates:
        return rows
    dupes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.unionByName(dupes.select(F.lit("duplicate_key").alias("check_name"), text.alias("key")))


def normalise_intraday_pack(df: DataFrame, source_path: str = "", series: Sequence[str] = ()) -> DataFrame:
    """Intraday contract with a default per missing column; hour_business is the target hour."""
    cols = []
    for name, default in fixed.INTRADAY_DEFAULTS.items():
        c = F.col(name) if name in df.columns else F.lit(default)
        if name == "business_day":
            c = c.cast("date")
        elif name in ("cutoff_hour", "target_hour"):
            c = F.coalesce(clean(c).cast("int"), F.lit(0))
        elif name in ("intraday_confidence", "fusion_weight"):
            c = F.coalesce(clean(c), F.lit(0.0))
        elif name == "shadow_only_flag":
            c = F.coalesce(c.cast("boolean"), F.lit(False))
        elif name in ("y_true", "baseline_error", "corrected_error"):
            c = clean(c)
        cols.append(c.alias(name))
    hour = first_present(df, ("target_hour", "hour_business"))
    cols.append(F.coalesce(clean(hour).cast("int"), F.lit(0)).alias("hour_business") if hour else F.lit(0).alias("hour_business"))
    return df.select(*series, *cols, F.lit(source_path).alias("source_pack_path"))


LEAK_WORDS = ("actual", "实际", "target", "label", "y_true")


def drop_leaking_columns(df: DataFrame, words: Sequence[str] = LEAK_WORDS, keep: Sequence[str] = ()) -> DataFrame:
    """Drop every column whose name tells of outcomes."""
    bad = [c for c in df.columns if c not in keep and any(w in c.lower() for w in words)]
    return df.drop(*bad)


def feature_manifest(columns: Sequence[str]) -> list[tuple[str, str]]:
    """(feature, source family) by name prefix."""
    families = (("feat_", "forecast"), ("hist_", "actual_history"), ("delta_", "delta_history"),
                ("tf_", "moving_average"), ("group_", "static_group"), ("da_", "price"), ("rt_", "price"))
    return [(c, next((f for p, f in families if c.startswith(p)), "calendar")) for c in columns]


def informative_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """feature, varied: numeric columns with more than one distinct value.

    Min against max answers the question with two mergeable values per column.
    """
    stats = df.groupBy(*keys).agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in columns])
    return stats.select(
        *keys,
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"{c}.a") != F.col(f"{c}.b"), F.lit(False)).alias("varied")) for c in columns]
            )
        ).alias("_s"),
    ).select(*keys, "_s.feature", "_s.varied")


def months_back(df: DataFrame, cutoff: str, months: int, ts: str = "ds") -> DataFrame:
    """Rows of the last ``months`` months up to and including the cutoff."""
    end = F.lit(cutoff).cast("timestamp_ntz")
    start = end - F.make_ym_interval(months=F.lit(months))
    return df.where((F.col(ts) >= start) & (F.col(ts) <= end))


def between_times(df: DataFrame, start: str, end: str, ts: str = "ds") -> DataFrame:
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def month_bounds(day: Column | str) -> tuple[Column, Column]:
    d = as_col(day).cast("date")
    return F.trunc(d, "month"), F.last_day(d)


def day_chunks(start: Column | str, end: Column | str, days: int) -> Column:
    """Array of (chunk_start, chunk_end) covering an inclusive date range."""
    a, b = as_col(start).cast("date"), as_col(end).cast("date")
    starts = F.sequence(a, b, F.make_dt_interval(days=F.lit(days)))
    return F.transform(
        starts, lambda s: F.struct(s.alias("chunk_start"), F.least(F.date_add(s, days - 1), b).alias("chunk_end"))
    )
