"""Readers for market and prediction tables."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import clock
from ..functions.numeric import clean
from ..operators import dedupe, normalize, rowblocks

# Encodings tried in turn.
ENCODINGS = ("utf-8", "gbk", "gb18030")
REPLACEMENT = "�"


UNDECODABLE = "undecodable"


class UndecodableFiles(ValueError):
    """Files that none of ``ENCODINGS`` decodes."""

    def __init__(self, files: Sequence[str]) -> None:
        super().__init__(f"none of {', '.join(ENCODINGS)} decodes {', '.join(files)}")
        self.files = list(files)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str | None = None,
    schema: T.StructType | None = None,
    skip_bad_lines: bool = False,
    undecodable: str = "error",
) -> DataFrame:
    """CSV with a header, all columns text unless a schema is given.

    Without ``encoding`` every file gets the first one of ``ENCODINGS`` that decodes all of its lines, and files of
    different encodings are read apart and put together by column name. Files that none decodes are refused by name
    (``UndecodableFiles``), or left out if ``undecodable`` is "skip"; ``file_encodings`` lists them under ``UNDECODABLE``.
    """
    if undecodable not in ("error", "skip"):
        raise ValueError(f"unknown rule {undecodable!r}; one of error, skip")
    if encoding is None:
        found = file_encodings(spark, path)
        broken = found.pop(UNDECODABLE, [])
        if broken and (undecodable == "error" or not found):
            raise UndecodableFiles(broken)
        parts = [read_csv(spark, files, enc, schema, skip_bad_lines) for enc, files in sorted(found.items())]
        if not parts:
            return read_csv(spark, path, ENCODINGS[0], schema, skip_bad_lines)
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED" if skip_bad_lines else "PERMISSIVE")
    if encoding.lower() in NATIVE_ENCODINGS:
        reader = reader.option("encoding", encoding)
    else:
        # Single-byte read keeps every byte; no byte of a multi-byte character is a comma, quote or line end.
        reader = reader.option("encoding", "ISO-8859-1").option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if encoding.lower() not in NATIVE_ENCODINGS:
        df = _decode_text(df, encoding)
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})


def file_encodings(spark: SparkSession, path: str | Sequence[str]) -> dict[str, list[str]]:
    """Files by encoding, judged on every line. Lines are the unit of work, so a large file is read by many tasks; the
    driver gets one row per file, as it does when it lists them."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw"))
    first = lines.groupBy("file").agg(F.min(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"))

    @F.pandas_udf("int")
    def failing(raw: pd.Series) -> pd.Series:
        def bits(line: bytes) -> int:
            out = 0
            for i, enc in enumerate(ENCODINGS[1:]):
                try:
                    line.decode(enc)
                except UnicodeDecodeError:
                    out |= 1 << i
            return out

        return raw.map(bits)

    found: dict[str, list[str]] = {}
    other = []
    for r in first.collect():
        (found.setdefault(ENCODINGS[0], []) if r["utf8"] else other).append(r["file"])
    if other:
        rest = spark.read.text(other).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw"))
        for r in rest.groupBy("file").agg(F.bit_or(failing("raw")).alias("failing")).collect():
            good = [enc for i, enc in enumerate(ENCODINGS[1:]) if not r["failing"] >> i & 1]
            found.setdefault(good[0] if good else UNDECODABLE, []).append(r["file"])
    return {enc: sorted(files) for enc, files in found.items()}


NATIVE_ENCODINGS = ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32")


def _decode_text(df: DataFrame, encoding: str) -> DataFrame:
    """Turn single-byte text back into its bytes and decode them, in Arrow batches."""
    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None else v.encode("iso-8859-1").decode(encoding, "replace"))

    names = {c: c.encode("iso-8859-1", "ignore").decode(encoding, "replace") for c in df.columns}
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: decode(F.col(f"`{c}`")) for c in text}).withColumnsRenamed(names)


def load_market(
    df: DataFrame,
    exogenous: Sequence[str] = (),
    series: Sequence[str] = (),
    required: Sequence[str] = ("ds",),
    aliases: Mapping[str, str] = fixed.MARKET_ALIASES,
    order: Sequence[str] = (),
    keep: str = "last",
) -> DataFrame:
    """Rename, require, coerce, one row per timestamp, fill exogenous gaps forward then 0.

    ``order`` names the columns of the input order (ingest time, file, position); the ``keep`` ("first" or "last") row by
    them stays. Values only break ties.
    """
    df = normalize.rename_aliases(df, aliases)
    normalize.require(df, [*required, *exogenous])
    numeric = [c for c in df.columns if c in fixed.MARKET_COLUMNS[1:] or c in exogenous]
    df = df.withColumns({"ds": F.col("ds").try_cast("timestamp_ntz"), **{c: clean(c) for c in numeric}})
    df = df.where(F.col("ds").isNotNull())
    df = dedupe.keep_one(df, [*series, "ds"], [*order, *numeric] or ["ds"], last=keep == "last")
    if not exogenous:
        return df
    keys = list(series)
    if not keys:
        df, keys = df.withColumn("_one", F.lit(0)), ["_one"]
    filled = rowblocks.forward_fill(df, keys, {c: F.col(c) for c in exogenous})
    return filled.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in exogenous}).drop("_one")


def read_database(
    spark: SparkSession,
    table: str,
    columns: Mapping[str, str],
    url: str | None = None,
    properties: Mapping[str, str] | None = None,
    partition: tuple[str, str, str, int] | None = None,
) -> DataFrame:
    """Aliased columns of one table, over JDBC (``url``) or from the catalog.

    ``partition`` is (column, lower, upper, parts) for a parallel JDBC read;
    projection is pushed into the source either way.
    """
    if url:
        extra = {}
        if partition:
            extra = dict(zip(("column", "lowerBound", "upperBound", "numPartitions"), partition))
        df = spark.read.jdbc(url, table, properties=dict(properties or {}), **extra)
    else:
        df = spark.table(table)
    return df.select(*[F.col(src).alias(dst) for src, dst in columns.items()])


TIME_CANDIDATES = ("ds", "timestamp", "时刻", "datetime", "time")
PREDICTION_CANDIDATES = ("y_pred", "pred_y", "prediction", "预测值", "predictions", "pred", "price", "y_fused")


def ensure_prediction_frame(df: DataFrame, prediction_column: str | None = None) -> DataFrame:
    """(ds, y_pred) from any frame with a time column and a prediction column."""
    ts = normalize.first_present(df, TIME_CANDIDATES)
    if ts is None:
        raise ValueError(f"no time column among {df.columns}")
    pred = prediction_column or normalize.first_present(df, PREDICTION_CANDIDATES)
    if pred is None:
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        if not numeric:
            raise ValueError(f"no prediction column among {df.columns}")
        pred = numeric[0]
    rest = [c for c in df.columns if c not in (ts, pred, "ds", "y_pred")]
    return df.select(F.col(ts).cast("timestamp_ntz").alias("ds"), clean(pred).alias("y_pred"), *rest)


def scan_daily(spark: SparkSession, path_glob: str, date_pattern: str = r"(\d{4}-\d{2}-\d{2})", fmt: str = "csv") -> DataFrame:
    """All daily output files as one table; ``run_day`` comes from the path, not from a listing loop."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path_glob)
    return df.withColumn("source_file", F.col("_metadata.file_path")).withColumn(
        "run_day", F.to_date(F.regexp_extract("source_file", date_pattern, 1))
    )


def day_spine(df: DataFrame, by: Sequence[str], start: str, end: str, day: str = "business_day") -> DataFrame:
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.select(*by).distinct().withColumn(day, F.explode(days))


def coverage_gaps(df: DataFrame, by: Sequence[str], start: str, end: str, day: str = "business_day") -> DataFrame:
    """Days of the range without any row per ``by``."""
    return day_spine(df, by, start, end, day).join(df.select(*by, day).distinct(), [*by, day], "left_anti")


def coverage_report(df: DataFrame, by: Sequence[str], day: str = "business_day", rows_per_day: int = 24) -> DataFrame:
    """Rows, days and complete days per ``by``."""
    daily = df.groupBy(*by, day).agg(F.count(F.lit(1)).alias("_n"))
    return daily.groupBy(*by).agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("days"),
        F.count(F.when(F.col("_n") >= rows_per_day, 1)).alias("complete_days"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )


def data_coverage(df: DataFrame, by: Sequence[str] = (), ts: str = "ds") -> DataFrame:
    """Latest timestamp, last complete business day, and the day every model can form."""
    top, day = F.col("latest_ts"), F.to_date(F.col("latest_ts"))
    return df.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("latest_ts")).withColumns(
        {
            "latest_complete_day": F.when(F.hour(top) == 0, F.date_sub(day, 1)).otherwise(day),
            "latest_safe_day": F.when(F.hour(top) == 0, F.date_sub(day, 3))
            .when(F.hour(top) == 23, day)
            .otherwise(F.date_sub(day, 1)),
        }
    )


def covers_range(df: DataFrame, start: str, end: str, by: Sequence[str] = (), ts: str = "ds") -> DataFrame:
    """Does the data span (start 01:00 … end + 1 day 00:00)?"""
    need_a = clock.business_timestamp(F.lit(start), F.lit(1))
    need_b = clock.business_timestamp(F.lit(end), F.lit(24))
    return df.groupBy(*by).agg(F.min(ts).alias("data_start"), F.max(ts).alias("data_end")).withColumn(
        "covers", (F.col("data_start") <= need_a) & (F.col("data_end") >= need_b)
    )
