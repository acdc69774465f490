"""Writers. Parquet partitions replace folders named by date and target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_daily(df: DataFrame, path: str, partitions: Sequence[str] = ("run_date", "target"), fmt: str = "parquet", bom: bool = False) -> None:
    """Replace just the partitions present in ``df``.

    ``bom`` starts every CSV file with a byte order mark (utf-8-sig): the header is the first line of each file, so the
    mark goes before its first name. ``tables.read_csv`` takes it off again.

    Rows are spread by partition and a hash of the row position within AQE's
    advisory size, so one hot date does not become a single writer task.
    """
    if bom and fmt != "csv":
        raise ValueError("only CSV files start with a byte order mark")
    if bom:
        head = next(c for c in df.columns if c not in partitions)
        df = df.withColumnRenamed(head, f"\ufeff{head}")
    out = df.hint("rebalance", *partitions)
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    if fmt == "csv":
        w = w.option("header", True).option("encoding", "UTF-8")
    w.format(fmt).save(path)
