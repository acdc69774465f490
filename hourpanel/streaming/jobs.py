"""Ledger and intraday ingest as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import fixed
from ..operators import dedupe, ledger
from ..sources.versions import VersionedTable

INTRADAY_PARTS = ("business_day",)


def read_directory(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a directory (or glob) as a stream with a bounded batch size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ledger_ingest(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    event_time: str = "event_time",
    key: Sequence[str] = fixed.LEDGER_KEY,
    force: bool = False,
) -> StreamingQuery:
    """Append a stream of ledger rows, one per key, however late they come.

    A batch is reduced to one row per key (the earliest event, then the smallest values), and the append skips keys that
    the table has, null days included. So no state is kept, no row is dropped for its age, and a replayed batch changes
    nothing: the table's log knows the batches of this checkpoint, and the keys of any other run. Read the table with
    ``ledger.read_table``. ``checkpoint`` must be the same folder at every start of the job.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = dedupe.keep_one(batch, list(key), [event_time, *[c for c in batch.columns if c not in (*key, event_time)]], last=False).drop(event_time)
        ledger.append_to_table(batch.sparkSession, path, once, force, key, checkpoint, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intraday_latest(
    pack: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("business_day", "target_hour"),
    tie: Sequence[str] = (),
) -> StreamingQuery:
    """Keep the highest cutoff per key in a versioned table of one partition per day; read it with ``read_intraday``.

    Each batch is reduced by itself and merged with the partitions of its days. The merged days are published as a whole or
    not at all, and the table's log knows the batches of this checkpoint, so a batch that is run again after any
    interruption neither loses nor doubles a row. ``checkpoint`` must be the same folder at every start of the job.
    """
    order = ["cutoff_hour", *tie]

    def merge(batch: DataFrame, number: int) -> None:
        fresh = dedupe.keep_one(batch, keys, order, last=True)
        table = VersionedTable(batch.sparkSession, path, INTRADAY_PARTS)
        table.merge(fresh, lambda old, new: dedupe.keep_one(old.unionByName(new), keys, order, last=True), True, checkpoint, number)

    return (
        pack.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_intraday(spark: SparkSession, path: str) -> DataFrame:
    """The intraday table as last published."""
    return VersionedTable(spark, path, INTRADAY_PARTS).read()


def intraday_state(pack: DataFrame, keys: Sequence[str], value: str, event_time: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Streaming aggregate with the value of the highest cutoff per key and event-time window, for update mode."""
    timed = pack.withWatermark(event_time, late)
    return timed.groupBy(F.window(event_time, window), *keys).agg(
        F.max("cutoff_hour").alias("cutoff_hour"), F.max_by(value, F.struct("cutoff_hour", event_time)).alias(value)
    )
