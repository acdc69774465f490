"""Session helpers. The library itself never creates a session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "hourpanel") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_DIR: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests, bench) gets a temporary
    folder, one per application; on a cluster it would not be shared, so there
    the setting is required.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root
    master = spark.sparkContext.master
    if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN_DIR[app]


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables that this application wrote; results that still read them must be done."""
    jvm = spark._jvm
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    Unlike a local checkpoint this survives the loss of an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster where it is not installed."""
    import os
    import shutil

    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), os.path.basename(here))
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
