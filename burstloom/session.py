"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with UTC time and adaptive execution; on a cluster the submitted settings win."""
    return (
        SparkSession.builder.master(master)
        .appName("burstloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; an own one where it is unset and the session runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = getattr(spark, "_burstloom_dir", None) or tempfile.mkdtemp(prefix="burstloom-")
        spark._burstloom_dir = found
    return found.rstrip("/")


_LEFT: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass
    _LEFT.pop(path, None)


def _sweep() -> None:
    for path, spark in list(_LEFT.items()):
        _delete(spark, path)


atexit.register(_sweep)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is deleted when the session's process ends."""
    path = f"{shared_dir(spark)}/burstloom-{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


class _Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def drop(self) -> None:
        _delete(self.spark, self.path)


def local_scratch(spark: SparkSession, name: str) -> _Folder | None:
    """A new folder in the shared one for arrays that tasks map into memory; None where the shared folder is no path of the machines."""
    path = re.sub(r"^file:/+", "/", scratch(spark, name))
    if not path.startswith("/") or not re.match(r"file:/|(?![a-zA-Z][\w+.-]*:)", spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")):
        return None
    os.makedirs(path)
    _LEFT[path] = spark
    return _Folder(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/burstloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _LEFT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._burstloom_path = path
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of jobs that are over: they stay until the driver collects its garbage, and a moment after."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def release(*frames: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that no later step reads."""
    for df in frames:
        path = getattr(df, "_burstloom_path", None)
        if path:
            _delete(df.sparkSession, path)
