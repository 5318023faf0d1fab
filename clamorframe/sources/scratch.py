"""Tables that are written on the way, in a folder that the driver and all executors share: lineage ends there, and lost tasks read them again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where none is set and all tasks run in this process."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="clamorframe-")
    context.setCheckpointDir(own)
    return own


def cut(rows: DataFrame, label: str = "rows") -> DataFrame:
    """``rows``, written and read again."""
    spark = rows.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(rows.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return
