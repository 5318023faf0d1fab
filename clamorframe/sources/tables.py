"""Reading and writing datasets and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import KINDS


def ensure_columns(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``rows`` with the columns it lacks, each with its default."""
    return rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in rows.columns})


def check_kinds(kinds: list[str]) -> list[str]:
    unknown = [k for k in kinds if k not in KINDS]
    if unknown or not kinds:
        raise ValueError(f"unknown kinds {unknown}; they are {KINDS}")
    return kinds


def dataset(spark: SparkSession, path: str, split: str, kinds: list[str] = KINDS, limit: int = -1, order: str = "id") -> DataFrame:
    """A split's rows of the kinds, then the first ``limit`` in order; all for -1. An unknown kind in a row is an error."""
    check_kinds(kinds)
    rows = spark.read.parquet(path).where(F.col("split") == split)
    bad = ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    rows = rows.withColumn("kind", F.when(bad, F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null"))))).otherwise(F.col("kind")))
    rows = rows.where(F.col("kind").isin(*kinds))
    return rows.orderBy(order).limit(limit) if limit >= 0 else rows


def write_dataset(rows: DataFrame, path: str) -> None:
    """Parquet, a folder a split."""
    rows.write.partitionBy("split").mode("overwrite").parquet(path)


def write_rows_json(rows: DataFrame, path: str) -> None:
    """JSON lines, a folder a split, without the audio."""
    rows.drop("audio").write.partitionBy("split").mode("overwrite").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log in one file or many, as (line, value), for ``jsonl``; ``line`` orders by file name, then place in the file."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("line"))
    return lines.where(F.trim("value") != "").select("line", "value")


def of_rate(rows: DataFrame, rate: int, column: str = "sampling_rate") -> tuple[DataFrame, DataFrame]:
    """Signals of the rate, and those that are turned away, as they are not resampled; an unknown rate is turned away."""
    fits = F.coalesce(F.col(column) == rate, F.lit(False))
    return rows.where(fits), rows.where(~fits)


def write_sweep(rows: DataFrame, path: str, band: str = "band") -> None:
    """A line for each n and band in order; their number does not grow with the data."""
    rows.orderBy("n_best", band).coalesce(1).write.mode("overwrite").json(path)
