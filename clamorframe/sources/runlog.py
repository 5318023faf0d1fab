"""A log of samples that a stopped run leaves usable: whole batches, a manifest of those that are committed, and a summary only at the end.

``path/samples/<batch>`` holds a batch's JSON lines; ``path/manifest/<batch>`` is made when they are all there, by a rename,
so readers see a batch whole or not at all. A batch of the same id is written over until it is committed and left alone
afterwards; so a job may be run again at any time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, delete

__all__ = ["append", "batches", "committed", "cut", "finish", "recover", "rest", "rows", "run", "summary"]


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    files, target = _path(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []


def committed(spark: SparkSession, path: str) -> list[str]:
    """Ids of the committed batches, in the order in which they were appended."""
    return [x for x in _names(spark, f"{path}/manifest") if not x.startswith((".", "_"))]


def recover(spark: SparkSession, path: str) -> list[str]:
    """Deletes batches that a stopped run left uncommitted, and returns their ids. Not while another run is writing."""
    left = sorted(set(_names(spark, f"{path}/samples")) - set(committed(spark, path)))
    for batch in left:
        delete(spark, f"{path}/samples/{batch}")
    return left


def append(samples: DataFrame, path: str, batch: str | None = None) -> str:
    """Writes and commits one batch; its id is the next number, or the one given. A batch that is committed already stays as it is."""
    spark = samples.sparkSession
    done = committed(spark, path)
    batch = batch or f"{len(done):08d}"
    if batch in done:
        return batch
    samples.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/samples/{batch}")
    files, mark = _path(spark, f"{path}/manifest/{batch}")
    _, draft = _path(spark, f"{path}/manifest/.{batch}")
    files.mkdirs(mark.getParent())
    files.create(draft, True).close()
    if not files.rename(draft, mark):
        raise OSError(f"batch {batch} of {path} could not be committed")
    return batch


def rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The samples of all committed batches."""
    done = committed(spark, path)
    return spark.read.schema(schema).json([f"{path}/samples/{b}" for b in done]) if done else spark.createDataFrame([], schema)


def rest(rows_wanted: DataFrame, path: str, key: str) -> DataFrame:
    """The rows whose key no committed sample has; a null key is never committed."""
    spark = rows_wanted.sparkSession
    kind = rows_wanted.select(key).schema[0].dataType.simpleString()
    return rows_wanted.join(rows(spark, path, f"`{key}` {kind}").distinct(), key, "left_anti")


def batches(rows_wanted: DataFrame, order: str, n: int) -> list[DataFrame]:
    """``rows_wanted`` in ``n`` parts along a numeric order, each all rows of a range; a null comes last."""
    edges = rows_wanted.agg(F.percentile_approx(order, [i / n for i in range(1, n)] or [1.0], 10_000)).first()[0] or []
    edges = sorted(set(edges[: n - 1]))
    value = F.col(order)
    tests: list[Column] = []
    for k in range(len(edges) + 1):
        test = F.lit(True) if not edges else value <= edges[0] if k == 0 else value.isNull() | (value > edges[-1]) if k == len(edges) else (value > edges[k - 1]) & (value <= edges[k])
        tests.append(test)
    return [rows_wanted.where(t) for t in tests]


def run(rows_wanted: DataFrame, evaluate: Callable[[DataFrame], DataFrame], path: str, key: str, order: str, n: int = 8) -> int:
    """Evaluates what the log lacks, batch by batch along ``order``, and returns how many batches it added.

    ``evaluate`` returns a sample for each row, with its key. A run that ends early leaves the batches before, which are all
    the rows up to some place but for what earlier runs had; the next one goes on behind them.
    """
    spark = rows_wanted.sparkSession
    recover(spark, path)
    todo = cut(rest(rows_wanted, path, key), "todo")
    added = 0
    for part in batches(todo, order, n):
        if not part.isEmpty():
            append(evaluate(part), path)
            added += 1
    return added


def finish(summary_rows: DataFrame, rows_wanted: DataFrame, path: str, key: str) -> None:
    """Writes the summary, only if every row is in the log; it replaces an earlier one."""
    left = rest(rows_wanted, path, key).count()
    if left:
        raise ValueError(f"{left} rows are not in the log at {path}: no summary")
    summary_rows.withColumn("type", F.lit("summary")).write.mode("overwrite").json(f"{path}/summary")


def summary(spark: SparkSession, path: str) -> DataFrame | None:
    """The summary; None while the run is not complete."""
    return spark.read.json(f"{path}/summary") if _names(spark, f"{path}/summary") else None
