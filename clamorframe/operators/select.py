"""Selection that depends on order: first rows, caps, claims and quotas. Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def cap_kinds(rows: DataFrame, caps: dict[str, int], order: str) -> DataFrame:
    """The first rows of each listed kind, all of the others."""
    limit = F.try_element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("kind"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(order))
    return rows.withColumn("_rank", rank).where(limit.isNull() | (F.col("_rank") <= limit)).drop("_rank")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def quota(rows: DataFrame, good: Column, n: int, order: str) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows that are good, and the claimed rows: all up to the last of them, or every row where there are fewer."""
    kept = rows.where(good).orderBy(order).limit(n)
    last = kept.agg(F.when(F.count("*") >= n, F.max(order)).alias("_last"))  # one row
    claimed = rows.join(F.broadcast(last), F.col("_last").isNull() | (F.col(order) <= F.col("_last"))).drop("_last")
    return kept, claimed


def bins(x: Column, edges: list[float]) -> Column:
    """The bin of a value among equal bins, both ends clipped."""
    n = len(edges) - 1
    return F.least(F.greatest(F.width_bucket(x, F.lit(edges[0]), F.lit(edges[-1]), F.lit(n)), F.lit(1)), F.lit(n)) - 1


def draw(purpose: str, *keys: Column) -> Column:
    """A number in [0, 1) from a seed, what it is for and the keys; the same however rows are partitioned."""
    digest = F.md5(F.concat_ws(":", F.lit(purpose), *(k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
