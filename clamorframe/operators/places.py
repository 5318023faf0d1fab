"""Places in an order over all rows, and draws by place, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: monotonically_increasing_id has the partition above these bits and the place in it below.
_BITS = 33


def placed(rows: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in ``order``, which must not leave two rows equal that differ.

    Rows are sorted by ranges into a table; a count of each partition, summed up over the partitions before it, is added to
    the place within. An empty table stays empty.
    """
    ordered = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", _BITS)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return ordered.join(F.broadcast(sizes), part == F.col("_part")).withColumn(name, F.col("_before") + inside).drop("_at", "_part", "_before")


def sequence_draw(purpose: str, place: Column) -> Column:
    """The draw number ``place`` of one sequence, in [0, 1): what a shared generator gives its rows in turn."""
    from .select import draw

    return draw(purpose, place)


def sweep(items: DataFrame, order: list[str | Column], bands: dict[str, tuple[float, float]], seed: int = 42) -> DataFrame:
    """Each item in each band with a level in it, to one decimal: bands in their order, and in a band items in theirs, draw from one sequence."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_b"), F.lit(b).alias("band"), F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi")) for i, (b, (lo, hi)) in enumerate(bands.items()))))
    whole = placed(items, order, "_i")
    n = whole.agg(F.count("*").alias("_all"))  # one row
    rows = whole.crossJoin(F.broadcast(n)).select("*", each.alias("_x")).select("*", "_x.*")
    rows = rows.withColumn("draw", F.col("_b") * F.col("_all") + F.col("_i"))
    u = sequence_draw(f"{seed}:sweep", F.col("draw"))
    return rows.withColumn("snr_db", F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * u, 1)).drop("_x", "_b", "_lo", "_hi", "_i", "_all")
