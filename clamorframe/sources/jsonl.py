"""JSON-lines logs: samples, then one summary of another shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_with(lines: DataFrame, field: str, value: str = "value", order: str = "line") -> DataFrame:
    """The last line whose object has ``field``, null as its value included; blank and broken lines are passed over."""
    has = F.coalesce(F.array_contains(F.json_object_keys(F.col(value)), field), F.lit(False))
    return lines.where(has).agg(F.max_by(value, order).alias(value))


def samples(rows: DataFrame) -> DataFrame:
    """All rows but summaries."""
    return rows.where(F.coalesce(F.col("type"), F.lit("")) != "summary")
