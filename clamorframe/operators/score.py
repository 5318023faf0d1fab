"""Scoring: matrix lookup, means by kind, harmonic means, confusion and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Score by matrix, kind and judged type.
KINDS = ["answer", "repair", "repeat"]
JUDGED = ["answer", "repair", "repair_off", "repeat", "bad"]
MATRICES = {
    "legacy": {
        "answer": {"answer": 1.0, "repair": 0.0, "repeat": 0.0, "bad": 0.0},
        "repair": {"answer": 1.0, "repair": 1.0, "repeat": 0.5, "bad": 0.0},
        "repeat": {"answer": 1.0, "repair": 0.5, "repeat": 1.0, "bad": 0.0},
    },
    "tree": {
        "answer": {"answer": 1.0, "repair": 0.0, "repair_off": 0.0, "repeat": 0.0, "bad": 0.0},
        "repair": {"answer": 1.0, "repair": 1.0, "repair_off": 0.0, "repeat": 0.5, "bad": 0.0},
        "repeat": {"answer": 1.0, "repair": 0.0, "repair_off": 0.0, "repeat": 1.0, "bad": 0.0},
    },
}
# End of fixed values.


def score_of(kind: Column, judged: Column, matrix: str) -> Column:
    """The matrix cell, as one literal map of 15 entries at most; null where the matrix has none."""
    cells = [(f"{k}/{t}", s) for k, row in MATRICES[matrix].items() for t, s in row.items()]
    return F.try_element_at(F.create_map(*(F.lit(x) for c in cells for x in c)), F.concat_ws("/", kind, judged))


def harmonic(*values: Column) -> Column:
    """0 if a value is 0, else n over the sum of reciprocals."""
    inverse = reduce(lambda a, b: a + b, (F.try_divide(F.lit(1.0), v) for v in values))
    return F.when(F.least(*values) == 0, F.lit(0.0)).otherwise(F.lit(float(len(values))) / inverse)


def kind_means(rows: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """One row: mean score of each requested kind (0 without rows), and their harmonic mean."""
    means = rows.agg(*(F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in kinds))
    return means.select(*(F.round(k, 6).alias(f"mean_{k}") for k in kinds), F.round(harmonic(*map(F.col, kinds)), 6).alias("ear"))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts by kind and judged type, a column a type."""
    return rows.groupBy("kind").pivot("judged", JUDGED).count().na.fill(0)


def grid(spark: SparkSession, **sides: list) -> DataFrame:
    """All combinations of a few fixed values, as a literal table."""
    rows = [()]
    for values in sides.values():
        rows = [(*r, v) for r in rows for v in values]
    return spark.createDataFrame(rows, list(sides))
