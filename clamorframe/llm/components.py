"""Connected components of an edge table by alternating stars, each round cut to a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for each node that is not that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        while (further := new[new]).tolist() != new.tolist() if len(new) < 64 else not np.array_equal(further := new[new], new):
            new = further
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's edges to stars around the smallest nodes: as connected, and never more edges than nodes."""
    for batch in batches:
        if batch.num_rows:
            u, v = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (u, v), both long and not null: root is the smallest node reachable; nodes that are roots are left out."""
    spark = edges.sparkSession
    now = common.cut(edges.select("u", "v").mapInArrow(_contract, "u long, v long").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # read from tables, so that the joins' inputs are plain exchanges and Spark can split a hub's rows
        least = common.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # u > v in each row
        large = common.cut(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = common.cut(small, "edges")
        found = new.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        for old in (now, least, large):
            common.drop_cut(old)
        now = new
        common.release_shuffles(spark)
        if mark == tuple(found) or not found["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(found)
