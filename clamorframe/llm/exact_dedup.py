"""Exact dedup by distributed MSD radix partitioning.

A group is documents that agree in all bytes so far; its number is its smallest row key. The first digit is
the length and the first bytes, so that all documents of a group end together; each later digit is the next
bytes, eight times as many. A group of one document is done at once, and a group that has ended holds equal
texts: bytes were compared, no digest. Only documents of open groups carry their text into the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FIRST_DIGIT, WIDER = 32, 8
WHITE = b" \t\n\x0b\x0c\r"


def _first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        texts = [(x or "").encode().translate(None, WHITE) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(x) for x in texts], pa.int64()), pa.array([x[:FIRST_DIGIT] for x in texts], pa.binary())], names=["_row", "_bytes", "_digit"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, most=16 << 20):
        data, offsets = common.utf8(batch.column(2))
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        raw = data.tobytes()
        texts = [raw[a:b].translate(None, WHITE) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(np.diff(points)), pa.array([len(x) for x in texts], pa.int64()), pa.array([x[:FIRST_DIGIT] for x in texts], pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array([x[FIRST_DIGIT:] for x in texts], pa.binary()),
            ],
            names=["doc_id", "_row", "_points", "_bytes", "_digit", "text_sha256", "_rest"],
        )


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, _row, _points (code points of the text), text_sha256, _group: null for a text that no other equals."""
    spark = docs.sparkSession
    doc = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_row", "text")
    heads = doc.mapInArrow(_first_digits, "_row long, _bytes long, _digit binary")
    shared = heads.groupBy("_bytes", "_digit").agg(F.min("_row").alias("_group"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    shared = common.cut(shared, "shared")
    whole = doc.mapInArrow(_whole, "doc_id long, _row long, _points long, _bytes long, _digit binary, text_sha256 string, _rest binary")
    state = whole.join(shared.hint("merge"), ["_bytes", "_digit"], "left")
    is_open = F.col("_group").isNotNull() & (F.col("_bytes") > FIRST_DIGIT)
    state = common.cut(state.select("doc_id", "_row", "_points", "text_sha256", "_bytes", "_group", F.when(is_open, F.col("_rest")).alias("_rest")), "radix")
    done = [state.where("_rest is null").drop("_rest", "_bytes")]
    at, width = FIRST_DIGIT, FIRST_DIGIT
    while not state.where("_rest is not null").isEmpty():
        common.release_shuffles(spark)
        width *= WIDER
        at += width
        live = state.where("_rest is not null").withColumn("_digit", F.substring("_rest", 1, width))
        parts = live.groupBy("_group", "_digit").agg(F.min("_row").alias("_next"), F.count("*").alias("_n"))
        split = live.join(common.cut(parts, "parts").hint("merge"), ["_group", "_digit"])
        is_open = (F.col("_n") > 1) & (F.col("_bytes") > at)
        state = common.cut(
            split.select("doc_id", "_row", "_points", "text_sha256", "_bytes", F.when(F.col("_n") > 1, F.col("_next")).alias("_group"), F.when(is_open, F.substring("_rest", width + 1, 2**31 - 1)).alias("_rest")),
            "radix",
        )
        done.append(state.where("_rest is null").drop("_rest", "_bytes"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and _row, its key in this table.

    Texts are equal when they are so without white space; null counts as empty, and empty texts are equal.
    Of equal texts the row with the most code points stays, then the one with the smallest doc_id (null last),
    then, of repeated rows, the first. An empty table gives an empty result; other columns are not read.
    """
    rows = groups(docs)
    order = F.struct("_points", F.bitwise_not("doc_id").alias("d"), F.bitwise_not("_row").alias("r"))
    best = rows.where("_group is not null").groupBy("_group").agg(F.count("*").alias("_size"), F.max(order).alias("_best"))
    alone = F.col("_group").isNull()
    best = common.cut(best, "best").withColumnRenamed("_group", "_key")
    # those alone have keys of their own, below all groups, so that nulls do not meet in one task
    joined = rows.withColumn("_key", F.coalesce("_group", -1 - F.col("_row"))).join(best.hint("merge"), "_key", "left")
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.bitwise_not("_best.d")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.bitwise_not("_best.r") == F.col("_row"))).alias("kept"),
        "text_sha256",
        "_row",
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns."""
    kept = exact_dedup(docs).where("kept").select("_row")
    return common.wrapped(docs).join(kept.hint("merge"), "_row", "left_semi").select("doc.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir)).drop("_row")


OP6_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\x0C\\r]', '', 'g') AS t FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w AS r
      FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, r = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""
