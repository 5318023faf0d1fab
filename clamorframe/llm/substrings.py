"""Substring dedup by difference-cover anchors.

Every two residues modulo PERIOD are moved to cover residues by one shift, so of two equal runs of WINDOW
words some aligned ANCHOR words begin at a cover position in both. Only windows at cover positions are
hashed and counted over the corpus; a document extends each anchor that occurs again to the WINDOW-word
windows around it. These are matched by 128 bits of their words with the smallest document that has them.
Documents whose words all equal an earlier document's are settled before that, by 128 bits of all words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

WINDOW = 50
#: A perfect difference set: each residue but 0 is one difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1


def _hashed(column: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = common.utf8(column)
    starts, ends, first = words.bounds(data, offsets)
    return words.hashes(data, starts, ends, seed), first


def _positions(first: np.ndarray, width: int, residues: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, word within it) of all windows of ``width`` words, or those at cover residues."""
    room = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(room)), room)
    at = words.ranges(np.zeros(len(room), np.int64), room)
    if residues is not None:
        keep = residues[at % PERIOD]
        text, at = text[keep], at[keep]
    return text, at


def _cover() -> np.ndarray:
    out = np.zeros(PERIOD, bool)
    out[list(COVER)] = True
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        counts, digests = [], []
        for text in batch.column(2):
            parts = (text.as_py() or "").encode().split()
            counts.append(len(parts))
            digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests), batch.column(3)], names=["_id", "_row", "n_words", "kept_sha256", "doc_id"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cover = _cover()
    for batch in common.slices(batches):
        h, first = _hashed(batch.column(1), 0)
        text, at = _positions(first, ANCHOR, cover)
        text_ok = np.diff(first)[text] >= WINDOW
        text, at = text[text_ok], at[text_ok]
        key = words.window_hashes(h, ANCHOR, first[text] + at)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(at.astype(np.int32))], names=["h", "_row", "at"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, _row, text, marks): the windows that hold a marked anchor."""
    for batch in common.slices(batches):
        h, first = _hashed(batch.column(2), 0)
        g, _ = _hashed(batch.column(2), 1)
        marks = batch.column(3)
        offsets = marks.offsets.to_numpy().astype(np.int64)
        anchor = marks.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
        text = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        n = np.diff(first)
        inside = np.zeros(len(h) + 1, np.int64)
        low = np.maximum(anchor - (WINDOW - ANCHOR), 0)
        high = np.minimum(anchor, n[text] - WINDOW) + 1
        good = high > low
        np.add.at(inside, (first[text] + low)[good], 1)
        np.add.at(inside, (first[text] + high)[good], -1)
        at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        own = np.searchsorted(first, at, side="right") - 1
        took = pa.array(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words.window_hashes(h, WINDOW, at, 0).view(np.int64)), pa.array(words.window_hashes(g, WINDOW, at, 1).view(np.int64)),
                batch.column(0).take(took), batch.column(1).take(took), pa.array((at - first[own]).astype(np.int32)),
            ],
            names=["h", "g", "doc_id", "_row", "at"],
        )


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, text, hits): words left when the windows at ``hits`` are taken out."""
    for batch in common.slices(batches):
        out = []
        for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts = (text or "").encode().split()
            gone = np.zeros(len(parts) + 1, np.int64)
            at = np.array(hits, np.int64)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + WINDOW, -1)
            gone = np.cumsum(gone)[:-1] > 0
            left = [w for w, x in zip(parts, gone.tolist(), strict=True) if not x]
            out.append((int(gone.sum()), b" ".join(left)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([x.decode() for _, x in out])], names=["_row", "n_removed", "kept_text"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, _row, n_words, n_removed, kept_text (null where nothing is removed) and kept_sha256.

    A word goes if a window of 50 words that covers it also starts in a document with a smaller doc_id. A null
    text has no words. A null doc_id counts as after all others and before no other. Rows with the same doc_id
    take nothing from each other. An empty table gives an empty result; other columns are not read.
    """
    doc = common.with_row_key(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    summary = common.cut(doc.select("_id", "_row", "text", "doc_id").mapInArrow(_summaries, "_id long, _row long, n_words long, kept_sha256 string, doc_id long"), "summaries")
    # documents that are an earlier one's copy: all is removed if it is a window at least
    first = common.cut(summary.groupBy("kept_sha256").agg(F.min("_id").alias("_first")), "first")
    state = summary.join(first, "kept_sha256").withColumn("_copy", F.col("_id") > F.col("_first"))
    state = common.cut(state.select("_id", "doc_id", "_row", "n_words", "kept_sha256", "_copy"), "state")
    anchors = doc.select("_row", "text").mapInArrow(_anchors, "h long, _row long, at int")
    again = common.cut(anchors.select("h").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    common.release_shuffles(docs.sparkSession)
    marks = anchors.join(again, "h").groupBy("_row").agg(F.collect_list("at").alias("marks"))  # a document's own anchors
    marks = common.cut(marks.join(state.where("not _copy").select("_row"), "_row"), "marks")
    common.release_shuffles(docs.sparkSession)
    marked = common.cut(doc.select("_id", "_row", "text").join(marks, "_row").select("_id", "_row", "text", "marks"), "marked", "zstd")
    common.drop_cut(again)
    common.drop_cut(marks)
    common.release_shuffles(docs.sparkSession)
    windows = marked.mapInArrow(_windows, "h long, g long, _id long, _row long, at int")  # read twice, hashed twice: a table of them would be the largest of all
    owner = windows.groupBy("h", "g").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    owner = common.cut(owner, "owner")
    common.release_shuffles(docs.sparkSession)
    hits = windows.join(owner, ["h", "g"]).where("_first < _id").groupBy("_row").agg(F.collect_list("at").alias("hits"))
    hits = common.cut(hits, "hits")
    common.drop_cut(owner)
    common.release_shuffles(docs.sparkSession)
    cleaned = marked.select("_row", "text").join(hits, "_row").select("_row", "text", "hits").mapInArrow(_removed, "_row long, n_removed long, kept_text string")
    out = state.join(cleaned, "_row", "left")
    gone = F.col("_copy") & (F.col("n_words") >= WINDOW)
    text = F.when(gone, F.lit("")).otherwise(F.col("kept_text"))
    return out.select(
        "doc_id", "_row", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        text.alias("kept_text"), F.when(text.isNull(), F.col("kept_sha256")).otherwise(F.sha2(text, 256)).alias("kept_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
