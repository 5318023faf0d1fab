"""Line dedup over content-defined chunks of lines.

A text's lines are cut into chunks where a rolling hash of the last lines' hashes meets a condition, so an
inserted line moves no boundary but those next to it. Chunks of two or more lines that occur again anywhere
are candidates by their hash; candidates are then grouped by their bytes, and all but the first go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A boundary follows a line in one of DIVISOR cases, after LEAST lines at the soonest.
DIVISOR, LEAST = 3, 2
_MASK = (1 << 64) - 1


def chunks(text: str | None) -> list[bytes]:
    """The text's chunks: with a line feed between them they are the text."""
    if not text:
        return []
    out, held, before = [], [], 0
    for line in text.encode().split(b"\n"):
        h = xxhash.xxh64_intdigest(line)
        held.append(line)
        rolled = ((before * 0x9E3779B97F4A7C15 + h) & _MASK) * 0xD6E8FEB86659FD93 & _MASK
        before = h
        if len(held) >= LEAST and (rolled >> 32) % DIVISOR == 0:
            out.append(b"\n".join(held))
            held = []
    if held:
        out.append(b"\n".join(held))
    return out


def shared(chunk: bytes) -> bool:
    """Whether a chunk may be removed: it has two lines at least, and something on them."""
    return b"\n" in chunk and bool(chunk.strip())


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        rows = [(xxhash.xxh3_64_intdigest(c) - (1 << 63), d, i) for d, x in enumerate(batch.column(1).to_pylist()) for i, c in enumerate(chunks(x)) if shared(c)]
        key, doc, at = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), batch.column(0).take(pa.array(doc, pa.int64())), pa.array(at, pa.int32())], names=["k", "_row", "at"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        texts = batch.column(2).to_pylist()
        cut = [chunks(x) for x in texts]
        lines = [sum(c.count(b"\n") + 1 for c in x) for x in cut]
        digest = [hashlib.sha256((x or "").encode()).hexdigest() for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.int64()), pa.array(list(map(len, cut)), pa.int64()), pa.array(digest)], names=["doc_id", "_row", "n_lines", "n_chunks", "kept_sha256"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        rows = []
        for d, (text, marks) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            cut = chunks(text)
            rows += [(cut[i], d, i) for i in marks]
        body, doc, at = zip(*rows, strict=True) if rows else ((), (), ())
        took = pa.array(doc, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(body, pa.binary()), batch.column(0).take(took), batch.column(1).take(took), pa.array(at, pa.int32())], names=["body", "_id", "_row", "at"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        kept, gone = [], []
        for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            cut, out = chunks(text), set(hits)
            kept.append(b"\n".join(c for i, c in enumerate(cut) if i not in out).decode())
            gone.append((len(out), sum(cut[i].count(b"\n") + 1 for i in out)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in gone], pa.int64()), pa.array([b for _, b in gone], pa.int64()), pa.array(kept)], names=["_row", "n_removed_chunks", "n_removed_lines", "kept_text"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, _row, n_lines, n_chunks, n_removed_chunks, n_removed_lines, kept_text (null where nothing goes), kept_sha256.

    Of equal chunks the first stays, by doc_id (null last), row and place. A null or empty text has no lines.
    Repeated rows are documents of their own. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    doc = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    summary = common.cut(doc.select("doc_id", "_row", "text").mapInArrow(_summaries, "doc_id long, _row long, n_lines long, n_chunks long, kept_sha256 string"), "summaries")
    keys = doc.select("_row", "text").mapInArrow(_keys, "k long, _row long, at int")
    again = common.cut(keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "again")
    marks = common.cut(keys.join(again.hint("merge"), "k").groupBy("_row").agg(F.collect_list("at").alias("marks")), "marks")  # a document's own chunks
    ident = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("_id")
    marked = common.cut(doc.select(ident, "_row", "text").join(marks.hint("merge"), "_row").select("_id", "_row", "text", "marks"), "marked")
    common.release_shuffles(spark)
    bodies = marked.mapInArrow(_bodies, "body binary, _id long, _row long, at int")
    me = F.struct("_id", "_row", "at")
    owner = common.cut(bodies.groupBy("body").agg(F.min(me).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "owner")
    hits = common.cut(bodies.join(owner.hint("merge"), "body").where(me != F.col("first")).groupBy("_row").agg(F.collect_list("at").alias("hits")), "hits")
    cleaned = marked.select("_row", "text").join(hits.hint("merge"), "_row").select("_row", "text", "hits").mapInArrow(_without, "_row long, n_removed_chunks long, n_removed_lines long, kept_text string")
    out = summary.join(cleaned, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    digest = F.when(F.col("kept_text").isNull(), F.col("kept_sha256")).otherwise(F.sha2("kept_text", 256))
    return out.select("doc_id", "_row", "n_lines", "n_chunks", zero("n_removed_chunks"), zero("n_removed_lines"), "kept_text", digest.alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; ``kept_sha256`` is of the text that is left, its chunks joined by line feeds."""
    return dedup(common.documents(spark, sf_dir)).drop("_row", "kept_text")
