"""Token ids as range-ANS coded block files.

A file table holds blocks; a block holds the ids of whole documents, in order of doc_id. Ids are dealt to
LANES interleaved coders that share one static frequency table (written beside the blocks), so a block is
coded a row of lanes at a time. Checkpoints in a block hold all lanes' states and the place in the stream
every ``ROWS`` rows: reading cuts a block at its checkpoints into parts that tasks decode independently, and
puts a document's checksum together from those of its parts. A checksum guards a block's payload and its table of documents.

Payload, little-endian: magic, lanes (u32), number of ids (u64), words (u64), checkpoints (u32), then for each
checkpoint its row and word (u64 each) and the lanes' states (u64 each), then the 32-bit words of the stream.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

END_ID = 2
LANES, ROWS, BLOCK_IDS = 512, 256, 1 << 19
SCALE = 20
LOW = np.uint64(1 << 31)
MAGIC = b"CFR1"
HEAD = struct.Struct("<4sIQQI")


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, in proportion to the counts and never 0."""
    total, size = int(counts.sum()), 1 << scale
    if len(counts) > size:
        raise ValueError("more symbols than the frequency scale has places")
    spare = size - len(counts)
    freq = 1 + (counts.astype(np.float64) * (spare / max(total, 1))).astype(np.int64)
    freq[int(np.argmax(freq))] += size - int(freq.sum())
    return freq.astype(np.uint64)


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE, lanes: int = LANES, rows: int = ROWS) -> None:
        self.freq, self.scale, self.lanes, self.rows = freq.astype(np.uint64), np.uint64(scale), lanes, rows
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.most = self.freq << np.uint64(63 - scale)

    def encode(self, ids: np.ndarray) -> bytes:
        lanes, n = self.lanes, len(ids)
        height = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, int, np.ndarray]] = []
        written = 0
        for row in range(height - 1, -1, -1):
            own = ids[row * lanes : (row + 1) * lanes]
            k = len(own)
            f, x = self.freq[own], state[:k]
            full = x >= self.most[own]
            if full.any():
                out.append(x[full].astype(np.uint32))
                written += len(out[-1])
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[:k] = (q << self.scale) + (x - q * f) + self.cum[own]
            if row % self.rows == 0:
                marks.append((row, written, state.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        head = HEAD.pack(MAGIC, lanes, n, len(words), len(marks))
        return head + b"".join(struct.pack("<QQ", row, len(words) - w) + s.astype("<u8").tobytes() for row, w, s in marks[::-1]) + words.astype("<u4").tobytes()

    def decode(self, payload: bytes, part: int | None = None) -> np.ndarray:
        """All ids of a block, or those from checkpoint ``part`` to the next one."""
        magic, lanes, n, n_words, n_marks = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block")
        step = 16 + 8 * lanes
        words = np.frombuffer(payload, "<u4", n_words, HEAD.size + n_marks * step).astype(np.uint64)
        height = -(-n // lanes)
        chosen = range(n_marks) if part is None else [part]
        out = np.empty(n, np.uint32)
        mask = np.uint64((1 << int(self.scale)) - 1)
        begin = end = 0
        for m in chosen:
            row, at = struct.unpack_from("<QQ", payload, HEAD.size + m * step)
            state = np.frombuffer(payload, "<u8", lanes, HEAD.size + m * step + 16).copy()
            last = min(height, row + self.rows)
            begin = row * lanes if m == chosen[0] else begin
            for r in range(row, last):
                k = min(lanes, n - r * lanes)
                x = state[:k]
                place = x & mask
                own = self.slot[place]
                out[r * lanes : r * lanes + k] = own
                x = self.freq[own] * (x >> self.scale) + place - self.cum[own]
                low = np.flatnonzero(x < LOW)
                if len(low):
                    x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
                    at += len(low)
                state[:k] = x
            end = min(n, last * lanes)
        return out[begin:end]


def id_type(tokenizer: str, end_id: int) -> str:
    """The least unsigned type that holds the tokenizer's ids."""
    return "<u2" if max(tokens.encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def id_writer(tokenizer: str, end_id: int, kind: str):
    """Texts to their ids with the end id behind, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer)
        for batch in common.slices(batches, most=tokens.SLICE_BYTES):
            ids, at = coder.encode(*common.utf8(batch.column(2)))
            ids = np.insert(ids, at[1:], end_id).astype(kind)
            edges = ((at + np.arange(len(at))) * ids.itemsize).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(edges), pa.py_buffer(ids)])], names=["doc_id", "_row", "ids"])

    return run


def counter(kind: str):
    """How often each id occurs, one row an id for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(common.utf8(batch.column(0))[0].view(kind), minlength=len(total))
            more[: len(total)] += total
            total = more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    return run


def block_writer(table, kind: str):
    """Sorted (doc_id, ids) to blocks; a task's blocks are numbered after its place in the sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value)
        part, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        size = 0

        def block() -> pa.RecordBatch:
            payload = coder.encode(np.concatenate(held))
            lengths = [len(x) for x in held]
            arrays = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([checksum(payload, docs, lengths)], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "block", "n_ids", "doc_ids", "lengths", "checksum", "payload"])

        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            ids, at = data.view(kind), offsets // np.dtype(kind).itemsize
            for d, doc in enumerate(batch.column(0).to_pylist()):
                held.append(ids[at[d] : at[d + 1]])
                docs.append(doc)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield block()
                    held, docs, size, number = [], [], 0, number + 1
        if held:
            yield block()
        common.give_back()

    return run


def checksum(payload: bytes, docs: list[int | None], lengths: list[int]) -> int:
    """The crc32 of a block: its payload, then each document's id (and whether there is one) and number of ids."""
    table = b"".join(struct.pack("<?qi", d is not None, d or 0, n) for d, n in zip(docs, lengths, strict=True))
    return zlib.crc32(table, zlib.crc32(payload))


def cut_at_checkpoints(payload: bytes) -> list[tuple[int, bytes]]:
    """(first id, payload) of each part of a block; a part is a payload of one checkpoint."""
    magic, lanes, n, n_words, n_marks = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block")
    step = 16 + 8 * lanes
    marks = [struct.unpack_from("<QQ", payload, HEAD.size + m * step) for m in range(n_marks)] + [(-(-n // lanes), n_words)]
    stream = HEAD.size + n_marks * step
    out = []
    for m, ((row, at), (behind, end)) in enumerate(zip(marks[:-1], marks[1:], strict=True)):
        state = payload[HEAD.size + m * step + 16 : HEAD.size + (m + 1) * step]
        own = min(n, behind * lanes) - row * lanes
        out.append((row * lanes, HEAD.pack(MAGIC, lanes, own, end - at, 1) + struct.pack("<QQ", 0, 0) + state + payload[stream + 4 * at : stream + 4 * end]))
    return out


def part_maker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to their parts: where each begins in its block, and the documents that have ids in it, by number, with how many."""
    for batch in batches:
        for b in batch.to_pylist():
            if checksum(b["payload"], b["doc_ids"], b["lengths"]) != b["checksum"]:
                raise ValueError(f"block {b['part']}/{b['block']} is damaged")
            length = np.array(b["lengths"], np.int64)
            end = np.cumsum(length)
            parts = cut_at_checkpoints(b["payload"])
            edges = [first for first, _ in parts] + [int(end[-1])]
            firsts, lasts = np.searchsorted(end, edges[:-1], side="right"), np.searchsorted(end, edges[1:], side="left")
            docs = [np.arange(x, y + 1) for x, y in zip(firsts, lasts, strict=True)]
            counts = [np.minimum(end[d], y) - np.maximum(end[d] - length[d], x) for d, x, y in zip(docs, edges[:-1], edges[1:], strict=True)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b["part"]] * n, pa.int32()), pa.array([b["block"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([x for _, x in parts], pa.binary()),
                    pa.array(docs, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())), pa.array([[b["doc_ids"][i] for i in d] for d in docs], pa.list_(pa.int64())), pa.array([(end - length)[d] for d in docs], pa.list_(pa.int64())),
                ],
                names=["part", "block", "mark", "payload", "docs", "counts", "doc_ids", "starts"],
            )


def part_reader(table):
    """Parts to a row for each document in them: how many of its ids are there, and their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value)
        for batch in batches:
            for b in batch.to_pylist():
                ids = coder.decode(b["payload"]).astype("<u4")
                count = np.array(b["counts"], np.int64)
                at = np.cumsum(count) - count
                crc = [zlib.crc32(ids[x : x + k].tobytes()) for x, k in zip(at.tolist(), count.tolist(), strict=True)]
                n = len(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b[c]] * n, pa.int32()) for c in ("part", "block")] + [pa.array(b["docs"], pa.int64()), pa.array(b["doc_ids"], pa.int64()), pa.array(b["starts"], pa.int64()), pa.array([b["mark"]] * n, pa.int32()), pa.array(count), pa.array(crc, pa.int64())],
                    names=["part", "block", "doc", "doc_id", "_start", "mark", "n", "crc"],
                )

    return run


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for column in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of what (crc32, bytes) are the parts of, one behind the other.

    Reading a zero bit is a linear map of the 32 bits, and that of many zeros its powers: a crc moves on over as many zeros
    as the next part has bits, and the next part's own crc is added.
    """
    total, _ = parts[0]
    for crc, size in parts[1:]:
        matrix = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
        bits = 8 * size
        while bits:
            if bits & 1:
                total = _times(matrix, total)
            matrix = [_times(matrix, column) for column in matrix]
            bits >>= 1
        total ^= crc
    return total


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., pieces): the crc32 of each document from those of its pieces, in order."""
    for batch in batches:
        crc = [p[0]["crc"] if len(p) == 1 else joined_crc([(x["crc"], 4 * x["n"]) for x in p]) for p in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "_start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Writes (blocks, frequency table) for all texts in order of doc_id, null first; a null text is the end id alone."""
    spark, path = docs.sparkSession, tokenizer or tokens.default_path()
    kind = id_type(path, end_id)
    rows = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_row", "text")
    ids = common.cut(rows.mapInArrow(id_writer(path, end_id, kind), "doc_id long, _row long, ids binary"), "ids", "zstd")
    freqs = common.cut(ids.select("ids").mapInArrow(counter(kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")), "frequencies")
    table = spark.sparkContext.broadcast(read_table(freqs))
    dealt = ids.repartitionByRange(F.col("doc_id"), F.col("_row")).sortWithinPartitions("doc_id", "_row").select("doc_id", "ids")
    blocks = dealt.mapInArrow(block_writer(table, kind), "part int, block int, n_ids long, doc_ids array<long>, lengths array<int>, checksum long, payload binary")
    blocks = common.cut(blocks, "blocks")
    common.drop_cut(ids)
    common.release_shuffles(spark)
    return blocks, freqs


def read_table(freqs: DataFrame) -> np.ndarray:
    """The shared frequencies; the vocabulary bounds the rows."""
    rows = freqs.collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return quantise(counts)


def read(blocks: DataFrame, freqs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the blocks, each checkpoint's part by itself."""
    table = blocks.sparkSession.sparkContext.broadcast(read_table(freqs))
    parts = blocks.select("part", "block", "doc_ids", "lengths", "checksum", "payload").mapInArrow(part_maker, "part int, block int, mark int, payload binary, docs array<long>, counts array<long>, doc_ids array<long>, starts array<long>")
    # parts of one block go to several tasks
    pieces = parts.repartition("part", "block", "mark").mapInArrow(part_reader(table), "part int, block int, doc long, doc_id long, _start long, mark int, n long, crc long")
    whole = pieces.groupBy("part", "block", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("_start").alias("_start"), F.sort_array(F.collect_list(F.struct("mark", "n", "crc"))).alias("pieces"), F.sum("n").alias("n_tokens"))
    docs = whole.select("part", "block", "doc_id", "_start", "pieces", "n_tokens").mapInArrow(_whole, "part int, block int, doc_id long, _start long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("part", "block", "n_ids")
    tasks = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a task of the sort
    tasks = tasks.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("part").orderBy("block")
    starts = sizes.select("part", "block", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("within")).join(tasks, "part")
    starts = common.cut(starts.select("part", "block", (F.col("before") + F.col("within")).alias("_before")), "starts")
    return docs.join(starts, ["part", "block"]).select("doc_id", (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def op8_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts coded, written and read again.

    A null or empty text is its end id alone. A null doc_id comes first; equal doc_ids and repeated rows are written one
    after the other. A long text goes on over checkpoints within one block and is read in parts. An empty table writes no
    block and gives an empty result; columns other than doc_id and text are not read.
    """
    return read(*write(common.documents(spark, sf_dir)))
