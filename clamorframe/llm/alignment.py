"""Alignment of two tokenizers' tokens, relational.

Tokens are exploded with their places, a window adds up their bytes, and an equi-join on the text and the end finds
the cuts that both tokenizers make; a running count of cuts numbers the groups. Between two neighbouring ends lies
exactly one token of either side, so each stretch is one link; a window carries both tokens to it, and no
group is multiplied out.

No token of either side crosses certain places in a text (before a space behind another sign, and between two
bytes that no token of either vocabulary holds side by side), so a document is a sequence of pieces whose tokens do not
depend on what stands around them. Equal pieces are aligned once. Documents are taken in blocks: a block has a
dictionary of its pieces, which receives the aligned links, and gives its documents' rows from them. How many documents
hold a linked pair is then counted over all, and joined back.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens, words

#: Text bytes of a block of documents; a longer document is a block of its own.
BLOCK_BYTES = 24 << 20
#: Entries whose links are Python numbers at a time.
NAMED = 20_000
#: Signs before which a text may be parted where no token holds them and the byte before side by side.
PARTING = b" .,;:!?"

#: Fixed value: a model file's message goes on with normalizer_spec (field 3), in it add_dummy_prefix (field 3) false; later values hold.
NO_PREFIX = b"\x1a\x02\x18\x00"

_pairs: dict[tuple[str, str], "Tokenizers"] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokenizers(paths: tuple[str, str]) -> "Tokenizers":
    if paths not in _pairs:
        _pairs[paths] = Tokenizers(*paths)
    return _pairs[paths]


class Tokenizers:
    """A: byte-level BPE of the ``tokenizers`` library; B: a sentencepiece model, here without the space that it adds."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=Path(path_b).read_bytes() + NO_PREFIX)
        level = {c: b for b, c in tokens._byte_characters().items()}
        self.bytes_a = {i: bytes(level[c] for c in t) if all(c in level for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_b = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def apart(self) -> np.ndarray:
        """[x, y]: whether no token of either side holds byte x before byte y."""
        out = np.ones((256, 256), bool)
        for x in {*self.bytes_a.values(), *self.bytes_b}:
            held = np.frombuffer(x, np.uint8)
            out[held[:-1], held[1:]] = False
        return out

    def encode(self, pieces: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Both sides' ids of each piece; none where their bytes are not the piece's."""
        ids_a = [e.ids for e in self.a.encode_batch(pieces, add_special_tokens=False)]
        ids_b = self.b.encode(pieces, num_threads=1)
        for piece, a, b in zip(pieces, ids_a, ids_b, strict=True):
            raw = piece.encode()
            if b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b]):
                yield a, b
            else:
                yield [], []


def piece_starts(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts, none of which is empty: at their first byte, and at a parting sign that no token joins to what is before it, white space excepted."""
    n = len(data)
    back = lambda k: np.concatenate([np.full(min(k, n), 0x20, np.uint8), data[: max(n - k, 0)]])
    x, y, z = back(1), back(2), back(3)
    white = words.SPACE[x] | (x < 0x20) | (y == 0xC2) & ((x == 0x85) | (x == 0xA0))
    white |= (z == 0xE2) & (y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF)) | (z == 0xE2) & (y == 0x81) & (x == 0x9F)
    white |= (z == 0xE1) & (y == 0x9A) & (x == 0x80) | (z == 0xE3) & (y == 0x80) & (x == 0x80)
    begins = np.isin(data, np.frombuffer(PARTING, np.uint8)) & apart[x, data] & ~white
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins)


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the last of each below 128; and where each number begins (one entry more than numbers)."""
    size = 1 + sum((x >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        has = size > k
        out[at[:-1][has] + k] = (x[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, at


def numbers(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    begin = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begin, ends - begin + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begin)


def _cutter(apart: np.ndarray):
    """To the pieces of each block's dictionary (block, code, piece), and its documents (block, doc_id, _row, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        known, code_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in common.slices(batches):
            text = pc.fill_null(batch.column(2), "")
            full = pc.not_equal(text, "")
            data, offsets = common.utf8(pc.binary_join_element_wise(pa.scalar(" ", text.type), text, pa.scalar("", text.type)))
            starts = piece_starts(data, offsets, apart)
            ends = np.append(starts[1:], len(data))
            key, first, inverse = np.unique(words.hashes(data, starts, ends), return_index=True, return_inverse=True)
            at = np.searchsorted(known, key)
            old = np.zeros(len(key), bool)
            old[at < len(known)] = known[at[at < len(known)]] == key[at < len(known)]
            code = np.empty(len(key), np.int64)
            code[old] = code_of[at[old]]
            new = np.flatnonzero(~old)
            new = new[np.argsort(first[new])]  # frequent pieces come early and have small codes
            code[new] = len(known) + np.arange(len(new))
            fresh = first[new]
            length = ends[fresh] - starts[fresh]
            edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.string(), len(fresh), [None, pa.py_buffer(edges), pa.py_buffer(data[words.ranges(starts[fresh], length)])])
            nothing = lambda n, kind: pa.nulls(n, kind)
            n, m = len(fresh), batch.num_rows
            names = ["block", "code", "piece", "doc_id", "_row", "codes"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(code[new]), pieces, nothing(n, pa.int64()), nothing(n, pa.int64()), nothing(n, pa.binary())], names=names)
            coded, upto = varints(code[inverse])
            edges = upto[np.searchsorted(starts, offsets)].astype(np.int32)
            codes = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(edges), pa.py_buffer(coded)])
            codes = pc.if_else(full, codes, pa.scalar(b"", pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), nothing(m, pa.int64()), nothing(m, pa.string()), batch.column(0), batch.column(1), codes], names=names)
            order = np.argsort(both := np.concatenate([known, key[~old]]))
            known, code_of = both[order], np.concatenate([code_of, code[~old]])[order]
            size += len(data)
            if size >= BLOCK_BYTES:
                block, size, known, code_of = block + 1, 0, known[:0], code_of[:0]

    return run


def _encoder(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                ids = list(both.encode(part.column(1).to_pylist()))
                sides = []
                for k, held in ((0, both.bytes_a), (1, both.bytes_b)):
                    edges = np.concatenate([[0], np.cumsum([len(x[k]) for x in ids])]).astype(np.int32)
                    flat = [i for x in ids for i in x[k]]
                    values = pa.StructArray.from_arrays([pa.array(flat, pa.int32()), pa.array([len(held[i]) for i in flat], pa.int32())], ["id", "bytes"])
                    sides.append(pa.ListArray.from_arrays(pa.array(edges), values))
                yield pa.RecordBatch.from_arrays([part.column(0), *sides], names=["k", "a", "b"])

    return run


def align(rows: DataFrame) -> DataFrame:
    """k, end, a, b, a_ends, b_ends, group: a row for each link of the texts (k, a, b), whose tokens are structs (id, bytes) in order.

    ``end`` is where the tokens ``a`` and ``b`` stop lying over each other; ``group`` counts from the text's end. Both sides
    of a text must have equally many bytes; texts without tokens give no rows.
    """
    rows = rows.repartition("k")

    def ends(side: str) -> DataFrame:
        each = rows.select("k", F.posexplode(side).alias("pos", "t"))
        return each.select("k", F.sum("t.bytes").over(Window.partitionBy("k").orderBy("pos")).alias("end"), F.col("t.id").alias(side))

    both = ends("a").join(ends("b").hint("merge"), ["k", "end"], "full_outer")
    back = Window.partitionBy("k").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b = F.col("a"), F.col("b")
    return both.select(
        "k", "end", F.last(a, ignorenulls=True).over(back).alias("a"), F.last(b, ignorenulls=True).over(back).alias("b"), a.isNotNull().alias("a_ends"), b.isNotNull().alias("b_ends"),
        F.count_if(a.isNotNull() & b.isNotNull()).over(back).alias("group"),
    )


def _aligned_pieces(pieces: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """piece, links: one long a link, in order: the ids of both sides and, in the lowest two bits, whether their tokens end there. Pieces whose bytes a side changes have none."""
    distinct = common.cut(pieces.select("piece").distinct(), "pieces")
    vocabulary = distinct.select(F.monotonically_increasing_id().alias("k"), "piece")
    encoded = common.cut(vocabulary.mapInArrow(_encoder(paths), "k long, a array<struct<id:int,bytes:int>>, b array<struct<id:int,bytes:int>>"), "encoded")
    links = align(encoded)
    packed = F.shiftleft(F.col("a").cast("long"), 33) + F.shiftleft(F.col("b").cast("long"), 2) + 2 * F.col("a_ends").cast("int") + F.col("b_ends").cast("int")
    each = links.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("end", packed.alias("v")))), lambda x: x["v"]).alias("links"))
    out = vocabulary.join(each.hint("merge"), "k", "left").select("piece", F.coalesce("links", F.array().cast("array<long>")).alias("links"))
    out = common.cut(out, "aligned")
    common.drop_cut(distinct)
    common.drop_cut(encoded)
    return out


def _compose(docs: pa.Table, entries: pa.Table) -> pa.Table:
    """A block's documents from its dictionary."""
    order = np.argsort(entries.column("code").to_numpy())
    lists = entries.column("links").combine_chunks()
    lists = (lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists).take(pa.array(order))
    edges = lists.offsets.to_numpy().astype(np.int64)
    value = lists.values.to_numpy()[edges[0] : edges[-1]] if len(lists) else np.zeros(0, np.int64)
    edges = edges - edges[0]
    a, b = value >> 33, value >> 2 & (1 << 31) - 1
    size = np.diff(edges)
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])
    ends_a, ends_b = (value >> 1 & 1).astype(bool), (value & 1).astype(bool)
    counts = [np.diff(upto(x)[edges]) for x in (ends_a, ends_b, ends_a & ends_b, np.ones(len(value), np.int64))]
    names = _group_names(a, b, ends_a, ends_b, edges)
    pair = (a << 32) | b
    out = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")}
    raw = docs.column("codes").to_pylist()
    for codes in raw:
        code = numbers(np.frombuffer(codes, np.uint8))
        fits = len(code) > 0 and bool((size[code] > 0).all())
        for k, c in zip(("n_a", "n_b", "n_groups", "n_links"), counts, strict=True):
            out[k].append(int(c[code].sum()) if fits else 0)
        out["groups_sha256"].append(hashlib.sha256(";".join([names[c] for c in code.tolist()]).encode()).hexdigest() if fits else "")
        own, n = np.unique(code if fits else code[:0], return_counts=True)
        held, at = np.unique(pair[words.ranges(edges[own], size[own])], return_inverse=True)
        out["pairs"].append(held)
        out["times"].append(np.bincount(at, np.repeat(n, size[own]), len(held)).astype(np.int32))
    upto = np.concatenate([[0], np.cumsum([len(x) for x in out["pairs"]])]).astype(np.int32)
    nested = lambda k, kind: pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([*out[k], np.zeros(0, kind)]).astype(kind)))
    cols = [docs.column("doc_id").combine_chunks(), docs.column("_row").combine_chunks(), *(pa.array(out[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(out["groups_sha256"], pa.string()), nested("pairs", np.int64), nested("times", np.int32)]
    common.give_back()
    return pa.table(cols, names=["doc_id", "_row", *out])


def _group_names(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, edges: np.ndarray) -> list[str]:
    """Each entry's groups, as ids of both sides."""
    out = []
    for low in range(0, len(edges) - 1, NAMED):
        part = edges[low : low + NAMED + 1]
        own = slice(part[0], part[-1])
        rows = zip(a[own].tolist(), b[own].tolist(), ends_a[own].tolist(), ends_b[own].tolist(), strict=True)
        for n in np.diff(part).tolist():
            groups, left, right = [], [], []
            for _ in range(n):
                x, y, x_ends, y_ends = next(rows)
                if x_ends:
                    left.append(str(x))
                if y_ends:
                    right.append(str(y))
                    if x_ends:
                        groups.append(",".join(left) + "|" + ",".join(right))
                        left, right = [], []
            out.append(";".join(groups))
    return out


def composed(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, _row, n_a, n_b, n_groups, n_links, groups_sha256, and each linked pair (a in the upper, b in the lower half of a long) with how often it is linked."""
    spark, paths = docs.sparkSession, paths or default_paths()
    doc = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_row", "text")
    both = common.cut(doc.mapInArrow(_cutter(tokenizers(paths).apart()), "block long, code long, piece string, doc_id long, _row long, codes binary"), "blocks", "zstd")
    pieces = both.where("piece is not null").select("block", "code", "piece")
    once = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(once)
    spark.conf.set(once, "false")  # joins on (text, end) keep the partitioning by text
    try:
        links = _aligned_pieces(pieces, paths)
    finally:
        spark.conf.set(once, was)
    common.release_shuffles(spark)
    entries = common.cut(pieces.join(links.hint("merge"), "piece").select("block", "code", "links"), "entries", "zstd")
    common.drop_cut(links)
    common.release_shuffles(spark)
    left = both.where("codes is not null").select("block", "doc_id", "_row", "codes").groupBy("block")
    kinds = "doc_id long, _row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    out = common.cut(left.cogroup(entries.groupBy("block")).applyInArrow(_compose, kinds), "composed", "zstd")
    common.drop_cut(both)
    common.drop_cut(entries)
    common.release_shuffles(spark)
    return out


def cross_alignment(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, or one whose bytes a tokenizer changes, has zeros and an empty string. Repeated rows are
    documents of their own, and each counts. An empty table gives an empty result; other columns are not read.
    """
    rows = composed(docs, paths)
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = common.cut(counts.select("pair", "n", (F.col("n") == best).cast("long").alias("best")), "counts")
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    sums = each.join(counts.hint("merge"), "pair").groupBy("_row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = common.cut(sums, "sums")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums.hint("merge"), "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_alignment(common.documents(spark, sf_dir))
