"""SimHash near-dedup over a segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two; a segment's bit count is 0, 1 or 2, kept as 00, 01 or 11,
so the Manhattan distance of two embeddings is the bit count of their difference, and it is at most the
Hamming distance. Fingerprints within 3 bits are within Manhattan distance 1 in one half of the segments:
a grid cell is one half's embedding, and each fingerprint looks in its own cell and in those where one
segment counts one more. What a cell brings together passes the whole lower bound, then the exact distance.
Copies share a fingerprint, so only distinct fingerprints are joined. A crowded cell is parted by the quarters
of the other half, of which one agrees; in what is still crowded, blocks of fingerprints are compared with
blocks and give a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, similar
from .components import components, forest

SHINGLE = 3
MOST_BITS = 3
#: Fingerprints in a cell from which blocks are compared, and their size.
CROWD, BLOCK = 96, 512
LOW_BITS = 0x5555555555555555


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of the words in lower case, repeats included; fewer words are one shingle, none give none."""
    parts = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= width:
        return np.array([digest(b" ".join(parts), 42)] if parts else [], np.uint64)
    return np.array([digest(b" ".join(x), 42) for x in zip(*(parts[i:] for i in range(width)), strict=False)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        total += np.unpackbits(h[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprinter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            prints = [majority(shingle_hashes(x, width)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "_row", "fp"])

    return run


def embedding(fp: Column) -> Column:
    """Each pair of bits as 00, 01 or 11 by its count."""
    low = F.lit(LOW_BITS)
    after = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(after).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(after).bitwiseAND(low), 1))


def _one_more(cell: Column, k: int) -> Column:
    """The cell where segment k counts one more, null where it counts two."""
    bits = F.shiftrightunsigned(cell, 2 * k).bitwiseAND(F.lit(3))
    return F.when(bits == 0, cell.bitwiseOR(F.lit(1 << (2 * k)))).when(bits == 1, cell.bitwiseOR(F.lit(2 << (2 * k))))


def _compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    home = pdf.loc[pdf["home"], "fp"].to_numpy().view(np.uint64)
    look = pdf.loc[~pdf["home"], "fp"].to_numpy().view(np.uint64)
    near = np.bitwise_count(home[:, None] ^ look[None, :]) <= MOST_BITS
    i, j = np.nonzero(near)
    u, v = forest(home[i].view(np.int64), look[j].view(np.int64))
    return pd.DataFrame({"u": u, "v": v})


def _quarters(rows: DataFrame) -> DataFrame:
    """Each row four times, with a quarter of its other half: of two fingerprints within 3 bits one quarter there is equal."""
    other = F.when(F.col("side") == 0, F.col("e")).otherwise(F.shiftrightunsigned("e", 32))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)).alias("q")) for k in range(4))))
    return rows.select("side", "cell", "fp", "e", each.alias("x")).select("side", "cell", "x.k", "x.q", "fp", "e")


def _crowded(homes: DataFrame, keys: list[str]) -> DataFrame:
    return common.cut(homes.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > CROWD), "crowded")


def _calm_pairs(homes: DataFrame, guests: DataFrame, crowded: DataFrame, keys: list[str]) -> DataFrame:
    apart = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= MOST_BITS
    calm = homes.join(crowded, keys, "left_anti").select(*keys, F.col("fp").alias("u"), F.col("e").alias("eu"))
    near = (F.col("u") != F.col("fp")) & apart(F.col("eu"), F.col("e")) & apart(F.col("u"), F.col("fp"))
    return calm.join(guests, keys).where(near).select("u", F.col("fp").alias("v"))


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints ``fp`` within 3 bits of each other, as the full pair set would.

    Cells that are crowded are parted by an equal quarter of the other half; where that is not enough, blocks
    of those at home meet blocks of those that look there.
    """
    e = fingerprints.select("fp", embedding(F.col("fp")).alias("e"))
    half = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("e", 32).alias("own")), F.struct(F.lit(1).alias("side"), F.col("e").bitwiseAND(F.lit(0xFFFFFFFF)).alias("own"))))
    halves = e.select("fp", "e", half.alias("h")).select("fp", "e", "h.side", F.col("h.own").alias("cell"))
    homes = common.cut(halves, "homes")
    near = F.explode(F.array_compact(F.array(F.col("cell"), *(_one_more(F.col("cell"), k) for k in range(16)))))
    looks = homes.select("fp", "e", "side", near.alias("cell"))
    cell, part = ["side", "cell"], ["side", "cell", "k", "q"]
    crowded = _crowded(homes, cell)
    pairs = _calm_pairs(homes, looks, crowded, cell)
    if crowded.isEmpty():
        return pairs
    homes, guests = (common.cut(_quarters(x.join(crowded.drop("n"), cell)), "parts") for x in (homes, looks))
    crowded = _crowded(homes, part)
    pairs = pairs.unionByName(_calm_pairs(homes, guests, crowded, part))
    if crowded.isEmpty():
        return pairs
    load = guests.join(crowded.drop("n"), part).groupBy(*part).agg(F.count("*").alias("m"))
    sizes = common.cut(crowded.join(load, part).select(*part, F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("m") / BLOCK).cast("int").alias("mb")), "sizes")
    of = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    left = homes.join(sizes, part).select(*part, "fp", F.lit(True).alias("home"), of("nb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"))
    right = guests.join(sizes, part).select(*part, "fp", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), of("mb").alias("j"))
    return pairs.unionByName(left.unionByName(right).groupBy(*part, "i", "j").applyInPandas(_compare, "u long, v long"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, _row, fp, root, component_id: the component's own key, and the smallest doc_id that links reach, the document's own included.

    A null text is empty; a text without words has fingerprint zero and links like any other. A null doc_id
    is never the smallest where another is there. Repeated rows share a fingerprint and so a component. An
    empty table gives an empty result; other columns are not read.
    """
    doc = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_row", "text")
    prints = common.cut(doc.mapInArrow(fingerprinter(shingle), "doc_id long, _row long, fp long"), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    # components of several fingerprints only; every other fingerprint is one of its own
    member = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    member = member.join(distinct, "fp")
    least = member.groupBy("root").agg(F.min("least").alias("linked"))
    linked = member.join(least, "root").select("fp", "root", "linked")
    own = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("linked", "least").alias("component_id"))
    return prints.join(common.cut(own, "classes"), "fp").select("doc_id", "_row", "fp", "root", "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id, null last (of repeated rows the first).

    Without ``similarity``, fingerprints within 3 bits link. With it, texts link whose sets of shingles have
    that Jaccard similarity at least, those within 3 bits as others; see ``similar``. Components are told
    apart by their root: a doc_id can be null or stand in several of them.
    """
    if similarity is None:
        rows = near_groups(docs, shingle)
    else:
        rows = similar.groups(docs, partial(shingle_hashes, width=shingle), majority, links, similarity)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    return common.wrapped(docs).join(first.select("first._row").hint("merge"), "_row", "left_semi").select("doc.*")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
