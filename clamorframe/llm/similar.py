"""Groups of texts whose sets of word shingles are alike by a least Jaccard similarity.

A SimHash of 64 bits tells texts of similarity 0.8 by 9 bits at the median and by up to 18, where no grid of
segment counts parts them from others. So beside the grid's pairs, samples give candidates: TABLES times the
least of the shingles' hashes in PER_KEY orders, which texts of similarity s share whole with probability
s ** PER_KEY. Texts that share a key form blocks, and candidates are verified by their whole shingle sets, in
two steps. First each text's best partner in each block is one; of a key's several blocks, the texts that lead form
blocks again. Then, of each key whose texts are still in different groups, the texts outside its largest group
meet all its texts, block by block, with the sets themselves: all pairs that may be alike enough are compared,
but for those that others have already connected. Only links are written, fewer than texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Samples of a text and hashes in each: at similarity 0.8 a pair shares one with probability 0.98.
TABLES, PER_KEY = 10, 5
#: Texts that are compared in one block.
BLOCK = 512
#: How far an estimate may lie below the similarity that is asked for; its standard deviation is 0.06 at 0.8.
SLACK = 0.2

_MULTIPLIERS = np.random.default_rng(17).integers(1, 1 << 63, TABLES * PER_KEY, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(h: np.ndarray) -> np.ndarray:
    """The least of the hashes in each order."""
    out = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):
        np.minimum(out, (h[k : k + 4096, None] * _MULTIPLIERS).min(axis=0), out=out)
    return out


def sketcher(hashes_of: Callable[[str | None], np.ndarray], fingerprint_of: Callable[[np.ndarray], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            fps, digests, signs, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                h = hashes_of(text)
                fps.append(fingerprint_of(h))
                own = np.unique(h)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                least = signature(own)
                signs.append((least >> np.uint64(32)).astype(np.uint32).tobytes())
                keys.append([xxhash.xxh3_64_intdigest(least[t * PER_KEY : (t + 1) * PER_KEY].tobytes(), t) - (1 << 63) for t in range(TABLES)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "_row", "fp", "set", "sign", "keys"],
            )

    return run


def setter(hashes_of: Callable[[str | None], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = [np.unique(hashes_of(x)).view(np.int64) for x in batch.column(1).to_pylist()]
            edges = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    return run


def _central(group: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Of each row the number of its hashes that its group's rows have in their places, which is its similarity to all of them together."""
    out = np.zeros(len(group), np.int64)
    large = np.flatnonzero(np.bincount(group)[group] > 2)  # of two rows either may lead
    if len(large):
        own = group[large]
        for column in sign[large].T:
            order = np.lexsort((column, own))
            g, c = own[order], column[order]
            run = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
            out[large[order]] += np.bincount(run)[run]
    return out


def _together(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within groups, by their distance; places are sorted by group."""
    size = np.bincount(group)
    left = size[group] - 1 - (np.arange(len(group)) - (np.cumsum(size) - size)[group])  # places that follow in the group
    places = np.flatnonzero(left)
    apart = 1
    while len(places):
        yield places, places + apart
        apart += 1
        places = places[left[places] >= apart]


def _alike(sign: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (sign[a] == sign[b]).mean(axis=1)


def _best(group: np.ndarray, sign: np.ndarray, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(partner, row, estimate): for each row of a group the one that is most alike, if it may be alike enough."""
    best, partner = np.full(len(group), enough - SLACK), np.full(len(group), -1)
    for a, b in _together(group):
        alike = _alike(sign, a, b)
        for row, other in ((a, b), (b, a)):
            more = (alike > best[row]) | (alike == best[row]) & (partner[row] < 0)
            best[row[more]], partner[row[more]] = alike[more], other[more]
    row = np.flatnonzero(partner >= 0)
    return partner[row], row, best[row]


def _leaders(group: np.ndarray, sign: np.ndarray, enough: float) -> np.ndarray:
    """Which rows lead: in turn each group's most central row that no leader is like by ``enough``."""
    n = len(group)
    rows = np.lexsort((-_central(group, sign), group))
    led, leads = np.zeros(n, bool), np.zeros(n, bool)
    while len(rows):
        own, at = np.unique(group[rows], return_index=True)
        heads = rows[at]
        leads[heads] = True
        led[rows[_alike(sign, rows, heads[np.searchsorted(own, group[rows])]) >= enough]] = True
        rows = rows[~led[rows]]
    return leads


def _by_block(compare: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]):
    """Gives ``compare`` whole blocks of rows (k, block, several, node, sign, root, ...), sorted by k and block, with each row's group and hashes."""

    def whole_blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        k, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sign = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(len(k), -1)
        group = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (block[1:] != block[:-1])]))
        return compare(batch, group, sign)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            k, block = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            first = int(np.flatnonzero((k == k[-1]) & (block == block[-1]))[0])  # the last group may go on
            if first:
                yield whole_blocks(whole.slice(0, first))
            held = whole.slice(first)
        if held is not None:
            yield whole_blocks(held)

    return run


def _nearest(enough: float):
    """To each row's best pair, and to leaders (v null) where a key has several blocks."""

    def compare(batch: pa.RecordBatch, group: np.ndarray, sign: np.ndarray) -> pa.RecordBatch:
        k, node, several = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 2))
        partner, row, alike = _best(group, sign, enough)
        wide = np.flatnonzero(several)
        up = wide[_leaders(np.unique(group[wide], return_inverse=True)[1], sign[wide], enough)]
        v = pa.chunked_array([pa.array(node[row]), pa.nulls(len(up), pa.int64())]).combine_chunks()
        est = np.concatenate([alike, np.ones(len(up))])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k[row], k[up]])), pa.array(np.concatenate([node[partner], node[up]])), v, pa.array(est)], names=["k", "u", "v", "alike"])

    return _by_block(compare)


def _linked(enough: float):
    """To pairs that are alike enough by their whole sets: as many as connect what all such pairs of a guest and another row connect, roots being connected already."""
    percent = round(100 * enough)

    def compare(batch: pa.RecordBatch, group: np.ndarray, sign: np.ndarray) -> pa.RecordBatch:
        several, node, root, guest = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 5, 6))
        sets = batch.column(7)
        edges = sets.offsets.to_numpy().astype(np.int64)
        values, size = sets.values.to_numpy(), np.diff(edges)
        us, vs = [], []
        for rows in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
            label = np.unique(root[rows], return_inverse=True)[1]
            comes = guest[rows]
            at_home = np.flatnonzero(~comes)
            guests = np.flatnonzero(comes)
            for x, i in enumerate(guests.tolist()):
                row = rows[i]
                # where a key has several blocks, each guest is at home in one of them and meets the other guests there
                others = at_home if several[row] else np.concatenate([at_home, guests[x + 1 :]])
                others = others[label[others] != label[i]]
                others = others[_alike(sign, np.full(len(others), row), rows[others]) >= enough - SLACK]
                own = values[edges[row] : edges[row + 1]]
                for j in others.tolist():
                    other = rows[j]
                    if label[j] == label[i] or 100 * min(len(own), size[other]) < percent * max(len(own), size[other]):
                        continue
                    both = len(np.intersect1d(own, values[edges[other] : edges[other + 1]], assume_unique=True))
                    if 100 * both >= percent * (len(own) + size[other] - both):
                        us.append(row)
                        vs.append(other)
                        label[label == label[j]] = label[i]
        return pa.RecordBatch.from_arrays([pa.array(node[np.array(us, np.int64)]), pa.array(node[np.array(vs, np.int64)])], names=["u", "v"])

    return _by_block(compare)


def _blocks(level: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Rows (k, block, several, node, sign, root) of the texts (k, n, node), sorted within partitions that hold whole blocks."""
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = level.join(nodes.hint("merge"), "node")
    rows = rows.select("k", F.pmod(F.xxhash64("node", F.lit(depth)), blocks).alias("block"), (blocks > 1).alias("several"), "node", "sign", "root")
    return _whole(rows)


def _whole(rows: DataFrame) -> DataFrame:
    return rows.repartition("k", "block").sortWithinPartitions("k", "block", "node")


def _met(apart: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (k, block, several, node, sign, root, guest, shingles): of the texts (k, n, m, main, node) those outside the root
    that most of a key's n texts have, its m guests, meet every text of the key. Blocks of guests meet blocks of all texts."""
    rows = apart.join(nodes.hint("merge"), "node")
    homes, guests = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / BLOCK)
    at = lambda seed, blocks: F.pmod(F.xxhash64("node", F.lit(seed)), blocks)
    comes = F.col("root") != F.col("main")
    place = lambda i, j, guest: F.struct((i * guests + j).alias("block"), guest.alias("guest"))
    as_home = F.transform(F.sequence(F.lit(0).cast("long"), guests - 1), lambda j: place(at(0, homes), j, F.lit(False)))
    as_guest = F.transform(F.sequence(F.lit(0).cast("long"), homes - 1), lambda i: place(i, at(1, guests), F.lit(True)))
    places = F.when(homes == 1, F.array(place(F.lit(0).cast("long"), F.lit(0).cast("long"), comes))).when(comes, F.concat(as_home, as_guest)).otherwise(as_home)
    rows = rows.select("k", F.explode(places).alias("p"), (homes > 1).alias("several"), "node", "sign", "root", "shingles")
    return _whole(rows.select("k", "p.block", "several", "node", "sign", "root", "p.guest", "shingles"))


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def nearest(nodes: DataFrame, enough: float) -> tuple[DataFrame, DataFrame]:
    """Each text's best pairs (u, v, alike) that may be alike enough, from (node, sign, keys), and the texts (k, n, node) of the keys that several share."""
    member = nodes.select("node", F.explode("keys").alias("k"))
    shared = common.cut(member.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    levels, found = [common.cut(member.join(shared.hint("merge"), "k").select("k", "n", "node"), "members")], []
    signs = nodes.select("node", "sign", F.lit(0).cast("long").alias("root"))
    while True:
        rows = _blocks(levels[-1], signs, len(found))
        out = common.cut(rows.mapInArrow(_nearest(enough), "k long, u long, v long, alike double"), "nearest")
        found.append(out.where("v is not null").select("u", "v", "alike"))
        leaders = out.where("v is null").select("k", F.col("u").alias("node"))
        sizes = common.cut(leaders.groupBy("k").agg(F.count("*").alias("n")), "leaders")
        before, after = (x.agg(F.sum("n")).first()[0] or 0 for x in (shared.where(f"n > {BLOCK}"), sizes))
        shared = sizes
        if not after or 4 * after > 3 * before:  # blocks of texts that are unlike each other: no fewer leaders than texts
            return _all_of(found), levels[0]
        levels.append(common.cut(leaders.join(sizes.hint("merge"), "k").select("k", "n", "node"), "members"))


def links_between(members: DataFrame, nodes: DataFrame, roots: DataFrame, sets_of: Callable[[DataFrame], DataFrame], enough: float) -> DataFrame:
    """Pairs (u, v) alike enough that connect, with what the roots connect, all such pairs of texts (k, node) that share a key."""
    nodes = common.cut(nodes.join(roots, "node", "left").select("node", "sign", F.coalesce("root", "node").alias("root")), "rooted")
    rooted = common.cut(members.select("k", "node").join(nodes.select("node", "root").hint("merge"), "node"), "rooted")
    each = rooted.groupBy("k", "root").agg(F.count("*").alias("c")).groupBy("k")
    keys = each.agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    keys = common.cut(keys.select("k", "n", (F.col("n") - F.col("most.c")).alias("m"), F.col("most.root").alias("main")), "spread")
    apart = common.cut(rooted.select("k", "node").join(keys.hint("merge"), "k"), "apart")
    common.drop_cut(rooted)
    sets = sets_of(apart.select("node"))
    out = common.cut(_met(apart, nodes.join(sets.hint("merge"), "node")).mapInArrow(_linked(enough), "u long, v long"), "links")
    common.drop_cut(sets)
    return out


def verified(pairs: DataFrame, sets: DataFrame, enough: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are alike enough."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    whole = F.size("a") + F.size("b") - both
    return pairs.select("u", "v").join(b.hint("merge"), "v").join(a.hint("merge"), "u").where(100 * both >= round(100 * enough) * whole).select("u", "v")


def groups(docs: DataFrame, hashes_of: Callable[[str | None], np.ndarray], fingerprint_of: Callable[[np.ndarray], int], links: Callable[[DataFrame], DataFrame], enough: float) -> DataFrame:
    """doc_id, _row, root: documents of one group, linked by pairs of similarity ``enough`` or more, have one root, the least _row of its texts.

    Texts with equal sets are one node; a text without words is like those without words only.
    """
    doc = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_row", "text")
    prints = common.cut(doc.mapInArrow(sketcher(hashes_of, fingerprint_of), "doc_id long, _row long, fp long, set binary, sign binary, keys array<long>"), "prints")
    nodes = prints.groupBy("set").agg(F.min("_row").alias("node"), F.min("fp").alias("fp"), F.first("sign").alias("sign"), F.first("keys").alias("keys"))
    nodes = common.cut(nodes.withColumn("keys", F.concat("keys", F.array("fp"))), "nodes")
    by_fp = common.cut(nodes.groupBy("fp").agg(F.min("node").alias("node")), "by_fp")
    ends = [by_fp.select(F.col("fp").alias(f"{x}_fp"), F.col("node").alias(x)) for x in "uv"]
    linked = links(by_fp.select("fp")).toDF("u_fp", "v_fp").join(ends[0], "u_fp").join(ends[1], "v_fp").select("u", "v", F.lit(1.0).alias("alike"))
    linked = common.cut(linked, "linked")
    first, members = nearest(nodes.select("node", "sign", "keys"), enough)
    pairs = common.cut(first.unionByName(linked).groupBy("u", "v").agg(F.max("alike").alias("alike")), "pairs")

    def sets_of(some: DataFrame) -> DataFrame:
        texts = doc.select("_row", "text").join(common.cut(some.distinct().toDF("_row"), "involved").hint("merge"), "_row")
        return common.cut(texts.mapInArrow(setter(hashes_of), "node long, shingles array<long>"), "sets")

    def alike_enough(some: DataFrame) -> DataFrame:
        sets = sets_of(some.select(F.col("u").alias("node")).unionByName(some.select(F.col("v").alias("node"))))
        out = common.cut(verified(some, sets, enough), "edges")
        common.drop_cut(sets)
        return out

    best = pairs.groupBy("v").agg(F.max(F.struct("alike", (-F.col("u")).alias("u"))).alias("b")).select((-F.col("b.u")).alias("u"), "v")
    edges = alike_enough(common.cut(best, "best"))
    roots = components(edges)
    more = links_between(members, nodes, roots, sets_of, enough)
    edges = common.cut(edges.unionByName(more), "edges")
    roots = components(edges)
    root_of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    apart = linked.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left").where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v"))
    more = alike_enough(common.cut(apart.select("u", "v"), "apart"))
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    own = nodes.select("set", "node").join(roots, "node", "left").select("set", F.coalesce("root", "node").alias("root"))
    return prints.select("doc_id", "_row", "set").join(common.cut(own, "classes"), "set").select("doc_id", "_row", "root")
