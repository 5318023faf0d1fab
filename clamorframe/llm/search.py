"""Ranked lexical search by dual-sorted wavelet trees, one a shard of documents.

A shard's postings stand term by term, each term's by falling impact; the sequence of their documents, numbered
by doc_id, is kept as a wavelet tree, one rank table a level. A stable partition keeps each term's postings in a
node in the order of impact, so the first of them bounds the whole subtree: a node's bound for an item is the
weighted sum of its terms' first impacts, and a leaf's bound is its document's score. Nodes are opened best
first, all terms' ranges at once, until no bound reaches the k-th score; so the result is exact. Each task's best
of one shard prune its next ones, and only k rows an item leave a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

TOP = 50
#: Documents of a shard, and nodes that are opened together.
SHARD, OPEN = 8192, 64
#: Items, and characters of theirs, that one pass over the documents answers, as their terms go to each task; a longer item has a pass of its own.
ITEMS, CHARACTERS = 1000, 4 << 20

#: Fixed value: what a term is made of.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The same by bytes: of UTF-8, bytes from 0x80 on belong to terms.
GAP = np.zeros(256, bool)
GAP[:0x80] = [not TERM.fullmatch(chr(b)) for b in range(0x80)]
_LOWER = {b: b + 32 for b in range(65, 91)}


def terms_of(text: str | None) -> list[str]:
    """A text's distinct terms in the order of their first places, only A-Z lower-cased."""
    return list(dict.fromkeys(TERM.findall((text or "").translate(_LOWER))))


class Vocabulary:
    """The items' terms, found in texts by hash and then compared by their bytes."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode() for t in terms]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        self.starts = self.ends - np.array([len(x) for x in raw], np.int64)
        for self.seed in range(64):
            key = words.hashes(self.data, self.starts, self.ends, self.seed)
            if len(np.unique(key)) == len(key):
                break
        else:
            raise ValueError("terms that no seed tells apart")
        self.order = np.argsort(key)
        self.key = key[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, term): the occurrences that are one of the terms, and the term's number."""
        if not len(self.key) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = words.hashes(data, starts, ends, self.seed)
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        which = np.flatnonzero(self.key[at] == h)
        term = self.order[at[which]]
        length = ends[which] - starts[which]
        fits = length == self.ends[term] - self.starts[term]
        which, term, length = which[fits], term[fits], length[fits]
        same = data[words.ranges(starts[which], length)] == self.data[words.ranges(self.starts[term], length)]
        equal = np.add.reduceat(same, np.cumsum(length) - length) == length if len(length) else fits[:0]
        return which[equal], term[equal]


def _postings(vocabulary: Vocabulary):
    size = max(1, len(vocabulary.key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            data, offsets = common.utf8(batch.column(2))
            lower = words.LOWER[data]
            starts, ends, first = words.bounds(lower, offsets, GAP)
            which, term = vocabulary.find(lower, starts, ends)
            doc = np.searchsorted(first, which, side="right") - 1
            pair, tf = np.unique(doc * size + term, return_counts=True)
            edges = np.searchsorted(pair, np.arange(batch.num_rows + 1) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(edges), pa.array(pair % size)), pa.ListArray.from_arrays(pa.array(edges), pa.array(tf))],
                names=["doc_id", "_row", "n", "terms", "tfs"],
            )

    return run


def postings(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, _row, n (terms with repeats), terms and tfs: which of the vocabulary a document holds, and how often."""
    doc = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_row", "text")
    return common.cut(doc.mapInArrow(_postings(vocabulary), "doc_id long, _row long, n long, terms array<long>, tfs array<long>"), "postings")


class Shard:
    """The wavelet tree of some documents' postings; documents are numbered in the order in which they are given."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int) -> None:
        order = np.lexsort((doc, -impact, term))
        seq, imp = doc[order].astype(np.int32), impact[order].astype(np.int32)
        upto = np.searchsorted(term[order], np.arange(n_terms + 1)).astype(np.int32)
        self.begin, self.end = upto[:-1], upto[1:]
        self.depth = max(1, int(n_docs - 1).bit_length())
        self.zeros = np.zeros((self.depth, len(seq) + 1), np.int32)
        self.impact = np.zeros((self.depth + 1, len(seq) + 1), np.int32)
        self.impact[0, :-1] = imp
        for level in range(self.depth):
            left = (seq >> (self.depth - 1 - level)) & 1 == 0
            np.cumsum(left, out=self.zeros[level, 1:])
            part = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
            seq, imp = seq[part], imp[part]
            self.impact[level + 1, :-1] = imp

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the ``top`` highest scores that are ``least`` or more; of equal ones the first documents."""
        begin, end = self.begin[terms][None, :], self.end[terms][None, :]
        level, low = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self._bound(level, begin, end, weights)
        found_doc, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = -1
        while True:
            live = (bound >= max(least, 1)) if last < 0 else (bound > found[-1]) | (bound == found[-1]) & (low < last)
            if not live.all():
                level, low, begin, end, bound = level[live], low[live], begin[live], end[live], bound[live]
            if not len(bound):
                return found_doc, found
            pick = np.argpartition(-bound, OPEN - 1)[:OPEN] if len(bound) > OPEN else np.arange(len(bound))
            ended = level[pick] == self.depth
            leaves, nodes = pick[ended], pick[~ended]
            if len(leaves):
                found_doc, found = np.concatenate([found_doc, low[leaves]]), np.concatenate([found, bound[leaves]])
                order = np.lexsort((found_doc, -found))[:top]
                found_doc, found = found_doc[order], found[order]
                last = int(found_doc[-1]) if len(found) == top else -1
            l, s, e = level[nodes][:, None], begin[nodes], end[nodes]
            zs, ze, z = self.zeros[l, s], self.zeros[l, e], self.zeros[l, -1]
            half = 1 << (self.depth - 1 - level[nodes])
            new = [np.concatenate([level[nodes] + 1] * 2), np.concatenate([low[nodes], low[nodes] + half]), np.concatenate([zs, z + s - zs]), np.concatenate([ze, z + e - ze])]
            rest = np.ones(len(bound), bool)
            rest[pick] = False
            bound = np.concatenate([bound[rest], self._bound(new[0], new[2], new[3], weights)])
            level, low, begin, end = (np.concatenate([x[rest], y]) for x, y in zip((level, low, begin, end), new, strict=True))

    def _bound(self, level: np.ndarray, begin: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.where(end > begin, self.impact[level[:, None], begin], 0) @ weights


def _searcher(items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, docs: int, length: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for table in _shards(batches):
            null = table.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids, row = table.column("doc_id").fill_null(0).to_numpy(), table.column("_row").to_numpy()
            order = np.lexsort((row, ids, null))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            lists = table.column("terms")
            edges = lists.offsets.to_numpy()
            size = np.diff(edges)
            term, tf = (table.column(c).values.to_numpy()[edges[0] : edges[-1]] for c in ("terms", "tfs"))
            m = np.repeat(50 + 50 * table.column("n").to_numpy() * docs // max(length, 1), size)
            shard = Shard(np.repeat(place, size), term, 1_000_000_000 * tf // (1000 * tf + 20 * m), n_terms, len(order))
            for i, (terms, weights) in enumerate(items):
                had = best[i]
                doc, score = shard.best(terms, weights, top, int(had[1][-1]) if len(had[1]) == top else 1)
                at = order[doc]
                both = [np.concatenate(x) for x in zip(had, (ids[at], score, row[at], null[at]), strict=True)]
                first = np.lexsort((both[2], both[0], both[3], -both[1]))[:top]
                best[i] = tuple(x[first] for x in both)
        for i, (ids, score, row, null) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids, mask=null), pa.array(score), pa.array(row)], names=["_item", "doc_id", "score", "_row"])
        common.give_back()

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's documents in parts of SHARD."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SHARD - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == SHARD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items (item_id, text) in blocks; the driver holds no more than one and a partition."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append(row)
        size += len(row["text"] or "")
        if len(block) == ITEMS or size >= CHARACTERS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents with the highest scores above 0, equal scores by doc_id, null last.

    Items are the stated query set: each block of ITEMS is answered by one pass over all documents, of which only
    the items' terms are indexed. A null text has no terms; an item without terms has no rows. Repeated rows are
    documents of their own, of equal ones the first counts first; so are repeated items. An empty table of either
    kind gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    out = None
    for block in _blocks(items):
        asked = [terms_of(x["text"]) for x in block]
        vocabulary = list(dict.fromkeys(t for x in asked for t in x))
        number = {t: i for i, t in enumerate(vocabulary)}
        rows = postings(docs, Vocabulary(vocabulary))
        n, length = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {x["t"]: x["df"] for x in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # no more than the block's terms
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))]
        held = [[number[t] for t in x if number[t] in df] for x in asked]
        queries = [(np.array(x, np.int64), np.array([weight[t] for t in x], np.int64)) for x in held]
        hits = rows.mapInArrow(_searcher(queries, len(vocabulary), n, length, top), "_item long, doc_id long, score long, _row long")
        names = spark.createDataFrame([(i, x["item_id"]) for i, x in enumerate(block)], "_item long, item_id long")
        rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_row"))
        ranked = hits.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(names), "_item")  # ITEMS rows at most
        ranked = common.cut(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
        out = ranked if out is None else out.unionByName(ranked)
        common.drop_cut(rows)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long").alias("item_id"), "text"))


_TERMS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS all_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS t FROM benchmark),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(ts) * n_docs) // all_terms AS m FROM d, s),
x AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
