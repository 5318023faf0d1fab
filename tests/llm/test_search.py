"""Ranked search against plain Python: the wavelet tree alone, and whole results with ties, nulls and repeated rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest

from clamorframe.llm import search


def ranked(docs, items, top):
    """(item_id, rank, doc_id, score) by the formula, all documents scored."""
    lower = str.maketrans({chr(b): chr(b + 32) for b in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (t or "").translate(lower))
    counts = [Counter(split(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        asked = [t for t in dict.fromkeys(split(text)) if t in df]
        scored = []
        for row, ((doc, _), c, s) in enumerate(zip(docs, counts, sizes, strict=True)):
            m = 50 + 50 * s * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, row))
        out += [(item, k + 1, None if null else doc, -score) for k, (score, null, doc, _) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def test_tree_finds_the_best_of_all():
    rng = np.random.default_rng(3)
    for n_docs, top, most in ((1, 5, 9), (2, 1, 3), (77, 10, 4), (700, 50, 1000), (700, 50, 2)):
        pairs = np.unique(rng.integers(0, n_docs * 6, 5 * n_docs))
        doc, term, impact = pairs // 6, pairs % 6, rng.integers(1, most, len(pairs))
        tree = search.Shard(doc, term, impact, 6, n_docs)
        for terms in ([0], [5, 2], [0, 1, 2, 3, 4, 5]):
            weights = rng.integers(1, 50, len(terms))
            score = np.zeros(n_docs, np.int64)
            for t, w in zip(terms, weights, strict=True):
                np.add.at(score, doc[term == t], w * impact[term == t])
            for least in (1, int(np.median(score))):
                want = [d for d in np.lexsort((np.arange(n_docs), -score)) if score[d] >= max(least, 1)][:top]
                got, scores = tree.best(np.array(terms), weights, top, least)
                assert got.tolist() == want and scores.tolist() == score[want].tolist()


def test_words_are_found_by_their_bytes():
    v = search.Vocabulary(["ab", "é", "x1"])
    data, offsets = np.frombuffer("AB é_x1ab x1".lower().encode(), np.uint8), np.array([0, 13])
    starts, ends, _ = search.words.bounds(data, offsets, search.GAP)
    which, term = v.find(data, starts, ends)
    assert which.tolist() == [0, 1, 3] and term.tolist() == [0, 1, 2]


@pytest.mark.parametrize("top", [3, 50])
def test_whole_results(spark, tmp_path, top):
    rng = random.Random(5)
    vocabulary = ["Ab", "ab", "c1", "É", "été", "z", "10", "rare"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", "_", "。"]) for _ in range(n))
    texts = [None, "", "_ -", "z" * 30_000, text(9000), *(text(rng.randint(1, 40)) for _ in range(90))]
    docs = [(None if i % 17 == 5 else i // 2, t) for i, t in enumerate(texts)] + [(7, "ab z")] * 60
    rng.shuffle(docs)
    items = [(1, "Ab, c1"), (2, None), (3, "nowhere"), (4, text(30)), (4, "rare"), (None, "z été z")]
    pa.parquet.write_table(pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs], "n": [0] * len(docs), "_row": ["x"] * len(docs), "score": ["y"] * len(docs)}), tmp_path / "d.parquet")
    got = search.search(spark.read.parquet(str(tmp_path / "d.parquet")), spark.createDataFrame(items, "item_id long, text string"), top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, top)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 2)
    monkeypatch.setattr(search, "CHARACTERS", 6)
    docs = [(i, t) for i, t in enumerate(["ab cd", "cd", "ef ab", "gh", None])]
    items = [(1, "ab"), (2, "cd ef"), (3, "gh ab cd"), (4, None), (5, "ef")]
    table = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert [[r["item_id"] for r in b] for b in search._blocks(table)] == [[1, 2], [3], [4, 5]]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string"), table)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 50)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    one = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs, one).collect() == [] and search.search(docs, items).collect() == []
