"""SimHash near-dedup against plain Python: fingerprints, links, components, and groups by similarity of shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from clamorframe.llm import components, similar, simhash

SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


def shingles(text, width):
    """All shingles of a text, in order, with repeats."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in SPACE.split(lowered) if w]
    return [" ".join(parts[i : i + width]) for i in range(max(len(parts) - width + 1, 1))] if parts else []


def fingerprint(text, width):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def united(n, pairs):
    """The least member of each one's set."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def texts(seed, n):
    """Texts with copies of which some words were changed, short and empty ones, and other capitals."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeAé", k=rng.randint(1, 5)))
    out = [None, "", " \n", "one", "two words", "TWO words"]
    for _ in range(n):
        words = [word() for _ in range(rng.randint(3, 150))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            other = list(words)
            for _ in range(rng.randrange(4)):
                other[rng.randrange(len(other))] = word()
            out.append(("\t" if rng.random() < 0.5 else "  ").join(other))
    return out


def table(spark, path, all_texts, ids):
    rows = [(d, t, i, "x") for i, (d, t) in enumerate(zip(ids, all_texts, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, n long, root string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_op4_rows(spark, tmp_path):
    """Every fingerprint, and the smallest doc_id that links of at most 3 bits reach."""
    all_texts = texts(1, 120)
    table(spark, f"{tmp_path}/documents.parquet", all_texts, range(len(all_texts)))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op4_simhash_near_dedup(spark, str(tmp_path)).collect()}
    prints = [fingerprint(t, 3) for t in all_texts]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = united(len(prints), pairs)
    assert len(set(roots)) < len(roots) - 30
    assert got == {i: (f"{p:016x}", roots[i]) for i, p in enumerate(prints)}


def test_crowded_cells_lose_no_link(spark, monkeypatch):
    """Thousands of fingerprints that share a half: chains in which each links with the next ones only."""
    monkeypatch.setattr(simhash, "CROWD", 20)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(2)
    half = rng.getrandbits(32)
    prints = sorted({half << 32 | sum(1 << b for b in rng.sample(range(20), rng.randint(0, 5))) for _ in range(900)})
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(frame)).collect()}
    want = united(len(prints), pairs)
    least = {}
    for i, r in enumerate(want):
        least[r] = min(least.get(r, signed[i]), signed[i])
    assert [got.get(p, p) for p in signed] == [least[r] for r in want]


def groups_of(docs, width=5):
    return similar.groups(docs, lambda t: simhash.shingle_hashes(t, width), simhash.majority, simhash.links, 0.8)


def test_similar_groups(spark, tmp_path):
    """Against all pairs: no wrong link, and all pairs of 0.8 and more but for one in fifty at most."""
    all_texts = texts(3, 150)
    docs = table(spark, f"{tmp_path}/d", all_texts, range(len(all_texts)))
    root = {r["doc_id"]: r["root"] for r in groups_of(docs).collect()}
    sets = [set(shingles(t, 5)) for t in all_texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    whole = united(len(sets), pairs)
    assert len(pairs) > 60 and sum(root[i] != root[j] for i, j in pairs) <= len(pairs) / 50
    spans = {}
    for i, r in enumerate(whole):
        spans.setdefault(root[i], set()).add(r)
    assert all(len(x) == 1 for x in spans.values())


def test_one_of_each_stays(spark, tmp_path):
    """Null, repeated and clashing names: the row of the smallest doc_id stays, with all its columns."""
    rng = random.Random(4)
    base = [" ".join(rng.choices([f"v{i}" for i in range(500)], k=100)) for _ in range(4)]
    near = [t + " end" for t in base]
    rows = [(None, base[0], 0), (None, near[0], 1), (8, base[1], 2), (3, near[1], 3), (3, base[2], 4), (3, base[2], 4), (5, base[3], 6), (None, near[3], 7), (None, None, 8), (1, "", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, _row int").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = simhash.keep_one_of_each(docs, shingle=5, similarity=0.8).collect()
    assert sorted(r["_row"] for r in got) == [0, 3, 4, 6, 9] and got[0].asDict().keys() == {"doc_id", "text", "_row"}
    assert simhash.keep_one_of_each(docs.where("doc_id < 0"), shingle=5, similarity=0.8).collect() == []


@pytest.mark.parametrize("block", [16, 512])
def test_large_groups_of_near_copies(spark, tmp_path, monkeypatch, block):
    """More near copies than a block holds are one group, and what shares a passage only is none."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(5)
    base = rng.choices([f"v{i}" for i in range(900)], k=200)
    copies = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in rng.choices(range(200), k=700)]
    passage = rng.choices([f"p{i}" for i in range(90)], k=60)
    others = [" ".join(passage + rng.choices([f"w{i}" for i in range(900)], k=90)) for _ in range(200)]
    docs = table(spark, f"{tmp_path}/d", copies + others, range(900))
    root = {r["doc_id"]: r["root"] for r in groups_of(docs).collect()}
    assert len({root[i] for i in range(700)}) == 1 and len({root[i] for i in range(700, 900)}) == 200


def test_blocks_lose_no_link():
    """Many partners whose samples are as good, of which few are alike enough: what is linked connects as all pairs would."""
    rng = random.Random(6)
    sets = []
    for group in range(6):
        core = [rng.getrandbits(40) for _ in range(60)]
        for _ in range(40):
            core = core[rng.randint(4, 9) :] + [rng.getrandbits(40) for _ in range(rng.randint(4, 9))]  # alike with a few before it only
            sets.append((group, sorted(core)))
    sign = np.zeros(50, np.uint32).tobytes()
    n = len(sets)
    root = list(range(n))
    for i in range(0, n, 40):
        root[i + 1] = root[i]  # connected before
    rows = pa.RecordBatch.from_arrays(
        [pa.array([g for g, _ in sets], pa.int64()), pa.array([0] * n, pa.int64()), pa.array([False] * n), pa.array(range(n), pa.int64()), pa.array([sign] * n), pa.array(root, pa.int64()), pa.array([True] * n), pa.array([x for _, x in sets], pa.list_(pa.int64()))],
        names=["k", "block", "several", "node", "sign", "root", "guest", "shingles"],
    )
    parts = [rows.slice(at, 7) for at in range(0, n, 7)]
    got = [(u, v) for out in similar._linked(0.8)(iter(parts)) for u, v in zip(*(x.to_pylist() for x in out.columns), strict=True)]
    alike = lambda a, b: 10 * len(set(a) & set(b)) >= 8 * len(set(a) | set(b))
    pairs = [(i, j) for i in range(n) for j in range(i) if sets[i][0] == sets[j][0] and alike(sets[i][1], sets[j][1])]
    before = [(i, r) for i, r in enumerate(root)]
    assert len(got) < n and united(n, got + before) == united(n, pairs + before)
    assert 1 < len(set(united(n, pairs))) < n


@pytest.mark.parametrize("block", [16, 512])
def test_keys_of_many_blocks_lose_no_link(spark, monkeypatch, block):
    """Texts that share every sample, more than a block holds, most of them unlike: wherever two that are alike stand, they are linked."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(7)
    sets = []
    for _ in range(60):
        core = [rng.getrandbits(40) for _ in range(40)]
        for _ in range(rng.randint(1, 6)):
            core = core[rng.randint(1, 6) :] + [rng.getrandbits(40) for _ in range(rng.randint(1, 6))]
            sets.append(sorted(core))
    rng.shuffle(sets)
    n = len(sets)
    alike = lambda a, b: 10 * len(set(a) & set(b)) >= 8 * len(set(a) | set(b))
    pairs = [(i, j) for i in range(n) for j in range(i) if alike(sets[i], sets[j])]
    sign = bytes(200)
    members = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(n) if k == 1 or i % 3 == 0], "k long, node long")
    nodes = spark.createDataFrame([(i, sign) for i in range(n)], "node long, sign binary")
    known = [(i, 0) for i in range(1, n) if rng.random() < 0.3]  # one large group that is connected before
    roots = spark.createDataFrame(known, "node long, root long")
    shingles = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    sets_of = lambda some: shingles.join(some.distinct(), "node")
    got = [(r["u"], r["v"]) for r in similar.links_between(members, nodes, roots, sets_of, 0.8).collect()]
    assert n > 150 and len(pairs) > 60 and all(alike(sets[u], sets[v]) for u, v in got)
    assert united(n, got + known) == united(n, pairs + known) and len(set(united(n, pairs))) > 40
