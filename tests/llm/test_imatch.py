"""I-Match fingerprints against plain Python: edited texts, every signature, and what likeness tells apart."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet
import xxhash

from clamorframe.llm import imatch

SIGNED = 1 << 63


def h64(x: bytes, seed=42):
    h = xxhash.xxh64_intdigest(x, seed % (1 << 64))
    return h - (1 << 64) if h >= SIGNED else h


def fold(values):
    seed = 42
    for x in values:
        seed = h64((x % (1 << 64)).to_bytes(8, "little"), seed)
    return seed % (1 << 32)


def rank(x, k):
    h = h64(k.to_bytes(4, "little"), h64((x % (1 << 64)).to_bytes(8, "little")))
    h = (h | 1 << 62) & (SIGNED - 1)
    return h & -h


def expected(docs):
    """By doc_id: all columns but the two likenesses, and both fingerprints' signatures."""
    words = lambda t: {w for w in re.split("[ \t\n\x0b\x0c\r]+", t.lower()) if w}
    texts = [t or "" for _, t in docs]
    df = Counter(w for t in texts for w in words(t))
    low, high = (len(docs) * math.exp(-x) for x in reversed(imatch.BAND))
    known = {w for w, n in df.items() if low <= n <= high}

    def signatures(t):
        terms = sorted(h64(w.encode()) for w in words(t) & known)
        if not terms:
            return [fold([h64(t.encode())])] * (imatch.LEXICONS + 1)
        out = [fold(terms)]
        for k in range(imatch.LEXICONS):
            best = max(rank(x, k) for x in terms)
            out.append(fold([x for x in terms if rank(x, k) == best]))
        return out

    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, -(docs[i][0] or 0)))
    out = {}
    for at, i in enumerate(order):
        t, behind = texts[i], texts[order[(at + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + behind[:half]
        s, e, b = signatures(t), signatures(edited), signatures(behind)
        same = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
        hexed = lambda x: "".join(f"{v:08x}" for v in x)
        out[docs[i][0]] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(s), hexed(e), same(s, e), same(s, b))
    return out


def run(spark, path, docs):
    n = len(docs)
    pa.parquet.write_table(pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), "h": ["x"] * n, "info": [1] * n, "_row": [2.0] * n}), path)
    got = imatch.fingerprints(spark.read.parquet(str(path)))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return [tuple(r) for r in got.collect()]


def test_rows(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abÉßz,", k=rng.randint(1, 3)))
    texts = [None, "", " \n", "x", "é", "w" * 5000, " ".join(word() for _ in range(20_000))]
    texts += [rng.choice(["\t", " ", "\n"]).join(word() for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += texts[20:30]
    ids = rng.sample(range(1000), len(texts))
    ids[9] = None
    docs = list(zip(ids, texts, strict=True))
    got = run(spark, tmp_path / "d.parquet", docs)
    assert {r[0]: r[1:] for r in got} == expected(docs) and len(got) == len(docs)


def test_repeated_rows_one_row_and_none(spark, tmp_path):
    got = run(spark, tmp_path / "a.parquet", [(5, "one two"), (5, "one two"), (5, "one two")])
    assert len(set(got)) == 1 and len(got) == 3
    assert got[0][6] == 1.0
    assert run(spark, tmp_path / "b.parquet", [(1, "abcd")])[0][:3] == (1, 4, hashlib.sha256(b"abab").hexdigest())
    assert run(spark, tmp_path / "c.parquet", []) == []
