"""Repeated passages and lines by brute force, and the pipeline's stages each against plain Python on its own input."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import xxhash
from clamorframe.llm import common, lines, quality, substrings

SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
words_of = lambda t: [w for w in SPACE.split(t or "") if w]
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def written(spark, path, texts):
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_op5_rows(spark, tmp_path):
    rng = random.Random(12)
    draw = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    passages = [draw(n) for n in (49, 50, 51, 120)]
    texts = [None, "", " ".join(draw(60)), *(" \t".join(draw(rng.randrange(40)) + rng.choice(passages) + draw(rng.randrange(40)) + rng.choice(passages)) for _ in range(40))]
    texts += [texts[9], texts[9], " ".join(["same"] * 130), " ".join(["same"] * 70)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.op5_substring_dedup(spark, written(spark, tmp_path, texts)).collect()}
    first, split = {}, [words_of(t) for t in texts]
    for d, w in enumerate(split):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, w in enumerate(split):
        gone = {k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(i, i + 50)}
        assert got[d] == (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def plain_chunks(text):
    """Chunks as lists of lines: an end after two lines or more, where a hash of the last two lines' hashes is divisible."""
    out, mask = [[]], (1 << 64) - 1
    before = 0
    for line in text.split("\n") if text else []:
        h = xxhash.xxh64(line.encode()).intdigest()
        out[-1].append(line)
        both = ((before * 0x9E3779B97F4A7C15 + h) * 0xD6E8FEB86659FD93) & mask
        before = h
        if len(out[-1]) >= 2 and (both >> 32) % 3 == 0:
            out.append([])
    return [c for c in out if c]


def test_op9_rows(spark, tmp_path):
    rng = random.Random(13)
    pool = [f"line {i} é" for i in range(60)] + ["", " "]
    runs = [rng.choices(pool, k=12) for _ in range(4)]
    texts = [None, "", "\n\n\n", *("\n".join(rng.choices(pool, k=rng.randrange(6)) + rng.choice(runs) + rng.choices(pool, k=3)) for _ in range(50))]
    got = {r["doc_id"]: r for r in lines.op9_line_dedup(spark, written(spark, tmp_path, texts)).collect()}
    seen, gone = set(), 0
    for d, t in enumerate(texts):
        cut, left, lost = plain_chunks(t), [], []
        for c in cut:
            whole = "\n".join(c)
            if len(c) > 1 and whole.strip(" \t\n\x0b\x0c\r") and whole in seen:
                lost.append(c)
                continue
            seen.add(whole)
            left.append(whole)
        gone += len(lost)
        r = got[d]
        assert (r["n_lines"], r["n_chunks"], r["n_removed_chunks"], r["n_removed_lines"], r["kept_sha256"]) == (sum(map(len, cut)), len(cut), len(lost), sum(map(len, lost)), sha("\n".join(left)))
    assert gone > 50


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(14)
    draw = lambda n: [f"w{rng.randrange(800)}" for _ in range(n)]
    texts = [None, "", "short text", "# " * 200 + " ".join(draw(60))]
    for _ in range(60):
        w = draw(rng.randrange(60, 200))
        texts.append(" ".join(w))
        if rng.random() < 0.5:
            texts.append("  ".join(w))
        if rng.random() < 0.5:
            texts.append(" ".join([*w[:-1], "other"]))
    path = written(spark, tmp_path, texts)
    docs = common.documents(spark, path)
    columns, stages = docs.columns, []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.cut(stage(spark, docs, path), f"test{at}")
        stages.append([r.asDict() for r in docs.collect()])
    good, exact, near, mixed, packed = stages
    assert all(list(s[0]) == columns for s in stages[:4])
    kept = {r["doc_id"] for r in quality.op3_quality_rules(spark, path).where("kept").collect()}
    assert {r["doc_id"] for r in good} == kept and len(good) >= len(texts) - 6
    best = {}
    for r in good:
        key = "".join(words_of(r["text"]))
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in exact} == {d for _, d in best.values()} and len(exact) < len(good) - 10
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [words_of(r["text"])] for i in range(len(w) - 4)} for r in exact}
    stay, own = set(), {r["doc_id"] for r in near}
    for d in sorted(sets):  # copies differ from one original each, so the first of each group stays
        if all(10 * len(sets[d] & sets[x]) < 8 * len(sets[d] | sets[x]) for x in stay):
            stay.add(d)
    assert own == stay and len(stay) < len(exact) - 10
    taken = collections.Counter(r["doc_id"] for r in mixed)
    assert set(taken) <= own and max(taken.values()) <= 2
    assert sorted(r["text"] for r in mixed) == sorted(r["text"] for r in near for _ in range(taken[r["doc_id"]]))
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == taken
    room = collections.Counter()
    for r in packed:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048
    assert len(corpus_pipeline.run(spark, path).collect()) == len(packed)
