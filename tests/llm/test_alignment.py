"""Cross-tokenizer alignment against plain Python, which encodes every text whole."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clamorframe.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LEVEL = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def encoded(text):
    """(id, bytes) of both sides, or none."""
    if not text:
        return [], []
    a = [(i, bytes(LEVEL[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def links_of(a, b):
    """All overlapping pairs, and groups as text."""
    spans = [[], []]
    for side, out in ((a, spans[0]), (b, spans[1])):
        at = 0
        for i, raw in side:
            out.append((at, at + len(raw), i))
            at += len(raw)
    links = [(i, j) for x, y, i in spans[0] for u, v, j in spans[1] if x < v and u < y]
    cuts = sorted({y for _, y, _ in spans[0]} & {v for _, v, _ in spans[1]})
    groups, low = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for _, y, i in side if low < y <= cut) for side in spans))
        low = cut
    return links, groups


def expected(docs):
    made = [links_of(*encoded(t)) for _, t in docs]
    sides = [encoded(t) for _, t in docs]
    count = Counter(p for links, _ in made for p in set(links))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (doc, _), (links, groups), (a, b) in zip(docs, made, sides, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=str)


SIGNS = ["a", "the", "ing", " ", "  ", "\n", "\t", "\r", ".", ",", ";\r", "'s", "'", "é", "œ", "1", "23", " ", " ", "　", " ", "\u0085", "—", "…", "日", "😀", "▁", "<s>", "<|endoftext|>", "</s>", "\x00", "\x1c", "²", "A", "ﬁ", "é", "<0x41>"]


def test_pieces_encode_as_whole_texts():
    both = alignment.tokenizers(alignment.default_paths())
    apart = both.apart()

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(st.sampled_from(SIGNS), min_size=1, max_size=24))
    def holds(parts):
        text = "".join(parts)
        raw = (" " + text).encode()
        starts = alignment.piece_starts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), apart).tolist()
        pieces = [raw[x:y].decode() for x, y in zip(starts, [*starts[1:], len(raw)], strict=True)]
        ids = list(both.encode(pieces))
        a, b = encoded(text)
        if not a:
            assert any(not x for x, _ in ids)
        else:
            assert [i for x, _ in ids for i in x] == [i for i, _ in a] and [i for _, x in ids for i in x] == [i for i, _ in b]

    holds()


def test_numbers_go_through_bytes():
    x = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1, (1 << 31) - 1])
    data, at = alignment.varints(x)
    assert alignment.numbers(data).tolist() == x.tolist() and at[-1] == len(data) and alignment.numbers(data[:0]).tolist() == []


def table(path, docs):
    n = len(docs)
    pa.parquet.write_table(pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), "a": ["x"] * n, "k": [1] * n, "_row": [0.5] * n, "block": [None] * n}), path)


def test_rows(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " ", "  ", "\n", "a ", *SIGNS, "x▁y and more", "word " * 6000, "é" * 4000, "z" * 3000, "ab" * 2000, " " * 500]
    texts += ["".join(rng.choices(SIGNS, k=rng.randint(1, 60))) for _ in range(150)]
    texts += [" ".join(rng.choice(["the", "of", "été,", "ing.", "Wherein", "naïve"]) for _ in range(rng.randint(1, 50))) for _ in range(60)]
    docs = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts + texts[-20:])]
    table(tmp_path / "d.parquet", docs)
    got = alignment.cross_alignment(spark.read.parquet(str(tmp_path / "d.parquet")))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs)


def test_align_of_whole_texts(spark):
    """The relational part on documents themselves, a token of one side over many of the other."""
    rows = [(1, [(5, 2), (6, 1), (7, 3)], [(1, 1), (2, 1), (3, 4)]), (2, [(9, 4)], [(8, 1)] * 4), (3, [], [])]
    kind = "array<struct<id:int,bytes:int>>"
    got = alignment.align(spark.createDataFrame(rows, f"k long, a {kind}, b {kind}")).orderBy("k", "end").select("k", "a", "b", "group").collect()
    assert list(map(tuple, got)) == [(1, 5, 1, 2), (1, 5, 2, 2), (1, 6, 3, 1), (1, 7, 3, 1), (2, 9, 8, 1), (2, 9, 8, 1), (2, 9, 8, 1), (2, 9, 8, 1)]


def test_empty_table(spark, tmp_path):
    table(tmp_path / "d.parquet", [])
    assert alignment.cross_alignment(spark.read.parquet(str(tmp_path / "d.parquet"))).collect() == []
