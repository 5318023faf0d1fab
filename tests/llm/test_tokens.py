"""Packing and token files against the tokenizers library, text by text."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from clamorframe.llm import packing, rans, tokens


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["the", "Password", "naïve", "Ünder", "x1y2", "don't", "a_b-c", "日本語", "🙂", "1,234.50", "ſ", " ", "###", "é"]
    out = [None, "", " \n\t", "one", "\x0b\x0cend\r\n", "".join(rng.choices("abcé", k=9000))]
    out += [" ".join(rng.choices(words, k=rng.choice([1, 5, 60, 900, 3000]))) for _ in range(40)]
    return out + out[6:12]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("tokens")
    rows = [(3 * i - 5, t, "x", i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, piece string, start int").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(tokens.default_path())
    return {3 * i - 5: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_op1_rows(spark, folder, ids):
    got = packing.op1_best_fit_packing(spark, folder).collect()
    want = []
    for d, own in ids.items():
        whole = [*own, 0]
        want += [(d, k // 2048, k, len(whole[k : k + 2048]), crc(whole[k : k + 2048])) for k in range(0, len(whole), 2048)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= -(-sum(r["length"] for r in got) // 2048) + 1  # the bound by tokens, or one more


def test_op8_rows(spark, folder, ids):
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rans.op8_rans_token_files(spark, folder).collect())
    want, start = [], 0
    for d in sorted(ids):
        whole = [*ids[d], 2]
        want.append((d, start, len(whole), crc(whole)))
        start += len(whole)
    assert got == want
