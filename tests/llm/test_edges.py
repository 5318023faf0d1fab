"""Very long texts, empty tables and frames that are no plain tables, where other tests do not have them."""

import collections
import hashlib
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from clamorframe.llm import common, exact_dedup, lines, mixing, quality, rans, search, simhash, substrings

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, keep_id int, root string"
LONG = " ".join(f"w{i}é" for i in range(30_000))
ONE = "x" * 200_000
TEXTS = [LONG, "  " + LONG.replace(" ", "\n"), ONE, ONE + "y", LONG[: len(LONG) // 2], None, "", "plain words " * 40]
SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", None, 1, "r") for i, t in enumerate(TEXTS)], COLUMNS).repartition(2).write.parquet(f"{folder}/documents.parquet")
    return common.documents(spark, str(folder)), str(folder)


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def test_long_texts_are_measured_and_compared_whole(docs):
    frame, _ = docs
    got = {r["doc_id"]: r for r in quality.quality_rules(frame).collect()}
    assert [got[i]["n_words"] for i in range(len(TEXTS))] == [len(words_of(t)) for t in TEXTS]
    bare = [SPACE.sub("", t or "") for t in TEXTS]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame).collect()}
    assert all(got[i]["text_sha256"] == hashlib.sha256(bare[i].encode()).hexdigest() and got[i]["group_size"] == bare.count(bare[i]) for i in got)
    prints = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_groups(frame).collect()}
    assert prints[0] == prints[1] and prints[0][0] != prints[4][0] and prints[5][1] == prints[6][1] == 5


def test_long_texts_lose_what_they_share(docs):
    frame, folder = docs
    got = {r["doc_id"]: r for r in substrings.op5_substring_dedup(frame.sparkSession, folder).collect()}
    assert [got[i]["n_removed"] for i in range(6)] == [0, len(words_of(LONG)), 0, 0, len(words_of(TEXTS[4])) - (0 if LONG[len(LONG) // 2] == " " or LONG[len(LONG) // 2 - 1] == " " else 1), 0]
    left = {r["doc_id"]: r["n_removed_lines"] for r in lines.op9_line_dedup(frame.sparkSession, folder).collect()}
    assert left[0] == 0 and len(left) == len(TEXTS)


def test_long_texts_stay_one_of_each(docs):
    frame, _ = docs
    kept = sorted(r["doc_id"] for r in simhash.keep_one_of_each(frame, 5, 0.8).collect())
    assert kept == [0, 2, 3, 4, 5, 7]  # texts without words are alike


def test_long_texts_are_mixed_by_size(docs):
    frame, _ = docs
    rows = {r["doc_id"]: r for r in mixing.mix(frame).collect()}
    assert all(rows[i]["size"] == len(words_of(TEXTS[i])) and rows[i]["taken"] <= 2 * rows[i]["size"] for i in rows)


def test_pipeline_takes_long_texts(docs):
    frame, folder = docs
    got = corpus_pipeline.run(frame.sparkSession, folder).collect()
    own = collections.defaultdict(int)
    for r in got:
        own[r["doc_id"]] += r["length"]
        assert r["length"] <= 2048
    assert set(own) <= {1, 4} and sum(own.values()) > 2048  # of equal texts the one with more white space stays; the others are short or repeat themselves


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = common.documents(spark, str(tmp_path))
    assert rans.op8_rans_token_files(spark, str(tmp_path)).collect() == []
    assert simhash.keep_one_of_each(frame, 5, 0.8).collect() == []
    assert search.op11_ranked_search(spark, str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_keys_of_a_frame_behind_a_shuffle(spark, docs):
    frame, _ = docs
    assert common.is_plain(frame) and common.is_plain(frame.select("doc_id").where("doc_id > 1"))
    for other in (frame.repartition(3), frame.orderBy("doc_id"), frame.distinct(), frame.limit(4)):
        assert not common.is_plain(other)
        keyed = common.with_row_key(other.select("doc_id"))
        assert common.is_plain(keyed.drop("_row")) and keyed.select(F.countDistinct("_row")).first()[0] == other.count()
    mixed = {r["doc_id"]: r["group_size"] for r in exact_dedup.exact_dedup(frame.repartition(5)).collect()}
    assert mixed[0] == 2 and len(mixed) == len(TEXTS)
