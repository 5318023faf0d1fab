"""Small functions that builds and evaluations are put together from."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from clamorframe.functions import judge as J
from clamorframe.functions import label as L
from clamorframe.operators import assemble as A
from clamorframe.operators import audio
from clamorframe.sources import provider, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*words):
    return F.array(*map(F.lit, words)).cast("array<string>")


def test_model_families_and_exact_tokens(spark):
    of = lambda x: one(spark, J.model_family(F.lit(x)))
    assert [of(x) for x in ("org/Qwen3-30B", "a/qwen2.5-3b", "QWEN2_5", "other")] == ["qwen3", "qwen2.5", "qwen2.5", None]
    score = lambda x: one(spark, J.token_score(F.lit(x).cast("string"), "<A>"))
    assert [score(x) for x in (" <A> ", "<A>.", None)] == [1.0, 0.0, 0.0]


def test_two_texts_need_two_witnesses(spark):
    of = lambda heard, reply, a, b: one(spark, L.by_two_texts(F.lit("play mocking bird by eminem"), F.lit(heard), F.lit(reply), a, b))
    assert tuple(of("x", "y", strings("eminem", "olly"), strings("eminem", "mocking bird"))) == ("repair", ["eminem"])
    assert of(" ", "y", strings("eminem"), strings("eminem")) is None and of("x", "y", F.lit(None).cast("array<string>"), strings()) is None


def test_eligible_rows_and_token_targets(spark):
    rows = spark.createDataFrame([(1, 5), (2, 3), (3, 9), (4, 4)], "id long, n int")
    assert [r["id"] for r in A.eligible(rows, spark.createDataFrame([(3,), (3,)], "id long"), "id", F.col("n")).orderBy("id").collect()] == [1, 4]
    assert A.eligible(rows, None, "id", F.col("n")).count() == 3
    target = lambda kind, token: one(spark, A.token_target(F.lit("yes"), F.lit(kind), token))
    assert (target("answer", "<A>"), target("repair", "<A>"), target("answer", None)) == ("<A>", "yes", "yes")


def test_channels_and_length(spark):
    stereo = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.5)))
    assert one(spark, audio.downmix(stereo)) == [0.5, 0.25]
    assert one(spark, audio.truncated(F.array(*map(F.lit, range(9))), 2, 3)) == [0, 1, 2, 3, 4, 5]


def test_replies_by_key(spark):
    asked = spark.createDataFrame([("a", 1), ("b", 2)], "request_key string, id int")
    given = spark.createDataFrame([("a", "y"), ("a", "x")], "request_key string, response string")
    assert {r["id"]: r["response"] for r in provider.answered(asked, given).collect()} == {1: "x", 2: None}
    assert [r["request_key"] for r in provider.open_requests(asked.unionByName(asked), given).collect()] == ["b"]


def test_rows_and_sweeps_as_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", bytearray(b"x")), (2, "test", None)], "id int, split string, audio binary")
    tables.write_rows_json(rows, f"{tmp_path}/rows")
    assert {p.parent.name for p in Path(f"{tmp_path}/rows").glob("*/part-*")} == {"split=train", "split=test"} and spark.read.json(f"{tmp_path}/rows").columns == ["id", "split"]
    tables.write_sweep(spark.createDataFrame([(2, "b"), (1, "c"), (2, "a")], "n_best int, band string").repartition(3), f"{tmp_path}/sweep")
    lines = [json.loads(x) for p in Path(f"{tmp_path}/sweep").glob("part-*") for x in p.read_text().splitlines()]
    assert [(x["n_best"], x["band"]) for x in lines] == [(1, "c"), (2, "a"), (2, "b")]
