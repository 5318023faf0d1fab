"""A whole build on a handful of utterances, costly builds that stop in time, and settings."""

import pytest
from pyspark.sql import functions as F

from clamorframe.operators import build as B
from clamorframe.operators import quota
from clamorframe.plans import dataset
from clamorframe.sources import settings as S


def test_a_costly_build_stops_in_time(spark):
    asked = []

    def build(block):
        asked.append([r["seq"] for r in block.orderBy("seq").collect()])
        return block.select("seq", F.when(F.col("seq") % 3 > 0, "probe").alias("reason"))

    rows = spark.range(1, 200).select(F.col("id").alias("seq")).repartition(5)
    kept, passed = quota.until(rows, build, 4, "seq")
    assert sorted(r["seq"] for r in kept.collect()) == [3, 6, 9, 12] and passed.count() == 12
    assert asked[0] == list(range(1, 9)) and sum(asked, []) == list(range(1, sum(map(len, asked)) + 1)) and sum(map(len, asked)) <= 16
    kept, passed = quota.until(rows.where("seq < 8"), build, 50, "seq")
    assert kept.count() == 2 and passed.count() == 7


def test_rare_successes_take_few_blocks(spark):
    """A success in a hundred: blocks grow with what one has taken so far, and the same rows are kept and passed."""
    asked = []

    def build(block):
        asked.append(block.count())
        return block.select("seq", F.when(F.col("seq") % 100 > 0, "probe").alias("reason"))

    kept, passed = quota.until(spark.range(1, 2001).select(F.col("id").alias("seq")), build, 4, "seq")
    assert sorted(r["seq"] for r in kept.collect()) == [100, 200, 300, 400] and passed.count() == 400
    assert len(asked) <= 4


def test_stages_share_claims(spark):
    """Utterance 5 starves, 7's repair leaks in every try, 8 is short, 2 has two recordings."""
    said = lambda i: f"turn on the lamp {i}" if i != 8 else "lamp on"
    even = spark.createDataFrame([(2, 1, said(2)), (2, 2, said(2)), (4, 3, said(4)), (6, 9, said(6))], "id long, seq long, sentence string")
    odd = spark.createDataFrame([(5, 1, said(5)), (2, 2, said(2)), (7, 3, said(7)), (8, 4, said(8)), (9, 5, said(9)), (11, 6, said(11)), (13, 7, said(13))], "id long, seq long, sentence string")

    def label(draws):
        kind = F.when((F.col("id") == 5) & (F.col("pos") % 3 == 1), None).when(F.col("pos") % 3 == 0, "answer").when(F.col("pos") % 3 == 1, "repair").otherwise("repeat")
        return draws.withColumns({"kind": kind, "lost": F.array(F.lit("lamp")), "reason": F.lit("why")})

    def write(probes):
        text = F.when(F.col("kind") == "answer", "On it.").when(F.col("id") == 7, "The lamp?").otherwise("Which one?")
        return probes.select("id", "kind", F.array(F.lit(" "), text).alias("tries"))

    stages = [dataset.Stage("test", even, "test", 1, label), dataset.Stage("train", odd, "train", 1, label, write), dataset.Stage("more", odd, "train", 5, label, write, ["answer"], 4)]
    rows, reasons = dataset.run(stages, "id", "seq")
    assert rows.columns == [*B.ROW, "split"]
    got = [(r["id"], r["slurp_id"], r["kind"], r["target"], r["split"]) for r in rows.orderBy("id").collect()]
    assert got == [
        (1, 2, "answer", "", "test"), (2, 2, "repair", "", "test"), (3, 2, "repeat", "", "test"),
        (4, 9, "answer", "On it.", "train"), (5, 9, "repair", "Which one?", "train"), (6, 9, "repeat", "Which one?", "train"),
        (7, 11, "answer", "On it.", "train"), (8, 13, "answer", "On it.", "train"),
    ]
    assert {r["classifier_reason"] for r in rows.collect()} == {"why"}
    why = sorted((r["stage"], r["reason"], r["n"]) for r in reasons.collect())
    assert why == [("more", "seen/short", 5), ("train", "probe:repair", 1), ("train", "seen/short", 2), ("train", "targets", 1)]


def test_settings(spark, tmp_path):
    base = S.settings({})
    assert (base.track, base.matrix, base.batch, base.witnesses, base.bands["repair"]) == ("two-pass", "legacy", 16, 2, (0.0, 12.0))
    tree = S.settings({"TREE": "1", "HR": "", "OTHER": "x"}, "node7")
    assert (tree.track, tree.matrix, tree.restate, tree.bands["repair"], tree.base_url) == ("tree", "tree", True, (5.0, 12.0), "http://node7:8000/v1")
    assert S.settings({"CR": "1"}).kinds == ["answer", "repair"] and S.settings({"BEAM": "1", "KINDS": "repeat, answer"}).kinds == ["repeat", "answer"]
    for wrong in ({"HR": "1", "TREE": "1"}, {"KINDS": "other"}, {"SCORE_MATRIX": "new"}):
        with pytest.raises(ValueError):
            S.settings(wrong)
    (tmp_path / "host").write_text("\n  node9 \n")
    assert S.host_from(spark, str(tmp_path / "host")) == "node9"
    (tmp_path / "none").write_text("\n")
    with pytest.raises(ValueError):
        S.host_from(spark, str(tmp_path / "none"))
