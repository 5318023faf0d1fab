"""Reports, arguments, reasons and folding of characters on small cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from clamorframe.functions import label as L
from clamorframe.functions import text as T
from clamorframe.operators import assemble as A
from clamorframe.plans import report


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*words):
    return F.array(*map(F.lit, words)).cast("array<string>")


def test_bins_keep_empty_cells_and_name_clean_rows(spark):
    data = [(1, 0.5, "answer"), (2, 3.9, "answer"), (3, 25.0, "bad"), (4, None, "bad"), (5, -2.0, "bad")]
    counts, clean = report.typed_bins(spark.createDataFrame(data, "id long, snr_db double, judged string"), "snr_db", "judged", [0, 4, 8], ["answer", "bad"])
    assert sorted(map(tuple, counts.collect())) == [(0, "answer", 2), (0, "bad", 1), (1, "answer", 0), (1, "bad", 1)]
    assert [r["id"] for r in clean.collect()] == [4]


def test_console_and_family(spark):
    total = spark.createDataFrame([(0.5, 0.25, 0.3333, 3, 2, 1, 1, 0)], "C double, R double, EAR double, answer_rows long, repair_rows long, repeat_rows long, judge_parse_failures long, unanswered_rows long")
    cells = spark.createDataFrame([("repair", "bad", 2), ("answer", "repair", 1), ("answer", "answer", 2)], "kind string, label string, n long")
    assert report.console(total, cells, ["answer", "repair"], "m").splitlines() == [
        "Final Eval - m (3 answer / 2 repair rows)", "C  :  0.500", "R  :  0.250", "EAR:  0.333", "judge parse failures: 1/5 (scored 0)",
        "confusion (target kind -> judged type):", "  answer   answer:  2 repair:  1", "  repair   bad:  2",
    ]
    text = report.family([["base", "**1.0**"]], [["answer", "1 → 2"]], ["C"], ["answer"], "tab:x")
    assert text.startswith(r"\begin{table}[t]") and r"\textbf{1.0}" in text and r"\label{tab:x}" in text and text.count(r"\begin{minipage}") == 2


def test_caps_as_arguments(spark):
    caps = report.arguments("answer=3, repeat=1")
    assert caps == {"answer": 3, "repeat": 1}
    rows = spark.createDataFrame([("answer",), ("repeat",), ("repair",)], "kind string")
    assert [tuple(r) for r in report.shortfall(rows, caps).collect()] == [("answer", 2)]
    for wrong in ("other=1", "answer", "answer=x", ""):
        with pytest.raises(ValueError):
            report.arguments(wrong)


def test_shifts_mark_the_diagonal(spark):
    base, tuned = (spark.createDataFrame([("answer", "answer", n)], "kind string, judged string, n long") for n in (3, 5))
    cells = spark.createDataFrame([("answer", "answer"), ("answer", "bad")], "kind string, judged string")
    assert sorted(tuple(r) for r in report.shift_table(base, tuned, cells).collect()) == [("answer", "answer", "**3 → 5**"), ("answer", "bad", "0 → 0")]


def test_pairs_for_preference(spark):
    rows = spark.createDataFrame([(i, "t") for i in range(200)], "id long, target string")
    rollouts = spark.createDataFrame([(i, "r", "bad", 0.0 if i % 2 else 1.0) for i in range(0, 210)], "id long, response string, judged string, score double")
    got = A.preference_pairs(rows, rollouts).toPandas()
    assert sorted(got["id"]) == list(range(1, 200, 2)) and set(got["chosen"]) == {"t"} and set(got["rejected_type"]) == {"bad"}
    assert 0 < (got["split"] == "dev").sum() < 25


def test_reasons(spark):
    command = F.lit("play mocking bird by eminem")
    of = lambda a, r: one(spark, L.reason_by_text(command, strings(*a), strings(*r)))
    assert of(["eminem"], ["eminem", "mocking bird"]) == "a1xr2 -> 1 agreed | asr lost: eminem | reply lost: eminem; mocking bird"
    assert of(["play", "mocking bird"], ["mocking bird", "eminem"]) == "a2xr2 -> 1 agreed (both wrecked) | asr lost: play; mocking bird | reply lost: mocking bird; eminem"
    assert of([], ["play"]) == "a0xr1 -> 0 agreed | asr lost: none | reply lost: play"
    consensus = lambda lost, bad, heard: one(spark, L.reason_by_consensus(F.lit(3), strings(*lost), F.lit(bad), F.lit(heard)))
    assert consensus(["a", "b"], False, "") == "3 hyps | consensus lost: a; b"
    assert consensus([], True, "other words") == "3 hyps | consensus lost: none (unintelligible) | misheard as: other words"


def test_leaks_are_counted_until_a_target_is_taken(spark):
    tries = strings("Did you say jazz?", " ", "JAZZ again?", "Which kind?", "jazz")
    assert one(spark, L.leaked_attempts(tries, F.lit("repair"), F.lit("jazz"))) == 2 and one(spark, L.leaked_attempts(tries, F.lit("answer"), F.lit("jazz"))) == 0
    assert one(spark, L.leaked_attempts(strings(*["jazz"] * 12), F.lit("repair"), F.lit("jazz"))) == 8


def test_variants_of_characters(spark):
    for text in ("Ｐｌａｙ　１２３", "x² ª ſo", "ﾃﾞ…", "éß œ", "", "plain"):
        want = "".join(n if len(n := unicodedata.normalize("NFKC", c)) == 1 else c for c in text)
        assert one(spark, T.folded(F.lit(text))) == want
    assert one(spark, T.normalize(F.lit("Ｐｌａｙ　ＪＡＺＺ！"))) == "play jazz"
