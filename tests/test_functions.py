"""Vectors for text functions and decisions."""

import pytest
from pyspark.sql import functions as F

from clamorframe.functions import decide as D
from clamorframe.functions import text as T
from clamorframe.operators.score import harmonic


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*words):
    return F.array(*map(F.lit, words)).cast("array<string>")


@pytest.mark.parametrize("before,after", [("p m s", "pm s"), ("at a 7", "at a7"), ("ten a m", "10 am"), ("at a m", "at am")])
def test_fold(spark, before, after):
    assert one(spark, T.fold(strings(*before.split()))) == after.split()


def test_distance(spark):
    a, b = "play mocking bird by eminem".split(), "play mockingbird by edna meyer".split()
    assert one(spark, T.token_distance(strings(*a), strings(*b))) == 0.8
    assert one(spark, T.token_distance(strings(), strings("x"))) == 1.0


@pytest.mark.parametrize(
    "text,want",
    [
        ("Heard: turn off the lights\nReply: Sure.", ("turn off the lights", "Sure.")),
        ("**Heard:** a b\n**Reply:** c", ("a b", "c")),
        ("a b\nreplied: c", ("a b", "c")),
        ('Heard:"turn off the brightness.".turn off the brightness.', ("turn off the brightness.", "turn off the brightness.")),
        ("Heard: only this", ("", "Heard: only this")),
        ("Sure! Heard: turn on the lamp\nReply: ok", ("turn on the lamp", "ok")),
        ('I **heard**: "lights off". done', ("lights off", "done")),
    ],
)
def test_heard_reply(spark, text, want):
    assert tuple(one(spark, T.heard_reply(F.lit(text)))) == want


def test_phrases(spark):
    assert tuple(one(spark, T.phrase_at(strings("wake", "me", "at", "five", "am"), strings("five", "am")))) == (3, 5)
    assert one(spark, T.phrase_at(strings("a"), strings("a", "b"))) is None
    assert one(spark, T.mask_phrase(F.lit("Play Jazz jazz"), F.lit("jazz"))) == "Play [GARBLED] jazz"
    assert one(spark, T.leaks(F.lit("Which city?"), F.lit("new york city"), ["city"])) is False


@pytest.mark.parametrize(
    "pieces,sides,kind,lost",
    [
        (["play", "mocking bird", "eminem"], [[3], [2, 3]], "repair", ["eminem"]),
        (["current traffic report"], [[1], [1]], "repeat", ["current traffic report"]),
        (["turn on", "the radio", "this channel"], [[1, 3], [1, 2, 3], [1, 3]], "repeat", ["turn on", "this channel"]),
        (["how many", "oceans"], [[2], [1]], "answer", []),
    ],
)
def test_decide_by_ids(spark, pieces, sides, kind, lost):
    got = one(spark, D.decide_by_ids(strings(*pieces), F.array(*(F.array(*map(F.lit, s)) for s in sides))))
    assert (got["kind"], got["lost"]) == (kind, lost)


@pytest.mark.parametrize(
    "command,asr,reply,kind,missing",
    [
        ("play mocking bird by eminem", ["eminem"], ["eminem", "mocking bird"], "repair", ["eminem"]),
        ("play mocking bird by eminem", ["play", "mocking bird"], ["mocking bird", "eminem"], "repeat", ["play", "mocking bird", "eminem"]),
        ("play mocking bird by eminem", ["eminem"], ["play"], "answer", []),
        ("set the alarm", ["the alarm"], ["alarm"], "repair", ["the alarm"]),
        ("play mocking bird", ["mocking bird"], ["bird"], "repeat", ["mocking bird", "bird"]),
    ],
)
def test_decide_by_text(spark, command, asr, reply, kind, missing):
    got = one(spark, D.decide_by_text(F.lit(command), strings(*asr), strings(*reply)))
    assert (got["kind"], got["missing"]) == (kind, missing)


def test_harmonic(spark):
    value = lambda *v: one(spark, harmonic(*map(F.lit, v)))
    assert value(0.5, 0.25, 1.0) == pytest.approx(3 / 7) and value(1.0, 1.0, 0.0) == 0 and value(0.8, 0.4) == pytest.approx(8 / 15)


def test_compatibility_forms(spark):
    assert one(spark, T.normalize(T.nfkc(F.lit("Ｐｌａｙ ﬁve")))) == "play five"
