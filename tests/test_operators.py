"""Judges' replies, labels, recall sweeps, signals, assembly, providers and streams on small cases."""

import io
import json
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from clamorframe.functions import judge as J
from clamorframe.functions import label as L
from clamorframe.operators import assemble as A
from clamorframe.operators import audio, nbest
from clamorframe.plans import report
from clamorframe.sources import provider, tables
from clamorframe.streaming import claims


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*words):
    return F.array(*map(F.lit, words)).cast("array<string>")


@pytest.mark.parametrize(
    "text,want",
    [('{"type": " Repair "}', ("repair", False)), ("{}", ("bad", False)), ('{"type": "other"}', ("bad", True)), ('{"type": null}', ("bad", True)), ("broken", ("bad", True)), ("[1]", ("bad", True)), (None, ("bad", True))],
)
def test_judged_type(spark, text, want):
    assert tuple(one(spark, J.judged_type(F.lit(text).cast("string")))) == want


@pytest.mark.parametrize("text,want", [('{"score": 0.5}', (0.5, False)), ('{"score": "1"}', (1.0, False)), ('{"score": 0.7}', (0.0, True)), ("{}", (0.0, True)), ("", (0.0, True))])
def test_judged_score(spark, text, want):
    assert tuple(one(spark, J.judged_score(F.lit(text)))) == want


@pytest.mark.parametrize("text,want", [('{"score": 0.25}', 0.25), ("{}", 0.0), ('so "score": .5, yes', 0.5), ("I say 1.", 1.0), ("none", 0.0)])
def test_loose_score(spark, text, want):
    assert one(spark, J.loose_score(F.lit(text))) == want


def test_rendering(spark):
    assert one(spark, J.shown(strings("a", "b"))) == '"a"; "b"' and one(spark, J.shown(strings())) == "(none)"
    assert one(spark, J.numbered(strings("x", "y"), "HYP ")) == "HYP 1: x\nHYP 2: y"
    assert one(spark, J.unfenced(F.lit('```json\n{"a": 1}\n```'))).strip() == '{"a": 1}'
    assert [one(spark, report.histogram_label(F.lit("a"), F.lit(x))) for x in (0.0, 0.5, 1.0)] == ["a@0", "a@0.5", "a@1"]
    assert report.latex([["r", "**1.0**"]], ["run", "c"]).splitlines()[2] == r"r & \textbf{1.0} \\"


def test_labels(spark):
    reply = lambda **x: F.lit(json.dumps(x))
    got = one(spark, L.single_witness(reply(kind="Repair", lost=[" jazz ", ""], reply="Which?")))
    assert (got["kind"], got["missing"], got["reason"]) == ("repair", ["jazz"], "lost from Heard: jazz")
    assert one(spark, L.single_witness(reply(kind="other"))) is None
    tries = F.array(L.classified(reply(kind="repair", missing=[])), L.classified(reply(kind="repair", missing=["x"])))
    assert one(spark, L.first_consistent(tries))["missing"] == ["x"]
    assert one(spark, L.first_consistent(F.array(L.classified(F.lit("broken")), L.classified(reply(kind="answer"))))) is None
    consensus = lambda **x: one(spark, L.by_consensus(F.lit("play mocking bird by eminem"), strings("play it"), reply(**x)))
    assert tuple(consensus(lost=["eminem", "please"])) == ("repair", ["eminem"])
    assert tuple(consensus(lost=["mocking bird eminem"])) == ("repeat", ["mocking bird eminem"])
    assert tuple(consensus(lost=[], unintelligible=True)) == ("repeat", [])
    assert tuple(consensus(lost=["olly"])) == ("answer", [])
    ids = F.array(strings("2"), strings("2", "x", "9"), strings("1"))
    assert tuple(one(spark, L.by_witnesses(strings("play", "jazz"), strings("a", "b", " "), ids))) == ("repair", ["jazz"])
    assert one(spark, L.by_witnesses(strings("play"), strings(" "), F.array(strings("1")))) is None
    written = strings("", "Did you say Jazz?", " Which kind? ")
    assert one(spark, L.first_target(written, F.lit("repair"), F.lit("jazz"))) == "Which kind?"
    assert one(spark, L.first_target(written, F.lit("answer"), F.lit("jazz"))) == "Did you say Jazz?"


def _slow_distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
    return d[len(a), len(b)] / max(len(a), len(b), 1)


def test_token_distance(spark):
    from clamorframe.functions.text import token_distance

    rng = random.Random(1)
    pairs = [[[rng.choice(["x", "yy", "z", "é", "w w"]) for _ in range(rng.randrange(9))] for _ in range(2)] for _ in range(300)]
    wide = [f"w{i}" for i in range(56_000)]
    pairs += [[wide[:300], wide[5:290]]]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>").select("i", token_distance(F.col("a"), F.col("b")).alias("d"))
    for r in got.collect():
        assert r["d"] == pytest.approx(_slow_distance(*pairs[r["i"]]))


def test_prefix_scores(spark):
    rng = random.Random(2)
    words = ["play", "jazz", "tune", "lamp", "red", "the"]
    data = [(i, " ".join(rng.choices(words, k=5)), [" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(rng.randrange(5))]) for i in range(40)] + [(99, "the", ["play"])]
    got = {(r["id"], r["n_best"]): r for r in nbest.prefix_scores(spark.createDataFrame(data, "id long, sentence string, hyps array<string>")).collect()}
    want = 0
    for i, sentence, hyps in data:
        content, hs = [w for w in sentence.split() if w != "the"], [h.split() for h in hyps]
        for n in range(1, len(hs) + 1) if content else ():
            r, top = got[i, n], hs[:n]
            hits = [sum(w in h for h in top) for w in content]
            pairs = [_slow_distance(top[a], top[b]) for a in range(n) for b in range(a + 1, n)]
            assert r["uniq"] == len({" ".join(h) for h in top}) and r["pair_wer"] == pytest.approx(sum(pairs) / len(pairs) if pairs else 0)
            assert [r["h1"], r["any"], r["two"]] == pytest.approx([sum(w in hs[0] for w in content) / len(content), sum(c > 0 for c in hits) / len(content), sum(c > 1 for c in hits) / len(content)])
            assert r["recovered"] == [w for w, c in zip(content, hits) if c and w not in hs[0]]
            want += 1
    assert want == len(got)


def test_pairs_of_a_long_row_are_dealt_out(spark):
    """150 hypotheses of one row meet in blocks, each pair once."""
    rng = random.Random(4)
    hyps = [[rng.choice(["x", "yy", "z", "é", "w"]) for _ in range(rng.randrange(5))] for _ in range(150)]
    codes = nbest.coded(spark.createDataFrame([(7, n, h) for n, h in enumerate(hyps)] + [(8, 0, ["x"])], "_row long, _n int, _words array<string>"))
    assert {(r["_row"], r["_n"]): (len(r["_code"]), r["_size"]) for r in codes.collect()} == {**{(7, n): (len(h), len(h)) for n, h in enumerate(hyps)}, (8, 0): (1, 1)}
    got = {r["_n"]: r["_apart"] for r in nbest.pair_distances(codes).collect()}
    assert got == {n: pytest.approx(sum(_slow_distance(hyps[m], hyps[n]) for m in range(n))) for n in range(1, 150)}
    rows = spark.createDataFrame([(1, "x yy", [" ".join(h) for h in hyps])], "id long, sentence string, hyps array<string>")
    last = nbest.prefix_scores(rows).orderBy(F.desc("n_best")).first()
    assert last["n_best"] == 150 and last["uniq"] == len({" ".join(h) for h in hyps})


def test_mix_ratio():
    rng = np.random.default_rng(3)
    clean, clips = rng.normal(0, 0.05, 4000).astype(np.float32), [rng.normal(0, 1, n) for n in (900, 4000, 9000)]
    for snr in (0.0, 7.5, 20.0):
        out = audio.mix(clean, clips, snr, np.random.default_rng(4))
        assert np.max(np.abs(out)) < 1
        assert 10 * np.log10(np.mean(clean**2) / np.mean((out - clean) ** 2)) == pytest.approx(snr, abs=0.01)
    assert np.max(np.abs(audio.mix(clean * 40, clips, 0.0, np.random.default_rng(4)))) == pytest.approx(1)


def test_mixed_rows(spark):
    rows = spark.createDataFrame([(i, [0.1 * (i + 1), -0.2, 0.3] * 4, None if i == 0 else 5.0) for i in range(6)], "id long, audio array<float>, snr_db double")
    first, again = ({r["id"]: r["noisy"] for r in audio.mixed(x, rows).collect()} for x in (rows, rows.repartition(5)))
    assert first == again and first[0] == pytest.approx([0.1, -0.2, 0.3] * 4) and first[1] != pytest.approx([0.2, -0.2, 0.3] * 4)


def test_mask_and_wav(spark):
    x = np.full(16_000, 0.5, np.float32)
    out = audio.mask(x, 0.5, 0.5, np.random.default_rng(5))
    assert np.flatnonzero(out != x).min() >= 7200 and np.flatnonzero(out != x).max() < 8800
    assert audio.mask(x, 2.0, 3.0, np.random.default_rng(5)) is None
    data = one(spark, audio.wav(F.array(F.lit(0.0), F.lit(1.5), F.lit(-0.5)).cast("array<float>")))
    with wave.open(io.BytesIO(bytes(data))) as f:
        assert (f.getframerate(), f.getnchannels()) == (16_000, 1)
        assert np.frombuffer(f.readframes(3), "<i2").tolist() == [0, 32767, -16384]


def test_masked_rows(spark):
    """As ``mask`` does it, for spans that are short, long, cut by an end, empty or null."""
    rng = np.random.default_rng(6)
    spans = [(0.0, 0.05), (0.05, 0.15), (0.1, 0.4), (0.19, 0.2), (0.5, 0.6), (-0.2, -0.1), (None, 0.1), (-0.06, 0.07)]
    data = [(i, rng.normal(0, 0.1, 3200).astype(np.float32).tolist(), s) for i, s in enumerate(spans)] + [(8, None, (0.0, 0.1)), (9, [], (0.0, 0.1)), (10, [0.5] * 3200, None)]
    got = {r["id"]: r["noisy"] for r in audio.masked(spark.createDataFrame(data, "id long, audio array<float>, span struct<start: double, end: double>").repartition(3), "id").collect()}
    for i, x, s in data:
        want = audio.mask(np.asarray(x, np.float32), *s, audio.generator(42, "mask", i)) if x and s and None not in s else None
        assert (got[i] is None) if want is None else np.allclose(got[i], want, rtol=1e-5, atol=1e-7)


def test_masking_keeps_signals_out_of_python(spark):
    """4,000 signals of 16,000 samples, a quarter of a GB in one partition: no node maps whole rows in Python."""
    rows = spark.range(0, 4000, 1, 1).select("id", F.array_repeat(F.lit(0.1).cast("float"), 16_000).alias("audio"), F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end")).alias("span"))
    made = audio.masked(rows)
    assert "MapInPandas" not in made._jdf.queryExecution().toString()
    got = made.agg(F.count("noisy").alias("n"), F.min(F.size("noisy")).alias("least"), F.max(F.size("noisy")).alias("most")).first()
    assert tuple(got) == (4000, 16_000, 16_000)


def test_assembly(spark):
    got = one(spark, A.mask_plan(F.lit("Play the Jazz, please"), F.lit("jazz"), F.lit(7)))
    assert (got["start"], got["end"]) == (2, 3) and got["stop"] in (1, 3)
    assert one(spark, A.mask_plan(F.lit("play jazz"), F.lit("jazz"), F.lit(7))) is None
    assert [tuple(e) for e in one(spark, A.entities(F.lit("play [Genre : Jazz ] at [time : six]")))] == [("genre", "jazz"), ("time", "six")]
    assert one(spark, A.target_line(F.lit("yes"), F.lit("no"), True)) == "Heard: no\nReply: yes" and one(spark, A.target_line(F.lit(""), F.lit("no"), True)) == ""


def test_provider(spark):
    key = lambda s, u, a=0: one(spark, provider.request_key(F.lit(s), F.lit(u), 0.7, a))
    assert key("a", "b") == key("a", "b") != key("a", "b", 1) and key("a|1:b", "") != key("a", "1:b|")
    tries = spark.createDataFrame([(1, 0, ""), (1, 1, "x"), (1, 2, "y"), (2, 0, "")], "id long, attempt int, text string")
    assert [tuple(r) for r in provider.first_valid(tries, ["id"], F.col("text") != "").collect()] == [(1, 1, "x")]


def test_dataset_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["answer", "repair"][i % 2], "train") for i in range(9)], "id long, kind string, split string")
    tables.write_dataset(tables.ensure_columns(rows, {"heard": "", "kind": "x"}), f"{tmp_path}/d")
    got = tables.dataset(spark, f"{tmp_path}/d", "train", ["repair"], 2).orderBy("id").collect()
    assert [(r["id"], r["heard"]) for r in got] == [(1, ""), (3, "")]
    with pytest.raises(ValueError):
        tables.check_kinds(["other"])


def test_stream_claims(spark, tmp_path):
    schema, seen = "id long, text string", lambda: sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    for batch in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i, "x") for i in batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        claims.drain(claims.first_claims(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "id"), f"{tmp_path}/out", f"{tmp_path}/mark")
    assert seen() == [1, 2, 3]


def test_build_parts(spark, tmp_path):
    from clamorframe.operators import build as B
    from clamorframe.operators import select as O
    from clamorframe.sources import jsonl

    rows = spark.createDataFrame([(i, i % 4 == 1) for i in range(10)], "id long, good boolean")
    for n, kept, claimed in ((2, [1, 5], 6), (3, [1, 5, 9], 10), (4, [1, 5, 9], 10)):
        a, b = O.quota(rows, F.col("good"), n, "id")
        assert sorted(r["id"] for r in a.collect()) == kept and b.count() == claimed
    a, b = O.quota(rows, F.lit(False), 2, "id")
    assert (a.count(), b.count()) == (0, 10)
    sides = F.array(F.array(F.lit(3)), F.array(F.lit(2), F.lit(3)))
    assert one(spark, L.reason_by_ids(F.lit(3), sides)) == "3 pieces | [3] x [2, 3] -> agreed [3]"
    assert tuple(one(spark, L.buckets(sides))) == ("a1", "r2")
    assert one(spark, L.slot_words(F.lit("media_type"), {"time": "time of day"})) == "media type" and one(spark, L.slot_words(F.lit("time"), {"time": "time of day"})) == "time of day"
    assert one(spark, L.supervised(F.lit(2), F.array(*map(F.lit, (7, 8, 9))))) == [-100, -100, 9]
    assert one(spark, B.critical(F.lit("ab"), F.lit("abcd"))) and not one(spark, B.critical(F.lit("abc"), F.lit("abcd")))
    assert one(spark, B.gated_target(F.lit("x"), F.lit("test"))) == "" and not one(spark, B.targets_written(strings("a", " ", "c")))
    made = B.dataset_rows(spark.createDataFrame([(1, "answer", "yes", "no", "train")], "id long, kind string, target string, asr_transcript string, split string"), True)
    assert made.columns == [*B.ROW, "split"] and len(B.ROW) == 17
    assert made.first()["target"] == "Heard: no\nReply: yes" and made.first()["lost"] == [] and made.first()["snr_db"] is None
    assert B.stacked(rows.select("id"), rows).count() == 20
    for name, lines in (("b", ['{"a": 1}', "", '{"a": 2}']), ("a", ['{"a": 3}'] * 2000)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    last = jsonl.last_with(tables.read_log(spark, str(tmp_path)), "a").first()["value"]
    assert json.loads(last) == {"a": 2}
    good, bad = tables.of_rate(spark.createDataFrame([(16000,), (8000,), (None,)], "sampling_rate int"), 16000)
    assert (good.count(), bad.count()) == (1, 2)


def test_evaluation(spark):
    from clamorframe.operators import evaluate as E

    data = [(1, "repair", ["x"], '{"type": "repair"}'), (2, "repair", ["x"], '{"type": "repair"}'), (3, "repair", [], '{"type": "repair"}'), (4, "answer", ["x"], '{"type": "repair"}'), (5, "repeat", [], "broken"), (6, "repair", ["x"], '{"type": "repair"}')]
    rows = spark.createDataFrame([(*r, "Heard: a\nReply: b" if r[0] % 2 else "b") for r in data], "id long, kind string, lost array<string>, judged string, response string")
    second = spark.createDataFrame([(1, '{"type": "repair_off"}'), (2, '{"type": "repair"}'), (4, '{"type": "repair_off"}')], "id long, answer string")
    samples = E.by_type(E.split_responses(rows, True), second, "tree")
    assert {r["id"]: (r["judged_type"], r["score"], r["heard"]) for r in samples.collect()} == {1: ("repair_off", 0.0, "a"), 2: ("repair", 1.0, ""), 3: ("repair", 1.0, "a"), 4: ("repair", 0.0, ""), 5: ("bad", 0.0, "a"), 6: (None, None, "")}
    got = E.summary(samples, ["answer", "repair"]).first()
    assert (got["C"], got["R"], got["F"], got["EAR"], got["heard_parse_failures"], got["judge_parse_failures"]) == (0.0, pytest.approx(2 / 3), None, 0.0, 3, 1)
    assert one(spark, E.shown_row(F.lit("c"), F.lit("r"), F.lit("repair"), strings("x"), True)) == 'COMMAND: c\nLOST PIECE: "x"\nREPLY: r\n' and one(spark, E.rubric(F.lit("answer"), True)) == "judge-answer"
    scored = E.by_kind(rows.withColumn("judged", F.lit('{"score": 0.5}'))).first()
    assert scored["score"] == 0.5 and scored["judged_type"] is None
