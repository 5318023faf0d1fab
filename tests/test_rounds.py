"""Probing in rounds, quotas, places, targets, aligned words, sound, model calls and the run log on small cases."""

import io
import random
import struct
import wave
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from clamorframe.operators import audio, places, probe, quota, sound, spans, targets
from clamorframe.operators import evaluate as E
from clamorframe.operators import score as S
from clamorframe.sources import client, provider, runlog
from clamorframe.streaming import claims


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


# --- probing


def test_rounds_draw_for_what_is_open(spark):
    """User 1 gets all at once, 2 never repairs, 3 answers only in the last round, 4 hears nothing."""
    say = {1: [["answer", "repair", "repeat"]] * 3, 2: [["answer", "repeat", None]] * 3, 3: [["repair", "repeat", None], [None, "repair", None], ["answer", "answer", "repair"]], 4: [[None] * 3] * 3}
    heard = [(u, r, p, k) for u, by_round in say.items() for r, kinds in enumerate(by_round) for p, k in enumerate(kinds)]
    known = spark.createDataFrame(heard, "u long, round int, pos int, kind string")
    asked = []

    def label(draws):
        asked.append({(r["u"], r["round"]): r["n"] for r in draws.groupBy("u", "round").agg(F.count("*").alias("n")).collect()})
        return draws.join(known, ["u", "round", "pos"])

    found = probe.probe_rounds(spark.createDataFrame([(u,) for u in (1, 2, 2, 3, 4, None)], "u long"), "u", label)
    assert rows(found.probes, "u", "kind", "round", "pos") == [(1, "answer", 0, 0), (1, "repair", 0, 1), (1, "repeat", 0, 2), (2, "answer", 0, 0), (2, "repeat", 0, 1), (3, "answer", 2, 0), (3, "repair", 0, 0), (3, "repeat", 0, 1)]
    assert sorted((r["u"], r["needed"]) for r in found.starved.collect()) == [(2, ["repair"]), (4, ["answer", "repair", "repeat"])]
    assert asked == [{(u, 0): 16 for u in (1, 2, 3, 4)}, {(2, 1): 8, (3, 1): 8, (4, 1): 16}, {(2, 2): 8, (3, 2): 8, (4, 2): 16}]
    assert found.tried.count() == 4 * 3 + 3 * 3 + 3 * 3
    reasons = [r[0] for r in found.starved.orderBy("u").select(probe.probe_reason(F.col("needed"))).collect()]
    assert reasons == ["probe:repair", "probe:answer,repair,repeat"]
    assert found.starved.select(probe.probe_reason(F.col("needed"), ["answer"])).first()[0] == "probe"


def test_rounds_end_without_utterances(spark):
    found = probe.probe_rounds(spark.createDataFrame([], "u long"), "u", lambda d: d.withColumn("kind", F.lit("answer")))
    assert found.probes.count() == found.starved.count() == 0


def test_slots_follow_weights_and_bands(spark):
    drawn = probe.slot_draws(spark.range(20_000).withColumn("needed", F.array(*map(F.lit, S.KINDS))), F.col("needed"), ["id"])
    got = drawn.toPandas()
    share = got["slot"].value_counts(normalize=True)
    assert share["answer"] == pytest.approx(0.2, abs=0.02) and share["repair"] == pytest.approx(0.4, abs=0.02)
    clean = got[got["slot"] == "answer"]["snr_db"].isna().mean()
    assert clean == pytest.approx(audio.CLEAN_SHARE, abs=0.03) and not got[got["slot"] != "answer"]["snr_db"].isna().any()
    for kind, (low, high) in audio.SLOT_SNR_DISJOINT.items():
        levels = got[got["slot"] == kind]["snr_db"].dropna()
        assert levels.between(low, high).all() and levels.min() < low + 0.2 and levels.max() > high - 0.2
    two = probe.slot_draws(spark.range(300).withColumn("needed", F.array(F.lit("repair"))), F.col("needed"), ["id"], disjoint=False)
    assert rows(two.select("slot").distinct(), "slot") == [("repair",)]


# --- quotas and places


def in_turn(stages, seen=()):
    """Plain Python: (stage, id, seq) kept, and ids claimed."""
    claimed, kept = {x: None for x in seen}, []
    for name, data, wanted in stages:
        n = 0
        for seq, key, good in sorted(data):
            if key in claimed:
                continue
            claimed[key] = name
            if good:
                kept.append((name, key, seq))
                n += 1
                if n == wanted:
                    break
    return sorted(kept), sorted((k, v) for k, v in claimed.items() if v)


@pytest.mark.parametrize("few", [1, 10_000])
def test_chained_quotas(spark, monkeypatch, few):
    monkeypatch.setattr(quota, "FEW", few)
    monkeypatch.setattr(quota, "RANGES", 4)
    rng = random.Random(few)
    for wanted in ((5, 7, 400), (1, 1, 1), (90, 60, 3)):
        data = [[(3 * i + k, rng.randrange(150), rng.random() < 0.4) for i in range(200)] for k in range(3)]
        frames = [spark.createDataFrame(d, "seq long, id long, good boolean").repartition(3) for d in data]
        stages = [quota.Stage(n, f, F.col("good"), w) for n, f, w in zip("abc", frames, wanted, strict=True)]
        kept, claimed = quota.chained(stages, "id", "seq", spark.createDataFrame([(5,), (9,), (5,)], "id long"))
        want = in_turn([(n, d, w) for n, d, w in zip("abc", data, wanted, strict=True)], (5, 9))
        assert (rows(kept, "stage", "id", "seq"), rows(claimed, "id", "stage")) == want


def test_quota_of_little(spark):
    some = spark.createDataFrame([(4, None), (7, True), (9, False), (None, True)], "seq long, good boolean")
    for n, kept, passed in ((1, 1, 2), (2, 1, 3)):
        a, b = quota.quota(some, F.col("good"), n, "seq")
        assert (a.count(), b.count()) == (kept, passed)
    assert quota.nth_good(some.limit(0), F.col("good"), 1, "seq") is None
    with pytest.raises(ValueError):
        quota.quota(some, F.col("good"), 0, "seq")


@pytest.mark.parametrize("files", [1, 2, 7])
def test_places_do_not_depend_on_files(spark, files):
    items = spark.range(500).select((F.col("id") * 7919 % 1009).alias("x")).repartition(files)
    order = {x: i for i, x in enumerate(sorted(i * 7919 % 1009 for i in range(500)))}
    assert dict(rows(places.placed(items, ["x"]), "x", "place")) == order
    swept = places.sweep(items, ["x"], {"a": (0, 1), "b": (5, 12)})
    got = {(r["band"], r["x"]): (r["draw"], r["snr_db"]) for r in swept.collect()}
    first = [draw for (band, _), (draw, _) in got.items() if band == "a"]
    assert sorted(first) == list(range(500)) and got["b", min(order)][0] == 500 and len(got) == 1000
    again = {(r["band"], r["x"]): (r["draw"], r["snr_db"]) for r in places.sweep(items.coalesce(1), ["x"], {"a": (0, 1), "b": (5, 12)}).collect()}
    assert got == again and places.placed(items.limit(0), ["x"]).count() == 0


# --- targets


def test_targets_carry_over(spark):
    tries = [(1, 0, "a", None, " "), (1, 1, "b", "r", ""), (1, 2, " ", None, " p "), (1, 3, "z", "z", "z"), (2, 0, "a", "r", None), (3, 5, "p", "q", "s"), (3, 2, None, "early", None)]
    late = [(4, i, "a" if i == 0 else "", "r" if i == 8 else "", "s") for i in range(12)]
    got = targets.carried(spark.createDataFrame(tries + late, "id long, attempt int, answer string, repair string, repeat string"), ["id"])
    assert rows(got, "id", "answer", "repair", "repeat") == [(1, "b", "r", "p"), (3, "p", "q", "s")]


def test_answer_and_repair(spark):
    kinds = "id long, attempt int, answer string, repair string, phrase string, slot string"
    tries = [
        (1, 0, "yes", "play jazz?", "jazz", "genre"), (1, 1, "no", "which one?", "jazz", "genre"), (1, 2, "x", "what?", "jazz", "genre"),
        (2, 0, "yes", "jazz or rock?", "jazz", "genre"), (2, 1, "", "JAZZ?", "jazz", "genre"), (2, 2, None, "which?", "jazz", "genre"),
        (3, 0, None, "which?", "jazz", "genre"), (4, 0, "a", None, "jazz", "genre"), (4, 3, "b", "which?", "jazz", "genre"), (4, 1, "", None, "jazz", "genre"), (4, 2, "", None, "jazz", "genre"),
        (5, 0, "first", None, "jazz", "genre"), (5, 1, " ", "which?", "jazz", "genre"),
    ]
    got = targets.answer_and_repair(spark.createDataFrame(tries, kinds), ["id"], "phrase", "slot")
    sorry = "Sorry, I didn't catch the genre — could you say that part again?"
    assert rows(got, "id", "answer", "repair", "fell_back") == [(1, "no", "which one?", False), (2, "yes", sorry, True), (4, "a", sorry, True), (5, "first", "which?", False)]


# --- aligned words


def test_alignment_is_checked_and_masked(spark):
    tone = [0.5] * 32_000
    sentences = [(1, "play the old jazz", tone), (2, "one two", tone), (3, "a b c", tone), (4, "x y", tone), (5, "p q r", tone), (6, "late words here", tone)]
    words = [(1, i, 0.4 * i, 0.4 * i + 0.3) for i in range(4)] + [(2, 0, 0.0, 0.1)] + [(3, 0, 0.0, 0.2), (3, 1, 0.3, 0.2), (3, 2, 0.5, 0.6)] + [(5, i, 0.5 - 0.1 * i, 1.0) for i in range(3)]
    words += [(6, 0, 0.0, 0.1), (6, 1, 0.1, 0.2), (6, 2, 5.0, 5.5)]
    table = spark.createDataFrame(sentences, "id long, sentence string, audio array<float>")
    times = spark.createDataFrame(words, "id long, place int, start double, end double").repartition(3)
    state = {r["id"]: r["reason"] for r in spans.checked(table, times, "id").collect()}
    assert state == {1: None, 2: "token-count", 3: "order", 4: "alignment", 5: "order", 6: None}
    plan = F.struct(F.lit(2).alias("start"), F.when(F.col("id") == 6, 3).otherwise(4).alias("end"), F.lit(1).alias("stop"))
    made, dropped = spans.mask_variants(table, times, plan, "id")
    got = {r["variant"]: np.array(r["noisy"]) for r in made.collect() if r["id"] == 1}
    edges = {k: (np.flatnonzero(x != 0.5).min(), np.flatnonzero(x != 0.5).max()) for k, x in got.items()}
    assert edges == {"unanswerable": (12_800, 23_999), "answerable": (6400, 11_199)} and made.count() == 2
    assert rows(dropped, "id", "reason") == [(2, "token-count"), (3, "order"), (4, "alignment"), (5, "order"), (6, "empty span")]


# --- sound


@pytest.mark.parametrize("rate,wanted", [(8000, 16_000), (44_100, 16_000), (48_000, 16_000), (22_050, 16_000), (16_000, 11_025)])
def test_resampled_tone(rate, wanted):
    f, n = 700.0, rate
    tone = lambda r, k: np.sin(2 * np.pi * f * np.arange(k) / r)
    out = sound.resample(tone(rate, n), rate, wanted)
    want = tone(wanted, len(out))
    inner = slice(wanted // 10, -wanted // 10)
    assert len(out) == wanted and np.max(np.abs(out[inner] - want[inner])) < 2e-3
    assert np.sum(out[inner] ** 2.0) / wanted == pytest.approx(np.sum(want[inner] ** 2) / wanted, rel=1e-3)


def test_what_a_rate_cannot_hold_goes():
    high = np.sin(2 * np.pi * 7000 * np.arange(32_000) / 32_000)
    assert np.max(np.abs(sound.resample(high, 32_000, 8000)[800:-800])) < 1e-3
    assert sound.resample(np.zeros(0), 8000).size == 0 and sound.resample([1.0], 8000, 16_000).size == 2


def wav_bytes(samples, width, rate, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def test_recordings(spark, tmp_path):
    x = np.round(np.sin(np.arange(800) / 9) * 20_000).astype("<i2")
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.wav").write_bytes(wav_bytes(x.tobytes(), 2, 16_000))
    (tmp_path / "sub/b.wav").write_bytes(wav_bytes(np.repeat(x[::2], 2).tobytes(), 2, 8000, 2))
    (tmp_path / "c.wav").write_bytes(b"RIFF")
    (tmp_path / "d.wav").write_bytes(wav_bytes(b"", 2, 16_000))
    (tmp_path / "note.txt").write_text("no sound")
    got = {r["path"].rsplit("/", 1)[1]: r for r in sound.recordings(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.wav", "b.wav", "c.wav", "d.wav"] and got["c.wav"]["error"] == "no wav file" and got["d.wav"]["audio"] == []
    assert np.allclose(got["a.wav"]["audio"], x / 32768, atol=1e-7) and got["b.wav"]["source_rate"] == 8000 and len(got["b.wav"]["audio"]) == 800


def test_wav_goes_round_and_widths_agree(spark):
    x = np.linspace(-0.9, 0.9, 50)
    back, rate = sound.decode_wav(spark.range(1).select(audio.wav(F.array(*map(F.lit, x.tolist())).cast("array<float>")).alias("w")).first()["w"])
    assert rate == 16_000 and np.allclose(back, x, atol=1e-4)
    eight = sound.decode_wav(wav_bytes(np.round(x * 128 + 128).astype(np.uint8).tobytes(), 1, 16_000))[0]
    three = sound.decode_wav(wav_bytes(b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x), 3, 16_000))[0]
    four = sound.decode_wav(wav_bytes((x * (1 << 31)).astype("<i4").tobytes(), 4, 16_000))[0]
    data = x.astype("<f4").tobytes()
    floats = sound.decode_wav(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 16_000, 64_000, 4, 32) + b"data" + struct.pack("<I", len(data)) + data)[0]
    assert np.allclose(eight, x, atol=1e-2) and np.allclose(three, x, atol=1e-6) and np.allclose(four, x, atol=1e-6) and np.allclose(floats, x, atol=1e-6)
    with pytest.raises(ValueError):
        sound.decode_wav(b"RIFF0000WAVE")


def test_rates_of_rows(spark):
    table = spark.createDataFrame([(1, [0.5] * 80, 8000), (2, [0.5] * 10, 16_000), (3, None, 8000), (4, [0.1], None)], "id long, audio array<float>, sampling_rate int")
    got = {r["id"]: (None if r["audio"] is None else len(r["audio"]), r["sampling_rate"]) for r in sound.at_rate(table).collect()}
    assert got == {1: (160, 16_000), 2: (10, 16_000), 3: (None, None), 4: (None, None)}


# --- model calls and the run log


def requests(spark, n):
    rows_ = spark.range(n).select(F.lit("sys").alias("system"), F.concat(F.lit("u"), F.col("id")).alias("user"))
    return rows_.withColumn("request_key", provider.request_key(F.col("system"), F.col("user"))).repartition(3)


def counting(path, fails):
    """A call that notes itself in a file and fails for some users, so many times each."""

    def call(system, user):
        with open(path, "a") as f:
            f.write(user + "\n")
        asked = open(path).read().split().count(user)
        if asked <= fails.get(user, 0):
            raise OSError("busy")
        return f"{system}:{user}"

    return call


def test_calls_are_tried_again_and_stay_in_order(spark, tmp_path):
    log = str(tmp_path / "calls")
    asked = runlog.cut(requests(spark, 40))
    got = client.replies(asked, counting(log, {"u3": 2, "u7": 3}), pause=0.001)
    users = [r["user"] for r in asked.select("user").collect()]
    assert [r["response"] for r in got.collect()] == [f"sys:{u}" for u in users]
    assert open(log).read().split().count("u7") == 4


def test_the_last_error_is_raised_or_null(spark, tmp_path):
    with pytest.raises(Exception, match="busy"):
        client.replies(requests(spark, 5), counting(str(tmp_path / "a"), {"u2": 9}), pause=0.001).collect()
    got = client.replies(requests(spark, 5), counting(str(tmp_path / "b"), {"u2": 9}), pause=0.001, quiet=True).collect()
    assert sorted(str(r["response"]) for r in got) == ["None", "sys:u0", "sys:u1", "sys:u3", "sys:u4"]


def test_waiting_results_are_bounded():
    taken = []

    def items():
        for i in range(100):
            taken.append(i)
            yield (i,)

    out = client.in_order(items(), lambda i: i * i, workers=2, window=3)
    assert next(out) == ((0,), 0) and len(taken) <= 6
    assert [r for _, r in out] == [i * i for i in range(1, 100)]


def test_a_restart_asks_nothing_twice(spark, tmp_path):
    log, path = str(tmp_path / "calls"), f"file://{tmp_path}/log"
    asked = requests(spark, 30).unionByName(requests(spark, 5))
    with pytest.raises(Exception, match="busy"):
        client.ask_open(spark, asked, counting(log, {"u29": 99}), path, batches=4, pause=0.001, retries=0)
    done = {r["response"].split(":")[1] for r in runlog.rows(spark, path, "request_key string, response string").collect()}
    before = open(log).read().split()
    got = client.ask_open(spark, asked, counting(log, {}), path, batches=4, pause=0.001)
    again = open(log).read().split()[len(before) :]
    assert not done & set(again) and len(again) == len(set(again)) and got.count() == 30
    client.ask_open(spark, asked, counting(log, {}), path, pause=0.001)
    assert len(open(log).read().split()) == len(before) + len(again)


def test_a_stopped_run_goes_on(spark, tmp_path):
    path, schema = f"file://{tmp_path}/log", "id long, score double"
    wanted = spark.range(100).withColumn("seq", F.col("id"))
    calls = []

    def evaluate(part):
        calls.append(part.count())
        if len(calls) == 3:
            part.write.json(f"{path}/samples/00000002")  # what a run that is ended here leaves
            raise KeyboardInterrupt
        return part.select("id", F.lit(0.5).alias("score"))

    with pytest.raises(KeyboardInterrupt):
        runlog.run(wanted, evaluate, path, "id", "seq", 5)
    kept = rows(runlog.rows(spark, path, schema), "id")
    assert runlog.committed(spark, path) == ["00000000", "00000001"] and kept == [(i,) for i in range(len(kept))] and 0 < len(kept) < 60
    summary = spark.createDataFrame([(0.5,)], "C double")
    with pytest.raises(ValueError, match="not in the log"):
        runlog.finish(summary, wanted, path, "id")
    assert runlog.summary(spark, path) is None
    assert runlog.run(wanted, lambda p: p.select("id", F.lit(0.5).alias("score")), path, "id", "seq", 5) == 5
    assert rows(runlog.rows(spark, path, schema), "id") == [(i,) for i in range(100)]
    assert runlog.run(wanted, evaluate, path, "id", "seq", 5) == 0
    runlog.finish(summary, wanted, path, "id")
    assert runlog.summary(spark, path).first()["type"] == "summary"
    assert runlog.append(spark.range(3), path, "00000000") == "00000000" and runlog.rows(spark, path, schema).count() == 100


# --- evaluation


def text(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_what_judges_are_shown(spark):
    lost = F.array(F.lit("x"), F.lit("y"))
    of = lambda kind, per_kind: text(spark, E.shown_row(F.lit("c"), F.lit("r"), F.lit(kind), lost, per_kind))
    assert of("repair", True) == 'COMMAND: c\nLOST PIECE: "x"; "y"\nREPLY: r\n'
    assert of("answer", True) == of("repair", False) == "COMMAND: c\nREPLY: r\n"
    assert text(spark, E.shown_target(F.lit("c"), F.lit(None).cast("string"), F.array().cast("array<string>"))) == "COMMAND: c\nLOST PIECE: (none)\nREPLY: \n"


def test_a_missing_answer_is_an_error_row(spark):
    repair, off = '{"type": "repair"}', '{"type": "repair_off"}'
    data = [(1, "repair", repair), (2, "repair", repair), (3, "repair", None), (4, "answer", '{"type": "answer"}'), (5, "repeat", repair), (6, "answer", off)]
    judged = spark.createDataFrame(data, "id long, kind string, judged string").withColumns({"lost": F.array(F.lit("x")), "response": F.lit("r"), "sentence": F.lit("c")})
    judged = E.split_responses(judged, False)
    asked = E.second_requests(judged, "tree", "sys")
    assert rows(asked, "id", "user") == [(1, 'COMMAND: c\nLOST PIECE: "x"\nREPLY: r\n'), (2, 'COMMAND: c\nLOST PIECE: "x"\nREPLY: r\n')]
    second = spark.createDataFrame([(1, off), (2, None)], "id long, answer string")
    samples = E.by_type(judged, second, "tree")
    got = {r["id"]: (r["judged_type"], r["score"], r["unanswered"], r["judge_failed"]) for r in samples.collect()}
    assert got == {1: ("repair_off", 0.0, False, False), 2: (None, None, True, False), 3: (None, None, True, False), 4: ("answer", 1.0, False, False), 5: ("repair", 0.0, False, False), 6: ("repair_off", 0.0, False, False)}
    total = E.summary(samples).first()
    assert (total["R"], total["repair_rows"], total["unanswered_rows"], total["unscored_rows"]) == (0.0, 3, 2, 0)
    line = E.record(samples, model="m").first()
    assert line["confusion"] == {"answer->answer": 1, "answer->repair_off": 1, "repair->repair_off": 1, "repeat->repair": 1}
    assert line["score_hist"] == {} and (line["type"], line["model"]) == ("summary", "m")
    old = E.summary(E.by_type(judged, second, "legacy")).first()
    assert (old["unanswered_rows"], old["unscored_rows"]) == (1, 1)
    by_kind = E.summary(E.by_kind(judged.withColumn("judged", F.when(F.col("id") > 1, '{"score": 1}')))).first()
    assert (by_kind["unanswered_rows"], by_kind["R"]) == (1, 1.0)
    line = E.record(E.by_kind(judged.withColumn("judged", F.when(F.col("id") > 1, '{"score": 0.5}'))), per_kind=True).first()
    assert line["confusion"] == {} and line["score_hist"] == {"answer@0.5": 2, "repair@0.5": 2, "repeat@0.5": 1}


# --- a stream


def test_the_least_claim_wins_though_it_is_late(spark, tmp_path):
    schema, at = "id long, seq long, ts timestamp", datetime(2026, 1, 1)
    (tmp_path / "in").mkdir()
    stream = claims.least_claims(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "id", "seq", "ts", 600)
    given = []
    for batch in ([(1, 50, 0), (2, 5, 0)], [(1, 20, 5), (2, 9, 5), (None, 1, 5)], [(1, 30, 6), (9, 1, 40)], [(1, 3, 41), (8, 2, 90)], [(7, 1, 200)]):
        spark.createDataFrame([(i, s, at + timedelta(minutes=m)) for i, s, m in batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        claims.drain(stream, f"{tmp_path}/out", f"{tmp_path}/mark")
        given.append(rows(spark.read.parquet(f"{tmp_path}/out"), "id", "seq"))
    assert given[1] == [] and given[-1][:2] == [(1, 20), (2, 5)] and (9, 1) in given[-1] and len([x for x in given[-1] if x[0] == 1]) == 1


# --- labels at their grains


def test_labels_through_requests(spark):
    from clamorframe.operators import labelling as G

    utterances = spark.createDataFrame([(1, "Play jazz, Olly!"), (1, "Play jazz, Olly!"), (2, "lamp on"), (3, "x")], "id long, sentence string")
    asked = G.piece_requests(utterances, "id", "sys")
    assert rows(asked, "id", "user") == [(1, "COMMAND: play jazz olly"), (2, "COMMAND: lamp on"), (3, "COMMAND: x")]
    said = {"COMMAND: play jazz olly": '```json\n{"pieces": ["play", " jazz ", "olly", ""]}\n```', "COMMAND: lamp on": '{"pieces": ["lamp on"]}', "COMMAND: x": "no json"}
    keys = {r["user"]: r["request_key"] for r in asked.collect()}
    replies = spark.createDataFrame([(keys[u], r) for u, r in said.items()], "request_key string, response string")
    pieces = G.pieces_of(asked, replies, "id")
    assert sorted((r["id"], r["pieces"]) for r in pieces.collect()) == [(1, ["play", "jazz"]), (2, ["lamp on"])]
    probes = spark.createDataFrame([(1, 0, "play it", "which?"), (1, 1, "play jazz", " "), (1, 2, "so", "no"), (2, 0, "ramp", "what"), (3, 0, "a", "b")], "id long, pos int, heard string, reply string")
    both = F.array(*(F.struct(F.lit(m).alias("mark"), F.col(c).alias("text")) for m, c in (("HEARD", "heard"), ("REPLY", "reply"))))
    heard = G.witnesses(probes, ["id", "pos"], both)
    requests = G.loss_requests(heard, pieces, "id", {"HEARD": "a", "REPLY": "b"})
    users = {(r["id"], r["pos"], r["witness"]): (r["system"], r["user"], r["request_key"]) for r in requests.collect()}
    assert users[1, 0, 0][:2] == ("a", "KEY PIECES:\n1. play\n2. jazz\nHEARD: play it") and (1, 1, 1) not in users and (3, 0, 0) not in users
    answers = {(1, 0, 0): '{"lost": ["2", 7, "x"]}', (1, 0, 1): '{"lost": [1, 2]}', (1, 1, 0): '{"lost": []}', (1, 2, 0): '{"lost": [1]}', (2, 0, 0): '{"lost": [1]}', (2, 0, 1): '{"lost": [1]}'}
    table = spark.createDataFrame([(users[k][2], a) for k, a in answers.items()], "request_key string, response string")
    got = G.labelled(requests, table, pieces, "id", ["id", "pos"], 2)
    assert sorted((r["id"], r["pos"], r["kind"], r["lost"], r["asr_bucket"], r["resp_bucket"], r["reason"]) for r in got.collect()) == [
        (1, 0, "repair", ["jazz"], "a1", "r2", "2 pieces | [2] x [1, 2] -> agreed [2]"), (2, 0, "repeat", ["lamp on"], "a1", "r1", "1 pieces | [1] x [1] -> agreed [1]"),
    ]
    shown = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert shown(G.two_lines(F.lit("A b."), "HEARD", F.lit("C"))) == "COMMAND: a b\nHEARD:   c" and shown(G.two_lines(F.lit("a"), "REPLY", F.lit("c"))) == "COMMAND: a\nREPLY:   c"
    assert shown(G.hypotheses(F.lit("A"), F.array(F.lit("B!"), F.lit(" "), F.lit("c")))) == "COMMAND: a\nHYP 1: b\nHYP 2: c"
    assert shown(G.quoted(F.lit("A b"), F.lit("b"))) == 'COMMAND:\n"A b"\nLOST-PIECE: "b"' and shown(G.quoted(F.lit("A"))) == 'COMMAND:\n"A"'


def test_a_model_is_loaded_once_a_task(spark):
    def load():
        seen = []

        def model(inputs):
            seen.append(len(inputs))
            return [f" {x}-{k} N{len(seen)} " for x in inputs for k in range(2)]

        return model

    table = spark.createDataFrame([(i, None if i == 3 else f"In{i}") for i in range(7)], "id int, prompt string").coalesce(1)
    got = {r["id"]: r["texts"] for r in client.generated(table, load, "prompt", batch=4, n_best=2, prefill="Heard: ").collect()}
    assert got[0] == ["Heard: in0-0 n1", "Heard: in0-1 n1"] and got[3] is None and got[6] == ["Heard: in6-0 n2", "Heard: in6-1 n2"]
    with pytest.raises(Exception, match="wanted of each"):
        client.generated(table, load, "prompt").collect()
