"""Queries of probing, quotas, draws, targets, alignments and signals on the driver's tables as stand-ins, with the same in DuckDB's SQL.

Users of ``events`` stand for utterances, their events for what a labeller says of a draw; ``conversations`` for commands (turn 0),
witnesses and writers' attempts (later turns); ``embeddings`` for signals.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import decide as D
from ..functions import label as L
from ..functions import text as T
from ..operators import audio, labelling, places, probe, quota, sound, spans, targets
from ..operators import score as S
from ..operators.assemble import LEAST_TOKENS
from ..operators.select import draw
from ..sources.scratch import cut
from . import dataset
from .built import _IDS, _WORDS, PIECES, _list
from .queries import _JUDGED, _U, _table, judged

WANTED = {"click": 30, "view": 30, "purchase": 30}
#: Triplets and answer rows of a build's stages.
BUILT = {"test": 8, "train": 8, "answers": 5}
#: Seconds that a letter takes in a stand-in for aligned words.
LETTER = 0.0625


def _labelled(rows):
    """A labeller: a draw hears one of its user's events (user_id, event_id, judged), by number; what that was judged is the label, other than kinds are none."""
    own = Window.partitionBy("user_id")
    rows = cut(rows.select("user_id", "event_id", "judged", (F.row_number().over(own.orderBy("event_id")) - 1).alias("place"), F.count("*").over(own).alias("n")), "heard")  # every round reads it
    counts, rows = rows.where("place = 0").select("user_id", "n"), rows.drop("n")

    def label(draws):
        heard = draws.join(counts, "user_id").withColumn("place", F.floor(draw("42:event", F.col("user_id"), F.col("round"), F.col("pos")) * F.col("n")))
        kind = F.when(F.col("judged").isin(*S.KINDS), F.col("judged"))
        return heard.join(rows, ["user_id", "place"]).select(*draws.columns, kind.alias("kind"), "event_id", (F.col("judged") == "bad").alias("unread"))

    return label


def _probing(spark, sf_dir, kinds=S.KINDS, batch=probe.BATCH):
    return probe.probe_rounds(_table(spark, sf_dir, "events"), "user_id", _labelled(judged(spark, sf_dir)), kinds, batch)


def probe_rounds(spark, sf_dir):
    """The probes that users keep after three rounds at most."""
    return _probing(spark, sf_dir).probes.select("user_id", "kind", "round", "pos", "slot", "snr_db", "event_id")


def probe_outcomes(spark, sf_dir):
    """Why users give no triplet or no answer row, and how many draws could not be read."""
    out = None
    for build, kinds, batch in (("triplets", S.KINDS, probe.BATCH), ("answers", ["answer"], probe.ANSWER_BATCH)):
        found = _probing(spark, sf_dir, kinds, batch)
        starved = found.starved.select(probe.probe_reason(F.col("needed"), kinds).alias("reason"))
        unread = found.tried.where("unread").select(F.lit("format").alias("reason"))
        rows = starved.unionByName(unread).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(build).alias("build"), "reason", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def slot_levels(spark, sf_dir):
    """A slot and a level for each document: what it needs depends on its language; bands that overlap and bands that do not."""
    needed = F.when(F.col("lang") == "en", F.array(*map(F.lit, S.KINDS))).when(F.col("lang") == "fr", F.array(F.lit("answer"), F.lit("repeat"))).otherwise(F.array(F.lit("answer")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", needed.alias("needed"))
    both = [probe.slot_draws(docs, F.col("needed"), ["doc_id"], disjoint).select("doc_id", F.lit(disjoint).alias("disjoint"), "slot", "snr_db") for disjoint in (True, False)]
    return both[0].unionByName(both[1])


def chained_quotas(spark, sf_dir):
    """Three stages of events by type, each until it has thirty of value 50 and more; users are claimed in passing."""
    events = _table(spark, sf_dir, "events")
    stages = [quota.Stage(name, events.where(F.col("event_type") == name), F.col("value") >= 50, n) for name, n in WANTED.items()]
    kept, claimed = quota.chained(stages, "user_id", "event_id")
    own = claimed.groupBy("stage").agg(F.count("*").alias("n_claimed"))  # a row a stage
    return kept.select("stage", "user_id", "event_id").join(F.broadcast(own), "stage")


def sweep_draws(spark, sf_dir):
    """Each conversation's command in each band, with levels from one sequence."""
    rows = _table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id")
    return places.sweep(rows, ["conv_id"], audio.SLOT_SNR_DISJOINT).select("conv_id", "band", "draw", "snr_db")


def _attempts(spark, sf_dir):
    """Turns as attempts that write some of three words."""
    rows = _table(spark, sf_dir, "conversations").where("text is not null").withColumn("w", T.tokens(F.col("text"))).withColumn("n", F.length("text"))
    word = lambda k: F.get("w", F.lit(k))
    return rows.select("conv_id", F.col("turn").alias("attempt"), F.when(F.col("n") % 3 > 0, word(0)).otherwise("").alias("answer"), F.when(F.col("n") % 2 > 0, word(1)).alias("repair"), F.when(F.col("n") % 5 > 1, word(2)).otherwise(" ").alias("repeat"))


def target_fold(spark, sf_dir):
    """Targets as soon as all three are written, each the last one so far."""
    return targets.carried(_attempts(spark, sf_dir), ["conv_id"])


def loss_overlap_decision(spark, sf_dir):
    """Kinds by what two turns lost of a command's first words, in free text."""
    turns = _table(spark, sf_dir, "conversations").where("turn <= 2").select("conv_id", "turn", "text", T.tokens(T.normalize(F.col("text"))).alias("w"))
    at = lambda k, c: F.max(F.when(F.col("turn") == k, F.col(c))).alias(f"{c}{k}")
    rows = turns.groupBy("conv_id").agg(at(0, "text"), at(0, "w"), at(1, "w"), at(2, "w")).where("w0 is not null and w1 is not null and w2 is not null")
    pieces = F.slice(F.array_distinct("w0"), 1, PIECES)
    lost = lambda w: F.filter(pieces, lambda p: ~F.array_contains(F.col(w), p))
    label = D.decide_by_text(F.col("text0"), lost("w1"), lost("w2"))
    reason = L.reason_by_text(F.col("text0"), lost("w1"), lost("w2"))
    return rows.where(F.size("w0") > 0).select("conv_id", label["kind"].alias("kind"), F.array_join(label["missing"], ";").alias("missing"), reason.alias("reason"))


def written_targets(spark, sf_dir):
    """Later turns as a writer's attempts at a repair that must not tell the command's first word: the first that does not, and how many did before it."""
    rows = _table(spark, sf_dir, "conversations").where("text is not null")
    lost = rows.where("turn = 0").select("conv_id", F.get(T.tokens(T.normalize(F.col("text"))), F.lit(0)).alias("lost")).where("lost is not null")
    tries = rows.where("turn > 0").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("tries")).join(lost, "conv_id")
    repair = F.lit("repair")
    return tries.select("conv_id", L.first_target(F.col("tries"), repair, F.col("lost")).alias("target"), L.leaked_attempts(F.col("tries"), repair, F.col("lost")).alias("n_leaks"))


def _words(spark, sf_dir):
    """Commands and stand-ins for their aligned words: letters take their time; some have no alignment, some lack the last word, in some a time runs backwards."""
    rows = _table(spark, sf_dir, "conversations").where("turn = 0 and text is not null").select("conv_id", F.col("text").alias("sentence"))
    each = spans.token_rows(rows, "conv_id").withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    upto = F.sum(F.length("token")).over(Window.partitionBy("conv_id").orderBy("place"))
    start = (upto - F.length("token")) * LETTER
    each = each.withColumns({"end": upto * LETTER, "start": F.when((F.col("conv_id") % 5 == 2) & (F.col("place") == 2), F.lit(0.0)).otherwise(start)})
    return rows, each.where((F.col("conv_id") % 11 != 3) & ((F.col("conv_id") % 7 != 1) | (F.col("place") < F.col("n") - 1))).select("conv_id", "place", "start", "end")


def alignment_state(spark, sf_dir):
    """Which commands' alignments can be used, and why others cannot."""
    rows, words = _words(spark, sf_dir)
    return spans.checked(rows, words, "conv_id")


def span_times(spark, sf_dir):
    """From when to when the second and third word are spoken."""
    rows, words = _words(spark, sf_dir)
    fine = spans.checked(rows, words, "conv_id").where("reason is null")
    found = spans.time_spans(fine.select("conv_id", F.lit(1).alias("first"), F.lit(3).alias("last")), words, "conv_id")
    return found.select("conv_id", "span.start", "span.end")


def span_noise(spark, sf_dir):
    """Which samples noise covers, of embeddings played a hundred times over."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.flatten(F.array_repeat("embedding", 100)).cast("array<float>").alias("audio"), F.struct((F.col("label") / 50).alias("start"), (F.col("label") / 50 + (F.col("vec_id") % 4) / 16).alias("end")).alias("span"))
    changed = F.filter(F.sequence(F.lit(0), F.size("audio") - 1), lambda i: F.get("audio", i) != F.get("noisy", i))
    return audio.masked(rows, "id", "span").select("id", F.array_min(changed).alias("first"), F.array_max(changed).alias("last"))


def resampled(spark, sf_dir):
    """Embeddings at 16 samples a second brought to 24: how many samples, their sum and their energy."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("audio"), F.lit(16).alias("sampling_rate"))
    out = sound.at_rate(rows, 24)
    total = F.aggregate("audio", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.select("vec_id", F.size("audio").cast("long").alias("n"), F.round(total, 3).alias("total"), F.round(sound.energy(F.col("audio"), 24), 3).alias("energy"))


def witness_labels(spark, sf_dir):
    """Labels of commands from up to three later turns as witnesses, through requests at their grains and a table of replies.

    The replies stand for a labeller's: the command's first words as pieces; the ids of those that a turn lacks, one no
    piece; for every thirteenth pair no JSON, for every seventeenth no reply.
    """
    turns = _table(spark, sf_dir, "conversations").where("turn <= 3")
    first = turns.where("turn = 0 and text is not null").select("conv_id", F.col("text").alias("sentence"))
    asked = labelling.piece_requests(first, "conv_id", "pieces")
    words = first.select("conv_id", F.slice(F.array_distinct(T.tokens(T.normalize(F.col("sentence")))), 1, PIECES).alias("p"))
    quote = lambda items: F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    as_text = F.transform("p", lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    given = asked.join(words, "conv_id").select("request_key", F.concat(F.lit('{"pieces": '), quote(as_text), F.lit("}")).alias("response")).dropDuplicates(["request_key"])
    pieces = labelling.pieces_of(asked, given, "conv_id")
    later = turns.where("turn > 0").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(F.when(x["turn"] == 1, "HEARD").otherwise("REPLY").alias("mark"), x["text"].alias("text"))).alias("said"))
    heard = labelling.witnesses(later, ["conv_id"], F.col("said"))
    requests = labelling.loss_requests(heard, pieces, "conv_id", {"HEARD": "asr", "REPLY": "reply"})
    has = T.tokens(T.normalize(F.col("text")))
    number = F.col("conv_id") * 3 + F.col("witness")
    lost = F.filter(F.sequence(F.lit(1), F.size("pieces")), lambda i: ~F.array_contains(has, F.element_at(F.col("pieces"), i)))
    reply = F.when(number % 13 == 12, "no json").otherwise(F.concat(F.lit('{"lost": '), quote(F.concat(F.array(F.lit("99")), F.transform(lost, lambda i: i.cast("string")))), F.lit("}")))
    answers = requests.join(pieces, "conv_id").where(number % 17 != 16).select("request_key", reply.alias("response")).groupBy("request_key").agg(F.min("response").alias("response"))
    out = labelling.labelled(requests, answers, pieces, "conv_id", ["conv_id"], 2)
    return out.select("conv_id", "kind", F.array_join("lost", ";").alias("lost"), "asr_bucket", "resp_bucket", "reason")


def _heard(spark, sf_dir):
    """Later turns as what a draw can hear: the kind by the length of the text, none for a quarter of them."""
    kind = F.element_at(F.array(*map(F.lit, [*S.KINDS, "none"])), (F.length("text") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "conversations").where("turn > 0 and text is not null").select(F.col("conv_id").alias("user_id"), F.col("turn").cast("long").alias("event_id"), kind.alias("judged"))


def dataset_build(spark, sf_dir):
    """A build from commands: test and training triplets by the parity of the conversation, then answers from what is left.

    Draws hear later turns; a writer's attempts are the later turns in order, and a repair must not tell the command's first word.
    """
    return _build(spark, sf_dir)[0].select("id", "kind", "target", "snr_db", "slurp_id", "split")


def dataset_reasons(spark, sf_dir):
    """Why the same build passed over conversations, by stage."""
    return _build(spark, sf_dir)[1]


def _build(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").where("text is not null")
    commands = turns.where("turn = 0").select(F.col("conv_id").alias("user_id"), F.col("conv_id").alias("seq"), F.col("text").alias("sentence"))
    lost = cut(commands.select("user_id", F.slice(T.tokens(T.normalize(F.col("sentence"))), 1, 1).alias("lost")), "lost")
    hears = _labelled(_heard(spark, sf_dir))
    label = lambda draws: hears(draws).join(lost, "user_id", "left")

    def write(probes):
        said = turns.where("turn > 0").withColumnRenamed("conv_id", "user_id").join(probes.select("user_id"), "user_id", "left_semi")  # a block's commands alone are gathered
        tries = said.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("tries"))
        return probes.select("user_id", "kind").join(tries, "user_id")

    even, odd = (commands.where(F.col("user_id") % 2 == k) for k in (0, 1))
    stages = [
        dataset.Stage("test", even, "test", BUILT["test"], label), dataset.Stage("train", odd, "train", BUILT["train"], label, write),
        dataset.Stage("answers", odd, "train", BUILT["answers"], label, write, ["answer"], probe.ANSWER_BATCH),
    ]
    return dataset.run(stages, "user_id", "seq")


QUERIES = {
    f.__name__: f
    for f in (probe_rounds, probe_outcomes, slot_levels, chained_quotas, sweep_draws, target_fold, loss_overlap_decision, written_targets, witness_labels, dataset_build, dataset_reasons, alignment_state, span_times, span_noise, resampled)
}


def _slot_sql(key: str, bands: dict, clean: bool) -> tuple[str, str]:
    """Expressions of the slot among ``needed`` and of its level."""
    has = [f"CASE WHEN list_contains(needed, '{k}') THEN {w} ELSE 0 END" for k, w in ((k, audio.SLOT_WEIGHTS[k]) for k in S.KINDS)]
    c1, c2, c3 = (" + ".join(has[:i]) for i in (1, 2, 3))
    u = _U("42:slot", key)
    slot = f"CASE WHEN {u} * ({c3}) < ({c1}) THEN 'answer' WHEN {u} * ({c3}) < ({c2}) THEN 'repair' ELSE 'repeat' END"
    level = "CASE slot " + " ".join(f"WHEN '{k}' THEN round({lo}::DOUBLE + {hi - lo}::DOUBLE * {_U('42:snr', key)}, 1)" for k, (lo, hi) in bands.items()) + " END"
    return slot, f"CASE WHEN slot = 'answer' AND {_U('42:clean', key)} < {audio.CLEAN_SHARE} THEN NULL ELSE {level} END" if clean else level


def _rounds_sql(p: str, kinds: list[str], batch: int, source: str = "events") -> str:
    """Of all user_id of ``source``, which hear the rows of e, of n by number: tables {p}g0.. of the probes that each round keeps, {p}t0.. of its labelled draws, and {p}o3 of what is open behind the last."""
    out = [f"{p}o0 AS (SELECT DISTINCT user_id, {kinds} AS needed FROM {source})"]
    for r in range(probe.ROUNDS):
        key = f"user_id || ':{r}:' || pos"
        slot, level = _slot_sql(key, audio.SLOT_SNR_DISJOINT, True)
        out += [
            f"{p}d{r} AS (SELECT *, {slot} AS slot FROM (SELECT user_id, needed, unnest(range(0, least({batch}, {probe.EACH} * len(needed)))) AS pos FROM {p}o{r}))",
            f"{p}t{r} AS (SELECT d.user_id, d.needed, d.pos, d.slot, {level} AS snr_db, e.event_id, e.judged FROM (SELECT * FROM {p}d{r} JOIN n USING (user_id)) d JOIN e ON e.user_id = d.user_id AND e.place = floor({_U('42:event', 'd.' + key)} * d.n))".replace(key, "d." + key).replace("d.d.", "d."),
            f"{p}g{r} AS (SELECT user_id, judged AS kind, {r} AS round, min(pos) AS pos, arg_min(slot, pos) AS slot, arg_min(CASE WHEN snr_db IS NULL THEN -1 ELSE snr_db END, pos) AS snr, arg_min(event_id, pos) AS event_id FROM {p}t{r} WHERE list_contains(needed, judged) GROUP BY user_id, judged)",
            f"{p}o{r + 1} AS (SELECT user_id, left_over AS needed FROM (SELECT o.user_id, list_filter(o.needed, lambda k: NOT list_contains(coalesce(h.have, []), k)) AS left_over FROM {p}o{r} o LEFT JOIN (SELECT user_id, list(kind) AS have FROM {p}g{r} GROUP BY user_id) h USING (user_id)) WHERE len(left_over) > 0)",
        ]
    return ", ".join(out)


_HEARD = f"{_JUDGED}, e AS (SELECT user_id, event_id, judged, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM judged), n AS (SELECT user_id, count(*) AS n FROM judged GROUP BY user_id)"
_ALL = lambda p, t: " UNION ALL ".join(f"SELECT * FROM {p}{t}{r}" for r in range(probe.ROUNDS))


def _build_sql(result: str) -> str:
    """Tables of the build's stages: c candidates with what each kind got, w their successes counted, p those passed, then ``result``."""
    first = lambda p, k: f"(SELECT arg_min(CASE WHEN snr IS NULL THEN -1 ELSE snr END, round) FROM ({_ALL(p, 'g')}) WHERE user_id = u.user_id AND kind = '{k}')"
    has = lambda p, k: f"EXISTS (SELECT 1 FROM ({_ALL(p, 'g')}) g WHERE g.user_id = u.user_id AND g.kind = '{k}')"
    target = {"answer": "plain", "repair": "safe", "repeat": "plain"}
    parts = [
        f"""e AS (SELECT user_id, event_id, judged, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM (SELECT conv_id AS user_id, turn AS event_id, CASE length(text) % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'repair' WHEN 2 THEN 'repeat' ELSE 'none' END AS judged FROM conversations WHERE turn > 0 AND text IS NOT NULL))""",
        "n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id)",
        f"cm AS (SELECT conv_id AS user_id, text, {_WORDS('text')} AS w, len({_TOKENS_OF('text')}) AS n_tokens FROM conversations WHERE turn = 0 AND text IS NOT NULL)",
        "lo AS (SELECT user_id, w[1] AS lost FROM cm WHERE len(w) > 0)",
        f"att AS (SELECT conv_id AS user_id, turn, trim(text) AS text, list_contains({_WORDS('text')}, lost) AND NOT list_contains({_list(L.NON_PIECE_WORDS)}, lost) AS leak FROM conversations JOIN lo ON lo.user_id = conv_id WHERE turn > 0 AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= {L.TARGET_ATTEMPTS})",
        "ta AS (SELECT user_id, coalesce(arg_min(text, turn) FILTER (text <> ''), '') AS plain, coalesce(arg_min(text, turn) FILTER (text <> '' AND NOT leak), '') AS safe FROM att GROUP BY user_id)",
        _rounds_sql("x", S.KINDS, probe.BATCH, "cm"), _rounds_sql("y", ["answer"], probe.ANSWER_BATCH, "cm"),
    ]
    for i, (stage, parity, p, kinds, free) in enumerate((("test", 0, "x", S.KINDS, ""), ("train", 1, "x", S.KINDS, ""), ("answers", 1, "y", ["answer"], " AND u.user_id NOT IN (SELECT user_id FROM p1)"))):
        starved = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT {has(p, k)} THEN '{k}' END" for k in kinds) + "], lambda x: x IS NOT NULL), ',')"
        unwritten = " OR ".join(f"coalesce({target[k]}, '') = ''" for k in kinds) if stage != "test" else "false"
        name = "'probe'" if len(kinds) == 1 else "'probe:' || st"
        parts += [
            f"c{i} AS (SELECT *, CASE WHEN st <> '' THEN {name} WHEN {unwritten} THEN 'targets' END AS reason FROM (SELECT u.user_id, ta.plain, ta.safe, {starved} AS st, {', '.join(f'{first(p, k)} AS s_{k}' for k in kinds)} FROM cm u LEFT JOIN ta USING (user_id) WHERE u.user_id % 2 = {parity} AND n_tokens >= {LEAST_TOKENS}{free}))",
            f"w{i} AS (SELECT *, sum((reason IS NULL)::INT) OVER (ORDER BY user_id) AS got FROM c{i})",
            f"p{i} AS (SELECT * FROM w{i} WHERE user_id <= (SELECT coalesce(min(user_id) FILTER (got >= {BUILT[stage]}), max(user_id)) FROM w{i}))",
            f"k{i} AS (" + " UNION ALL ".join(f"SELECT {i} AS stage, user_id, {j} AS place, '{k}' AS kind, {target[k] if stage != 'test' else chr(39) * 2} AS target, s_{k} AS snr, '{'test' if stage == 'test' else 'train'}' AS split FROM p{i} WHERE reason IS NULL" for j, k in enumerate(kinds)) + ")",
            f"r{i} AS (SELECT '{stage}' AS stage, reason FROM p{i} WHERE reason IS NOT NULL UNION ALL SELECT '{stage}', 'seen/short' FROM cm WHERE user_id % 2 = {parity} AND user_id NOT IN (SELECT user_id FROM p{i}) AND user_id <= (SELECT max(user_id) FROM p{i}))",
        ]
    return f"WITH {', '.join(parts)} {result}"


def _outcomes_sql(p: str, build: str, reason: str) -> str:
    return f"SELECT '{build}' AS build, {reason} AS reason, count(*) AS n FROM {p}o{probe.ROUNDS} GROUP BY ALL UNION ALL SELECT '{build}', 'format', count(*) FROM ({_ALL(p, 't')}) WHERE judged = 'bad' HAVING count(*) > 0"


def _quotas_sql() -> str:
    parts, taken = [], []
    for i, (name, n) in enumerate(WANTED.items()):
        free = "".join(f" AND user_id NOT IN (SELECT user_id FROM p{k})" for k in range(i))
        parts += [
            f"c{i} AS (SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_type = '{name}'{free} GROUP BY user_id)",
            f"w{i} AS (SELECT *, sum((value >= 50)::INT) OVER (ORDER BY event_id) AS got FROM c{i})",
            f"p{i} AS (SELECT * FROM w{i} WHERE event_id <= (SELECT coalesce(min(event_id) FILTER (got >= {n}), max(event_id)) FROM w{i}))",
        ]
        taken.append(f"SELECT '{name}' AS stage, user_id, event_id, (SELECT count(*) FROM p{i}) AS n_claimed FROM p{i} WHERE value >= 50")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(taken)


def _sinc_sql() -> str:
    """The filter from 16 to 24 samples: phases of thirds, weights that sum to 1."""
    c = sound.CROSSINGS
    t = "(m - (k * 2 % 3) / 3.0)::DOUBLE"
    raw = f"CASE WHEN abs({t}) > {c} THEN 0 WHEN {t} = 0 THEN 1 ELSE sin(pi() * {t}) / (pi() * {t}) * power(cos(pi() * {t} / {2 * c}), 2) END"
    return f"""WITH f AS (SELECT k, m, {raw} AS w FROM (SELECT unnest(range(0, 3)) AS k), (SELECT unnest(range(-{c}, {c + 1})) AS m)),
        g AS (SELECT k, m, w / sum(w) OVER (PARTITION BY k) AS w FROM f),
        y AS (SELECT vec_id, i, sum(embedding[i * 2 // 3 + m + 1] * w) FILTER (i * 2 // 3 + m BETWEEN 0 AND len(embedding) - 1) AS y FROM (SELECT vec_id, embedding, unnest(range(0, (len(embedding) * 3 + 1) // 2)) AS i FROM embeddings) JOIN g ON g.k = i % 3 GROUP BY ALL)
        SELECT vec_id, count(*) AS n, round(sum(y), 3) AS total, round(sum(y * y) / 24, 3) AS energy FROM y GROUP BY vec_id"""


_NEED = "CASE lang WHEN 'en' THEN ['answer', 'repair', 'repeat'] WHEN 'fr' THEN ['answer', 'repeat'] ELSE ['answer'] END"
_LEVELS = [(d, *_slot_sql("doc_id", audio.SLOT_SNR_DISJOINT if d else audio.SLOT_SNR, d)) for d in (True, False)]
_TOKENS_OF = lambda c: f"list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda x: x <> '')"
_STOP = _list(T.PIECE_STOPWORDS)
_CARRY = lambda f: f"last_value({f} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {f}"
_SHARE = lambda x: f"coalesce(len(list_filter(cmd, lambda c: list_contains({x}, c))) / nullif(len(cmd), 0), 0)"
_SPOKEN = f"""r AS (SELECT conv_id, {_TOKENS_OF('text')} AS ts FROM conversations WHERE turn = 0 AND text IS NOT NULL),
  a AS (SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts))) AS place, unnest(ts) AS token FROM r),
  b AS (SELECT *, sum(length(token)) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM a),
  ws AS (SELECT conv_id, place, CASE WHEN conv_id % 5 = 2 AND place = 2 THEN 0 ELSE (upto - length(token)) * {LETTER} END::DOUBLE AS start, (upto * {LETTER})::DOUBLE AS "end" FROM b WHERE conv_id % 11 <> 3 AND (conv_id % 7 <> 1 OR place < n - 1)),
  q AS (SELECT r.conv_id, len(ts) AS n_tokens, (SELECT count(*) FROM ws WHERE ws.conv_id = r.conv_id) AS n_words FROM r),
  st AS (SELECT *, CASE WHEN n_words = 0 THEN 'alignment' WHEN n_words <> n_tokens THEN 'token-count' WHEN conv_id % 5 = 2 AND n_tokens > 2 THEN 'order' END AS reason FROM q)"""
#: The ends of the covered samples, as the mask's rule has them.
_A, _B = "trunc((label / 50.0)::DOUBLE * 16000)", "trunc(((label / 50.0)::DOUBLE + (vec_id % 4) / 16.0) * 16000)"
_MIDDLE = f"floor(({_A} + {_B}) / 2) - 800"

SQL = {
    "probe_rounds": f"WITH {_HEARD}, {_rounds_sql('x', S.KINDS, probe.BATCH)} SELECT user_id, kind, round, pos, slot, CASE WHEN snr >= 0 THEN snr END AS snr_db, event_id FROM ({_ALL('x', 'g')})",
    "probe_outcomes": f"WITH {_HEARD}, {_rounds_sql('x', S.KINDS, probe.BATCH)}, {_rounds_sql('y', ['answer'], probe.ANSWER_BATCH)} " + _outcomes_sql("x", "triplets", "'probe:' || array_to_string(needed, ',')") + " UNION ALL " + _outcomes_sql("y", "answers", "'probe'"),
    "slot_levels": " UNION ALL ".join(f"SELECT doc_id, {d} AS disjoint, slot, {level} AS snr_db FROM (SELECT *, {slot} AS slot FROM (SELECT doc_id, {_NEED} AS needed FROM documents))" for d, slot, level in _LEVELS),
    "chained_quotas": _quotas_sql(),
    "sweep_draws": "WITH c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS i, count(*) OVER () AS n FROM conversations WHERE turn = 0), b AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {lo}::DOUBLE, {hi}::DOUBLE)" for i, (k, (lo, hi)) in enumerate(audio.SLOT_SNR_DISJOINT.items())) + f") b(b, band, lo, hi)), d AS (SELECT *, b * n + i AS draw FROM c CROSS JOIN b) SELECT conv_id, band, draw, round(lo + (hi - lo) * {_U('42:sweep', 'draw')}, 1) AS snr_db FROM d",
    "target_fold": f"""WITH w AS (SELECT conv_id, turn, {_TOKENS_OF('text')} AS w, length(text) AS n FROM conversations WHERE text IS NOT NULL),
        a AS (SELECT conv_id, turn, CASE WHEN n % 3 > 0 THEN w[1] END AS answer, CASE WHEN n % 2 > 0 THEN w[2] END AS repair, CASE WHEN n % 5 > 1 THEN w[3] END AS repeat FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= {targets.ATTEMPTS}),
        s AS (SELECT conv_id, turn, {", ".join(map(_CARRY, S.KINDS))} FROM a)
        SELECT conv_id, answer, repair, repeat FROM s WHERE answer IS NOT NULL AND repair IS NOT NULL AND repeat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""",
    "loss_overlap_decision": f"""WITH t AS (SELECT conv_id, turn, {_WORDS('text')} AS w FROM conversations WHERE turn <= 2),
        c AS (SELECT a.conv_id, list_filter(a.w, lambda x, i: list_position(a.w, x) = i)[1:{PIECES}] AS p, list_distinct(list_filter(a.w, lambda x: NOT list_contains({_STOP}, x))) AS cmd, b.w AS w1, c.w AS w2 FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1 JOIN t c ON a.conv_id = c.conv_id AND c.turn = 2 WHERE len(a.w) > 0),
        l AS (SELECT *, list_filter(p, lambda x: NOT list_contains(w1, x)) AS a, list_filter(p, lambda x: NOT list_contains(w2, x)) AS r FROM c),
        g AS (SELECT *, list_filter(a, lambda x: list_contains(r, x) AND NOT list_contains({_STOP}, x)) AS g FROM l),
        k AS (SELECT *, CASE WHEN {_SHARE('a')} >= {D.LOST_SHARE} AND {_SHARE('r')} >= {D.LOST_SHARE} OR len(g) = 1 AND {_SHARE('g')} >= {D.LOST_SHARE} THEN 'repeat' WHEN len(g) = 0 THEN 'answer' WHEN len(g) = 1 THEN 'repair' ELSE 'repeat' END AS kind FROM g)
        SELECT conv_id, kind, array_to_string(CASE kind WHEN 'repeat' THEN list_concat(a, list_filter(r, lambda x: NOT list_contains(a, x))) WHEN 'repair' THEN g ELSE [] END, ';') AS missing,
          'a' || len(a) || 'xr' || len(r) || ' -> ' || len(g) || ' agreed' || CASE WHEN {_SHARE('a')} >= {D.LOST_SHARE} AND {_SHARE('r')} >= {D.LOST_SHARE} THEN ' (both wrecked)' ELSE '' END || ' | asr lost: ' || coalesce(nullif(array_to_string(a, '; '), ''), 'none') || ' | reply lost: ' || coalesce(nullif(array_to_string(r, '; '), ''), 'none') AS reason FROM k""",
    "written_targets": f"""WITH w AS (SELECT conv_id, turn, text, {_WORDS('text')} AS w FROM conversations WHERE text IS NOT NULL),
        l AS (SELECT conv_id, w[1] AS lost FROM w WHERE turn = 0 AND len(w) > 0),
        a AS (SELECT w.conv_id, turn, trim(text) AS text, trim(text) <> '' AND list_contains(w, lost) AND NOT list_contains({_list(L.NON_PIECE_WORDS)}, lost) AS leak FROM w JOIN l ON l.conv_id = w.conv_id WHERE turn > 0 QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY turn) <= {L.TARGET_ATTEMPTS}),
        f AS (SELECT conv_id, min(turn) FILTER (text <> '' AND NOT leak) AS took FROM a GROUP BY conv_id)
        SELECT conv_id, coalesce(max(text) FILTER (turn = took), '') AS target, count(*) FILTER (leak AND (took IS NULL OR turn < took))::INT AS n_leaks FROM a JOIN f USING (conv_id) GROUP BY conv_id""",
    "witness_labels": f"""WITH t AS (SELECT conv_id, turn, {_WORDS('text')} AS w FROM conversations WHERE turn <= 3 AND text IS NOT NULL),
        k AS (SELECT conv_id, list_filter(p, lambda x: NOT list_contains({_list(T.WAKE_WORDS)}, x)) AS p FROM (SELECT conv_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:{PIECES}] AS p FROM t WHERE turn = 0)),
        v AS (SELECT t.conv_id, turn, p, (t.conv_id * 3 + turn - 1) AS number, list_filter(range(1, len(p) + 1), lambda i: NOT list_contains(w, p[i])) AS ids FROM t JOIN k ON k.conv_id = t.conv_id WHERE turn > 0 AND len(p) > 0 AND len(w) > 0),
        g AS (SELECT conv_id, any_value(p) AS p, list(ids ORDER BY turn) AS sides, bool_or(number % 13 = 12 OR number % 17 = 16) AS broken FROM v GROUP BY conv_id HAVING count(*) >= 2),
        a AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: len(list_filter(sides, lambda s: NOT list_contains(s, i))) = 0) AS g FROM g WHERE NOT broken)
        SELECT conv_id, CASE WHEN len(g) = 0 THEN 'answer' WHEN len(g) = 1 AND len(p) > 1 THEN 'repair' ELSE 'repeat' END AS kind, array_to_string(list_transform(g, lambda i: p[i]), ';') AS lost, 'a' || len(sides[1]) AS asr_bucket, 'r' || len(sides[-1]) AS resp_bucket,
          len(p) || ' pieces | ' || array_to_string(list_transform(sides, lambda s: {_IDS('s')}), ' x ') || ' -> agreed ' || {_IDS('g')} AS reason FROM a""",
    "dataset_build": _build_sql("SELECT row_number() OVER (ORDER BY stage, user_id, place) AS id, kind, target, CASE WHEN snr >= 0 THEN snr END AS snr_db, user_id AS slurp_id, split FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2)"),
    "dataset_reasons": _build_sql("SELECT stage, reason, count(*) AS n FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY ALL"),
    "alignment_state": f"WITH {_SPOKEN} SELECT conv_id, n_tokens, n_words, reason FROM st",
    "span_times": f'WITH {_SPOKEN} SELECT conv_id, min(start) AS start, max("end") AS "end" FROM ws WHERE place IN (1, 2) AND conv_id IN (SELECT conv_id FROM st WHERE reason IS NULL) GROUP BY conv_id',
    "span_noise": f"SELECT vec_id AS id, greatest(CASE WHEN {_B} - {_A} < 1600 THEN {_MIDDLE} ELSE {_A} END, 0)::INT AS first, (least(CASE WHEN {_B} - {_A} < 1600 THEN {_MIDDLE} + 1600 ELSE {_B} END, 6400) - 1)::INT AS last FROM embeddings",
    "resampled": _sinc_sql(),
}
