"""Queries of the build and evaluation paths on the driver's tables as stand-ins, with the same in DuckDB's SQL.

``conversations`` stand for commands (turn 0) and what witnesses heard (later turns); ``events`` for judged
probes, their users for utterances; ``documents`` for rows to assemble.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decide as D
from ..functions import label as L
from ..functions import text as T
from ..operators import assemble as A
from ..operators import build as B
from ..operators import evaluate as E
from ..operators import score as S
from ..sources import jsonl
from .queries import _JUDGED, _table, judged

#: Pieces of a command that witnesses are held against.
PIECES = 6


def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize(F.col("text")).alias("plain"))


def content_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.content(F.col("text"))), " ").alias("content"))


def pair_assembly(spark, sf_dir):
    """An answer and a repair of each document, with its language and its source for targets."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("lang").alias("target")).alias("answer"), F.struct(F.col("source").alias("target")).alias("repair"))
    return B.pair_rows(docs, ["doc_id"])


def utterances(spark, sf_dir):
    """Users as utterances: their kinds, a target for each, the types as pieces; one user in ten was met before."""
    rows = judged(spark, sf_dir).groupBy("user_id").agg(F.collect_set("kind").alias("have"), F.collect_set("judged").alias("pieces"), F.count("*").alias("n_tokens"), *(F.min(F.when(F.col("kind") == k, F.col("judged"))).alias(f"t_{k}") for k in S.KINDS))
    split = F.when(F.col("user_id") % 2 == 0, "test").otherwise("train")
    empty = F.when(F.col("user_id") % 7 == 0, "")  # a writer that gave nothing
    targets = F.array_compact(F.array(*(F.coalesce(empty, F.col(f"t_{k}")) for k in S.KINDS)))
    return rows.withColumn("split", split).withColumn("reason", B.skip_reason(F.col("user_id") % 10 == 0, F.col("n_tokens"), F.col("pieces"), F.col("have"), targets, F.col("split")))


def skip_reasons(spark, sf_dir):
    return B.reasons(utterances(spark, sf_dir))


def kind_counts(spark, sf_dir):
    return B.kind_counts(judged(spark, sf_dir).withColumn("split", F.when(F.col("user_id") % 2 == 0, "test").otherwise("train")))


def first_probes(spark, sf_dir):
    """The first probe of each user and kind, by rounds of a hundred events and the place in them."""
    rows = judged(spark, sf_dir).select("user_id", "kind", "judged", F.floor(F.col("event_id") / 100).alias("round"), (F.col("event_id") % 100).alias("pos"))
    return B.first_probes(rows, "user_id")


def piece_inventory_intersection(spark, sf_dir):
    """A command's first distinct words as pieces; each of the next two turns lost those that it lacks."""
    turns = _table(spark, sf_dir, "conversations").where("turn <= 2").select("conv_id", "turn", T.tokens(T.normalize(F.col("text"))).alias("words"))
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("words"))).alias(f"w{k}")
    rows = turns.groupBy("conv_id").agg(at(0), at(1), at(2)).where("w0 is not null and w1 is not null and w2 is not null")
    pieces = F.slice(F.array_distinct("w0"), 1, PIECES)
    ids = F.transform(pieces, lambda p, i: (i + 1).cast("int"))
    lost = lambda w: F.filter(ids, lambda i: ~F.array_contains(w, F.element_at(pieces, i)))
    sides = F.array(lost(F.col("w1")), lost(F.col("w2")))
    label = D.decide_by_ids(pieces, sides)
    bucket = L.buckets(sides)
    return rows.where(F.size("w0") > 0).select("conv_id", label["kind"].alias("kind"), F.array_join(label["lost"], ";").alias("lost"), bucket["asr_bucket"].alias("asr_bucket"), bucket["resp_bucket"].alias("resp_bucket"), L.reason_by_ids(F.size(pieces), sides).alias("reason"))


def phrase_search(spark, sf_dir):
    """Where a turn's third and fourth words stand first."""
    rows = _table(spark, sf_dir, "conversations").withColumn("words", A.norm_tokens(F.col("text"))).where(F.size("words") >= 4)
    return rows.select("conv_id", "turn", T.phrase_at(F.col("words"), F.slice("words", 3, 2)).alias("at")).select("conv_id", "turn", "at.start", "at.end")


def mask_phrase(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", T.mask_phrase(F.col("text"), F.lit("TH")).alias("masked"))


def leak_check(spark, sf_dir):
    """Whether a word of a conversation's first turn stands in a later one."""
    rows = _table(spark, sf_dir, "conversations")
    first = rows.where("turn = 0").select("conv_id", F.col("text").alias("phrase"))
    return rows.where("turn > 0").join(first, "conv_id").select("conv_id", "turn", T.leaks(F.col("text"), F.col("phrase"), T.PIECE_STOPWORDS).alias("leaks"))


def entity_extract(spark, sf_dir):
    """Slots and phrases of an annotation put together from a document's source and language."""
    docs = _table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    found = A.entities(F.concat(F.lit("play ["), F.upper("source"), F.lit(" : "), "lang", F.lit("] at [Time : Five AM ]")))
    return docs.select("doc_id", F.posexplode(found).alias("place", "e")).select("doc_id", "place", "e.slot", "e.phrase")


_FORMS = ("Heard: {}\nReply: yes", "Sure! **Heard:** {}\n**Reply:** \"no\"", "{}\nreplied: so", "Heard: {}")


def heard_reply_split(spark, sf_dir):
    """Answers in four forms around each turn's text, by the turn."""
    form = F.coalesce(*(F.when(F.col("turn") % len(_FORMS) == i, F.concat(F.lit(a), F.col("text"), F.lit(b))) for i, (a, b) in enumerate(f.split("{}") for f in _FORMS)))
    rows = _table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", T.heard_reply(form).alias("p")).select("conv_id", "turn", "p.heard", "p.reply")


def json_last_wins(spark, sf_dir):
    lines = _table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.col("props").alias("value"))
    return jsonl.last_with(lines, "k").select(F.get_json_object("value", "$.k").cast("long").alias("k"))


def _samples(spark, sf_dir):
    rows = judged(spark, sf_dir).select("event_id", "kind", F.array(F.lit("x")).alias("lost"), F.when(F.col("event_id") % 11 == 0, "no json").otherwise(F.concat(F.lit('{"type": "'), "judged", F.lit('"}'))).alias("judged"), F.lit("a").alias("response"))
    second = rows.where("event_id % 3 = 1 and event_id % 5 <> 0").select("event_id", F.when(F.col("event_id") % 2 == 0, '{"type": "repair_off"}').otherwise('{"type": "repair"}').alias("answer"))
    return E.by_type(E.split_responses(rows, False), second, "tree", "event_id")


def eval_record(spark, sf_dir):
    """The summary line of the same run: its counts of kind and judged type, in order, as text."""
    out = E.record(_samples(spark, sf_dir), model="m", score_matrix="tree")
    shown = F.array_join(F.transform(F.map_entries("confusion"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ")
    return out.select("type", "model", "score_matrix", F.array_join("kinds", ",").alias("kinds"), shown.alias("confusion"), F.size("score_hist").alias("n_scores"), "unanswered_rows")


def eval_run(spark, sf_dir):
    """An evaluation from judges' replies to its summary; a second judge finds half of the repairs off and has not answered to a fifth."""
    samples = _samples(spark, sf_dir)
    out = E.summary(samples)
    return out.select(*(F.round(c, 6).alias(c) for c in ("C", "R", "F", "EAR")), "answer_rows", "repair_rows", "repeat_rows", "judge_parse_failures", "unanswered_rows", "unscored_rows")


QUERIES = {
    f.__name__: f
    for f in (normalize_text, content_tokens, pair_assembly, skip_reasons, kind_counts, first_probes, piece_inventory_intersection, phrase_search, mask_phrase, leak_check, entity_extract, heard_reply_split, json_last_wins, eval_run, eval_record)
}

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_NORMAL = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '\\[[^\\]]*\\]|<[^>]*>|\\([^)]*\\)', '', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = lambda c: f"list_filter(string_split({_NORMAL(c)}, ' '), lambda x: x <> '')"
_KIND_SETS = ", ".join(f"min(judged) FILTER (kind = '{k}') AS t_{k}" for k in S.KINDS)
_STARVED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN t_{k} IS NULL THEN '{k}' END" for k in S.KINDS) + "], lambda x: x IS NOT NULL), ',')"
_LOST = lambda w: f"list_filter(range(1, len(p) + 1), lambda i: NOT list_contains({w}, p[i]))"
_IDS = lambda s: f"'[' || array_to_string({s}, ', ') || ']'"
_CLEAN = lambda c: f"trim(trim(trim({c}, e' \\n\\t'), '*\"'), e' \\n\\t')"
_FORM_SQL = "CASE turn % 4 " + " ".join(f"WHEN {i} THEN " + " || ".join(["'" + a.replace("'", "''") + "'", "text", "'" + b + "'"]) for i, (a, b) in enumerate(f.split("{}") for f in _FORMS)) + " END"
_REPLY_RE, _HEARD_RE = r"\**\s*repl(?:y|ied)\s*\**\s*:\**", r"(?is)^.*?\**\s*heard\s*\**\s*:\**"
_EVENTS_SQL = f"""{_JUDGED}, r AS (SELECT kind, event_id, CASE WHEN event_id % 11 = 0 THEN 'bad' WHEN kind = 'repair' AND judged = 'repair' AND event_id % 5 = 0 THEN NULL WHEN kind = 'repair' AND judged = 'repair' AND event_id % 2 = 0 THEN 'repair_off' ELSE judged END AS j FROM judged),
s AS (SELECT kind, event_id, j, CASE {" ".join(f"WHEN kind = '{k}' AND j = '{t}' THEN {x}" for k, row in S.MATRICES["tree"].items() for t, x in row.items())} END AS score FROM r),
m AS (SELECT {", ".join(f"coalesce(avg(score) FILTER (kind = '{k}'), 0) AS {n}" for k, n in zip(S.KINDS, "CRF", strict=True))}, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_rows" for k in S.KINDS)}, count(*) FILTER (event_id % 11 = 0) AS judge_parse_failures, count(*) FILTER (j IS NULL) AS unanswered_rows, count(*) FILTER (j IS NOT NULL AND score IS NULL) AS unscored_rows FROM s)"""

SQL = {
    "normalize_text": f"SELECT conv_id, turn, {_NORMAL('text')} AS plain FROM conversations",
    "content_tokens": f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter({_WORDS('text')}, lambda x: NOT list_contains({_list(T.PIECE_STOPWORDS)}, x)))), ' ') AS content FROM conversations",
    "pair_assembly": "SELECT doc_id, 'answer' AS kind, 0 AS place, lang AS target FROM documents UNION ALL SELECT doc_id, 'repair', 1, source FROM documents",
    "skip_reasons": f"""WITH {_JUDGED}, u AS (SELECT user_id, count(*) AS n, {_KIND_SETS} FROM judged GROUP BY user_id),
        r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN user_id % 10 = 0 OR n < {A.LEAST_TOKENS} THEN 'seen/short' WHEN {_STARVED} <> '' THEN 'probe:' || {_STARVED} WHEN user_id % 2 <> 0 AND user_id % 7 = 0 THEN 'targets' END AS reason FROM u)
        SELECT split, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL""",
    "kind_counts": f"WITH {_JUDGED} SELECT CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'train' END AS split, kind, count(*) AS n FROM judged GROUP BY ALL",
    "first_probes": f"WITH {_JUDGED} SELECT user_id, kind, arg_min(judged, event_id) AS judged, min(event_id) // 100 AS round, min(event_id) % 100 AS pos FROM judged GROUP BY user_id, kind",
    "piece_inventory_intersection": f"""WITH t AS (SELECT conv_id, turn, {_WORDS('text')} AS w FROM conversations WHERE turn <= 2),
        c AS (SELECT a.conv_id, a.w AS w0, b.w AS w1, c.w AS w2 FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1 JOIN t c ON a.conv_id = c.conv_id AND c.turn = 2 WHERE len(a.w) > 0),
        p AS (SELECT *, list_filter(w0, lambda x, i: list_position(w0, x) = i)[1:{PIECES}] AS p FROM c),
        s AS (SELECT *, {_LOST('w1')} AS a, {_LOST('w2')} AS b FROM p), g AS (SELECT *, list_filter(a, lambda i: list_contains(b, i)) AS g FROM s)
        SELECT conv_id, CASE WHEN len(g) = 0 THEN 'answer' WHEN len(g) = 1 AND len(p) > 1 THEN 'repair' ELSE 'repeat' END AS kind, array_to_string(list_transform(g, lambda i: p[i]), ';') AS lost, 'a' || len(a) AS asr_bucket, 'r' || len(b) AS resp_bucket,
          len(p) || ' pieces | ' || {_IDS('a')} || ' x ' || {_IDS('b')} || ' -> agreed ' || {_IDS('g')} AS reason FROM g""",
    "phrase_search": "WITH w AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '[^a-z0-9'']', '', 'g')) AS w FROM conversations), f AS (SELECT conv_id, turn, list_filter(range(1, len(w)), lambda i: w[i] = w[3] AND w[i + 1] = w[4])[1] AS i FROM w WHERE len(w) >= 4) SELECT conv_id, turn, i - 1 AS start, i + 1 AS \"end\" FROM f",
    "mask_phrase": "SELECT conv_id, turn, CASE WHEN position('th' IN lower(text)) > 0 THEN substr(text, 1, position('th' IN lower(text)) - 1) || '[GARBLED]' || substr(text, position('th' IN lower(text)) + 2) ELSE text END AS masked FROM conversations WHERE text IS NOT NULL",
    "leak_check": f"WITH f AS (SELECT conv_id, text AS phrase FROM conversations WHERE turn = 0) SELECT conv_id, turn, list_has_any(list_filter(regexp_extract_all(lower(phrase), '([a-z'']+)', 1), lambda x: length(x) > 2 AND NOT list_contains({_list(T.PIECE_STOPWORDS)}, x)), regexp_extract_all(lower(text), '([a-z'']+)', 1)) AS leaks FROM conversations JOIN f USING (conv_id) WHERE turn > 0",
    "entity_extract": "WITH e AS (SELECT doc_id, unnest([{'place': 0, 'slot': lower(source), 'phrase': lower(lang)}, {'place': 1, 'slot': 'time', 'phrase': 'five am'}]) AS e FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) SELECT doc_id, e.place, e.slot, e.phrase FROM e",
    "heard_reply_split": f"""WITH f AS (SELECT conv_id, turn, {_FORM_SQL} AS t FROM conversations WHERE text IS NOT NULL), s AS (SELECT *, regexp_matches(t, '(?is){_REPLY_RE}') AS two, regexp_extract(t, '(?is)^(.*?){_REPLY_RE}(.*)$', 1) AS a, regexp_extract(t, '(?is)^(.*?){_REPLY_RE}(.*)$', 2) AS b FROM f)
        SELECT conv_id, turn, CASE WHEN two THEN {_CLEAN(f"regexp_replace(a, '{_HEARD_RE}', '')")} ELSE '' END AS heard, CASE WHEN two THEN {_CLEAN('b')} ELSE trim(t, e' \\n\\t') END AS reply FROM s""",
    "json_last_wins": "SELECT (arg_max(props, event_id)->>'$.k')::BIGINT AS k FROM events WHERE json_contains(json_keys(props)::JSON, '\"k\"')",
    "eval_record": f"WITH {_EVENTS_SQL}, c AS (SELECT kind || '->' || j AS l, count(*) AS n FROM s WHERE j IS NOT NULL GROUP BY ALL) SELECT 'summary' AS type, 'm' AS model, 'tree' AS score_matrix, 'answer,repair,repeat' AS kinds, string_agg(l || ':' || n, ' ' ORDER BY l) AS confusion, 0 AS n_scores, (SELECT unanswered_rows FROM m) AS unanswered_rows FROM c",
    "eval_run": f"WITH {_EVENTS_SQL} SELECT round(C, 6) AS C, round(R, 6) AS R, round(F, 6) AS F, round(CASE WHEN least(C, R, F) = 0 THEN 0 ELSE 3.0 / (1.0 / nullif(C, 0) + 1.0 / nullif(R, 0) + 1.0 / nullif(F, 0)) END, 6) AS EAR, answer_rows, repair_rows, repeat_rows, judge_parse_failures, unanswered_rows, unscored_rows FROM m",
}
