"""More queries on the driver's tables as stand-ins, with the same in DuckDB's SQL.

``embeddings`` stand for signals, ``conversations`` for commands (turn 0) and hypotheses (later turns),
``events`` for judged samples, their ``props`` for judges' replies.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judge as J
from ..functions import text as T
from ..operators import assemble as A
from ..operators import audio, nbest
from ..operators import score as S
from ..operators.select import draw
from ..sources import provider
from . import report
from .built import _WORDS, _list
from .queries import _JUDGED, _U, _scored_sql, _table, judged


def nbest_sweep(spark, sf_dir):
    """Recall of each conversation's first turn in the first n of its later turns, by conv_id modulo 3."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("sentence"), F.sort_array(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", "text")))).alias("later"))
    rows = turns.select((F.col("conv_id") % 3).alias("band"), "sentence", F.transform("later", lambda x: x["text"]).alias("hyps"))
    means = nbest.sweep(nbest.prefix_scores(rows))
    return means.select("n_best", "band", "n", *(F.round(c, 6).alias(c) for c in means.columns[3:]))


def babble_mix(spark, sf_dir):
    """Every embedding as a quiet signal at 16 samples a second, with noise of the pool at a drawn ratio; the ratio measured, to one decimal."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: (x / 100).cast("float")).alias("audio"))
    mixed = audio.mixed(rows.withColumn("snr_db", F.floor(draw("42:snr", F.col("id")) * 200) / 10), audio.noise_pool(rows, "id", rate=16))
    added = F.zip_with("noisy", "audio", lambda y, x: y - x)  # nothing reaches 1, so nothing was rescaled
    return mixed.select("id", "snr_db", F.round(10 * F.log10(audio.power(F.col("audio")) / audio.power(added)), 1).alias("measured_db"))


def signal_power(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(audio.power(F.col("embedding")), 8).alias("power"), F.round(audio.peak(F.col("embedding")).cast("double"), 6).alias("peak"))


def judge_parse(spark, sf_dir):
    """Judges' replies parsed to types, by kind."""
    reply = F.when(F.col("event_id") % 5 == 0, "no json").when(F.col("event_id") % 5 == 1, F.lit("{}")).otherwise(F.concat(F.lit('{"type": " '), F.upper("judged"), F.lit('"}')))
    return judged(spark, sf_dir).withColumn("r", J.judged_type(reply)).groupBy("kind", F.col("r.type").alias("type")).agg(F.count("*").alias("n"), F.count_if("r.failed").alias("n_failed"))


def second_look(spark, sf_dir):
    rows = judged(spark, sf_dir).where(J.needs_second_look(F.col("kind"), F.col("judged"), F.array(F.lit("x")), "tree"))
    return rows.groupBy("kind", "judged").agg(F.count("*").alias("n"))


def score_labels(spark, sf_dir):
    """The histogram of scores under ``kind@score``."""
    rows = judged(spark, sf_dir).withColumn("score", S.score_of(F.col("kind"), F.col("judged"), "tree")).where("score is not null")
    return rows.groupBy(report.histogram_label(F.col("kind"), F.col("score")).alias("label")).agg(F.count("*").alias("n"))


def best_runs(spark, sf_dir):
    """Mean scores of seven runs (users modulo 7) as percentages, the best of each kind marked."""
    rows = judged(spark, sf_dir).withColumn("score", S.score_of(F.col("kind"), F.col("judged"), "tree"))
    runs = rows.groupBy((F.col("user_id") % 7).alias("run")).agg(*(F.round(F.avg(F.when(F.col("kind") == k, F.col("score"))), 9).alias(k) for k in S.KINDS))
    return report.score_table(runs, S.KINDS)


def open_calls(spark, sf_dir):
    """Requests (a document's text, by its source's prompt) without a response: labels stand for those given."""
    key = provider.request_key(F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"))
    requests = _table(spark, sf_dir, "documents").select("doc_id", key.alias("request_key"))
    given = requests.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("request_key")
    return provider.open_requests(requests, given).select("doc_id")


def build_overlap(spark, sf_dir):
    """Two builds: the users of even and of odd events, each with its least value as a level."""
    rows = judged(spark, sf_dir).groupBy("user_id", "kind")
    least = lambda c: rows.agg(F.min(F.when(c, F.col("value"))).alias("snr_db")).where("snr_db is not null")
    found = A.build_overlap(least(F.col("event_id") % 2 == 0), least(F.col("event_id") % 2 == 1), ["user_id", "kind"])
    return found.select("n_a", "n_b", "n_both", F.round("spread", 6).alias("spread"))


def claimed_ids(spark, sf_dir):
    """Claims of three stages: documents in English, those in other languages or none, and labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return A.claimed(docs.where(english), docs.where(~english), _table(spark, sf_dir, "labels"), key="doc_id")


QUERIES = {f.__name__: f for f in (nbest_sweep, signal_power, babble_mix, judge_parse, second_look, score_labels, best_runs, open_calls, build_overlap, claimed_ids)}

_REPLY = "CASE event_id % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'bad' ELSE judged END"
_MEANS = ", ".join(f"round(avg(score) FILTER (kind = '{k}'), 9) AS {k}" for k in S.KINDS)
_MARKED = ", ".join(f"CASE WHEN {k} = max({k}) OVER () THEN '**' || printf('%.1f', {k} * 100) || '**' ELSE printf('%.1f', {k} * 100) END AS {k}" for k in S.KINDS)

_LEVEL = f"floor({_U('42:snr', 'vec_id')} * 200) / 10"

_NUMBERS = "CASE x " + " ".join(f"WHEN '{w}' THEN '{d}'" for w, d in T.NUMBERS.items()) + " ELSE x END"
_FOLD = f"list_reduce(list_transform({_WORDS('text')}, lambda x: [{_NUMBERS}]), lambda a, b: CASE WHEN length(b[1]) = 1 AND regexp_full_match(coalesce(a[-1], ''), '\\p{{L}}') THEN list_concat(list_slice(a, 1, len(a) - 1), [a[-1] || b[1]]) ELSE list_concat(a, b) END, []::VARCHAR[])"
#: Words that two hypotheses share are a byte each, others of either side one byte: the distance of strings counts bytes.
_CODED = lambda h, other: f"array_to_string(list_transform({h}, lambda x: CASE WHEN list_contains(c, x) THEN chr((list_position(c, x) + 2)::INT) ELSE chr({other}) END), '')"
_SWEEP = f"""WITH w AS (SELECT conv_id, turn, {_FOLD} AS h FROM conversations WHERE text IS NOT NULL),
    s AS (SELECT conv_id, list_filter(h, lambda x: NOT list_contains({_list([*T.PIECE_STOPWORDS, *T.WAKE_WORDS])}, x)) AS content FROM w WHERE turn = 0),
    k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, h FROM w WHERE turn > 0 AND conv_id IN (SELECT conv_id FROM s WHERE len(content) > 0)),
    d AS (SELECT conv_id, n, sum(levenshtein({_CODED('ha', 1)}, {_CODED('hb', 2)}) / greatest(len(ha), len(hb), 1)) AS d FROM (SELECT b.conv_id, b.n, a.h AS ha, b.h AS hb, list_intersect(a.h, b.h) AS c FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.n < b.n) GROUP BY ALL),
    p AS (SELECT k.conv_id, k.n, coalesce(2 * sum(coalesce(d, 0)) OVER (PARTITION BY k.conv_id ORDER BY k.n) / nullif(k.n * (k.n - 1), 0), 0) AS pair_wer FROM k LEFT JOIN d USING (conv_id, n)),
    u AS (SELECT a.conv_id, a.n, count(DISTINCT array_to_string(b.h, ' ')) AS uniq FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.n <= a.n GROUP BY ALL),
    x AS (SELECT conv_id, len(content) AS m, unnest(range(1, len(content) + 1)) AS i, unnest(content) AS w FROM s),
    g AS (SELECT conv_id, i, list_sort(list(n)) AS ns FROM (SELECT x.conv_id, i, n FROM x JOIN k ON k.conv_id = x.conv_id AND list_contains(h, w)) GROUP BY ALL),
    r AS (SELECT k.conv_id, k.n, x.m, count(*) FILTER (ns[1] <= k.n) AS one, count(*) FILTER (ns[2] <= k.n) AS two, count(*) FILTER (ns[1] = 1) AS h1, count(*) FILTER (ns[1] <= k.n AND ns[1] > 1) AS saved FROM k JOIN x USING (conv_id) LEFT JOIN g ON g.conv_id = x.conv_id AND g.i = x.i GROUP BY ALL)
    SELECT r.n AS n_best, conv_id % 3 AS band, count(*) AS n, round(avg(uniq), 6) AS uniq, round(avg(pair_wer), 6) AS pair_wer, round(avg(h1 / m), 6) AS h1_recall, round(avg(one / m), 6) AS any_hyp_recall, round(avg(two / m), 6) AS two_hyp_recall, round(avg(one / m) - avg(h1 / m), 6) AS gain, round(avg((saved > 0)::INT), 6) AS rows_recovered
    FROM r JOIN p USING (conv_id, n) JOIN u USING (conv_id, n) GROUP BY ALL"""

SQL = {
    "nbest_sweep": _SWEEP,
    "babble_mix": f"SELECT vec_id AS id, {_LEVEL} AS snr_db, {_LEVEL} AS measured_db FROM embeddings",
    "signal_power": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding), 8) AS power, round(list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE, 6) AS peak FROM embeddings",
    "judge_parse": f"WITH {_JUDGED} SELECT kind, {_REPLY} AS type, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS n_failed FROM judged GROUP BY ALL",
    "second_look": f"WITH {_JUDGED} SELECT kind, judged, count(*) AS n FROM judged WHERE kind = 'repair' AND judged = 'repair' GROUP BY ALL",
    "score_labels": f"WITH {_scored_sql('tree')} SELECT kind || '@' || CASE score WHEN 0.5 THEN '0.5' ELSE score::INT::VARCHAR END AS label, count(*) AS n FROM scored WHERE score IS NOT NULL GROUP BY ALL",
    "best_runs": f"WITH {_scored_sql('tree')}, m AS (SELECT user_id % 7 AS run, {_MEANS} FROM scored GROUP BY ALL) SELECT run, {_MARKED} FROM m",
    "open_calls": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "build_overlap": f"WITH {_JUDGED}, a AS (SELECT user_id, kind, min(value) AS x FROM judged WHERE event_id % 2 = 0 AND value IS NOT NULL GROUP BY ALL), b AS (SELECT user_id, kind, min(value) AS y FROM judged WHERE event_id % 2 = 1 AND value IS NOT NULL GROUP BY ALL) SELECT count(x) AS n_a, count(y) AS n_b, count(x + y) AS n_both, round(stddev_pop(x - y), 6) AS spread FROM a FULL JOIN b USING (user_id, kind)",
    "claimed_ids": "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels",
}
