"""Queries that put the operators to the driver's tables as stand-ins, each with the same in DuckDB's SQL.

``events`` stands for judged samples: its type is the judged type and event_id modulo 3 the kind; users are
utterances. ``conversations`` stands for commands (turn 0) and what was heard (later turns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assemble as A
from ..operators import build as B
from ..operators import score as S
from ..operators import select as O
from . import report

_TYPES = {"click": "answer", "view": "repair", "signup": "repair_off", "purchase": "repeat", "error": "bad"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    types = F.create_map(*(F.lit(x) for kv in _TYPES.items() for x in kv))
    kinds = F.array(*map(F.lit, S.KINDS))
    return events.select("event_id", "user_id", "value", "props", F.element_at(kinds, (F.col("event_id") % 3 + 1).cast("int")).alias("kind"), F.element_at(types, F.col("event_type")).alias("judged"))


_JUDGED = """judged AS (SELECT event_id, user_id, value, props, CASE event_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'repair' ELSE 'repeat' END AS kind,
  CASE event_type WHEN 'click' THEN 'answer' WHEN 'view' THEN 'repair' WHEN 'signup' THEN 'repair_off' WHEN 'purchase' THEN 'repeat' ELSE 'bad' END AS judged FROM events)"""


def _scored_sql(matrix: str) -> str:
    cells = " ".join(f"WHEN kind = '{k}' AND judged = '{t}' THEN {s}" for k, row in S.MATRICES[matrix].items() for t, s in row.items())
    return f"{_JUDGED}, scored AS (SELECT *, CASE {cells} END AS score FROM judged)"


def eval_rollup(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return S.kind_means(rows.withColumn("score", S.score_of(F.col("kind"), F.col("judged"), "tree")))


def eval_rollup_cr(spark, sf_dir):
    rows = judged(spark, sf_dir).where(F.col("kind").isin("answer", "repair"))
    return S.kind_means(rows.withColumn("score", S.score_of(F.col("kind"), F.col("judged"), "tree")), ["answer", "repair"])


def _rollup_sql(kinds: list[str]) -> str:
    means = ", ".join(f"coalesce(avg(score) FILTER (kind = '{k}'), 0) AS {k}" for k in kinds)
    least, inverse = ", ".join(kinds), " + ".join(f"1.0 / nullif({k}, 0)" for k in kinds)
    out = ", ".join(f"round({k}, 6) AS mean_{k}" for k in kinds)
    return f"WITH {_scored_sql('tree')}, m AS (SELECT {means} FROM scored) SELECT {out}, round(CASE WHEN least({least}) = 0 THEN 0 ELSE {float(len(kinds))} / ({inverse}) END, 6) AS ear FROM m"


def confusion_matrix(spark, sf_dir):
    return S.confusion(judged(spark, sf_dir))


def score_histogram(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("score", S.score_of(F.col("kind"), F.col("judged"), "legacy"))
    return rows.where("score is not null").groupBy("kind", "score").agg(F.count("*").alias("n"))


def confusion_shift(spark, sf_dir):
    """Cells of two runs (even and odd users) on the whole grid, none as 0; the diagonal is bold."""
    side = lambda parity: judged(spark, sf_dir).where(F.col("user_id") % 2 == parity).groupBy("kind", "judged").agg(F.count("*").alias("n"))
    return report.shift_table(side(0), side(1), F.broadcast(S.grid(spark, kind=S.KINDS, judged=S.JUDGED)))


def snr_bins(spark, sf_dir):
    """Judged types by bins of a level on the whole grid; every tenth event is clean and in no bin."""
    rows = judged(spark, sf_dir).withColumn("level", F.when(F.col("event_id") % 10 > 0, F.col("value") % 30))
    return report.typed_bins(rows, "level", "judged", [0, 4, 8, 12, 16, 20], S.JUDGED)[0]


def clean_ids(spark, sf_dir):
    """The rows that the bins leave out, as they have no level."""
    rows = judged(spark, sf_dir).withColumn("level", F.when(F.col("event_id") % 10 > 0, F.col("value") % 30))
    return report.typed_bins(rows, "level", "judged", [0, 4, 8, 12, 16, 20], S.JUDGED)[1].select("event_id")


def kind_caps(spark, sf_dir):
    return O.cap_kinds(judged(spark, sf_dir), {"answer": 50, "repair": 70}, "event_id").select("event_id", "kind")


def first_probe_per_kind(spark, sf_dir):
    return O.first_of(judged(spark, sf_dir), ["user_id", "kind"], ["event_id"]).select("user_id", "kind", "event_id")


def triplet_complete(spark, sf_dir):
    kinds = F.array(*map(F.lit, S.KINDS))
    rows = judged(spark, sf_dir).groupBy("user_id").agg(F.collect_set("kind").alias("have"))
    return rows.select("user_id", F.concat_ws(",", F.array_except(kinds, "have")).alias("starved"))


def seen_anti_join(spark, sf_dir):
    return O.unseen(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


def quota_stop(spark, sf_dir):
    """The first 100 documents of 300 characters, and how many were claimed for them."""
    kept, claimed = O.quota(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars") >= 300, 100, "doc_id")
    return kept.agg(F.count("*").alias("n_kept"), F.max("doc_id").alias("last_id")).crossJoin(claimed.agg(F.count("*").alias("n_claimed")))  # one row each


def first_recording(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").where(F.size(T.tokens(F.col("text"))) >= 4)
    return O.first_of(rows, ["conv_id"], ["turn"]).select("conv_id", "turn")


def min_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").where(F.size(T.tokens(F.col("text"))) >= 4).select("conv_id", "turn", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def row_unpivot(spark, sf_dir):
    """A row a kind of each document, from three structs."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", *(F.struct(F.col(c).alias("target")).alias(k) for k, c in zip(S.KINDS, ("lang", "source", "lang"), strict=True)))
    return B.triplet_rows(docs, ["doc_id"])


def preference_pairs(spark, sf_dir):
    """Pairs from rollouts that scored under 1, by kind, rejected type and split; rows and rollouts are joined by id."""
    rows = judged(spark, sf_dir).withColumn("score", S.score_of(F.col("kind"), F.col("judged"), "tree"))
    found = A.preference_pairs(rows.select("event_id", "kind", F.col("user_id").alias("target")), rows.select("event_id", F.col("value").alias("response"), "judged", "score"), "event_id")
    return found.groupBy("kind", "rejected_type", "split").agg(F.count("*").alias("n"), F.sum("chosen").alias("chosen"), F.round(F.sum("rejected"), 2).alias("rejected"))


def hash_draws(spark, sf_dir):
    """A noise level in [0, 20) to one decimal, cut off, and a slot by weights 1, 2, 2, for each document."""
    level = F.floor(O.draw("42:snr", F.col("doc_id")) * 200) / 10
    u = O.draw("42:slot", F.col("doc_id"))
    return _table(spark, sf_dir, "documents").select("doc_id", level.alias("snr_db"), F.when(u < 0.2, "answer").when(u < 0.6, "repair").otherwise("repeat").alias("slot"))


_U = lambda purpose, key: f"(('0x' || substr(md5('{purpose}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"

QUERIES = {f.__name__: f for f in (eval_rollup, eval_rollup_cr, confusion_matrix, score_histogram, confusion_shift, snr_bins, clean_ids, kind_caps, first_probe_per_kind, triplet_complete, seen_anti_join, quota_stop, first_recording, min_tokens, row_unpivot, preference_pairs, hash_draws)}

_TOKENS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))"

SQL = {
    "eval_rollup": _rollup_sql(S.KINDS),
    "eval_rollup_cr": _rollup_sql(["answer", "repair"]),
    "confusion_matrix": f"WITH {_JUDGED} SELECT kind, " + ", ".join(f"count(*) FILTER (judged = '{t}') AS {t}" for t in S.JUDGED) + " FROM judged GROUP BY kind",
    "score_histogram": f"WITH {_scored_sql('legacy')} SELECT kind, score::DOUBLE AS score, count(*) AS n FROM scored WHERE score IS NOT NULL GROUP BY ALL",
    "confusion_shift": f"WITH {_JUDGED} SELECT k.kind, t.judged, CASE WHEN k.kind = t.judged THEN '**' ELSE '' END || count(*) FILTER (user_id % 2 = 0) || ' → ' || count(*) FILTER (user_id % 2 = 1) || CASE WHEN k.kind = t.judged THEN '**' ELSE '' END AS cell FROM (SELECT unnest({S.KINDS}) AS kind) k CROSS JOIN (SELECT unnest({S.JUDGED}) AS judged) t LEFT JOIN judged j ON j.kind = k.kind AND j.judged = t.judged GROUP BY k.kind, t.judged",
    "snr_bins": f"WITH {_JUDGED}, c AS (SELECT least(greatest(floor((value % 30) / 4), 0), 4)::BIGINT AS bin, judged, count(*) AS n FROM judged WHERE event_id % 10 > 0 AND value IS NOT NULL GROUP BY ALL) SELECT b.bin, t.judged, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(0, 5)) AS bin) b CROSS JOIN (SELECT unnest({S.JUDGED}) AS judged) t LEFT JOIN c USING (bin, judged)",
    "clean_ids": "SELECT event_id FROM events WHERE event_id % 10 = 0 OR value IS NULL",
    "kind_caps": f"WITH {_JUDGED}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS r FROM judged) SELECT event_id, kind FROM r WHERE r <= CASE kind WHEN 'answer' THEN 50 WHEN 'repair' THEN 70 ELSE r END",
    "first_probe_per_kind": f"WITH {_JUDGED} SELECT user_id, kind, min(event_id) AS event_id FROM judged GROUP BY ALL",
    "triplet_complete": f"WITH {_JUDGED}, h AS (SELECT user_id, list(kind) AS have FROM judged GROUP BY user_id) SELECT user_id, array_to_string(list_filter({S.KINDS}, lambda k: NOT list_contains(have, k)), ',') AS starved FROM h",
    "seen_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "quota_stop": "WITH k AS (SELECT doc_id FROM documents WHERE n_chars >= 300 ORDER BY doc_id LIMIT 100) SELECT count(*) AS n_kept, max(doc_id) AS last_id, (SELECT count(*) FROM documents WHERE doc_id <= (SELECT max(doc_id) FROM k)) AS n_claimed FROM k",
    "first_recording": f"SELECT conv_id, min(turn) AS turn FROM conversations WHERE {_TOKENS} >= 4 GROUP BY conv_id",
    "min_tokens": f"SELECT conv_id, turn, {_TOKENS} AS n_tokens FROM conversations WHERE {_TOKENS} >= 4",
    "row_unpivot": "SELECT doc_id, kind, place, CASE kind WHEN 'repair' THEN source ELSE lang END AS target FROM documents CROSS JOIN (VALUES ('answer', 0), ('repair', 1), ('repeat', 2)) k(kind, place)",
    "preference_pairs": f"WITH {_scored_sql('tree')} SELECT kind, judged AS rejected_type, CASE WHEN {_U('42:hold-out', 'event_id')} < 0.1 THEN 'dev' ELSE 'train' END AS split, count(*) AS n, sum(user_id)::BIGINT AS chosen, round(sum(value), 2) AS rejected FROM scored WHERE score < 1 GROUP BY ALL",
    "hash_draws": f"SELECT doc_id, floor({_U('42:snr', 'doc_id')} * 200) / 10 AS snr_db, CASE WHEN {_U('42:slot', 'doc_id')} < 0.2 THEN 'answer' WHEN {_U('42:slot', 'doc_id')} < 0.6 THEN 'repair' ELSE 'repeat' END AS slot FROM documents",
}
