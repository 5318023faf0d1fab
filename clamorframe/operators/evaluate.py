"""Evaluation of a model from tables: rows, the model's responses and the judges' replies, to samples and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import judge as J
from ..functions.text import heard_reply
from ..sources.provider import request_key
from . import score as S


def _line(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(text, F.lit("")), F.lit("\n"))


def shown_row(sentence: Column, reply: Column, kind: Column, lost: Column, per_kind: bool) -> Column:
    """What a judge is shown, a line each: the command, the lost piece where a repair is judged by its own rubric, and the reply."""
    piece = F.when(F.lit(per_kind) & (kind == "repair"), _line("LOST PIECE", J.shown(lost))).otherwise("")
    return F.concat(_line("COMMAND", sentence), F.coalesce(piece, F.lit("")), _line("REPLY", reply))


def shown_target(sentence: Column, reply: Column, lost: Column) -> Column:
    """What the second judge is shown, who tells whether a repair asks for what was lost."""
    return F.concat(_line("COMMAND", sentence), _line("LOST PIECE", J.shown(lost)), _line("REPLY", reply))


def second_requests(rows: DataFrame, matrix: str, system: str, sentence: str = "sentence", reply: str = "reply") -> DataFrame:
    """``rows`` that the second judge is to see, with request_key and user, from the first judge's reply ``judged``."""
    asks = J.needs_second_look(F.col("kind"), J.judged_type(F.col("judged"))["type"], F.col("lost"), matrix)
    user = shown_target(F.col(sentence), F.col(reply), F.col("lost"))
    return rows.where(asks).withColumn("user", user).withColumn("request_key", request_key(F.lit(system), F.col("user")))


def rubric(kind: Column, per_kind: bool) -> Column:
    """The name of the rubric that a row is judged by: its kind's own, or the one that tells types apart."""
    return F.concat(F.lit("judge-"), kind) if per_kind else F.lit("judge-type")


def split_responses(rows: DataFrame, with_heard: bool) -> DataFrame:
    """``rows`` with heard, reply and heard_failed; without a heard part the whole response is the reply."""
    if not with_heard:
        return rows.withColumns({"heard": F.lit(""), "reply": F.col("response"), "heard_failed": F.lit(False)})
    parts = heard_reply(F.coalesce("response", F.lit("")))
    return rows.withColumn("_parts", parts).select("*", "_parts.heard", "_parts.reply", (F.col("_parts.heard") == "").alias("heard_failed")).drop("_parts")


def by_type(rows: DataFrame, second: DataFrame, matrix: str, key: str = "id") -> DataFrame:
    """judged_type, judge_failed, unanswered and score from ``judged`` (the first judge's reply); ``second`` (key, answer) is asked only where it matters.

    A row without a reply of the first judge, or of the second where that was to see it, is an error row: unanswered, its
    type and score null. A reply that cannot be read is ``bad``, and judge_failed.
    """
    first = rows.withColumn("_first", J.judged_type(F.col("judged")))
    asks = F.coalesce(J.needs_second_look(F.col("kind"), F.col("_first.type"), F.col("lost"), matrix), F.lit(False))
    answers = second.where("answer is not null").groupBy(key).agg(F.min("answer").alias("_answer"))
    both = first.withColumn("_asks", asks).join(answers, key, "left").withColumn("_second", J.judged_type(F.col("_answer")))
    answered = F.col("judged").isNotNull() & (~F.col("_asks") | F.col("_answer").isNotNull())
    said = F.when(F.col("_asks"), F.col("_second")).otherwise(F.col("_first"))
    out = both.withColumns({"judged_type": F.when(answered, said["type"]), "judge_failed": answered & said["failed"], "unanswered": ~answered})
    return out.withColumn("score", S.score_of(F.col("kind"), F.col("judged_type"), matrix)).drop("_first", "_second", "_asks", "_answer")


def by_kind(rows: DataFrame) -> DataFrame:
    """score, judge_failed and unanswered from ``judged``, a per-kind judge's reply; there is no type. A row without a reply has no score."""
    found = rows.withColumn("_s", J.judged_score(F.col("judged")))
    there = F.col("judged").isNotNull()
    return found.select("*", F.lit(None).cast("string").alias("judged_type"), (there & F.col("_s.failed")).alias("judge_failed"), (~there).alias("unanswered"), F.when(there, F.col("_s.score")).alias("score")).drop("_s")


def summary(samples: DataFrame, kinds: list[str] = S.KINDS) -> DataFrame:
    """One row: C, R and F (null for a kind not asked for, 0 for one without scores), EAR over those asked for, and counts.

    Means are over rows with a score; unanswered and unscored count those that have none, and why: no reply, or a type that the
    matrix has no score for.
    """
    mean = lambda k: F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)) if k in kinds else F.lit(None).cast("double")
    names = dict(zip(S.KINDS, ("C", "R", "F"), strict=True))
    count = [F.count_if(F.col("kind") == k).alias(f"{k}_rows") for k in S.KINDS]
    out = samples.agg(*(mean(k).alias(n) for k, n in names.items()), *count, F.count_if("heard_failed").alias("heard_parse_failures"), F.count_if("judge_failed").alias("judge_parse_failures"),
                      F.count_if("unanswered").alias("unanswered_rows"), F.count_if(F.col("score").isNull() & ~F.col("unanswered")).alias("unscored_rows"))
    return out.withColumn("EAR", S.harmonic(*(F.col(names[k]) for k in kinds)))


def _counted(samples: DataFrame, label: Column, name: str) -> DataFrame:
    """One row: a map from label to count, in the order of labels; empty without any. Labels are a grid's cells."""
    each = samples.select(label.alias("_l")).where("_l is not null").groupBy("_l").agg(F.count("*").alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct("_l", "_n")))
    return each.agg(F.map_from_entries(entries).alias(name))


def record(samples: DataFrame, kinds: list[str] = S.KINDS, per_kind: bool = False, **told: str) -> DataFrame:
    """The summary line of a run: ``summary`` with what was ``told`` of it (model, judge, matrix), the kinds, and counts ``kind->type``, or ``kind@score`` where each kind had its own judge; the other map is there and empty."""
    pair = F.concat_ws("->", "kind", F.col("judged_type"))
    types = _counted(samples, F.when(F.col("judged_type").isNotNull() & F.lit(not per_kind), pair), "confusion")
    scores = _counted(samples, F.when(F.col("score").isNotNull() & F.lit(per_kind), F.concat(F.col("kind"), F.lit("@"), F.regexp_replace(F.format_string("%.6f", F.col("score").cast("double")), r"\.?0+$", ""))), "score_hist")
    out = summary(samples, kinds).withColumns({"type": F.lit("summary"), "kinds": F.array(*map(F.lit, kinds)), **{k: F.lit(v) for k, v in told.items()}})
    return out.crossJoin(types).crossJoin(scores)  # one row each
