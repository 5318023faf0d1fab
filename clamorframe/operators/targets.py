"""Targets from a writer's attempts: an ordered fold whose state carries what earlier attempts gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PIECE_STOPWORDS, leaks
from .score import KINDS

# Attempts, and the question asked where only the answer was written.
ATTEMPTS, PAIR_ATTEMPTS = 8, 3
FALLBACK = ("Sorry, I didn't catch the ", " — could you say that part again?")
# End of fixed values.


def _given(x: Column) -> Column:
    """What was written, without white space around; null for nothing."""
    text = F.regexp_replace(x, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    return F.when(text != "", text)


def in_turn(attempts: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """keys and ``_a``, their first ``most`` attempts in order, each with all other columns."""
    rest = [c for c in attempts.columns if c not in (*keys, order)]
    return attempts.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct(order, *rest))), 1, most).alias("_a"))


def carried(attempts: DataFrame, keys: list[str], fields: list[str] = KINDS, order: str = "attempt", most: int = ATTEMPTS) -> DataFrame:
    """keys and the fields as soon as each of them has been written once; keys that never get so far are absent.

    An attempt replaces what it writes and keeps the rest from the attempts before it. Attempts behind the first that
    completes the fields are not read, nor are those beyond ``most``. Null and blank count as not written.
    """
    state = lambda s, x: {f: F.coalesce(_given(x[f]), s[f]) for f in fields}
    none = F.struct(*(F.lit(None).cast("string").alias(f) for f in fields), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        new = state(s, x)
        done = F.lit(True)
        for v in new.values():
            done = done & v.isNotNull()
        return F.when(s["done"], s).otherwise(F.struct(*(v.alias(f) for f, v in new.items()), done.alias("done")))

    folded = in_turn(attempts, keys, order, most).select(*keys, F.aggregate("_a", none, step).alias("_s"))
    return folded.where("_s.done").select(*keys, *(F.col(f"_s.{f}").alias(f) for f in fields))


def answer_and_repair(attempts: DataFrame, keys: list[str], phrase: str, slot: str, order: str = "attempt", most: int = PAIR_ATTEMPTS) -> DataFrame:
    """keys, answer, repair, fell_back: the first attempt whose repair does not tell the masked phrase, with the last answer so far.

    ``phrase`` and ``slot`` are columns of the attempts, the same in each of a key. Where no repair will do, but an answer was
    written, a fixed question names the slot; keys without an answer are absent. A repair counts only beside its own
    attempt's answer being there (not null), as the reply is read in that order.
    """
    rows = attempts.withColumn("_fits", _given(F.col("repair")).isNotNull() & F.col("answer").isNotNull() & ~leaks(F.col("repair"), F.col(phrase), PIECE_STOPWORDS))
    none = F.struct(F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("repair"))

    def step(s: Column, x: Column) -> Column:
        answer = F.coalesce(_given(x["answer"]), s["answer"])
        repair = F.when(F.coalesce(x["_fits"], F.lit(False)) & answer.isNotNull(), _given(x["repair"]))
        return F.when(s["repair"].isNotNull(), s).otherwise(F.struct(answer.alias("answer"), repair.alias("repair")))

    folded = in_turn(rows, keys, order, most).select(*keys, F.get("_a", F.lit(0))[slot].alias("_slot"), F.aggregate("_a", none, step).alias("_s"))
    question = F.concat(F.lit(FALLBACK[0]), F.coalesce("_slot", F.lit("")), F.lit(FALLBACK[1]))
    return folded.where("_s.answer is not null").select(*keys, "_s.answer", F.coalesce("_s.repair", question).alias("repair"), F.col("_s.repair").isNull().alias("fell_back"))
