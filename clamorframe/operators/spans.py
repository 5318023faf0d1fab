"""Aligned words at their own grain: a table of words with times, joined to sentences token by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .audio import masked


def token_rows(rows: DataFrame, key: str, sentence: str = "sentence") -> DataFrame:
    """(key, place, token): the sentence's words between white space, from 0."""
    return rows.select(key, F.posexplode(tokens(F.col(sentence))).alias("place", "token"))


def checked(rows: DataFrame, words: DataFrame, key: str, sentence: str = "sentence") -> DataFrame:
    """(key, n_tokens, n_words, reason): why a row's alignment cannot be used; null where it can.

    ``words`` (key, place, start, end) has the aligner's words. ``alignment``: it gave none. ``token-count``: it parted the
    sentence in another way, so places do not fit. ``order``: places are not 0, 1, 2, ..., or times are null, run backwards
    inside a word or from one word to the next.
    """
    w = Window.partitionBy(key).orderBy("place")
    faults = (
        F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end"))
        | (F.col("place") != F.row_number().over(w) - 1) | (F.col("start") < F.coalesce(F.lag("start").over(w), F.col("start")))
    )
    per_row = words.withColumn("_fault", F.coalesce(faults, F.lit(True))).groupBy(key).agg(F.count("*").alias("n_words"), F.max("_fault").alias("_fault"))
    both = rows.select(key, F.size(tokens(F.col(sentence))).cast("long").alias("n_tokens")).join(per_row, key, "left")
    reason = F.when(F.col("n_words").isNull(), "alignment").when(F.col("n_words") != F.col("n_tokens"), "token-count").when(F.col("_fault"), "order")
    return both.select(key, "n_tokens", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), reason.alias("reason"))


def time_spans(ranges: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """``ranges`` (key, first, last, ...) with ``span``: from the start of word ``first`` to the end of the word before ``last``; ranges that hold no word are absent."""
    held = ranges.join(words.select(key, "place", "start", "end"), key).where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("last")))
    span = F.struct(F.min_by("start", "place").alias("start"), F.max_by("end", "place").alias("end"))
    return held.groupBy(*ranges.columns).agg(span.alias("span"))


def mask_variants(rows: DataFrame, words: DataFrame, plan: Column, key: str, sentence: str = "sentence", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(variants, dropped): two signals a row, and (key, reason) of rows that give none.

    ``plan`` is a struct (start, end, stop): the critical words and one that says little, null where there are none. ``answerable``
    has noise over the latter, ``unanswerable`` over the former. Both or neither come out.
    """
    state = checked(rows, words, key, sentence)
    fine = rows.withColumn("_plan", plan).join(state.where("reason is null").select(key), key)
    at = lambda name, a, b: F.struct(F.lit(name).alias("variant"), a.cast("long").alias("first"), b.cast("long").alias("last"))
    p = F.col("_plan")
    both = F.explode(F.array(at("unanswerable", p["start"], p["end"]), at("answerable", p["stop"], p["stop"] + 1)))
    ranges = fine.where(p.isNotNull()).select(key, both.alias("_r")).select(key, "_r.*")
    spans = time_spans(ranges, words, key)
    noisy = masked(rows.join(spans, key).withColumn("_id", F.concat_ws(":", "variant", F.col(key).cast("string"))), "_id", "span", seed).drop("_id")
    whole = noisy.where(F.size("noisy") > 0).withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 2").drop("_n")
    unplanned = fine.where(p.isNull()).select(key, F.lit("no phrase").alias("reason"))
    empty = fine.where(p.isNotNull()).select(key).join(whole.select(key), key, "left_anti").select(key, F.lit("empty span").alias("reason"))
    return whole, state.where("reason is not null").select(key, "reason").unionByName(unplanned).unionByName(empty)
