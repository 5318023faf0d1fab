"""From utterances to rows: feasibility, claims on ids, triplets and pairs, comparison of two builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrase_at
from .select import draw

# Words that may be masked without loss.
MASKABLE = ["the", "a", "an", "is", "for", "to", "please", "can", "you", "me", "my", "of", "in"]
LEAST_TOKENS = 4
MOST_PHRASE_SHARE = 0.5
# End of fixed values.


def norm_tokens(sentence: Column) -> Column:
    """One entry for each word between white space, lower case and bare; entries may be empty, as their places count."""
    words = F.filter(F.split(F.coalesce(sentence, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9']", ""))


def entities(annotation: Column) -> Column:
    """(slot, phrase) of each ``[slot : phrase]``, in lower case."""
    part = lambda i: F.regexp_extract_all(annotation, F.lit(r"\[(.*?) : (.*?)\]"), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("s"), part(2).alias("p")), lambda e: F.struct(F.lower(F.trim(e["s"])).alias("slot"), F.lower(F.trim(e["p"])).alias("phrase")))


def pick(items: Column, purpose: str, *key: Column) -> Column:
    """One entry, drawn by the key; null of none."""
    return F.get(items, F.floor(draw(purpose, *key) * F.size(items)).cast("int"))


def mask_plan(sentence: Column, phrase: Column, *key: Column) -> Column:
    """(start, end, stop): where the phrase stands, and a maskable word outside it; null where either is missing."""
    words = norm_tokens(sentence)
    at = phrase_at(words, norm_tokens(phrase))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.get(words, i).isin(*MASKABLE) & ((i < at["start"]) | (i >= at["end"])))
    stop = pick(places, "42:stop", *key)
    return F.when(at.isNotNull() & stop.isNotNull(), F.struct(at["start"].alias("start"), at["end"].alias("end"), stop.alias("stop")))


def eligible(rows: DataFrame, seen: DataFrame | None, key: str, n_tokens: Column) -> DataFrame:
    """Rows long enough, of ids not seen yet."""
    out = rows.where(n_tokens >= LEAST_TOKENS)
    return out if seen is None else out.join(seen.select(key).distinct(), key, "left_anti")


def claimed(*stages: DataFrame, key: str) -> DataFrame:
    """All ids that earlier stages have claimed."""
    out = stages[0].select(key)
    for more in stages[1:]:
        out = out.unionByName(more.select(key))
    return out.distinct()


def unpivot_kinds(rows: DataFrame, kinds: list[str], shared: list[str]) -> DataFrame:
    """A row for each kind from a struct column a kind, in the order of ``kinds``; ``place`` is that order."""
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("place"), F.col(k).alias("probe")) for i, k in enumerate(kinds)))
    return rows.select(*shared, F.explode(parts).alias("_k")).select(*shared, "_k.kind", "_k.place", "_k.probe.*")


def target_line(target: Column, heard: Column, with_heard: bool) -> Column:
    """What a model is trained to say; with what it heard before it, where there is something to say."""
    if not with_heard:
        return target
    return F.when(target != "", F.concat(F.lit("Heard: "), heard, F.lit("\nReply: "), target)).otherwise(target)


def token_target(target: Column, kind: Column, token: str | None) -> Column:
    """Answers become one token where one is asked for."""
    return target if token is None else F.when(kind == "answer", F.lit(token)).otherwise(target)


def preference_pairs(rows: DataFrame, rollouts: DataFrame, key: str = "id", held_out: float = 0.1) -> DataFrame:
    """chosen (the target) and rejected (the response) for rollouts that scored under 1; a tenth of the ids is held out."""
    bad = rollouts.where("score < 1").select(key, F.col("response").alias("rejected"), F.col("judged").alias("rejected_type"))
    split = F.when(draw("42:hold-out", F.col(key)) < held_out, "dev").otherwise("train")
    return rows.withColumnRenamed("target", "chosen").join(bad, key).withColumn("split", split)


def build_overlap(a: DataFrame, b: DataFrame, keys: list[str], level: str = "snr_db") -> DataFrame:
    """One row: keys in a, in b and in both, and how far levels of the same key spread (of the whole population)."""
    left = a.groupBy(*keys).agg(F.first(level).alias("_a"), F.lit(1).alias("_in_a"))
    right = b.groupBy(*keys).agg(F.first(level).alias("_b"), F.lit(1).alias("_in_b"))
    return left.join(right, keys, "full").agg(F.count("_in_a").alias("n_a"), F.count("_in_b").alias("n_b"), F.count(F.col("_in_a") + F.col("_in_b")).alias("n_both"), F.stddev_pop(F.col("_a") - F.col("_b")).alias("spread"))
