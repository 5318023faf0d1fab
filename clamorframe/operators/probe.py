"""Probing in rounds: each utterance draws noise for the kinds it still lacks, until it has them all or the rounds end.

A round is a table. Its draws depend on the kinds that the rounds before have left open, its labels decide which are open in
the next, and the number of rounds is bounded, so the loop ends whatever the labels say.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .audio import CLEAN_SHARE, SLOT_SNR, SLOT_SNR_DISJOINT, SLOT_WEIGHTS
from .score import KINDS
from .select import draw

# Rounds, draws a round and draws for each open kind.
ROUNDS = 3
BATCH, ANSWER_BATCH = 16, 4
EACH = 8
# End of fixed values.


def slot(needed: Column, u: Column) -> Column:
    """The kind that ``u`` picks among those needed, by their weights."""
    weight = lambda k: F.when(F.array_contains(needed, k), F.lit(SLOT_WEIGHTS[k])).otherwise(F.lit(0))
    upto = [reduce(lambda a, b: a + b, map(weight, KINDS[: i + 1])) for i in range(len(KINDS))]
    return F.coalesce(*(F.when(u * upto[-1] < s, F.lit(k)) for k, s in zip(KINDS, upto, strict=True)))


def level(kind: Column, u: Column, bands: dict[str, tuple[float, float]]) -> Column:
    """A ratio in the kind's band, to one decimal."""
    lows, highs = (F.create_map(*(F.lit(x) for k, v in bands.items() for x in (k, float(v[i])))) for i in (0, 1))
    low, high = lows[kind], highs[kind]
    return F.round(low + (high - low) * u, 1)


def slot_draws(rows: DataFrame, needed: Column, keys: list[str], disjoint: bool = True, seed: int = 42) -> DataFrame:
    """``rows`` with slot and snr_db, drawn by ``keys``; where bands are disjoint, a quarter of the answers stay clean (null)."""
    of = lambda purpose: draw(f"{seed}:{purpose}", *map(F.col, keys))
    out = rows.withColumn("slot", slot(needed, of("slot")))
    ratio = level(F.col("slot"), of("snr"), SLOT_SNR_DISJOINT if disjoint else SLOT_SNR)
    if disjoint:
        ratio = F.when((F.col("slot") == "answer") & (of("clean") < CLEAN_SHARE), F.lit(None)).otherwise(ratio)
    return out.withColumn("snr_db", ratio)


def n_draws(needed: Column, batch: int = BATCH) -> Column:
    return F.least(F.lit(batch), EACH * F.size(needed))


@dataclass(frozen=True)
class Probing:
    """probes: the kept one of each (key, kind); starved: (key, needed) of those that lack kinds; tried: all draws with their labels."""

    probes: DataFrame
    starved: DataFrame
    tried: DataFrame


def probe_rounds(utterances: DataFrame, key: str, label: Callable[[DataFrame], DataFrame], kinds: list[str] = KINDS, batch: int = BATCH, rounds: int = ROUNDS, disjoint: bool = True, seed: int = 42) -> Probing:
    """Probes for every distinct key of ``utterances``.

    ``label`` gets the draws (key, round, pos, slot, snr_db) and returns them with ``kind`` and what columns it likes; a null
    kind, or a row left out, is no probe. A kind's probe is the first with that label by round and place, whatever slot it was
    drawn for. A null key is dropped.
    """
    still = cut(utterances.select(key).where(F.col(key).isNotNull()).distinct().withColumn("needed", F.array(*map(F.lit, kinds))), "open")
    found, tried = [], []
    for number in range(rounds):
        if number and still.isEmpty():
            break
        each = F.explode(F.sequence(F.lit(0), n_draws(F.col("needed"), batch) - 1)).alias("pos")
        draws = slot_draws(still.select(key, "needed", F.lit(number).alias("round"), each), F.col("needed"), [key, "round", "pos"], disjoint, seed)
        labelled = cut(label(draws.drop("needed")), "labelled")
        tried.append(labelled)
        fits = labelled.join(still, key).where(F.array_contains("needed", F.col("kind"))).drop("needed")
        rest = F.struct(*(c for c in fits.columns if c not in (key, "kind")))
        got = cut(fits.groupBy(key, "kind").agg(F.min_by(rest, "pos").alias("_p")).select(key, "kind", "_p.*"), "filled")
        found.append(got)
        have = got.groupBy(key).agg(F.collect_set("kind").alias("_have"))
        left = F.array_except("needed", F.coalesce("_have", F.array().cast("array<string>")))
        still = cut(still.join(have, key, "left").select(key, left.alias("needed")).where(F.size("needed") > 0), "open")
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return Probing(union(found), still, union(tried))


def probe_reason(needed: Column, kinds: list[str] = KINDS) -> Column:
    """Why an utterance gives nothing: the kinds that starved are named where several were wanted."""
    return F.lit("probe") if len(kinds) == 1 else F.concat(F.lit("probe:"), F.array_join(needed, ","))
