"""Quotas that count successes along an order, stage after stage, without sorting all rows.

A quota ends at its n-th good row. That row is found by counts: the rows' order is parted into ranges, the good rows of each
range are counted, and only the range that holds the n-th is read again and parted further.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .select import first_of

#: Ranges that are counted in one pass, and good rows in a range from which it is sorted.
RANGES, FEW = 64, 10_000


def nth_good(rows: DataFrame, good: Column, n: int, order: str) -> int | None:
    """The order, a whole number that no two rows share, of the n-th good row; None where there are fewer."""
    part = rows.where(good & F.col(order).isNotNull()).select(F.col(order).cast("long").alias(order))
    if n < 1:
        raise ValueError("a quota is one row at least")
    while True:
        edges = part.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES + 1)], 10_000)).first()[0]
        if edges is None:
            return None
        edges = sorted(set(edges))
        place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(order)))
        counts = dict(part.groupBy(place.alias("range")).agg(F.count("*").alias("n")).collect())  # RANGES rows at most
        at = 0
        while at <= len(edges) and counts.get(at, 0) < n:
            n -= counts.get(at, 0)
            at += 1
        if at > len(edges):
            return None
        if at:
            part = part.where(F.col(order) > edges[at - 1])
        if at < len(edges):
            part = part.where(F.col(order) <= edges[at])
        if counts[at] <= FEW or len(edges) == 1:
            return part.orderBy(order).limit(n).agg(F.max(order)).first()[0]


def up_to(rows: DataFrame, last: int | None, order: str) -> DataFrame:
    """The rows that a quota's search has passed; all of them where it was not filled."""
    return rows if last is None else rows.where(F.col(order) <= last)


def quota(rows: DataFrame, good: Column, n: int, order: str) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` good rows, and all rows up to the last of them. A row whose test is null is not good; rows without an order are never met."""
    good = F.coalesce(good, F.lit(False))
    claimed = up_to(rows.where(F.col(order).isNotNull()), nth_good(rows, good, n, order), order)
    return claimed.where(good), claimed


@dataclass(frozen=True)
class Stage:
    """A stage's candidates, which of them give an output, and how many outputs it wants."""

    name: str
    rows: DataFrame
    good: Column
    wanted: int


def chained(stages: list[Stage], key: str, order: str, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, claimed): the kept rows of all stages with ``stage``, and (key, stage) of each key that a stage claimed.

    A key is claimed at its first candidate, whether that gives an output or not, and no later candidate of it counts, in
    this stage or another; ``seen`` holds keys claimed before. Candidates behind a stage's last output stay free. A
    null key is a key as others.
    """
    kept, claims = [], None if seen is None else seen.select(F.struct(F.col(key)).alias("_key")).distinct()
    taken: list[DataFrame] = []
    for stage in stages:
        fresh = stage.rows.withColumn("_key", F.struct(F.col(key)))  # a struct is never null
        if claims is not None:
            fresh = fresh.join(claims, "_key", "left_anti")
        fresh = cut(first_of(fresh, ["_key"], [order]), "candidates")
        chosen, passed = quota(fresh, stage.good, stage.wanted, order)
        kept.append(chosen.drop("_key").withColumn("stage", F.lit(stage.name)))
        own = cut(passed.select("_key"), "claims")
        taken.append(own.select(f"_key.{key}", F.lit(stage.name).alias("stage")))
        claims = own if claims is None else claims.unionByName(own)
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, taken)


def until(candidates: DataFrame, build: Callable[[DataFrame], DataFrame], wanted: int, order: str, share: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(kept, passed): the first ``wanted`` candidates that a costly ``build`` makes something of, and all built ones up to the last of them.

    ``build`` returns its candidates with ``order`` and ``reason``, null for success. It gets blocks along the order, each with
    ``share`` candidates for every success still missing, or as many as one has taken so far, and no more of them once there are
    enough; so it is asked for little beyond what is kept, and blocks are few where successes are rare. Every block is a table,
    and no row is built twice.
    """
    built: list[DataFrame] = []
    rest, have, tried = candidates.where(F.col(order).isNotNull()), 0, 0
    while have < wanted:
        size = max(1, round((wanted - have) * max(share, tried / max(have, 0.5))))
        last = nth_good(rest, F.lit(True), size, order)
        block = cut(build(up_to(rest, last, order)), "built")
        built.append(block)
        have += block.where(F.col("reason").isNull()).count()
        tried += size
        if last is None:
            break
        rest = rest.where(F.col(order) > last)
    whole = reduce(DataFrame.unionByName, built)
    return quota(whole, F.col("reason").isNull(), wanted, order)
