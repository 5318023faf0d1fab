"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is the expected number of times that each of its documents is taken. The
whole part is taken for certain; the fractional part is an inclusion probability. Blocks of a source fly:
three documents at a time, their probabilities move along the null space of the constraints (documents and
tokens) until one is 0 or 1, so both totals stay as they are. A block leaves two documents at most; blocks'
leftovers fly together, until one block of a source lands by the choice nearest to its totals.

What is drawn depends on the documents alone, not on how their file is split: a document's place is a hash of
its doc_id, text and number among rows that are equal in both. Which of such rows has which number does not
show in the result.
"""

from __future__ import annotations

import math
import random
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Documents that fly together, and blocks whose leftovers do.
BLOCK, MERGE = 4_000, 1_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with ``target``; one row a source, so the ordered windows hold no document.

    Sorted by limit over weight, a source stops at its limit when its share of what those before it left is
    no less; what is left over is shared by weight among the others.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    rows = sources.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns({"all": share * F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    stops = F.col("cap") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("all") - F.col("cap_before"))
    rows = rows.withColumn("stops", stops)
    left = F.col("all") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything)
    left_w = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("w"))).over(everything)
    return rows.select("source", "source_size", "docs", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("w") * left / F.when(left_w > 0, left_w).otherwise(1.0)).alias("target"))


def fly(p: list[float], size: list[float], rng: random.Random) -> list[int]:
    """Moves probabilities in place until two are fractional at most; returns which."""
    live: list[int] = []
    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        live.append(k)
        while len(live) >= 2:
            a, b = live[0], live[1]
            if len(live) == 2:
                if size[a] != size[b]:
                    break
                v = (1.0, -1.0)
            else:
                c = live[2]
                v = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
                if not any(v):
                    v = (1.0, -1.0, 0.0)
            up = down = math.inf
            for i, x in zip(live, v, strict=True):
                if x > 0:
                    up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
                elif x < 0:
                    up, down = min(up, -p[i] / x), min(down, -(1 - p[i]) / x)
            move = up if rng.random() * (up + down) < down else -down
            for i, x in zip(live, v, strict=True):
                p[i] += move * x
                if p[i] < 1e-9:
                    p[i] = 0.0
                elif p[i] > 1 - 1e-9:
                    p[i] = 1.0
            live = [i for i in live if 0 < p[i] < 1]
    return live


def land(p: list[float], size: list[float], live: list[int]) -> None:
    """The choice whose tokens, then documents, are nearest to what is expected."""
    if live:
        tokens, docs = sum(p[i] * size[i] for i in live), sum(p[i] for i in live)
        best = min(product((0.0, 1.0), repeat=len(live)), key=lambda c: (abs(sum(x * size[i] for x, i in zip(c, live, strict=True)) - tokens), abs(sum(c) - docs), c))
        for i, x in zip(live, best, strict=True):
            p[i] = x


def _flight(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    number, block, level, last = key
    pdf = pdf.sort_values(["_order", "size", "doc_id"], kind="stable", ignore_index=True)
    p, size = pdf["p"].tolist(), pdf["size"].astype(float).tolist()
    live = fly(p, size, random.Random(f"{number}/{block}/{level}"))
    if last:
        land(p, size, live)
    return pdf.assign(p=p)


#: Rows of one doc_id and text that are numbered together.
RUN = 10_000


def _numbered(sized: DataFrame) -> DataFrame:
    """``sized`` with ``_again``, a number from 0 among rows of one doc_id and text; rows of a very frequent one are numbered in runs."""
    same = ["doc_id", "_digest"]
    often = common.cut(sized.groupBy(*same).agg(F.count("*").alias("_n")).where("_n > 1"), "often")
    rows = common.join_keys(sized, often, same, "left")
    once = rows.where("_n is null").drop("_n").withColumn("_again", F.lit(0).cast("long"))
    dealt = rows.where("_n is not null").withColumn("_run", F.pmod(F.xxhash64("_row"), F.ceil(F.col("_n") / RUN)))
    sizes = dealt.groupBy(*same, "_run").agg(F.count("*").alias("_k"))
    before = sizes.withColumn("_before", F.sum("_k").over(Window.partitionBy(*same).orderBy("_run")) - F.col("_k")).drop("_k")
    within = F.row_number().over(Window.partitionBy(*same, "_run").orderBy("_row")) - 1
    meet = [*(F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same), F.col("r._run") == F.col("b._run")]
    more = dealt.withColumn("_within", within).alias("r").join(before.alias("b"), meet).select("r.*", "b._before").withColumn("_again", F.col("_before") + F.col("_within"))
    return once.unionByName(more.select(*once.columns))


def copies(docs: DataFrame, **rules: object) -> DataFrame:
    """doc_id, _row, size, source_size, target, copies: how often the mix takes each document.

    A null text has size 0; null is a source of its own, the last. Repeated rows are documents of their own.
    All sizes 0 give targets 0 and no copies. An empty table gives an empty result; other columns are not read.
    The same documents give the same numbers however they are split and ordered.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")
    digest = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")), F.col("source").isNull())
    doc = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("size"), digest.alias("_digest")))
    sized = common.cut(doc.select("doc_id", "_row", "source", "size", "_digest"), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = targets(totals, **rules).withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    plan = common.cut(plan, "targets")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = common.join_keys(common.cut(_numbered(sized), "numbered"), plan, ["source"]).withColumn("rate", rate)
    rows = rows.withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rows = rows.withColumn("blocks", F.ceil(F.col("docs") / BLOCK).cast("long")).withColumn("_order", F.xxhash64("doc_id", "_digest", "_again"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("_order"), F.col("blocks"))).withColumn("level", F.lit(0)).withColumn("last", F.col("blocks") == 1)
    names = ["doc_id", "_row", "size", "source_size", "target", "number", "whole", "p", "blocks", "_order", "block", "level", "last"]
    state = rows.select(*names)
    schema = "doc_id long, _row long, size long, source_size long, target double, number int, whole long, p double, blocks long, _order long, block long, level int, last boolean"
    done = []
    while True:
        state = common.cut(state.groupBy("number", "block", "level", "last").applyInPandas(_flight, schema), "flight")
        live = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(state.where(~live))
        if state.where(live).isEmpty():
            break
        fewer = F.ceil(F.col("blocks") / MERGE).cast("long")
        state = state.where(live).withColumn("blocks", fewer).withColumn("block", F.floor(F.col("block") / MERGE)).withColumn("level", F.col("level") + 1).withColumn("last", F.col("blocks") == 1).select(*names)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "_row", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it does."""
    chosen = copies(docs).where("copies > 0").select("_row", "copies")
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return common.wrapped(docs).join(chosen.hint("merge"), "_row").select("doc", again.alias("copy")).select("doc.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))
