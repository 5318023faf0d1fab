"""A whole build: utterances in order, probed in rounds, labelled, given targets, until each stage has the rows that it wants.

Stages share one set of claimed ids: test triplets, training triplets, then answers alone from what is left. A stage's labels and
targets come from functions of tables, which may call models (``sources.client``) or join stored replies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.label import first_target
from ..functions.text import tokens
from ..operators import build as B
from ..operators import probe
from ..operators.assemble import LEAST_TOKENS, unpivot_kinds
from ..operators.places import placed
from ..operators.quota import until
from ..operators.score import KINDS
from ..operators.select import first_of
from ..sources.scratch import cut

#: From draws (key, round, pos, slot, snr_db) to draws with their kind and, as they are there, lost, transcripts and reasons.
Label = Callable[[DataFrame], DataFrame]
#: From probes (key, kind, ..., sentence) to (key, kind, tries): what a writer wrote, in order.
Write = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    """What one stage builds: from which utterances, for which split, how many, of which kinds, drawn in which batches."""

    name: str
    utterances: DataFrame
    split: str
    wanted: int
    label: Label
    write: Write | None = None
    kinds: list[str] = field(default_factory=lambda: list(KINDS))
    batch: int = probe.BATCH


def built(block: DataFrame, stage: Stage, key: str, order: str) -> DataFrame:
    """(key, order, sentence, reason, a struct for each kind): one row an utterance; ``reason`` is null where all kinds, and in training their targets, are there."""
    block = cut(block.select(key, order, "sentence"), "block")
    probes = probe.probe_rounds(block, key, stage.label, stage.kinds, stage.batch).probes
    if stage.split == "test" or stage.write is None:
        probes = probes.withColumn("target", F.lit(""))
    else:
        probes = cut(probes, "probes")
        tries = stage.write(probes.join(block.select(key, "sentence"), key)).select(key, "kind", "tries")
        lost = F.coalesce(F.get("lost", F.lit(0)), F.lit("")) if "lost" in probes.columns else F.lit("")
        probes = probes.join(tries, [key, "kind"], "left").withColumn("target", F.coalesce(first_target(F.col("tries"), F.col("kind"), lost), F.lit(""))).drop("tries")
    whole = F.struct(*(c for c in probes.columns if c not in (key, "kind")))
    own = probes.groupBy(key).agg(*(F.first(F.when(F.col("kind") == k, whole), ignorenulls=True).alias(k) for k in stage.kinds))
    out = block.join(own, key, "left")
    starved = F.array_compact(F.array(*(F.when(F.col(k).isNull(), F.lit(k)) for k in stage.kinds)))
    unwritten = reduce(lambda a, b: a | b, (F.col(f"{k}.target") == "" for k in stage.kinds)) if stage.split != "test" and stage.write else F.lit(False)
    return out.withColumn("reason", F.when(F.size(starved) > 0, probe.probe_reason(starved, stage.kinds)).when(unwritten, "targets"))


def run(stages: list[Stage], key: str, order: str, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, reasons): the 17 columns and ``split`` of all stages' rows, ids from 1 on, and how many utterances each stage passed over and why.

    An utterance is a candidate at its first recording of four words or more; its id is claimed there, whatever comes of it.
    Ids are in the order of stages, within a stage in that of ``order``, and within an utterance in that of kinds.
    """
    claimed = None if seen is None else seen.select(key).distinct()
    rows, passed_over = [], []
    for number, stage in enumerate(stages):
        long_enough = F.size(tokens(F.col("sentence"))) >= LEAST_TOKENS
        fresh = stage.utterances.where(long_enough & F.col(key).isNotNull())
        if claimed is not None:
            fresh = fresh.join(claimed, key, "left_anti")
        fresh = cut(first_of(fresh, [key], [order]), "candidates")
        kept, passed = until(fresh, lambda block, stage=stage: built(block, stage, key, order), stage.wanted, order)
        own = cut(passed.select(key, order, "reason"), "passed")
        last = own.agg(F.max(order)).first()[0]
        skipped = stage.utterances.join(own.select(key, order), [key, order], "left_anti")
        skipped = skipped if last is None else skipped.where(F.col(order) <= last)
        why = own.where("reason is not null").select("reason").unionByName(skipped.select(F.lit("seen/short").alias("reason")))
        passed_over.append(why.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(stage.name).alias("stage"), "reason", "n"))
        each = unpivot_kinds(kept.withColumn("slurp_id", F.col(key)), stage.kinds, ["slurp_id", order, "sentence"])
        rows.append(each.withColumns({"split": F.lit(stage.split), "_stage": F.lit(number)}))
        claimed = own.select(key) if claimed is None else claimed.unionByName(own.select(key))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    numbered = placed(whole, ["_stage", order, "place"], "id").withColumn("id", F.col("id") + 1)
    if "reason" in numbered.columns:
        numbered = numbered.withColumnRenamed("reason", "classifier_reason")
    return B.dataset_rows(numbered), reduce(DataFrame.unionByName, passed_over)
