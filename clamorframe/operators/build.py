"""From labelled probes to a dataset: which utterances are complete, why others are skipped, and the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import share_of
from .assemble import LEAST_TOKENS, MOST_PHRASE_SHARE, target_line, unpivot_kinds
from .score import KINDS

#: Columns of a dataset's row, in order, with their defaults where a track has none.
ROW = {
    "id": 0, "kind": "", "target": "", "audio": None, "snr_db": None, "asr_transcript": "", "omni_response": "", "lost": [], "classifier_reason": "", "asr_bucket": "",
    "resp_bucket": "", "beam_hypotheses": [], "beam_losses": "", "key_pieces": [], "slurp_id": None, "sentence": "", "source": "babble",
}
_LISTS = ("lost", "beam_hypotheses", "key_pieces")
_TYPES = {"audio": "binary", "snr_db": "double", "slurp_id": "long"}


def first_reason(*tests: tuple[str, Column]) -> Column:
    """The first reason whose test holds; null for a row that is not skipped. A test of null holds not."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in tests))


def starved(have: Column, kinds: list[str] = KINDS) -> Column:
    """Kinds without a probe, in the order of ``kinds``."""
    return F.array_except(F.array(*map(F.lit, kinds)), F.coalesce(have, F.array().cast("array<string>")))


def skip_reason(seen: Column, n_tokens: Column, pieces: Column, have: Column, targets: Column, split: Column) -> Column:
    """Why an utterance gives no rows: met before or short, no pieces, kinds without a probe, or in training a target that is empty."""
    missing = starved(have)
    return F.coalesce(
        first_reason(("seen/short", F.coalesce(seen, F.lit(False)) | (n_tokens < LEAST_TOKENS)), ("pieces", F.size(pieces) <= 0)),
        F.when(F.size(missing) > 0, F.concat(F.lit("probe:"), F.array_join(missing, ","))),
        F.when((split != "test") & ~targets_written(targets), F.lit("targets")),
    )


def targets_written(targets: Column) -> Column:
    """Whether all targets of a triplet are there and not empty."""
    return (F.size(targets) == len(KINDS)) & F.forall(targets, lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))


def gated_target(target: Column, split: Column) -> Column:
    """Test rows carry no target."""
    return F.when(split == "test", F.lit("")).otherwise(F.coalesce(target, F.lit("")))


def reasons(rows: DataFrame, reason: str = "reason", split: str = "split") -> DataFrame:
    """How many utterances of each split were skipped, and why."""
    return rows.where(F.col(reason).isNotNull()).groupBy(split, reason).agg(F.count("*").alias("n"))


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "kind").agg(F.count("*").alias("n"))


def critical(phrase: Column, sentence: Column) -> Column:
    """Whether a phrase is no more than half of its sentence, so that the rest can still be understood."""
    return share_of(phrase, sentence) <= MOST_PHRASE_SHARE


def dataset_rows(rows: DataFrame, with_heard: bool = False) -> DataFrame:
    """The 17 columns in order: what ``rows`` lack is empty, and a target may tell first what was heard."""

    def column(name: str, default: object) -> Column:
        if name in rows.columns:
            return F.col(name)
        if name in _LISTS:
            return F.array().cast("array<string>")
        return F.lit(default).cast(_TYPES.get(name, "string"))

    out = rows.withColumn("target", target_line(F.coalesce("target", F.lit("")), F.coalesce(column("asr_transcript", ""), F.lit("")), with_heard))
    rows = out
    return out.select(*(column(n, d).alias(n) for n, d in ROW.items()), *([F.col("split")] if "split" in out.columns else []))


def triplet_rows(utterances: DataFrame, shared: list[str]) -> DataFrame:
    """Three rows an utterance, from a struct column for each kind."""
    return unpivot_kinds(utterances, KINDS, shared)


def pair_rows(utterances: DataFrame, shared: list[str]) -> DataFrame:
    """An answer and a repair of each utterance, from the struct columns ``answer`` and ``repair``."""
    return unpivot_kinds(utterances, ["answer", "repair"], shared)


def stacked(*parts: DataFrame) -> DataFrame:
    """Rows of several builds of one split, repeats included; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_probes(probes: DataFrame, utterance: str = "slurp_id", order: tuple[str, ...] = ("round", "pos")) -> DataFrame:
    """Each utterance's first probe of each kind, by round and place in it; probes without a label do not count."""
    names = [c for c in probes.columns if c not in (utterance, "kind")]
    whole = F.struct(*names)
    return probes.where("kind is not null").groupBy(utterance, "kind").agg(F.min_by(whole, F.struct(*order)).alias("_p")).select(utterance, "kind", "_p.*")
