"""The corpus pipeline: each stage calls one corpus operator and takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clamorframe.llm import common, exact_dedup, mixing, packing, quality, simhash


#: Scratch tables of the stage before, for each input: its rows have been written when the next stage begins.
_scratch: dict[str, list] = {}


def stage(function):
    """A stage that first drops the scratch tables of the stage before."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_tables(_scratch.pop(sf_dir, []))
        common.release_shuffles(spark)
        out, made = common.cuts_made(lambda: function(spark, docs, sf_dir))
        _scratch[sf_dir] = made
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in fives and a similarity of 0.8, as near-duplicate stages take them."""
    return simhash.keep_one_of_each(docs, shingle=5, similarity=0.8)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Packing, mixing and SimHash are not expressible in SQL; a test holds each stage against plain Python on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = common.documents(spark, sf_dir)
    for at, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = common.cut(docs, "stage")
    return docs
