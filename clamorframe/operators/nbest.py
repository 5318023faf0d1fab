"""How much of a command the first n of its hypotheses recover together, for every n, in built-in functions.

All pairs of a row's hypotheses are compared, so the work is quadratic in their number in a row; pairs are dealt out by blocks
of hypotheses, so that a row with many does not fall to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PIECE_STOPWORDS, WAKE_WORDS, character, fold, normalize, tokens, word_list
from ..sources.scratch import cut

#: Earlier hypotheses of a row that its later ones meet in one group.
BLOCK = 64


def coded(hyps: DataFrame, key: str = "_row") -> DataFrame:
    """(key, _n, _code, _size) of (key, _n, _words): the word list as a string with a character for each of the key's words, and its length.

    There are characters for 1,111,808 words of a key; with more the query fails.
    """
    each = hyps.select(key, "_n", F.posexplode_outer("_words").alias("_place", "_word"))
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("_word"))
    inside = each.select(key, "_n", F.struct("_place", F.when(F.col("_word").isNotNull(), character(number)).alias("c")).alias("_c"))
    code = F.array_join(F.transform(F.sort_array(F.collect_list("_c")), lambda x: x["c"]), "")
    return inside.groupBy(key, "_n").agg(code.alias("_code"), F.count("_c.c").alias("_size"))


def pair_distances(codes: DataFrame, key: str = "_row") -> DataFrame:
    """(key, _n, _apart): the sum of a word list's distances to those before it, each over the longer one's length; the first has none."""
    block = lambda n: F.floor(n / BLOCK)
    own = codes.where("_n > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("_n") - 1))))
    before = codes.select(key, block(F.col("_n")).alias("_block"), F.col("_n").alias("_m"), F.col("_code").alias("_other"), F.col("_size").alias("_long"))
    pairs = own.join(before, [key, "_block"]).where("_m < _n")
    return pairs.groupBy(key, "_n").agg(F.sum(F.levenshtein("_other", "_code") / F.greatest("_size", "_long", F.lit(1))).alias("_apart"))


def prefix_scores(rows: DataFrame, sentence: str = "sentence", hyps: str = "hyps") -> DataFrame:
    """A row for each row and n: uniq, pair_wer, h1, any, two (shares of content words, repeats counted), recovered.

    Rows without hypotheses or without a content word give none.
    """
    words = lambda c: fold(tokens(normalize(c)))
    skipped = word_list([*PIECE_STOPWORDS, *WAKE_WORDS])
    step = rows.withColumns({"_hyps": F.transform(F.coalesce(hyps, F.array().cast("array<string>")), words), "_content": F.filter(words(F.col(sentence)), lambda w: ~F.array_contains(skipped, w))})
    step = cut(step.withColumn("_row", F.monotonically_increasing_id()), "hypotheses").where((F.size("_hyps") > 0) & (F.size("_content") > 0))
    codes = cut(coded(step.select("_row", F.posexplode("_hyps").alias("_n", "_words"))), "codes")
    first = F.row_number().over(Window.partitionBy("_row", "_code").orderBy("_n")) == 1
    upto = Window.partitionBy("_row").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = codes.select("_row", "_n", first.cast("int").alias("_new")).join(pair_distances(codes), ["_row", "_n"], "left")
    each = each.select("_row", (F.col("_n") + 1).alias("n_best"), F.sum("_new").over(upto).cast("int").alias("uniq"), F.sum(F.coalesce("_apart", F.lit(0.0))).over(upto).alias("_total"))

    # of each content word the first two places, from 1, of the hypotheses that have it
    heard = lambda w: F.filter(F.transform("_hyps", lambda h, i: F.when(F.array_contains(h, w), i + 1)), lambda i: i.isNotNull())
    at = F.transform("_content", lambda w: F.struct(w.alias("w"), F.slice(heard(w), 1, 2).alias("p")))
    places = cut(step.select(*rows.columns, "_row", at.alias("_at")), "places")
    k, n = F.col("n_best"), F.size("_at")
    within = lambda x, j: F.coalesce(F.get(x["p"], F.lit(j)) <= k, F.lit(False))
    share = lambda test: F.size(F.filter("_at", test)) / n
    saved = F.filter("_at", lambda x: within(x, 0) & (F.get(x["p"], F.lit(0)) > 1))
    return places.join(each, "_row").select(
        *rows.columns, "n_best", "uniq",
        F.coalesce(F.try_divide(2 * F.col("_total"), (k * (k - 1)).cast("double")), F.lit(0.0)).alias("pair_wer"),
        share(lambda x: F.coalesce(F.get(x["p"], F.lit(0)) == 1, F.lit(False))).alias("h1"), share(lambda x: within(x, 0)).alias("any"), share(lambda x: within(x, 1)).alias("two"), F.transform(saved, lambda x: x["w"]).alias("recovered"),
    )


def sweep(scores: DataFrame, band: str = "band") -> DataFrame:
    """Means by n and band; gain is what later hypotheses add to the first."""
    return scores.groupBy("n_best", band).agg(
        F.count("*").alias("n"),
        F.avg("uniq").alias("uniq"),
        F.avg("pair_wer").alias("pair_wer"),
        F.avg("h1").alias("h1_recall"),
        F.avg("any").alias("any_hyp_recall"),
        F.avg("two").alias("two_hyp_recall"),
        (F.avg("any") - F.avg("h1")).alias("gain"),
        F.avg((F.size("recovered") > 0).cast("int")).alias("rows_recovered"),
    )
