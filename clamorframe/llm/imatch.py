"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

The lexicon is the terms whose inverse document frequency lies in a band: rarer ones are typing errors and
names, more frequent ones say little. Its size does not grow with the corpus, as a term in it is in a fixed share
of all documents at least; so it is sent to all tasks, which find each text's terms without a shuffle. The first
signature is the hash of a text's distinct lexicon terms, sorted. Each further one comes from a random lexicon:
its subsets, each half of the one before, are nested, and the signature is the hash of the sorted terms in the
smallest of them that holds any of the text's, so that short and long texts have signatures from few terms alike.
The likeness of two fingerprints is the share of equal signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Natural logarithm of documents by documents that hold the term: from, to.
BAND = (3.0, 7.0)
#: Random lexicons.
LEXICONS = 16
#: Lexicon terms that are broadcast at most; by the band's end there are no more than 1,100 times the mean number of
#: distinct terms of a text, usually far fewer. A larger lexicon is joined by a shuffle.
BROADCAST_TERMS = 2_000_000

WHITE = r"[ \t\n\x0B\f\r]+"
_PART = 1 << 33


def _terms(text: Column) -> Column:
    """The empty string, then the distinct words in lower case."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(text), WHITE)))


def lexicon(texts: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(h): hashes of the terms within the band, over all rows (text), and of the empty string, which stands for each text itself."""
    n = texts.count()
    low, high = n * math.exp(-band[1]), n * math.exp(-band[0])
    terms = texts.select(F.explode(_terms(F.col("text"))).alias("t")).where("t <> ''").select(F.xxhash64("t").alias("h"))
    df = terms.groupBy("h").agg(F.count("*").alias("df")).where((F.col("df") >= low) & (F.col("df") <= high)).select("h")
    return common.cut(df.unionByName(texts.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("h"))), "lexicon")


def _lowest_bit(x: Column) -> Column:
    """Of a hash under half of the lexicon 1, of a quarter 2, of an eighth 4, and so on."""
    x = x.bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))
    return x.bitwiseAND(-x)


def _rank(term: Column, lexicon_number: int) -> Column:
    return _lowest_bit(F.xxhash64(term, F.lit(lexicon_number)))


def signatures(terms: Column, deepest: list[Column], text_hash: Column) -> list[Column]:
    """From the sorted hashes of a text's lexicon terms and their highest rank in each lexicon; a text without any has the hash of its whole text."""
    fold = lambda x: F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))
    highest = lambda k, d: F.filter(terms, lambda x: _rank(x, k) == d)
    subsets = [highest(k, d) for k, d in enumerate(deepest)]
    return [F.when(F.size(terms) > 0, fold(x)).otherwise(fold(text_hash)) for x in (terms, *subsets)]


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures of two lists of them."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return equal / F.lit(float(LEXICONS + 1))


def in_turn(rows: DataFrame) -> DataFrame:
    """_row, doc_id, n, next: each of the rows (_row, doc_id, n, h) and the _row of the one behind it by falling doc_id, null last; the first follows the last.

    Equal doc_ids are in the order of the text's hash. Places are counted within the sorted partitions, and partitions are counted up.
    """
    order = [F.desc_nulls_last("doc_id"), "h", "n", "_row"]
    sorted_rows = common.cut(rows.orderBy(*order).select("_row", "doc_id", "n", F.monotonically_increasing_id().alias("at")), "sorted")
    part = F.floor(F.col("at") / _PART)
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row a partition
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy()).alias("all"))
    sizes = F.broadcast(common.cut(sizes, "sizes"))
    place = F.col("before") + F.col("at") % _PART
    placed = sorted_rows.join(sizes, part == sizes["part"]).select("_row", "doc_id", "n", place.alias("place"), ((place + 1) % F.col("all")).alias("behind"))
    placed = common.cut(placed, "placed")
    behind = placed.select(F.col("place").alias("behind"), F.col("_row").alias("next"))
    return placed.join(behind.hint("merge"), "behind").select("_row", "doc_id", "n", "next")


def _edited(texts: DataFrame, turn: DataFrame) -> DataFrame:
    """_row, doc_id, n, text, edited: the last half of each text's code points replaced by the first as many of the next one."""
    keys = turn.select("_row", "doc_id", "n")
    asked = turn.select(F.col("next").alias("_row"), F.col("_row").alias("to"), F.floor(F.col("n") / 2).cast("int").alias("k"))
    # both joins read one shuffle of the texts
    lent = texts.join(asked.hint("merge"), "_row").select(F.col("to").alias("_row"), F.left("text", "k").alias("lent"))
    own = texts.join(keys.hint("merge"), "_row")
    half = F.left("text", (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    return own.join(lent.hint("merge"), "_row").select("_row", "doc_id", "n", "text", F.concat(half, "lent").alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty; texts without lexicon terms, empty ones among them, are told apart by their whole text.
    Repeated rows are documents of their own and have equal fingerprints. A null doc_id comes behind all others. Of
    a single row the next document is itself. An empty table gives an empty result; other columns are not read.
    """
    texts = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    words = lexicon(texts)
    turn = common.cut(in_turn(texts.select("_row", "doc_id", F.length("text").cast("long").alias("n"), F.xxhash64("text").alias("h"))), "turn")
    common.release_shuffles(docs.sparkSession)
    both = _edited(texts.select("_row", "text"), turn).withColumn("sha", F.sha2("edited", 256))
    info = F.struct("doc_id", "n", "sha")
    each = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    each = both.select("_row", info.alias("info"), each.alias("x")).select("_row", "info", "x.kind", F.xxhash64("x.t").alias("whole"), F.posexplode(_terms(F.col("x.t"))).alias("pos", "term"))
    whole = F.when(F.col("pos") == 0, F.struct("info", "whole")).alias("whole")  # in the first row of each text alone
    each = each.select("_row", "kind", F.when(F.col("pos") == 0, F.xxhash64(F.lit(""))).otherwise(F.xxhash64("term")).alias("h"), (F.col("pos") > 0).alias("is_term"), whole)
    each = each.where("h <> xxhash64('') or not is_term")
    known = each.join(F.broadcast(words) if words.count() <= BROADCAST_TERMS else words.hint("merge"), "h")
    term = F.when(F.col("is_term"), F.col("h"))
    deepest = [F.max(F.when(F.col("is_term"), _rank(F.col("h"), k))).alias(f"d{k}") for k in range(LEXICONS)]
    lists = known.groupBy("_row", "kind").agg(F.sort_array(F.collect_list(term)).alias("terms"), F.first("whole", ignorenulls=True).alias("whole"), *deepest)
    signed = F.array(*signatures(F.col("terms"), [F.col(f"d{k}") for k in range(LEXICONS)], F.col("whole.whole")))
    signed = lists.select("_row", "kind", "whole.info", signed.alias("s"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("s")))
    prints = common.cut(signed.groupBy("_row").agg(F.first("info").alias("info"), of(0).alias("s"), of(1).alias("e")), "prints")
    behind = prints.select(F.col("_row").alias("next"), F.col("s").alias("s_next"))
    out = prints.join(turn.select("_row", "next").hint("merge"), "_row").join(behind.hint("merge"), "next")
    text = lambda s: F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return out.select(
        "info.doc_id", F.col("info.n").alias("n_chars"), F.col("info.sha").alias("edited_sha256"), text(F.col("s")).alias("fingerprint"), text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("s_next")).alias("near_next"),
    )


def op12_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))
