"""Quality rules with thresholds from mergeable quantile sketches, in DataFrame functions only.

Two measures are shares of a text: its symbols and its capitals. Two are what a text has beyond its group's own rate:
the root of its count of repeated words, or lines, less the root of the count that the rate of its language and source
would give a text of its length. A sketch is the number of documents in each bucket of a measure. Buckets add up, so
sketches of sources merge to one of their language and to one of the corpus, in any order and with the same result, and
a quantile is right within the bucket width. A source's sketch in a language is completed by its language's as if PRIOR
more documents had been seen there, and the language's by the corpus's in the same way: few documents lean on the larger
sketch, many on their own, without a step between. Rates are completed likewise. Thresholds are then joined to the
documents. Counts are kept in thousandths of documents as whole numbers, so that sums
do not depend on the order of adding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Buckets of a share's sketch, steps of its root; and of an excess, steps of one.
STEPS, FINE = 200, 20
#: A share fails above the third quartile by so many interquartile ranges, and by so many mean deviations from the
#: median, which are not zero where most documents measure zero.
REACH, DEVIATIONS = 6, 3
#: An excess fails above so many times the excess that so many tenths of the documents with any stay within.
TIMES, TENTHS = 2, 9
SHARES = {"symbols": ("n_symbols", "word_chars"), "capitals": ("_capitals", "word_chars")}
EXCESSES = {"repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "_n_lines")}
MEASURES = (*SHARES, *EXCESSES)
#: Documents that the next larger sketch counts as in a smaller one.
PRIOR = 200

WHITE = r"[ \t\n\x0B\f\r]+"


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the base rules. Windows are compared by two hashes of their words, 96 bits."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    step = docs.withColumn("_words", F.filter(F.split(t, WHITE), lambda x: x != "")).withColumn("_lines", lines)
    step = step.withColumns({"n_words": F.size("_words").cast("long"), "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"), "_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long")})
    step = step.withColumns({"word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_n_lines": F.size("_lines")})
    w = F.col("_words")
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), F.hash(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))
    spans = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))
    step = step.withColumn("_windows", F.coalesce(spans, F.array().cast("array<struct<h:bigint,g:int,i:int>>")))
    single = F.size(F.array_distinct(F.transform("_windows", lambda x: x["h"]))) == F.size("_windows")
    step = step.withColumn("_sorted", F.when(~single, F.array_sort("_windows"))).drop("_words", "_lines", "_windows")
    s = F.col("_sorted")
    same = lambda x, k: (F.get(s, k)["h"] == x["h"]) & (F.get(s, k)["g"] == x["g"])
    again = F.filter(s, lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | ((k > 0) & F.coalesce(same(x, k - 1), F.lit(False))))
    step = step.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_sorted")
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")
    return step.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def buckets() -> dict[str, Column]:
    """Each measure's bucket: of a share x the floor of STEPS times its root, of an excess the floor of FINE times it."""
    share = lambda n, of: F.floor(STEPS * F.sqrt(F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0)))).cast("long")
    excess = lambda m, n, of: F.floor(FINE * F.greatest(F.lit(0.0), F.sqrt(n) - F.sqrt(F.coalesce(f"rate_{m}", F.lit(0.0)) * F.col(of)))).cast("long")
    return {m: share(*x) for m, x in SHARES.items()} | {m: excess(m, *x) for m, x in EXCESSES.items()}


def rates(rows: DataFrame) -> DataFrame:
    """(lang, source, rate_...): counts by units over documents that pass the base rules, PRIOR documents of the language's mean counted in."""
    columns = [c for x in EXCESSES.values() for c in x]
    totals = lambda keys: rows.where("not base_failed").groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in columns))
    own = totals(["lang", "source"])
    larger = totals(["lang"]).select(F.col("lang").alias("lang__l"), *(F.col(c).cast("double").alias(f"{c}__l") for c in ("n", *columns)))
    both = own.join(larger, own["lang"].eqNullSafe(larger["lang__l"]))
    whole = lambda c: F.col(c).cast("double") * F.col("n__l") + PRIOR * F.col(f"{c}__l")
    return both.select("lang", "source", *((whole(n) / whole(of)).alias(f"rate_{m}") for m, (n, of) in EXCESSES.items()))


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over documents, with their rates, that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), b.alias("bucket")) for m, b in buckets().items())))
    return rows.where("not base_failed").select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def completed(sketches: DataFrame, keys: list[str], larger: DataFrame, on: list[str]) -> DataFrame:
    """(keys, measure, bucket, w): the sketches' documents in thousandths, and PRIOR more, dealt as in the larger sketch (on, measure, bucket, w)."""
    whole = larger.withColumn("whole", F.sum("w").over(Window.partitionBy(*on, "measure")))
    lent_w = F.expr(f"{PRIOR * 1000}L * w div whole")  # whole numbers, for up to 4e10 documents
    share = whole.select(*(F.col(k).alias(f"{k}__l") for k in on), F.col("measure").alias("m__l"), "bucket", lent_w.alias("w"))
    mine = sketches.select(*keys, "measure").distinct()
    same = [mine[k].eqNullSafe(share[f"{k}__l"]) for k in on] + [mine["measure"] == share["m__l"]]
    lent = mine.join(share, same).select(*keys, "measure", "bucket", "w")
    own = sketches.select(*keys, "measure", "bucket", (1000 * F.col("n")).alias("w"))
    return own.unionByName(lent).groupBy(*keys, "measure", "bucket").agg(F.sum("w").alias("w")).where("w > 0")


def limits(weights: DataFrame, keys: list[str]) -> DataFrame:
    """For each value of ``keys`` a threshold for each measure: of a share in squared buckets, which are shares again, of an excess in buckets."""
    w = Window.partitionBy(*keys, "measure")
    upto = {"upto": F.sum("w").over(w.orderBy("bucket")), "all": F.sum("w").over(w)}
    share = weights.where(F.col("measure").isin(*SHARES)).withColumns(upto).withColumn("x", F.col("bucket") * F.col("bucket"))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("x")))
    off = share.withColumn("off", (F.col("w") * F.abs(F.col("x") - at(2).over(w))).cast("decimal(38,0)"))
    quartiles = off.groupBy(*keys, "measure").agg(at(1).alias("q1"), at(3).alias("q3"), F.sum("off").cast("double").alias("off"), F.max("all").cast("double").alias("all"))
    high = F.col("q3") + F.greatest((REACH * (F.col("q3") - F.col("q1"))).cast("double"), DEVIATIONS * (F.col("off") / F.col("all")))
    tail = weights.where(F.col("measure").isin(*EXCESSES) & (F.col("bucket") > 0)).withColumns(upto)
    tail = tail.groupBy(*keys, "measure").agg((TIMES * F.min(F.when(10 * F.col("upto") >= TENTHS * F.col("all"), F.col("bucket")))).cast("double").alias("high"))
    both = quartiles.select(*keys, "measure", high.alias("high")).unionByName(tail)
    return both.groupBy(*keys).agg(*(F.max(F.when(F.col("measure") == m, F.col("high"))).alias(f"limit_{m}") for m in MEASURES))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row for each language and source, with the rates and thresholds that hold there."""
    rate = common.cut(rates(rows), "rates")
    own = common.cut(sketch(common.join_keys(rows, rate, ["lang", "source"], "left")), "sketch")
    corpus = merge(own, []).withColumnRenamed("n", "w")
    of_lang = completed(merge(own, ["lang"]), ["lang"], corpus, [])
    found = limits(completed(own, ["lang", "source"], of_lang, ["lang"]), ["lang", "source"])
    return common.cut(common.join_keys(found, rate, ["lang", "source"]), "limits")


def judge(rows: DataFrame) -> DataFrame:
    """``rows``, a table with the features, with ``kept``."""
    joined = common.join_keys(rows, thresholds(rows), ["lang", "source"], "left")
    good = F.lit(True)
    for m, b in buckets().items():
        good = good & F.coalesce((b * b if m in SHARES else b) <= F.col(f"limit_{m}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & good)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails. Null languages and sources are values of their own. Repeated rows are
    judged each by itself. An empty table gives an empty result; columns other than doc_id, text, lang and
    source are not read.
    """
    rows = features(docs.select("doc_id", "text", "lang", "source")).drop("text")
    out = judge(common.cut(rows, "features"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    whole = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.text").alias("text"), F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"))
    rows = common.cut(features(whole).drop("text"), "features")
    return judge(rows).where("kept").select("doc.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.documents(spark, sf_dir))


_SQL_NAMES = {"_capitals": "capitals", "_n_lines": "n_lines"}
_NAMED = lambda c: _SQL_NAMES.get(c, c)
_BUCKETS = {m: f"floor({STEPS} * sqrt(coalesce({_NAMED(n)} / nullif({_NAMED(of)}, 0), 0)))::BIGINT" for m, (n, of) in SHARES.items()}
_BUCKETS |= {m: f"floor({FINE} * greatest(0.0::DOUBLE, sqrt({_NAMED(n)}) - sqrt(coalesce(rate_{m}, 0) * {_NAMED(of)})))::BIGINT" for m, (n, of) in EXCESSES.items()}
_COUNTED = [c for x in EXCESSES.values() for c in map(_NAMED, x)]
_TOTALS = ", ".join(["count(*)::DOUBLE AS n", *(f"sum({c})::DOUBLE AS {c}" for c in _COUNTED)])
_WHOLE = lambda c: f"(ro.{c} * rl.n + {PRIOR} * rl.{c})"
_RATES = ", ".join(f"{_WHOLE(_NAMED(n))} / {_WHOLE(_NAMED(of))} AS rate_{m}" for m, (n, of) in EXCESSES.items())
_QUOTED = lambda names: ", ".join(f"'{m}'" for m in names)
_WITHIN = " AND ".join(f"coalesce({f'b_{m} * b_{m}' if m in SHARES else f'b_{m}'} <= limit_{m}, true)" for m in MEASURES)
_SHARE = f"({PRIOR * 1000} * w::HUGEINT) // (sum(w) OVER"
_MEASURE_LIST = "UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, b_{m} AS bucket FROM b WHERE NOT base_failed " for m in MEASURES)

OP3_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\x0C\\r]')) AS ls FROM t),
p AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
k AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM p),
a AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM k),
u AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM a WHERE n > 1) GROUP BY r),
f AS (SELECT w.r, doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS capitals, coalesce(u.n, 0) AS n_repeat_words FROM w LEFT JOIN u USING (r)),
fb AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
ro AS (SELECT lang, source, {_TOTALS} FROM fb WHERE NOT base_failed GROUP BY ALL),
rl AS (SELECT lang, {_TOTALS} FROM fb WHERE NOT base_failed GROUP BY ALL),
ra AS (SELECT ro.lang, ro.source, {_RATES} FROM ro JOIN rl ON rl.lang IS NOT DISTINCT FROM ro.lang),
b AS (SELECT fb.*, {", ".join(f"{x} AS b_{m}" for m, x in _BUCKETS.items())} FROM fb LEFT JOIN ra ON ra.lang IS NOT DISTINCT FROM fb.lang AND ra.source IS NOT DISTINCT FROM fb.source),
s AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({_MEASURE_LIST}) GROUP BY ALL),
c AS (SELECT measure, bucket, {_SHARE} (PARTITION BY measure)) AS w FROM (SELECT measure, bucket, sum(n) AS w FROM s GROUP BY ALL)),
lw AS (SELECT lang, measure, bucket, sum(w) AS w FROM (SELECT lang, measure, bucket, 1000 * n AS w FROM s UNION ALL SELECT l.lang, c.measure, c.bucket, c.w FROM (SELECT DISTINCT lang, measure FROM s) l JOIN c USING (measure)) GROUP BY ALL HAVING sum(w) > 0),
l AS (SELECT lang, measure, bucket, {_SHARE} (PARTITION BY lang, measure)) AS w FROM lw),
pw AS (SELECT lang, source, measure, bucket, sum(w) AS w FROM (SELECT lang, source, measure, bucket, 1000 * n AS w FROM s
  UNION ALL SELECT m.lang, m.source, m.measure, l.bucket, l.w FROM (SELECT DISTINCT lang, source, measure FROM s) m JOIN l ON l.lang IS NOT DISTINCT FROM m.lang AND l.measure = m.measure) GROUP BY ALL HAVING sum(w) > 0),
o AS (SELECT *, bucket * bucket AS x, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(w) OVER (PARTITION BY lang, source, measure) AS whole FROM pw WHERE measure IN ({_QUOTED(SHARES)}) OR bucket > 0),
q AS (SELECT lang, source, measure, min(x) FILTER (4 * upto >= whole) AS q1, min(x) FILTER (4 * upto >= 2 * whole) AS q2, min(x) FILTER (4 * upto >= 3 * whole) AS q3, min(bucket) FILTER (10 * upto >= {TENTHS} * whole) AS tail FROM o GROUP BY ALL),
d AS (SELECT o.lang, o.source, o.measure, any_value(q1) AS q1, any_value(q3) AS q3, any_value(tail) AS tail, sum(w * abs(x - q2))::DOUBLE / any_value(whole)::DOUBLE AS off
  FROM o JOIN q ON q.lang IS NOT DISTINCT FROM o.lang AND q.source IS NOT DISTINCT FROM o.source AND q.measure = o.measure GROUP BY ALL),
e AS (SELECT lang, source, measure, CASE WHEN measure IN ({_QUOTED(SHARES)}) THEN q3 + greatest(({REACH} * (q3 - q1))::DOUBLE, {DEVIATIONS} * off) ELSE ({TIMES} * tail)::DOUBLE END AS high FROM d),
h AS (SELECT lang, source, {", ".join(f"max(high) FILTER (measure = '{m}') AS limit_{m}" for m in MEASURES)} FROM e GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_WITHIN} AS kept
FROM b LEFT JOIN h ON h.lang IS NOT DISTINCT FROM b.lang AND h.source IS NOT DISTINCT FROM b.source
"""
