"""Text functions, Column to Column: tokens, folding, phrases, leaks and reply parsing."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these word lists.
WAKE_WORDS = ["hey", "ok", "okay", "olly", "ollie", "alexa", "siri", "google", "assistant", "computer"]
PIECE_STOPWORDS = [
    "a", "an", "and", "any", "are", "at", "be", "by", "do", "for", "from", "i", "in", "is", "it", "me", "my", "of", "on", "please",
    "s", "that", "the", "this", "to", "what", "you", "your",
]
NUMBERS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12"}
# Marks of a two-part answer, and a heard part in quotes without a mark behind it.
HEARD_MARK = r"\**\s*heard\s*\**\s*:\**"
REPLY_MARK = r"\**\s*repl(?:y|ied)\s*\**\s*:\**"
QUOTED_HEARD = "^[\\s*]*[\"“](.*?)[\"”]\\.?\\s*(.*)$"
# End of fixed values.


def word_list(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


@cache
def _compatible() -> tuple[str, str]:
    """Characters whose compatibility form is another single character, and those forms, by Unicode's own rule."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    pairs = [(c, to) for c, to in pairs if len(to) == 1 and c != to]
    return "".join(c for c, _ in pairs), "".join(to for _, to in pairs)


def folded(text: Column) -> Column:
    """Full-width, superscript and other variants of a character as that character; ligatures and combining marks need ``nfkc``."""
    source, target = _compatible()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, source, target)).otherwise(text)


def normalize(text: Column) -> Column:
    """Lower case; bracketed spans out; variants folded; whatever is not a letter, digit or white space to a space; white space collapsed."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\[[^\]]*\]|<[^>]*>|\([^)]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(folded(bare), r"[^\p{L}\p{N}\s]", " "), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Words between Unicode white space; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def content(text: Column, stop: list[str] = PIECE_STOPWORDS) -> Column:
    """Distinct normalised tokens that are no stop words."""
    return F.array_except(tokens(normalize(text)), word_list(stop))


def keep_pieces(pieces: Column, stop: list[str] = WAKE_WORDS) -> Column:
    """Pieces with a token besides ``stop``."""
    return F.filter(pieces, lambda p: F.size(content(p, stop)) > 0)


def fold(words: Column) -> Column:
    """Number words to digits; a one-character token joins a single letter before it."""
    mapping = F.create_map(*(F.lit(x) for kv in NUMBERS.items() for x in kv))
    digits = F.transform(words, lambda w: F.coalesce(F.try_element_at(mapping, w), w))

    def step(done: Column, w: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        glue = F.coalesce((F.length(w) == 1) & last.rlike(r"^\p{L}$"), F.lit(False))
        return F.when(glue, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, w)))).otherwise(F.concat(done, F.array(w)))

    # few lists have a single letter before a one-character token: only those are gone through word by word
    may_glue = lambda ws: F.array_join(ws, " ").rlike(r"(?s)(^| )\p{L}\R? .( |$)")
    folded_list = lambda ws: F.when(may_glue(ws), F.aggregate(ws, F.array().cast("array<string>"), step)).otherwise(ws)
    return F.get(F.transform(F.array(digits), folded_list), F.lit(0))


def phrase_at(words: Column, phrase: Column) -> Column:
    """[start, end) of the first place where ``phrase`` stands; null where it is empty or does not."""
    n, m = F.size(words), F.size(phrase)
    starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(1), n - m + 1))
    first = F.get(F.filter(starts, lambda i: F.slice(words, i, m) == phrase), F.lit(0))
    return F.when(first.isNotNull(), F.struct((first - 1).alias("start"), (first - 1 + m).alias("end")))


def mask_phrase(sentence: Column, phrase: Column, mark: str = "[GARBLED]") -> Column:
    """The first place of ``phrase``, in any case, replaced."""
    at = F.position(F.lower(phrase), F.lower(sentence))
    return F.when(at > 0, F.overlay(sentence, F.lit(mark), at, F.length(phrase))).otherwise(sentence)


def leaks(target: Column, phrase: Column, stop: list[str]) -> Column:
    """Whether a word of the phrase, longer than two letters and no stop word, is in the target."""
    found = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), 1)
    secret = F.filter(F.array_except(found(phrase), word_list(stop)), lambda w: F.length(w) > 2)
    return F.arrays_overlap(secret, found(target))


def character(number: Column) -> Column:
    """A character of its own for each number from 1; surrogates are passed over."""
    code = number + 255
    return F.decode(F.unhex(F.lpad(F.hex((code + F.when(code >= 0xD800, 0x800).otherwise(0)).cast("long")), 8, "0")), "UTF-32")


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two word lists over the longer one's length, at least 1.

    Words that both have become a character each, so the built-in distance of strings serves; all other words of one
    side match nothing, so one character stands for them.
    """
    shared = F.array_intersect(a, b)
    coded = lambda words, other: F.array_join(F.transform(words, lambda w: F.when(F.array_contains(shared, w), character(F.array_position(shared, w))).otherwise(F.lit(other))), "")
    return F.levenshtein(coded(a, "a"), coded(b, "b")) / F.greatest(F.size(a), F.size(b), F.lit(1))


def heard_reply(text: Column) -> Column:
    """(heard, reply) of a two-part answer; ("", text) where there is no such form.

    The reply is behind its first mark. What stands before a mark of the heard part, wherever that is, is no
    part of it. Without a reply mark, a quoted span at the beginning of what is left is the heard part.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    clean = lambda c: strip(F.regexp_replace(strip(c), "^[*\"'“”]+|[*\"'“”]+$", ""))
    behind_mark = lambda c: F.regexp_replace(c, f"(?isU)^.*?{HEARD_MARK}", "")
    whole = f"(?isU)^(.*?){REPLY_MARK}(.*)$"
    quoted = f"(?sU){QUOTED_HEARD}"
    bare = behind_mark(text)
    pair = lambda h, r: F.struct(clean(h).alias("heard"), clean(r).alias("reply"))
    return (
        F.when(text.rlike(whole), pair(behind_mark(F.regexp_extract(text, whole, 1)), F.regexp_extract(text, whole, 2)))
        .when(bare.rlike(quoted), pair(F.regexp_extract(bare, quoted, 1), F.regexp_extract(bare, quoted, 2)))
        .otherwise(F.struct(F.lit("").alias("heard"), strip(text).alias("reply")))
    )


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark has no function for; before ``normalize`` where texts may hold such characters."""

    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(compose, "string")(text)


def share_of(phrase: Column, sentence: Column) -> Column:
    """Characters of the phrase over those of the sentence; 0 for an empty sentence."""
    return F.coalesce(F.try_divide(F.length(phrase), F.length(sentence)), F.lit(0.0))
