"""Labels from labellers' replies, Column to Column; null is a label that must not be used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decide import LOST_SHARE, agreed_ids, agreed_texts, both_wrecked, decide_by_ids, decide_by_text, share_lost, valid_ids
from .judge import is_object, strings
from .text import PIECE_STOPWORDS, WAKE_WORDS, keep_pieces, normalize, tokens, word_list

# Words that make no piece, besides those of the two lists that are joined to them.
NON_PIECE_EXTRA = [
    "am", "as", "been", "being", "can", "could", "did", "does", "had", "has", "have", "he", "her", "him", "may", "might",
    "must", "shall", "she", "should", "them", "they", "us", "was", "we", "were", "will", "would",
]
KINDS = ["answer", "repair", "repeat"]
TARGET_ATTEMPTS = 8
# End of fixed values.

NON_PIECE_WORDS = [*PIECE_STOPWORDS, *WAKE_WORDS, *NON_PIECE_EXTRA]


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _text(reply: Column, field: str) -> Column:
    return F.trim(F.coalesce(F.get_json_object(reply, f"$.{field}"), F.lit("")))


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def single_witness(reply: Column) -> Column:
    """(kind, missing, misheard_as, reply, reason) of one labeller's object; null for an unknown kind."""
    kind = F.lower(_text(reply, "kind"))
    missing = strings(reply, "lost")
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("lost from Heard: "), F.concat_ws("; ", missing))).otherwise("all key pieces survived in Heard")
    fields = F.struct(kind.alias("kind"), missing.alias("missing"), _text(reply, "misheard_as").alias("misheard_as"), _text(reply, "reply").alias("reply"), reason.alias("reason"))
    return F.when(is_object(reply) & kind.isin(*KINDS), fields)


def classified(reply: Column) -> Column:
    """(kind, missing, consistent) of one attempt of the classifier; null for no object or an unknown kind.

    Answers miss nothing and repairs miss one piece; other attempts are not consistent, and the next one counts.
    """
    kind, missing = F.lower(_text(reply, "kind")), strings(reply, "missing")
    wrong = ((kind == "answer") & (F.size(missing) > 0)) | ((kind == "repair") & (F.size(missing) != 1))
    return F.when(is_object(reply) & kind.isin(*KINDS), F.struct(kind.alias("kind"), missing.alias("missing"), (~wrong).alias("consistent")))


def first_consistent(attempts: Column) -> Column:
    """The first consistent one of an array of ``classified``; null if there is none, or an attempt before it is null."""
    return F.aggregate(
        attempts,
        F.struct(F.lit(False).alias("over"), F.lit(None).cast("struct<kind:string,missing:array<string>,consistent:boolean>").alias("found")),
        lambda done, a: F.when(done["over"], done).otherwise(F.struct((a.isNull() | a["consistent"]).alias("over"), F.when(a["consistent"], a).alias("found"))),
    )["found"]


def by_two_texts(command: Column, heard: Column, reply: Column, heard_lost: Column, reply_lost: Column) -> Column:
    """``decide_by_text`` without wake-only pieces; null where a witness is blank or a labeller gave nothing."""
    usable = ~blank(heard) & ~blank(reply) & heard_lost.isNotNull() & reply_lost.isNotNull()
    return F.when(usable, decide_by_text(command, keep_pieces(heard_lost), keep_pieces(reply_lost)))


def by_witnesses(pieces: Column, witnesses: Column, lost_ids: Column) -> Column:
    """``decide_by_ids`` over the witnesses that are not blank; null without any, or if one of theirs is null.

    ``lost_ids``: for each witness an array of ids as text, of which those that are no piece are dropped.
    """
    pairs = F.filter(F.arrays_zip(witnesses.alias("w"), lost_ids.alias("ids")), lambda p: ~blank(p["w"]))
    sides = F.transform(pairs, lambda p: valid_ids(p["ids"], F.size(pieces)))
    usable = (F.size(pairs) > 0) & ~F.exists(pairs, lambda p: p["ids"].isNull())
    return F.when(usable, decide_by_ids(pieces, sides))


def by_consensus(command: Column, hyps: Column, reply: Column) -> Column:
    """(kind, missing) from one labeller's object over all hypotheses: entries without a content word do not count."""
    lost = keep_pieces(strings(reply, "lost"), NON_PIECE_WORDS)
    unheard = F.coalesce(F.get_json_object(reply, "$.unintelligible").try_cast("boolean"), F.lit(False))
    n = F.size(lost)
    bundled = (n == 1) & (share_lost(F.element_at(F.concat(lost, F.array(F.lit(""))), 1), command) >= LOST_SHARE)
    kind = F.when(unheard, "repeat").when(n == 0, "answer").when((n == 1) & ~bundled, "repair").otherwise("repeat")
    missing = F.when(kind == "answer", _nothing()).otherwise(lost)  # a bundled entry is kept with its repeat
    usable = F.exists(hyps, lambda h: ~blank(h)) & is_object(reply)
    return F.when(usable, F.struct(kind.alias("kind"), missing.alias("missing")))


def target_leaks(target: Column, lost: Column) -> Column:
    """Whether a content word of the lost piece stands in the target."""
    secret = F.array_except(tokens(normalize(lost)), word_list(NON_PIECE_WORDS))
    return F.arrays_overlap(secret, tokens(normalize(target)))


def first_target(targets: Column, kind: Column, lost: Column) -> Column:
    """The first of an array of written targets that is not empty and, in a repair, does not leak; "" if none is."""
    good = F.filter(F.slice(targets, 1, TARGET_ATTEMPTS), lambda t: ~blank(t) & ~((kind == "repair") & target_leaks(t, lost)))
    return F.coalesce(F.trim(F.get(good, F.lit(0))), F.lit(""))


def leaked_attempts(targets: Column, kind: Column, lost: Column) -> Column:
    """How many attempts were turned away for leaking before ``first_target`` took one, or all gave out."""
    tried = F.slice(targets, 1, TARGET_ATTEMPTS)
    leak = lambda t: (kind == "repair") & ~blank(t) & F.coalesce(target_leaks(t, lost), F.lit(False))
    state = F.struct(F.lit(False).alias("over"), F.lit(0).alias("n"))
    step = lambda s, t: F.when(s["over"], s).otherwise(F.struct((~blank(t) & ~leak(t)).alias("over"), (s["n"] + leak(t).cast("int")).alias("n")))
    return F.aggregate(tried, state, step)["n"]


def reason_by_ids(n_pieces: Column, sides: Column) -> Column:
    """How witnesses' lost ids came to be agreed on: ``3 pieces | [3] x [2, 3] -> agreed [3]``."""
    shown = lambda ids: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ", "), F.lit("]"))
    return F.concat(n_pieces.cast("string"), F.lit(" pieces | "), F.array_join(F.transform(sides, shown), " x "), F.lit(" -> agreed "), shown(agreed_ids(sides)))


def _listed(pieces: Column) -> Column:
    return F.when(F.size(pieces) > 0, F.concat_ws("; ", pieces)).otherwise("none")


def reason_by_text(command: Column, asr: Column, reply: Column) -> Column:
    """How two witnesses' lost pieces in free text came to be agreed on."""
    wrecked = F.when(both_wrecked(command, asr, reply), " (both wrecked)").otherwise("")
    count = F.format_string("a%dxr%d -> %d agreed", F.size(asr), F.size(reply), F.size(agreed_texts(asr, reply)))
    return F.concat(count, wrecked, F.lit(" | asr lost: "), _listed(asr), F.lit(" | reply lost: "), _listed(reply))


def reason_by_consensus(n_hyps: Column, lost: Column, unintelligible: Column, misheard: Column) -> Column:
    """What a labeller of several hypotheses found; ``misheard`` may be empty."""
    heard = F.when(F.coalesce(misheard, F.lit("")) != "", F.concat(F.lit(" | misheard as: "), misheard)).otherwise("")
    return F.concat(n_hyps.cast("string"), F.lit(" hyps | consensus lost: "), _listed(lost), F.when(unintelligible, " (unintelligible)").otherwise(""), heard)


def buckets(sides: Column) -> Column:
    """(asr_bucket, resp_bucket): how many pieces the first and the last witness lost."""
    count = lambda mark, i: F.concat(F.lit(mark), F.size(F.element_at(sides, i)).cast("string"))
    return F.struct(count("a", 1).alias("asr_bucket"), count("r", -1).alias("resp_bucket"))


def slot_words(slot: Column, described: dict[str, str]) -> Column:
    """A slot's description; its name with spaces where it has none."""
    table = F.create_map(*(F.lit(x) for kv in described.items() for x in kv)) if described else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, slot), F.replace(slot, F.lit("_"), F.lit(" ")))


def supervised(n_prompt: Column, token_ids: Column, ignored: int = -100) -> Column:
    """Labels of a training sequence: the ids behind the prompt, and ``ignored`` for those of the prompt."""
    return F.transform(token_ids, lambda x, i: F.when(i >= n_prompt, x.cast("int")).otherwise(F.lit(ignored)))
