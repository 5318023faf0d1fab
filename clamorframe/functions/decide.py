"""Decisions from what witnesses lost, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import content

#: Share of a command's content words from which too much is lost.
LOST_SHARE = 0.6


def share_lost(lost: Column, command: Column) -> Column:
    """Share of the command's content words in ``lost``; 0 for a command without any."""
    cmd = content(command)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(content(lost), cmd)), F.size(cmd)), F.lit(0.0))


def valid_ids(ids: Column, n_pieces: Column) -> Column:
    """Ids that are whole numbers from 1 to the number of pieces; others, as 2.7, are dropped."""
    numbers = F.transform(ids, lambda x: x.try_cast("int"))
    return F.filter(numbers, lambda i: i.isNotNull() & (i >= 1) & (i <= n_pieces))


def agreed_ids(sides: Column) -> Column:
    """Ids that every side lost, sorted; none without sides."""
    some = F.aggregate(sides, F.get(sides, F.lit(0)), lambda a, s: F.array_intersect(a, s))
    return F.coalesce(F.array_sort(F.array_distinct(some)), F.array().cast("array<int>"))


def by_number(n: Column) -> Column:
    return F.when(n == 0, "answer").when(n == 1, "repair").otherwise("repeat")


def decide_by_ids(pieces: Column, sides: Column) -> Column:
    """(kind, lost): none agreed answers, one repairs unless it is the only piece, more repeat."""
    agreed = agreed_ids(sides)
    kind = F.when((F.size(agreed) == 1) & (F.size(pieces) == 1), "repeat").otherwise(by_number(F.size(agreed)))
    return F.struct(kind.alias("kind"), F.transform(agreed, lambda i: F.element_at(pieces, i)).alias("lost"))


def agreed_texts(asr: Column, reply: Column) -> Column:
    """Pieces of the first witness that share a content word with what the second lost."""
    said = F.flatten(F.transform(reply, lambda p: content(p)))
    return F.filter(asr, lambda p: F.arrays_overlap(content(p), said))


def both_wrecked(command: Column, asr: Column, reply: Column) -> Column:
    """Whether either witness lost too much of the command by itself."""
    much = lambda side: share_lost(F.concat_ws(" ", side), command) >= LOST_SHARE
    return much(asr) & much(reply)


def decide_by_text(command: Column, asr: Column, reply: Column) -> Column:
    """(kind, missing) from two lists of lost pieces in free text; see the tests for each branch."""
    agreed = agreed_texts(asr, reply)
    much = share_lost(F.concat_ws(" ", agreed), command) >= LOST_SHARE
    n = F.size(agreed)
    kind = F.when(both_wrecked(command, asr, reply) | ((n == 1) & much), "repeat").otherwise(by_number(n))
    nothing = F.array().cast("array<string>")
    missing = F.when(kind == "repeat", F.array_distinct(F.concat(asr, reply))).when(kind == "repair", agreed).otherwise(nothing)
    return F.struct(kind.alias("kind"), missing.alias("missing"))
