"""What judges answer, parsed to types and scores; what they are shown, rendered. Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.score import JUDGED, MATRICES

# Which scores are legal, and how a score is read from a reply that is no JSON.
VALID_SCORES = [0.0, 0.5, 1.0]
SCORE_FIELD = r'"score"\s*:\s*([0-9]*\.?[0-9]+)'
SCORE_BARE = r"\b(0?\.5|0|1(?:\.0)?)\b"
# End of fixed values.


def unfenced(text: Column) -> Column:
    """Without the fence lines that models put around JSON."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "```(json)?", ""))


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object."""
    return F.try_parse_json(text).isNotNull() & F.json_object_keys(text).isNotNull()


def has(text: Column, field: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(text), field), F.lit(False))


def strings(text: Column, field: str) -> Column:
    """A field's entries, stripped, without empty ones; none where it is missing."""
    found = F.from_json(F.get_json_object(text, f"$.{field}"), "array<string>")
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")


def judged_type(text: Column) -> Column:
    """(type, failed). An object without a type is bad, but no failure; anything not legal is bad and a failure."""
    said = F.lower(F.trim(F.get_json_object(text, "$.type")))
    legal = F.coalesce(is_object(text) & said.isin(*JUDGED), F.lit(False))
    silent = F.coalesce(is_object(text) & ~has(text, "type"), F.lit(False))
    return F.struct(F.when(legal, said).otherwise("bad").alias("type"), (~legal & ~silent).alias("failed"))


def judged_score(text: Column) -> Column:
    """(score, failed): 0 and a failure unless the object's score is a legal one."""
    said = F.get_json_object(text, "$.score").try_cast("double")
    legal = F.coalesce(is_object(text) & said.isin(*VALID_SCORES), F.lit(False))
    return F.struct(F.when(legal, said).otherwise(0.0).alias("score"), (~legal).alias("failed"))


def loose_score(text: Column, default: float = 0.0) -> Column:
    """An object's score, else the first number after a score key, else the first bare legal score, else the default."""
    found = lambda pattern: F.regexp_extract(text, pattern, 1).try_cast("double")
    plain = F.get_json_object(text, "$.score").try_cast("double")
    silent = F.coalesce(is_object(text) & ~has(text, "score"), F.lit(False))
    return F.when(silent, F.lit(default)).otherwise(F.coalesce(F.when(is_object(text), plain), found(SCORE_FIELD), found(SCORE_BARE), F.lit(default)))


def token_score(reply: Column, token: str) -> Column:
    """1 for a reply that is the token and nothing else."""
    return F.when(F.trim(F.coalesce(reply, F.lit(""))) == token, 1.0).otherwise(0.0)


def shown(lost: Column) -> Column:
    """Lost pieces as judges see them."""
    quoted = F.transform(lost, lambda s: F.concat(F.lit('"'), s, F.lit('"')))
    return F.when(F.size(F.coalesce(lost, F.array().cast("array<string>"))) > 0, F.concat_ws("; ", quoted)).otherwise("(none)")


def numbered(pieces: Column, label: str = "") -> Column:
    """One line a piece, numbered from 1."""
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.lit(label), (i + 1).cast("string"), F.lit(": "), p)), "\n")


def needs_second_look(kind: Column, judged: Column, lost: Column, matrix: str) -> Column:
    """Whether it matters if a repair question is about what was lost: only where the matrix scores the two differently."""
    kinds = [k for k, cells in MATRICES[matrix].items() if cells.get("repair_off", cells["repair"]) < cells["repair"]]
    return (judged == "repair") & (F.size(lost) > 0) & kind.isin(*kinds)


def model_family(path: Column) -> Column:
    """The family named in a model's path; null where none is."""
    low = F.lower(path)
    return F.when(low.contains("qwen3"), "qwen3").when(low.rlike(r"qwen2\.5|qwen2_5|qwen25"), "qwen2.5")
