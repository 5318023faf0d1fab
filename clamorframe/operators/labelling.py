"""Labels from model replies that are asked for at their own grains: pieces once an utterance, losses once a probe and witness.

A request is a row with its key, system and user text; replies are a table by request key, so equal requests are asked once and
stored replies are joined. Probes come out with their label, or without one where a reply is missing or cannot be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import judge as J
from ..functions import label as L
from ..functions.text import keep_pieces, normalize
from ..sources.provider import request_key


def _request(rows: DataFrame, system: Column, user: Column, attempt: Column | int = 0, temperature: float = 0.0) -> DataFrame:
    out = rows.withColumns({"system": system, "user": user})
    return out.withColumn("request_key", request_key(F.col("system"), F.col("user"), temperature, attempt))


def two_lines(command: Column, mark: str, text: Column) -> Column:
    """A command and what a witness has of it, their texts below each other."""
    return F.concat(F.lit("COMMAND: "), normalize(command), F.lit(f"\n{mark + ':':9}"), normalize(text))


def hypotheses(command: Column, hyps: Column) -> Column:
    """A command and a numbered line for each hypothesis that is not blank."""
    heard = F.filter(hyps, lambda h: ~L.blank(h))
    lines = F.transform(heard, lambda h, i: F.concat(F.lit("HYP "), (i + 1).cast("string"), F.lit(": "), normalize(h)))
    return F.concat_ws("\n", F.concat(F.lit("COMMAND: "), normalize(command)), F.array_join(lines, "\n"))


def quoted(command: Column, lost: Column | None = None) -> Column:
    """What a target's writer is shown: the command as it is, and the lost piece of a repair."""
    shown = F.concat(F.lit('COMMAND:\n"'), command, F.lit('"'))
    return shown if lost is None else F.concat(shown, F.lit('\nLOST-PIECE: "'), lost, F.lit('"'))


def piece_requests(utterances: DataFrame, key: str, system: str, sentence: str = "sentence") -> DataFrame:
    """(key, request_key, system, user): one for each utterance, however many recordings it has; of different sentences of a key the smallest counts."""
    one = utterances.where(F.col(sentence).isNotNull()).groupBy(key).agg(F.min(sentence).alias(sentence))
    return _request(one.select(key, sentence), F.lit(system), F.concat(F.lit("COMMAND: "), normalize(F.col(sentence)))).drop(sentence)


def pieces_of(requests: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """(key, pieces) of the utterances whose reply names a piece that is more than a wake word; others are absent."""
    found = requests.select(key, "request_key").join(replies.select("request_key", "response"), "request_key")
    pieces = F.when(J.is_object(J.unfenced(F.col("response"))), keep_pieces(J.strings(J.unfenced(F.col("response")), "pieces")))
    return found.select(key, pieces.alias("pieces")).where(F.size("pieces") > 0)


def witnesses(probes: DataFrame, keys: list[str], said: Column) -> DataFrame:
    """(keys, witness, mark, text): a row for each witness of a probe that is not blank, by its place; ``said`` is an array of structs (mark, text)."""
    each = probes.select(*keys, F.posexplode(said).alias("witness", "_w")).select(*keys, "witness", "_w.mark", "_w.text")
    return each.where(~L.blank(F.col("text")))


def loss_requests(heard: DataFrame, pieces: DataFrame, key: str, systems: dict[str, str]) -> DataFrame:
    """``heard`` (key, ..., witness, mark, text) of utterances that have pieces, with request_key, system and user: which of the numbered pieces the witness lacks."""
    both = heard.join(pieces.select(key, "pieces"), key)
    lines = F.array_join(F.transform("pieces", lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")
    user = F.concat(F.lit("KEY PIECES:\n"), lines, F.lit("\n"), F.col("mark"), F.lit(": "), normalize(F.col("text")))
    system = F.create_map(*(F.lit(x) for kv in systems.items() for x in kv))[F.col("mark")]
    return _request(both, system, user).drop("pieces")


def labelled(requests: DataFrame, replies: DataFrame, pieces: DataFrame, key: str, keys: list[str], least: int = 1) -> DataFrame:
    """(keys, kind, lost, asr_bucket, resp_bucket, reason) of each probe from its witnesses' replies.

    A probe with fewer than ``least`` witnesses, or one whose reply is missing or no object, is absent: it counts as not
    drawn. Ids that are no piece are passed over.
    """
    reply = J.unfenced(F.col("response"))
    listed = F.coalesce(F.from_json(F.get_json_object(reply, "$.lost"), "array<string>"), F.array().cast("array<string>"))
    each = requests.select(*keys, "witness", "text", "request_key").join(replies.select("request_key", "response"), "request_key", "left")
    each = each.select(*keys, F.struct("witness", "text", F.when(J.is_object(reply), listed).alias("ids")).alias("_w"))
    own = each.groupBy(*keys).agg(F.sort_array(F.collect_list("_w")).alias("_w")).where(F.size("_w") >= least)
    both = own.join(pieces.select(key, "pieces"), key)
    label = L.by_witnesses(F.col("pieces"), F.transform("_w", lambda w: w["text"]), F.transform("_w", lambda w: w["ids"]))
    sides = F.transform("_w", lambda w: F.array_sort(F.array_distinct(L.valid_ids(w["ids"], F.size("pieces")))))
    out = both.withColumns({"_label": label, "_sides": sides}).where(F.col("_label").isNotNull())
    bucket = L.buckets(F.col("_sides"))
    return out.select(*keys, "_label.kind", "_label.lost", bucket["asr_bucket"].alias("asr_bucket"), bucket["resp_bucket"].alias("resp_bucket"), L.reason_by_ids(F.size("pieces"), F.col("_sides")).alias("reason"))
