"""Model calls as a table: requests have keys, responses are joined by them. Nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(system: Column, user: Column, temperature: float = 0.0, attempt: Column | int = 0) -> Column:
    """A digest of all that a response depends on; lengths keep two texts apart that join to the same one."""
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    parts = [system, user, F.lit(f"{temperature:g}"), attempt.cast("string")]
    return F.sha2(F.concat_ws("|", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)


def answered(requests: DataFrame, responses: DataFrame, key: str = "request_key") -> DataFrame:
    """Requests with the column ``response``, null where there is none. Repeated responses to a key: the smallest."""
    one = responses.groupBy(key).agg(F.min("response").alias("response"))
    return requests.join(one, key, "left")


def open_requests(requests: DataFrame, responses: DataFrame, key: str = "request_key") -> DataFrame:
    """The distinct requests still to be sent."""
    return requests.dropDuplicates([key]).join(responses.select(key), key, "left_anti")


def first_valid(attempts: DataFrame, keys: list[str], valid: Column, order: str = "attempt") -> DataFrame:
    """Each key's first valid attempt; keys without one are absent."""
    rows = attempts.where(valid)
    whole = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.min_by(whole, order).alias("_a")).select(*keys, "_a.*")
