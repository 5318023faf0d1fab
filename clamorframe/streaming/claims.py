"""An online form of the builder's claims: an id is taken once, whichever batch brings it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_claims(stream: DataFrame, key: str, event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen before. With an event time, keys are forgotten once the watermark has passed them."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def least_claims(stream: DataFrame, key: str, order: str, event_time: str, late_seconds: int = 3600) -> DataFrame:
    """(key, order, event_time) of each key's row with the least ``order``, whichever batch brings it before the watermark does.

    A key's claim is open from its first row until the watermark, which runs ``late_seconds`` behind the latest event time,
    has passed that row's time; rows that come by then can take it with a smaller order. It is given out once. Later rows of
    the key are turned away for ``late_seconds`` more, then the key is forgotten, so state does not grow without end. Keys and
    orders are whole numbers; a null key or order is dropped.
    """

    def settle(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            least, at, given, due = state.get
            if given:
                state.remove()
                return
            yield pd.DataFrame({key: [own[0]], order: [least], event_time: pd.to_datetime([at], unit="us")})
            due = now + 1000 * late_seconds
            state.update((least, at, True, due))
            state.setTimeoutTimestamp(due)
            return
        best = state.get if state.exists else None
        for frame in frames:
            i = frame[order].idxmin()
            least, at = int(frame.loc[i, order]), int(frame.loc[i, event_time].value) // 1000
            if best is None:
                best = (least, at, False, int(frame[event_time].min().value) // 1_000_000 + 1)
            elif not best[2] and least < best[0]:
                best = (least, at, False, best[3])
        state.update(best)
        state.setTimeoutTimestamp(max(best[3], now + 1))  # a call without it would end the timeout

    rows = stream.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), event_time).withWatermark(event_time, f"{late_seconds} seconds")
    out = f"`{key}` long, `{order}` long, `{event_time}` timestamp"
    return rows.groupBy(key).applyInPandasWithState(settle, out, "least long, at long, given boolean, due long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there as Parquet and stops; a later call goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
