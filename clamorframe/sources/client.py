"""Calls to a model from tasks: so many at once, tried again after a pause, results in the order of the requests.

A call is a function of (system, user) that returns the reply's text or raises; it is sent to the tasks, so it must make its own
connection there. Only requests without a stored reply are sent, and replies are stored batch by batch, so a run that ended
half-way asks nothing twice but what its open batch had in flight.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runlog
from .provider import open_requests

# Tries behind the first, and seconds before the first of them, doubled each time.
RETRIES = 3
PAUSE = 1.0
# End of fixed values.

#: Calls in flight of one task, and requests that wait behind them, so that a slow one keeps no thread idle.
IN_FLIGHT, WINDOW = 6, 3


def with_retries(call: Callable[..., str], retries: int = RETRIES, pause: float = PAUSE, quiet: bool = False) -> Callable[..., str | None]:
    """``call``, tried again after 1, 2, 4, ... pauses; then its last error, or null if ``quiet``."""

    def attempt(*request: str) -> str | None:
        for k in range(retries + 1):
            try:
                return call(*request)
            except Exception:
                if k == retries:
                    if quiet:
                        return None
                    raise
                time.sleep(pause * 2**k)
        return None

    return attempt


def in_order(items: Iterator[tuple], work: Callable[..., object], workers: int = IN_FLIGHT, window: int = WINDOW) -> Iterator[tuple[tuple, object]]:
    """(item, result) in the order of the items, ``workers`` of them worked on at once and never more than ``workers * window`` taken ahead."""
    waiting: deque = deque()
    with ThreadPoolExecutor(workers) as pool:
        try:
            for item in items:
                waiting.append((item, pool.submit(work, *item)))
                if len(waiting) == workers * window:
                    first, result = waiting.popleft()
                    yield first, result.result()
            while waiting:
                first, result = waiting.popleft()
                yield first, result.result()
        finally:
            for _, result in waiting:
                result.cancel()


def replies(requests: DataFrame, call: Callable[[str, str], str], retries: int = RETRIES, pause: float = PAUSE, quiet: bool = False, workers: int = IN_FLIGHT) -> DataFrame:
    """(request_key, response) of every row of ``requests`` (request_key, system, user), each partition's in its order.

    An error that is left after the last try ends the job, as a reply that is missing without notice would change scores;
    ``quiet`` gives null instead.
    """
    tried = with_retries(call, retries, pause, quiet)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            given = [r for _, r in in_order(zip(frame["system"], frame["user"], strict=True), tried, workers)]
            yield pd.DataFrame({"request_key": frame["request_key"], "response": pd.Series(given, dtype="object")})

    return requests.select("request_key", "system", "user").mapInPandas(ask, "request_key string, response string")


def ask_open(spark: SparkSession, requests: DataFrame, call: Callable[[str, str], str], path: str, batches: int = 1, **how: object) -> DataFrame:
    """(request_key, response) of all requests from the log at ``path``, after asking those that it lacks, in ``batches`` parts.

    Requests of equal key are asked once. A part is committed whole; what an error leaves uncommitted is asked again by the next run.
    """
    runlog.recover(spark, path)
    todo = open_requests(requests, runlog.rows(spark, path, "request_key string, response string"))
    todo = todo.withColumn("_batch", F.pmod(F.xxhash64("request_key"), F.lit(batches)))
    todo = runlog.cut(todo, "requests")
    for k in range(batches):
        part = todo.where(F.col("_batch") == k).drop("_batch")
        if not part.isEmpty():
            runlog.append(replies(part, call, **how), path)
    return runlog.rows(spark, path, "request_key string, response string")


def generated(rows: DataFrame, load: Callable[[], Callable[[list], list[str]]], column: str, batch: int = 16, n_best: int = 1, prefill: str | None = None) -> DataFrame:
    """``rows`` with ``texts``: what a model that each task loads once makes of ``column``, ``batch`` rows at a time.

    ``load`` returns a function from a list of inputs to their texts, ``n_best`` for each input, one input after the other.
    Texts are in lower case, without white space around; a prefill, which the model was given to go on with, is put back
    before them. A null input has null texts. Another number of texts than asked for is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            texts: list[list[str] | None] = [None] * len(frame)
            given = [i for i, x in enumerate(frame[column]) if x is not None]
            for at in range(0, len(given), batch):
                part = given[at : at + batch]
                model = model or load()
                out = model([frame[column].iloc[i] for i in part])
                if len(out) != n_best * len(part):
                    raise ValueError(f"{len(out)} texts for {len(part)} inputs, {n_best} wanted of each")
                made = [(prefill or "") + t.lower().strip() for t in out]
                for k, i in enumerate(part):
                    texts[i] = made[k * n_best : (k + 1) * n_best]
            yield frame.assign(texts=pd.Series(texts, index=frame.index, dtype="object"))

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, texts array<string>")
