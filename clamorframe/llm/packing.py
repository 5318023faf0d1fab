"""Best-fit packing of token pieces into sequences by bin completion.

The number of pieces of each length (at most ``capacity`` counts, however large the corpus) is all that
the search sees. It takes the longest piece left, enumerates undominated fillings of the room beside it,
applies a filling as often as the counts allow, and branches over fillings. A branch is cut when its bins
and the tokens left need no fewer bins than the incumbent, which best-fit decreasing gives first. The plan
is a list of (filling, times); every piece finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
END_ID = 0
#: Fillings tried beside a longest piece, and search steps in all.
WIDTH = 6
NODES = 12_000
#: Pieces that are ranked together.
BLOCK = 2_000

Plan = list[tuple[tuple[int, ...], int]]


class Counts:
    """How many pieces of each length are left, with the next shorter length that is left."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.astype(np.int64).copy()
        self.total = int((np.arange(len(counts)) * self.n).sum())

    def take(self, filling: tuple[int, ...], times: int) -> None:
        for x in filling:
            self.n[x] -= times
        self.total -= sum(filling) * times

    def below(self) -> np.ndarray:
        """For each room the largest length left that fits, 0 for none."""
        at = np.where(self.n > 0, np.arange(len(self.n)), 0)
        at[0] = 0
        return np.maximum.accumulate(at)


def times_of(n: np.ndarray, filling: tuple[int, ...]) -> int:
    lengths, each = np.unique(np.asarray(filling), return_counts=True)
    return int((n[lengths] // each).min())


def fillings(counts: Counts, capacity: int, width: int) -> list[tuple[int, ...]]:
    """Undominated fillings around the longest piece left, the fullest first.

    One piece that fills the room exactly dominates all others. Otherwise the room is filled with longest
    pieces until two more may close it, and the last two are searched over all lengths: for a first one the
    longest second one that still fits; a pair no fuller than the longest single piece is dominated by it.
    """
    below = counts.below()
    longest = int(below[-1])
    n = counts.n
    used: dict[int, int] = {longest: 1}
    base, room = [longest], capacity - longest

    def left(x: int) -> int:
        return int(n[x]) - used.get(x, 0)

    def fitting(limit: int) -> int:
        x = int(below[limit]) if limit > 0 else 0
        while x and left(x) <= 0:
            x = int(below[x - 1])
        return x

    while True:
        single = fitting(room)
        if not single or single == room or room <= 2 * single + single // 2:
            break
        base.append(single)
        used[single] = used.get(single, 0) + 1
        room -= single
    if not single:
        return [tuple(base)]
    if single == room:
        return [(*base, single)]
    free = n.copy()
    for x, k in used.items():
        free[x] -= k
    at = np.where(free > 0, np.arange(len(free)), 0)
    at[0] = 0
    under = np.maximum.accumulate(at)
    first = np.flatnonzero(free[: room + 1] > 0)
    first = first[first > 0]
    second = under[np.minimum(room - first, first)]
    clash = (second == first) & (free[first] < 2)
    second[clash] = under[np.maximum(second[clash] - 1, 0)]
    pair_sum = first + second
    found = [(room - single, (*base, single))]
    good = np.flatnonzero((second > 0) & (pair_sum > single))
    for k in good[np.lexsort((-first[good], room - pair_sum[good]))][:width]:
        found.append((room - int(pair_sum[k]), (*base, int(first[k]), int(second[k]))))
    if min(w for w, _ in found) > 0:
        for _, pair in list(found):  # a third piece in what is left
            rest = capacity - sum(pair)
            third = int(under[rest]) if rest > 0 else 0
            if third and free[third] > pair.count(third) - base.count(third):
                found.append((rest - third, (*pair, third)))
    found.sort(key=lambda x: (x[0], len(x[1]), tuple(-y for y in x[1])))
    return [f for _, f in found[:width]]


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit over runs of equal lengths: bins with equal room are one group, so groups stay few."""
    groups: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        todo = int(counts[length])
        while todo:
            room = next((r for r in range(length, capacity + 1) if r in groups), None) if groups else None
            if room is None:
                fit = capacity // length
                full, rest = divmod(todo, fit)
                for k, times in ((fit, full), (rest, 1)):
                    if k and times:
                        own = groups.setdefault(capacity - k * length, {})
                        own[(length,) * k] = own.get((length,) * k, 0) + times
                break
            filling, times = next(iter(groups[room].items()))
            k = min(room // length, todo)
            some = min(times, todo // k)
            if some == times:
                del groups[room][filling]
                if not groups[room]:
                    del groups[room]
            else:
                groups[room][filling] = times - some
            own = groups.setdefault(room - k * length, {})
            key = (*filling, *(length,) * k)
            own[key] = own.get(key, 0) + some
            todo -= some * k
    return [(f, t) for own in groups.values() for f, t in own.items()]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: tokens by capacity, and the same with long pieces kept apart."""
    lengths = np.arange(len(counts))
    total = int((lengths * counts).sum())
    best = -(-total // capacity)
    upto = np.concatenate([[0], np.cumsum(counts)])
    tokens_upto = np.concatenate([[0], np.cumsum(lengths * counts)])
    for k in range(0, capacity // 2 + 1):
        big = int(upto[capacity + 1] - upto[capacity - k + 1])
        half = int(upto[capacity - k + 1] - upto[capacity // 2 + 1])
        room = half * capacity - int(tokens_upto[capacity - k + 1] - tokens_upto[capacity // 2 + 1])
        small = int(tokens_upto[capacity // 2 + 1] - tokens_upto[k]) if k else int(tokens_upto[capacity // 2 + 1])
        best = max(best, big + half + max(0, -(-(small - room) // capacity)))
    return best


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, width: int = WIDTH, nodes: int = NODES) -> Plan:
    """The plan with the fewest bins found; the first descent takes the fullest filling each time."""
    incumbent = best_fit_decreasing(counts, capacity)
    best = sum(t for _, t in incumbent)
    least = lower_bound(counts, capacity)
    if best <= least:
        return incumbent
    state, path, bins = Counts(counts), [], 0
    stack: list[list[tuple[int, ...]]] = []
    steps = 0
    while steps < nodes and best > least:
        steps += 1
        if state.total == 0:
            if bins < best:
                best, incumbent = bins, list(path)
            choices = []
        elif bins + -(-state.total // capacity) >= best:
            choices = []
        else:
            choices = fillings(state, capacity, width)[::-1]
        stack.append(choices)
        while stack and not stack[-1]:
            stack.pop()
            if path and len(path) > len(stack) - 1 >= 0:
                filling, times = path.pop()
                state.take(filling, -times)
                bins -= times
        if not stack:
            break
        filling = stack[-1].pop()
        times = times_of(state.n, filling)
        state.take(filling, times)
        bins += times
        path.append((filling, times))
    return incumbent


def piece_rows(tokenizer: str, capacity: int, end_id: int):
    """(doc_id, _row, text) to one row for each piece: its bounds in the document and the crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer)
        for batch in common.slices(batches, most=tokens.SLICE_BYTES):
            ids, at = coder.encode(*common.utf8(batch.column(2)))
            rows: list[tuple[int, int, int, int, int]] = []
            end = np.array([end_id], "<u4")
            for d in range(batch.num_rows):
                own = np.concatenate([ids[at[d] : at[d + 1]].astype("<u4"), end])
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((d, piece, start, len(part), zlib.crc32(part.tobytes())))
            d, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            took = pa.array(d)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(took), batch.column(1).take(took), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                names=["doc_id", "_row", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, width: int = WIDTH, nodes: int = NODES) -> DataFrame:
    """Packs all documents' pieces into sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the end id
    alone. A document longer than ``capacity`` is cut into full pieces and a last shorter one. A null doc_id
    stays null; repeated rows are packed each by itself. An empty table gives an empty result. Other columns
    are not read, whatever their names. Equal lengths are placed in order of a hash of the document.
    """
    spark = docs.sparkSession
    path = tokenizer or tokens.default_path()
    doc = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))).select("doc_id", "_row", "text")
    items = common.cut(doc.mapInArrow(piece_rows(path, capacity, end_id), "doc_id long, _row long, piece int, start long, length long, ids_crc32 long"), "pieces")
    found = {int(r["length"]): int(r["n"]) for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in found.items():
        counts[length] = n
    plan = complete_bins(counts, capacity, width, nodes)
    slots = spark.sparkContext.broadcast(slot_table(plan, capacity))  # a few rows for each filling; the counts bound both
    blocks = common.row_count_blocks(int(counts.sum()), BLOCK)
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("doc_id", "_row", "piece"), F.lit(blocks)))
    sizes = dealt.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_block", (F.sum("_n").over(Window.partitionBy("length").orderBy("_block")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "_row", "piece")) - 1
    ranked = dealt.withColumn("_within", within).join(before, ["length", "_block"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_within")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, first, offset = slots.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            sequence = first[at] + rank - low[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def slot_table(plan: Plan, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place of each filling: the (length, rank) from which pieces go there, that rank, the first sequence and the offset; sorted."""
    given = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for length in filling:
            rows.append(((length << 40) + int(given[length]), int(given[length]), sequence, offset))
            given[length] += times
            offset += length
        sequence += times
    rows.sort()
    key, low, first, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return key.copy(), low.copy(), first.copy(), offset.copy()


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
