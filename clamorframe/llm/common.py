"""What the corpus operators share: scratch tables, batch slicing and input checks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; temporaries are about thirty times this.
SLICE_BYTES = 2 << 20

#: Bytes of text that go to Python in one Arrow batch; Spark's own bound is by rows, however long they are.
BATCH_BYTES = 4 << 20

_own_tables: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one where none is set and all tasks run in this process."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="clamorframe-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, label: str = "cut", codec: str = "snappy") -> DataFrame:
    """Writes ``df`` to a table in the shared folder and returns the table: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _own_tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._clamorframe_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes a table of ``cut`` that nothing will read again."""
    path = getattr(df, "_clamorframe_path", None)
    if path:
        _delete(df.sparkSession, path)
        _own_tables[:] = [x for x in _own_tables if x[1] != path]


def cuts_made(function: Callable[[], DataFrame]) -> tuple[DataFrame, list[tuple[SparkSession, str]]]:
    """What ``function`` returns, and the tables that it cut on the way."""
    before = set(_own_tables)
    out = function()
    return out, [x for x in _own_tables if x not in before]


def drop_tables(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        _delete(spark, path)
    _own_tables[:] = [x for x in _own_tables if x not in tables]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_own_tables() -> None:
    for spark, path in _own_tables:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps before the next one writes its own."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)  # the cleaner works beside


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Returns freed memory to the machine: an idle Python worker otherwise keeps what its last task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``most`` bytes of text each; a longer text is a slice of its own. Memory is given back behind the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and where each begins; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data_buffer is None or not data_buffer.size:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(data_buffer, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Rows of a table of keys up to which it is broadcast; beyond, the join shuffles and Spark splits skewed keys.
BROADCAST_ROWS = 20_000


def join_keys(rows: DataFrame, keys: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Joins many rows, some keys of which may be very frequent, with a table of ``cut`` of one row a key. Null equals null.

    The key table is read from disk, so on either way both inputs of a shuffled join are plain exchanges,
    whose skewed partitions Spark splits.
    """
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    right = keys.select(*(F.col(n).alias(f"{n}__key") for n in names), *(c for c in keys.columns if c not in names))
    on = [rows[n].eqNullSafe(right[f"{n}__key"]) for n in names]
    return rows.join(right, on, how).drop(*(f"{n}__key" for n in names))


def wrapped(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``doc``, so that no column of the input clashes with those that are added; _row as in ``with_row_key``."""
    return with_row_key(docs.select(F.struct("*").alias("doc")))


#: Steps of a plan that give a task its rows in the same order each time.
STEADY = {"Project", "Filter", "SubqueryAlias", "View", "Union", "LogicalRelation", "LocalRelation", "LogicalRDD", "OneRowRelation"}


def is_plain(docs: DataFrame) -> bool:
    """Whether a frame is nothing but tables' rows, chosen and projected."""
    nodes = [docs._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in STEADY:
            return False
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return True


def with_row_key(docs: DataFrame, name: str = "_row") -> DataFrame:
    """A key for each row, also for rows that are equal in all columns. What is no plain table, as rows behind a shuffle, whose order a rerun may change, is written to one first."""
    bound_batches(docs.sparkSession)
    if not is_plain(docs):
        docs = cut(docs, "input")
    return docs.withColumn(name, F.monotonically_increasing_id())


def row_count_blocks(n_rows: int, block: int) -> int:
    return max(1, -(-n_rows // block))
