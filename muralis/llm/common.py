"""Shared plumbing of the corpus operators: tables, the shared folder, Arrow text buffers."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_SHARED = "file:///tmp/muralis-shared"

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it's unset, the warehouse, or a
    local folder if the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = LOCAL_SHARED if re.match(r"local(\[|$)", spark.sparkContext.master) else spark.conf.get("spark.sql.warehouse.dir")
    return (named if "://" in named or named.startswith("file:") else f"file://{named}").rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; removed again when the driver's Python ends."""
    path = f"{shared_dir(spark)}/muralis/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget, spark)
    _made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession) -> None:
    try:
        for path in filter(None, _made):
            _delete(spark, path)
    except Exception:  # the session may be gone by then; the files are only scratch
        pass


def mark() -> int:
    """A point in time for ``release_since``."""
    return len(_made)


def release_since(spark: SparkSession, start: int, stop: int) -> None:
    """Delete what was stashed between two marks; nothing may read it any more."""
    for i in range(start, stop):
        if _made[i]:
            _delete(spark, _made[i])
            _made[i] = ""


def release(*tables: DataFrame | None) -> None:
    """Delete stashed tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "stashed_at", None)
        if path in _made:
            _delete(t.sparkSession, path)
            _made[_made.index(path)] = ""


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, so that a lost
    executor costs at most the tasks of one step, and no later step recomputes an earlier one."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Inside, texts reach Python in batches of ``size`` bytes: numpy's arrays are some fifty times their text.  Only
    the cut into batches changes, never a result.  Holds for jobs that run inside; the session's setting returns."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``, inside a single expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's identifying columns; nulls count, so rows with null ids have keys too."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array end to end, and the n+1 offsets of its values; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if texts.null_count:
        sizes = np.where(np.asarray(texts.is_valid()), np.diff(at), 0)
        if sizes.sum() != at[-1] - at[0]:  # nulls may own bytes
            return text_buffer(pa.array([x or b"" for x in texts.to_pylist()], pa.large_binary()))
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text in ``column``, one row at least."""
    texts = batch.column(column).cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
