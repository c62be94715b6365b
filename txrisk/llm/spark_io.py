"""Small helpers shared by the operators: intermediate tables and Arrow slices."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.session import checkpoint_dir

#: Whether a query's shuffle files go when it ends, not when the driver's garbage collector meets them.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and reread it.

    Cuts the lineage: a lost executor costs the tasks that ran on it, never
    the steps before.  Files stay until ``discard`` or until the folder is cleaned
    by its owner.
    """
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialize``, and the folder it wrote.

    The shuffle files of the write are deleted when it ends: what follows reads
    the table, and a lost executor's tasks are done again while it runs.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that ``stored`` wrote, once nothing reads them any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Mark a small side for broadcast if it has at most ``most`` rows of a few
    bytes; beyond that the join shuffles both sides.  ``df`` should be cheap to
    count (a materialized table)."""
    return F.broadcast(df) if df.count() <= most else df


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def utf8_len(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def give_back() -> None:
    """Return memory that this worker has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A task function over record batches that gives memory back when it ends:
    Spark keeps idle workers, beside the tasks of the next stage."""
    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return whole


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of rows with about ``limit`` bytes of text.

    Yields (rows, bytes of the texts one after another, offsets of each text
    with the end).  A null text counts as empty; a text longer than ``limit``
    makes a run of its own, whole.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(column)
        lens = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run, size = 0, 0
        for i, n in enumerate(lens.tolist() + [None]):
            if n is None or (size and size + n > limit):
                part = pc.fill_null(texts.slice(run, i - run).cast(pa.large_string()), "")
                _, off, data = part.buffers()
                off = np.frombuffer(off, np.int64)[part.offset:part.offset + len(part) + 1]
                buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
                yield batch.slice(run, i - run), buf[off[0]:off[-1]], off - off[0]
                run, size = i, 0
            size += n or 0


def fresh_name(taken: list[str], base: str) -> str:
    """A column name that is not among ``taken`` (compared as Spark does, without case)."""
    have, name = {c.lower() for c in taken}, base
    while name.lower() in have:
        name += "_"
    return name
