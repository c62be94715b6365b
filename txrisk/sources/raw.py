"""Raw event scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import schema as S


def read_raw(spark: SparkSession, path: str, start_ms: int | None = None,
             end_ms: int | None = None) -> DataFrame:
    """Scan a directory of raw parquet with an explicit schema.

    Only the model's columns are read (column pruning) and the half-open
    time range is a pushed parquet filter, so row groups outside it are skipped.
    """
    df = spark.read.schema(S.RAW_SCHEMA).parquet(path)
    return time_range(df, start_ms, end_ms).select("tx_id", *S.RAW_COLUMNS)


def time_range(df: DataFrame, start_ms: int | None, end_ms: int | None,
               ts: str = S.SORT_KEY) -> DataFrame:
    """[start, end) filter."""
    if start_ms is not None:
        df = df.where(F.col(ts) >= F.lit(start_ms))
    if end_ms is not None:
        df = df.where(F.col(ts) < F.lit(end_ms))
    return df


def smoke_slice(df: DataFrame, n: int, ts: str = S.SORT_KEY, key: str = "tx_id") -> DataFrame:
    """The first n rows in (ts, key) order.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps
    its own top n, so no task sorts the whole table.
    """
    return df.orderBy(F.col(ts), F.col(key)).limit(n)
