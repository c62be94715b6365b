"""Incremental build of one time slice.

State before the slice comes from a per-sender snapshot (one aggregate over
history, pruned to two columns) and a look-back of raw rows for the time
features; the slice's rows are then trimmed back.  Equal to the full build
restricted to the slice.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.operators.features import build_features, plan_time_ranges
from txrisk.operators.labels import assign_split, with_labels
from txrisk.schema import SplitRanges


def sender_snapshot(tx: DataFrame, before_ms: int, history_start_ms: int | None = None) -> DataFrame:
    """A1: (from_addr, _pre_count, _pre_gas_sum) over rows with ts < before_ms.

    Partial + final hash aggregate: a hot sender is combined map-side first.
    """
    h = tx.where(F.col(S.SORT_KEY) < F.lit(before_ms))
    if history_start_ms is not None:
        h = h.where(F.col(S.SORT_KEY) >= F.lit(history_start_ms))
    return (h.where(F.col("from_addr").isNotNull())
             .groupBy("from_addr")
             .agg(F.count(F.lit(1)).alias("_pre_count"),
                  F.sum(F.log1p(F.col("gas_price").cast("double") / 1e9)).alias("_pre_gas_sum")))


def unique_senders(snapshot: DataFrame) -> DataFrame:
    """Number of distinct senders in a snapshot."""
    return snapshot.agg(F.count_distinct("from_addr").alias("unique_senders"))


@dataclass(frozen=True)
class State:
    """Sender state of all rows before ``upto_ms`` and how many rows these are."""
    upto_ms: int
    n_rows: int
    senders: DataFrame


class SnapshotStore:
    """A1 rolled forward: versions of the sender state under one folder.

    A version is a table of its own; it counts once its row stands in the log, which
    is appended after the table is complete (one small file, put in place whole by the
    writer's commit).  A reader therefore sees the version before or the new one,
    and a job that died in between has published nothing.
    """

    _LOG = "version long, upto_ms long, n_rows long, path string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._LOG).parquet(f"{self.root}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self._LOG)

    def latest(self, upto_ms: int | None = None) -> State | None:
        """The newest published state, or the one of exactly ``upto_ms``."""
        log = self._log()
        if upto_ms is not None:
            log = log.where(F.col("upto_ms") == upto_ms)
        r = log.orderBy(F.desc("version")).first()
        return None if r is None else State(r["upto_ms"], r["n_rows"], self.spark.read.parquet(r["path"]))

    def publish(self, upto_ms: int, n_rows: int, senders: DataFrame) -> State:
        path = f"{self.root}/state/{upto_ms}-{uuid.uuid4().hex}"
        senders.write.parquet(path)
        version = (self._log().agg(F.max("version")).first()[0] or 0) + 1
        self.spark.createDataFrame([(version, upto_ms, n_rows, path)], self._LOG).coalesce(1) \
            .write.mode("append").parquet(f"{self.root}/log")
        return self.latest(upto_ms)

    def roll(self, rows: DataFrame, upto_ms: int) -> State:
        """Merge the rows in [latest, upto_ms) into the latest state; only these are
        read.  The first call takes all rows before ``upto_ms``."""
        done = self.latest()
        if done is not None and done.upto_ms >= upto_ms:
            known = self.latest(upto_ms)
            if known is None:
                raise ValueError(f"state is already at {done.upto_ms}, past {upto_ms}")
            return known
        new = rows if done is None else rows.where(F.col(S.SORT_KEY) >= done.upto_ms)
        n = new.where(F.col(S.SORT_KEY) < upto_ms).count() + (done.n_rows if done else 0)
        part = sender_snapshot(new, upto_ms)
        if done is not None:
            part = part.unionByName(done.senders).groupBy("from_addr").agg(
                F.sum("_pre_count").alias("_pre_count"), F.sum("_pre_gas_sum").alias("_pre_gas_sum"))
        return self.publish(upto_ms, n, part)


def build_increment(tx: DataFrame, start_ms: int, end_ms: int, splits: SplitRanges = SplitRanges(),
                    lookback_ms: int = S.LOOKBACK_MS, hash_fn: str = "md5",
                    rows_per_range: int | None = None, store: SnapshotStore | None = None) -> DataFrame:
    """The rows of [start_ms, end_ms) as the full build gives them.

    Without ``store`` the state before the slice is computed from all of ``tx``'s
    history.  With it, ``tx`` is read from the last published state on only, and
    the state is rolled to the start of this slice's look-back.
    """
    load_start = start_ms - lookback_ms
    chunk = tx.where((F.col(S.SORT_KEY) >= F.lit(load_start)) & (F.col(S.SORT_KEY) < F.lit(end_ms)))
    if store is not None:
        state = store.roll(tx, load_start)
        snap, n_before = state.senders, state.n_rows
    else:
        snap = sender_snapshot(tx, load_start)
        n_before = tx.where(F.col(S.SORT_KEY) < F.lit(load_start)).count()
    ranges = plan_time_ranges(chunk, rows_per_range)
    # rows before the look-back shift the row index, and when there are
    # any, an empty look-back means the true gap exceeds the 300 s clip
    feats = build_features(chunk, ranges, hash_fn, snapshot=snap,
                           keep=["receipt_status", "mev_type", "included_at_block_height"],
                           first_delta=S.DELTA_CLIP_MAX if n_before else 0.0)
    feats = feats.withColumn("row_idx", F.col("row_idx") + F.lit(n_before))
    out = with_labels(feats, splits)
    out = out.where((F.col(S.SORT_KEY) >= F.lit(start_ms)) & (F.col(S.SORT_KEY) < F.lit(end_ms)))
    return assign_split(out, splits)


def append_increment(existing: DataFrame, increment: DataFrame) -> DataFrame:
    """Stack a new slice under earlier output; columns matched by name,
    types widened, columns missing on one side filled with NULL."""
    return existing.unionByName(increment, allowMissingColumns=True)
