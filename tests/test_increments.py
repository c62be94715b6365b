"""Rolled sender state, mergeable metrics, late rows over many batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.operators import metrics as M
from txrisk.plans.build import build_dataset
from txrisk.plans.incremental import SnapshotStore, build_increment
from txrisk.sources.testbind import TEST_SPLITS, tx_view

SF001 = "/root/testdata/sf0.001"


def rounded(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_three_increments_equal_the_full_build_without_history(spark, tmp_path):
    tx = tx_view(spark, SF001).cache()
    full = build_dataset(tx, TEST_SPLITS)
    store = SnapshotStore(spark, str(tmp_path))
    cuts = [1704067200000 + d * 86_400_000 for d in (22, 25, 27, 30)]
    for start, end in zip(cuts[:-1], cuts[1:]):
        done = store.latest()
        # history is gone: only rows from the published state on are there
        seen = tx if done is None else tx.where(F.col(S.SORT_KEY) >= done.upto_ms)
        got = build_increment(seen, start, end, TEST_SPLITS, store=store).select(*full.columns)
        want = full.where((F.col(S.SORT_KEY) >= start) & (F.col(S.SORT_KEY) < end))
        assert rounded(got) == rounded(want)
    log = store._log().orderBy("version").collect()
    assert [r.version for r in log] == [1, 2, 3]
    n = tx.where(F.col(S.SORT_KEY) < log[-1].upto_ms).count()
    assert log[-1].n_rows == n


def test_unpublished_state_is_never_read(spark, tmp_path):
    tx = tx_view(spark, SF001)
    store = SnapshotStore(spark, str(tmp_path))
    assert store.latest() is None
    t = 1704067200000 + 5 * 86_400_000
    first = store.roll(tx, t)
    # a job that died after writing its table, before its log row
    tx.limit(3).write.parquet(f"{tmp_path}/state/{t + 1}-dead")
    assert store.latest().upto_ms == t and store.latest().n_rows == first.n_rows
    again = store.roll(tx, t)  # a retry of the same step publishes nothing new
    assert store._log().count() == 1 and again.n_rows == first.n_rows
    with pytest.raises(ValueError):
        store.roll(tx, t - 1)


@pytest.mark.parametrize("rows_per_range", [10**9, 7])
def test_mergeable_metric_any_group_size(spark, rows_per_range):
    rng = np.random.default_rng(8)
    rows = [(g, None if rng.random() < 0.05 else float(np.round(rng.random(), 2)), int(rng.random() < 0.3))
            for g in ("a", "b", None) for _ in range(200)] + [("one", 0.5, 1)] * 5
    df = spark.createDataFrame(rows, "g string, score double, label int").repartition(3)
    got = {r.g: r.value for r in M.mergeable_metric(df, ["g"], M.AUC, rows_per_range=rows_per_range).collect()}
    want = {r.g: r.auc for r in M.roc_auc(M.score_curve(df, by=["g"]), ["g"]).collect()}
    assert set(got) == set(want) and got["one"] is None
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-12) if want[g] is not None else got[g] is None
    # a metric that no built-in gives: the largest gap of the two cumulative shares (KS)
    def partial(s, n, p):
        return [*np.stack([n, p]).ravel().tolist()]

    def merge(a, b):
        x, y = (np.array(v).reshape(2, -1) for v in (a, b))
        return np.concatenate([x, y], axis=1).ravel().tolist()

    def finish(s):
        n, p = np.array(s).reshape(2, -1)
        q = n - p
        return float(np.abs(np.cumsum(p) / p.sum() - np.cumsum(q) / q.sum()).max()) if p.sum() and q.sum() else None
    ks = {r.g: r.ks for r in M.mergeable_metric(df, ["g"], M.Metric(partial, merge, finish), "ks",
                                                rows_per_range=rows_per_range).collect()}
    for g in ("a", "b"):
        part = [(-1.0 if s is None else s, y) for gg, s, y in rows if gg == g]
        pos, neg = (np.array([s for s, y in part if y == v]) for v in (1, 0))
        want_ks = max(abs((pos >= t).mean() - (neg >= t).mean()) for t in {s for s, _ in part})
        assert ks[g] == pytest.approx(want_ks)


def test_late_rows_are_counted_over_more_than_a_hundred_batches(spark, tmp_path):
    from txrisk.streaming import jobs as J
    path = str(tmp_path / "in")
    for k in range(104):  # a day a batch; each batch also brings one row of the first hour
        rows = [(2 * k, k * 86_400_000), (2 * k + 1, 1_000 + k)]
        spark.createDataFrame(rows, "tx_id long, timestamp_ms long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("tx_id long, timestamp_ms long").option("maxFilesPerTrigger", 1).parquet(path)
    with J.LateRows(spark) as late:
        out = J.run_available_now(spark, J.dedup_stream(J.with_event_time(stream)).select("tx_id"), "late")
    kept = spark.read.parquet(out).count()
    assert late.dropped + kept == 208 and late.dropped >= 101
