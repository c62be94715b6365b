"""Bootstrap bundle from replicate vectors against a loop over replicates."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.functions.scalar import POISSON1_CDF, replicate_weight_array, replicate_weights
from txrisk.operators.bootstrap import metric_bundle_ci
from txrisk.operators.sampling import bootstrap_weights

REPS = 40


def hashes(ids, seed=42):
    h = [hashlib.md5(f"{seed}|{i}".encode()).hexdigest() for i in ids]
    return np.array([int(x[:8], 16) for x in h]), np.array([int(x[8:16], 16) for x in h])


def test_weights_agree_and_follow_poisson(spark):
    ids = np.arange(3000)
    w = replicate_weights(*hashes(ids), REPS)
    df = spark.createDataFrame([(int(i),) for i in ids], "tx_id long")
    got = {r.tx_id: r.w for r in df.select("tx_id", replicate_weight_array(42, F.col("tx_id"), REPS).alias("w")).collect()}
    assert all(got[i] == w[i].tolist() for i in ids.tolist())
    boot = bootstrap_weights(df, REPS).groupBy("rep").agg(F.sum("w").alias("s")).collect()
    assert {r.rep: r.s for r in boot} == dict(enumerate(w.sum(axis=0).tolist()))
    share = np.bincount(w.ravel(), minlength=4)[:4] / w.size
    np.testing.assert_allclose(share, np.diff([0, *POISSON1_CDF[:4]]), atol=0.005)
    corr = np.corrcoef(w.T)
    assert np.abs(corr - np.eye(REPS)).max() < 0.1  # replicates are independent


def brute(task, score, label, ids, w):
    """Metrics of one replicate by counting pairs and walking down the rows."""
    score = np.where(np.isnan(score), -np.inf, score)
    keep = w > 0
    s, y, w, ids = score[keep], label[keep], w[keep], ids[keep]
    p, q = (w * y).sum(), (w * (1 - y)).sum()
    tp, fp = (w * y)[s > 0.5].sum(), (w * (1 - y))[s > 0.5].sum()
    fn = (w * y)[(s <= 0.5) & np.isfinite(s)].sum()
    order = np.lexsort((ids, -s))
    out = {"f1": 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0}
    if p and q:
        win = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
        out["auc"] = ((w * y)[:, None] * (w * (1 - y))[None, :] * win).sum() / (p * q)
    if p:
        ap = 0.0
        for v in np.unique(s):
            at, above = s == v, s >= v
            ap += (w * y)[at].sum() * (w * y)[above].sum() / w[above].sum()
        out["pr_auc"] = ap / p
    for k in (100, 1000):
        left, hit = k, 0
        for i in order:
            take = min(w[i], left)
            hit += take * y[i]
            left -= take
        out[f"p_at_{k}"] = hit / min(k, w.sum())
    return out


@pytest.mark.parametrize("rows_per_range", [10**9, 60])
def test_bundle_matches_a_loop_over_replicates(spark, rows_per_range):
    rng = np.random.default_rng(3)
    n = 260
    rows = []
    for run in ("a", "b"):
        for task in ("revert", "mev", "drop"):
            y = (rng.random(n) < 0.2).astype(int)
            y[rng.random(n) < 0.1] = -1 if task != "mev" else 0
            s = np.round(rng.random(n) * 0.7 + 0.3 * np.maximum(y, 0), 2 if run == "a" else 6)
            s[: n // 3] = 0.5  # a third of the rows share a score
            s[-4:] = np.nan
            rows += [(run, task, i, None if np.isnan(x) else float(x), int(l)) for i, (x, l) in enumerate(zip(s, y))]
    rows += [("c", "mev", i, 0.1, 0) for i in range(30)] + [("c", "drop", i, 0.1, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "run_id string, task string, tx_id long, score double, label int").repartition(3)
    got = {(r.run_id, r.metric): tuple(r)[3:] for r in
           metric_bundle_ci(df, REPS, 42, by=["run_id"], rows_per_range=rows_per_range).collect()}
    want = {}
    names = {"revert": ["f1", "auc"], "drop": ["f1", "auc"], "mev": ["pr_auc", "p_at_100", "p_at_1000"]}
    for run in ("a", "b"):
        for task, metrics in names.items():
            part = [r for r in rows if r[:2] == (run, task) and r[4] >= 0]
            ids = np.array([r[2] for r in part])
            s = np.array([np.nan if r[3] is None else r[3] for r in part])
            y = np.array([r[4] for r in part])
            w = replicate_weights(*hashes(ids), REPS)
            point = brute(task, s, y, ids, np.ones(len(ids), int))
            reps = [brute(task, s, y, ids, w[:, b]) for b in range(REPS)]
            for m in metrics:
                v = [r[m] for r in reps if m in r]
                want[run, f"{task}_{m}"] = (point[m], *np.percentile(v, [2.5, 97.5]))
    assert set(got) == set(want)  # run c fails both guards
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, rtol=1e-9, err_msg=str(k))


def test_grouped_bundle_reads_its_rows_once(spark):
    """The shared counts and top rows give what each metric alone gives from the rows, and no
    metric reads the rows themselves."""
    from txrisk.operators import bootstrap as B
    rng = np.random.default_rng(8)
    rows = [("a", task, i, float(np.round(rng.random(), 2)), int(rng.random() < 0.3))
            for task in ("revert", "mev", "drop") for i in range(150)]
    rows += [("a", "drop", 999, None, 1)]
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "run_id string, task string, tx_id long, score double, label int")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = {(r.task, r.metric): tuple(r)[3:] for r in
           metric_bundle_ci(df.mapInArrow(count, df.schema), 20, 42, by=["run_id"], method="grouped").collect()}
    assert seen.value == 2 * len(rows)  # counts and top rows
    for task, metrics in B.CI_BUNDLE.items():
        for m in metrics:
            base, k = ("p_at_k", int(m.split("_")[-1])) if m.startswith("p_at_") else (m, 100)
            want = B.grouped_bootstrap_ci(df.where(F.col("task") == task), base, 20, 0.95, 42, ["run_id", "task"], k).first()
            np.testing.assert_allclose(got[task, f"{task}_{B._NAMES[m]}"], tuple(want)[2:], rtol=1e-9)
