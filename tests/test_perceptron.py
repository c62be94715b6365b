"""The perceptron's passes against MLlib's own fit."""

import numpy as np
import pytest

from txrisk.operators import baselines as B
from txrisk.operators import perceptron as P


class _Features:
    columns = ["a", "b", "c"]


def _rows(spark, n=700):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1]
    y = (x[:, 0] + 0.1 * x[:, 1] ** 2 + rng.normal(size=n) > 2).astype(float)
    rows = [(*map(float, r), float(v), float(1 - v), -1.0 if i % 7 == 0 else float(v)) for i, (r, v) in enumerate(zip(x, y))]
    rows[3] = (None, *rows[3][1:])
    return spark.createDataFrame(rows, "a double, b double, c double, is_reverted double, is_mev_victim double, "
                                       "is_dropped double").repartition(3).cache()


def test_weights_equal_mllibs_fit(spark, monkeypatch):
    """Same steps as MLlib on the same partitions, and MLlib itself only starts and holds the models."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    df = _rows(spark)
    passes = []
    real = P.objective
    monkeypatch.setattr(P, "objective", lambda rows, *a: passes.append(rows.count()) or real(rows, *a))
    models = B.fit_mlp(df, _Features, hidden=8, max_iter=6)
    assert passes == [700, 700, 600]
    stats = B.standardize_stats(df, _Features.columns).first()
    for task, lab in (("revert", "is_reverted"), ("drop", "is_dropped")):
        d = df.where(f"{lab} >= 0").select(*_Features.columns, lab)
        want = Pipeline(stages=[*B._standardized(stats, _Features.columns, task), MultilayerPerceptronClassifier(
            **B._outputs(task), labelCol=lab, layers=[3, 8, 8, 2], maxIter=6, seed=42)]).fit(d).stages[-1].weights.toArray()
        np.testing.assert_allclose(models[task].stages[-1].weights.toArray(), want, rtol=1e-6, atol=1e-8)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    layers = [3, 4, 4, 2]
    flat, x = rng.normal(size=46), rng.normal(size=(9, 3))
    y, w = rng.integers(0, 2, 9), rng.random(9)
    grad = np.zeros(46)
    P.add_gradient(flat, layers, x, y, w, grad)
    for i in (0, 13, 30, 45):
        step = np.zeros(46)
        step[i] = 1e-6
        up, down = (P.add_gradient(flat + s, layers, x, y, w, np.zeros(46)) for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, rel=1e-5, abs=1e-8)


def test_rows_are_spread_over_cores(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_TASK", 100)
    one = spark.range(0, 700, 1, 1)
    assert P.spread(one).rdd.getNumPartitions() == 7
    assert P.spread(spark.range(0, 50, 1, 1)).rdd.getNumPartitions() == 1
    assert P.spread(spark.range(0, 50, 1, 40)).rdd.getNumPartitions() == 8


def test_heads_are_fitted_side_by_side(spark, monkeypatch):
    """All three fits are under way at once: each waits for the others."""
    from threading import Barrier
    meet = Barrier(3)
    monkeypatch.setattr(P, "minimize", lambda f, x, n: [meet.wait(60), f(x), x][-1])
    models = B.fit_mlp(_rows(spark), _Features, hidden=4, max_iter=1)
    assert list(models) == ["revert", "mev", "drop"]


def test_packed_rows_come_back_whole_and_in_order(spark):
    rows = _rows(spark, 1500).na.fill(0.0).select("c", "a", "is_dropped")
    parts = P.packed(rows, "is_dropped").rdd.glom().collect()
    plain = rows.rdd.glom().collect()
    for records, want in zip(parts, plain, strict=True):
        x, y = (np.concatenate([np.frombuffer(r[c], kind) for r in records]) for c, kind in (("x", float), ("y", np.int64)))
        np.testing.assert_array_equal(np.column_stack([x.reshape(-1, 2), y]), np.array(want))
        assert [len(r["y"]) // 8 for r in records[:-1]] == [P.CHUNK] * (len(records) - 1)


def test_scores_equal_mllibs(spark, monkeypatch):
    """Rows are scored in batches, as MLlib scores them one by one; NULL and NaN inputs too."""
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    df = _rows(spark).withColumn("tx_id", F.monotonically_increasing_id())
    df = df.withColumn("b", F.when(F.col("tx_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("b")))
    models = B.fit_mlp(df, _Features, hidden=8, max_iter=3)
    want = df
    for m in models.values():
        want = m.transform(want)
    want = want.select("tx_id", "is_dropped", *[vector_to_array(f"_{t}_prob")[1].cast("float") for t in models]).collect()

    def never(*_):
        raise AssertionError("rows go through MLlib one by one")
    monkeypatch.setattr(MultilayerPerceptronClassificationModel, "transform", never)
    got = B.score_models(models, df, ["tx_id", "is_dropped"])
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("tx_id", "bigint"), ("is_dropped", "double"), *[(f"{t}_score", "float") for t in models]]
    got, want = (np.array(sorted(map(tuple, rows))) for rows in (got.collect(), want))
    assert got.shape == (700, 5)
    np.testing.assert_array_equal(got[:, :2], want[:, :2])
    np.testing.assert_allclose(got[:, 2:], want[:, 2:], rtol=1e-6)


def test_query_scores_each_row_once(spark, monkeypatch, tmp_path):
    """Metrics read stored scores: the networks see a test row once."""
    from datetime import datetime, timedelta
    from pyspark.sql import functions as F
    from txrisk.plans.q_more import q_mlp
    first = datetime(2024, 1, 1, 1)
    events = [(i, first + timedelta(hours=i), i % 7, "view", float(i % 11), '{"k": %d}' % (i % 13)) for i in range(700)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(str(tmp_path / "events.parquet"))
    seen = spark.sparkContext.accumulator(0)
    fit, score = B.fit_mlp, B.score_models

    @F.udf("float")
    def tally(x):
        seen.add(1)
        return x
    monkeypatch.setattr(B, "fit_mlp", lambda train: fit(train, hidden=4, max_iter=1))
    monkeypatch.setattr(B, "score_models", lambda m, d, keep: score(m, d, keep).withColumn("revert_score", tally("revert_score")))
    metrics = {r.metric: r.value for r in q_mlp(spark, str(tmp_path)).collect()}
    assert len(metrics) == 9 and 0 <= metrics["revert_auc"] <= 1
    assert seen.value == 700 - 26 * 24 + 1  # hours from January 27 on
