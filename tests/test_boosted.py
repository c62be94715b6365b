"""Boosted trees stopped by a ranking metric, and models as tables and expressions."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array

from tests.test_metrics import _ap_brute, _auc_brute
from txrisk import schema as S
from txrisk.operators import boosted as B
from txrisk.operators.baselines import _assembler, fit_logreg, score_models

COLS = ["a", "b", "c"]


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 1.5 * rng.normal(size=n) > 1).astype(float)
    y[rng.random(n) < 0.1] = -1
    return pd.DataFrame({"tx_id": np.arange(n), **dict(zip(COLS, x.T)), "is_reverted": y, "is_mev_victim": y})


class _Features:
    columns = COLS


def _small(train, val, **kw):
    return B.fit_ranked_gbt(train, val, _Features, max_depth=3, min_instances=5, step=0.3,
                            **{"tasks": {"revert": "is_reverted", "mev": "is_mev_victim"}, **kw})


def test_rounds_equal_a_scan_over_mllib_fits(spark):
    """The chosen round is the one that a plain scan over MLlib's rounds finds, and
    the margins are MLlib's, NaN included."""
    from pyspark.ml.classification import GBTClassifier
    tr, va = _rows(500, 1), _rows(300, 2)
    va.loc[3, "a"] = np.nan
    train, val = spark.createDataFrame(tr), spark.createDataFrame(va)
    fits = _small(train, val, max_iter=16, patience=4, block=3)
    known = va[va.is_reverted >= 0]
    y = known.is_reverted.to_numpy().astype(int)
    for task, brute in (("revert", _auc_brute), ("mev", _ap_brute)):
        f = fits[task]
        values, best = [], 0
        d = train.where("is_reverted >= 0")
        pos = tr[tr.is_reverted >= 0].is_reverted
        assert f.pos_weight == (pos == 0).sum() / (pos == 1).sum()
        d = _assembler(COLS).transform(d.selectExpr("*", f"CASE WHEN is_reverted = 1 THEN {f.pos_weight} ELSE 1.0 END AS weight"))
        m = GBTClassifier(featuresCol="features", labelCol="is_reverted", weightCol="weight", maxDepth=3, maxIter=16,
                          stepSize=0.3, minInstancesPerNode=5, subsamplingRate=0.9, featureSubsetStrategy="0.9",
                          seed=42, maxBins=64).fit(d)
        trees = B.read_trees(spark, m, COLS)
        margin = np.zeros(len(known))
        for out in trees.outputs(known[COLS].to_numpy()):
            margin += out
            values.append(brute(margin, y))
        stop = next((i for i in range(1, 17) if i - (int(np.argmax(values[:i])) + 1) >= 4), 16)
        best = int(np.argmax(values[:stop])) + 1
        assert (f.best, len(f.values), f.model.rounds) == (best, stop, best)
        assert f.values == pytest.approx(values[:stop], abs=1e-12)
        mine = _assembler(COLS).transform(val.where("is_reverted >= 0").orderBy("tx_id"))
        want = {r.tx_id: r.p for r in m.transform(mine).select("tx_id", vector_to_array("probability")[1].alias("p")).collect()}
        got = {r.tx_id: r.x_score for r in B.tree_scores(val, {"x": trees}).collect()}
        assert all(abs(got[i] - p) < 1e-6 for i, p in want.items()) and len(got) == len(va)


def test_doubling_blocks_give_the_rounds_of_one_fit(spark):
    train, val = spark.createDataFrame(_rows(400, 3)), spark.createDataFrame(_rows(200, 4))
    few = {"tasks": {"revert": "is_reverted"}}
    a = _small(train, val, max_iter=12, patience=12, block=50, **few)["revert"]
    b = _small(train, val, max_iter=12, patience=3, block=2, **few)["revert"]
    n = len(b.values)
    assert a.values[:n] == pytest.approx(b.values, abs=1e-12) and b.best == B.best_round(a.values[:n])


def test_blocks_end_at_the_most_rounds(spark, monkeypatch):
    """24 rounds at patience 8 are one fit, not one of 16 and then one of 24; margins are only carried to rounds
    that are looked at."""
    from pyspark.ml.classification import GBTClassifier
    fits, carried = [], []
    real, go_on = GBTClassifier.fit, B.advance
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, d: fits.append(self.getMaxIter()) or real(self, d))
    monkeypatch.setattr(B, "advance", lambda *a: carried.append(a[2:]) or go_on(*a))
    train, val = spark.createDataFrame(_rows(400, 3)), spark.createDataFrame(_rows(200, 4))
    f = _small(train, val, max_iter=6, patience=2, block=4, tasks={"revert": "is_reverted"})["revert"]
    assert fits == [6] and carried == ([(0, 4)] if len(f.values) > 4 else [])
    assert [B.first_block(*x) for x in ((24, 8), (1000, 50), (12, 3), (16, 4), (5, 8), (1, 0), (0, 4))] == [
        24, 125, 6, 8, 5, 1, 0]


def test_undefined_metric_and_best_round():
    assert B.best_round([None, None]) == 1 and B.best_round([]) == 0
    assert B.best_round([0.4, None, 0.5, 0.5]) == 3


def test_trees_as_table_and_sql(spark, tmp_path, monkeypatch):
    train, val = spark.createDataFrame(_rows(400, 5)), spark.createDataFrame(_rows(150, 6))
    f = _small(train, val, max_iter=4, patience=4, tasks={"revert": "is_reverted"})["revert"].model
    monkeypatch.setattr(S, "TASKS", {"revert": "is_reverted"})
    B.save_trees({"revert": f}, spark, str(tmp_path / "m"))
    back = B.load_trees(spark, str(tmp_path / "m"))["revert"]
    want = {r.tx_id: r.revert_score for r in B.tree_scores(val, {"revert": f}).collect()}
    assert {r.tx_id: r.revert_score for r in B.tree_scores(val, {"revert": back}).collect()} == want
    t = val.toPandas()  # noqa: F841 (read by name below)
    sql = duckdb.sql(f"SELECT tx_id, {back.sql()} AS s FROM t").fetchall()
    assert all(abs(want[i] - s) < 1e-6 for i, s in sql) and len(sql) == len(want)
    assert B.tree_scores(val.limit(0), {"revert": f}).count() == 0


def test_linear_heads_score_as_expressions(spark, monkeypatch):
    """MLlib's vectors, Spark expressions and DuckDB give the same scores; NULL and NaN count as the mean."""
    monkeypatch.setattr(S, "TASKS", {"revert": "is_reverted"})
    train, va = spark.createDataFrame(_rows(400, 7)), _rows(100, 8)
    va.loc[5, "b"] = np.nan
    val = spark.createDataFrame(va).selectExpr("tx_id", "a", "b", "CASE WHEN tx_id <> 7 THEN c END AS c")
    models = fit_logreg(train, _Features)
    heads = B.linear_table(train, models, COLS).collect()
    df = B.linear_scores(val, heads)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.tx_id: r.revert_score for r in df.collect()}
    want = {r.tx_id: r.revert_score for r in score_models(models, val).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    t = val.toPandas()  # noqa: F841
    sql = duckdb.sql(f"SELECT tx_id, {B.linear_sql(heads, 'revert')} AS s FROM t").fetchall()
    assert all(abs(got[i] - s) < 1e-6 for i, s in sql)
