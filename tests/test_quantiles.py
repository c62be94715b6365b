"""Selection by counts against numpy: groups, hot values, wide spans, no sort of values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators.quantiles import percentile_table

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


def check(row, x, probs=PROBS):
    x = x[~np.isnan(x)]
    if len(x) == 0:
        assert row == [None] * len(probs)
    else:
        np.testing.assert_allclose(row, np.percentile(x, [100 * p for p in probs]), rtol=1e-12, atol=0)


@pytest.mark.parametrize("few,bins", [(10_000, 4096), (0, 16), (3, 2)])
def test_groups_columns_and_hot_values(spark, few, bins):
    rng = np.random.default_rng(1)
    n = 900
    a = rng.normal(size=n)
    a[:360] = 0.25                      # 40 % of one value
    b = np.exp(rng.normal(size=n) * 200)  # spans hundreds of orders of magnitude
    b[::7] = np.nan
    g = rng.choice(["x", "y", None], n)
    c = np.where(g == "y", np.nan, rng.integers(0, 3, n).astype(float))
    pdf = pd.DataFrame({"g": g, "a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf, "g string, a double, b double, c double").repartition(3)
    cols = {"a": PROBS, "b": PROBS, "c": PROBS}
    if bins == 2:
        cols.pop("b")
    got = {r["g"]: r for r in percentile_table(df, cols, ["g"], bins=bins, few_rows=few).collect()}
    assert set(got) == {"x", "y", None}
    for key, row in got.items():
        part = pdf[pdf.g.isna() if key is None else pdf.g == key]
        for col in cols:
            check(row[col], part[col].to_numpy())


def test_infinite_null_and_empty(spark):
    rows = [(float("inf"),), (float("-inf"),), (1.5,), (None,), (float("nan"),), (-0.0,), (0.0,), (1e308,), (-1e308,)]
    df = spark.createDataFrame(rows, "x double")
    assert percentile_table(df, {"x": [0.0, 0.5, 1.0]}, few_rows=0, bins=4).first()["x"] == [float("-inf"), 0.0, float("inf")]
    assert percentile_table(df.limit(0), {"x": [0.5]}).first()["x"] == [None]
    assert percentile_table(df.limit(0).withColumn("g", F.lit(1)), {"x": [0.5]}, ["g"]).count() == 0


def test_no_task_sorts_or_holds_a_hot_value(spark, monkeypatch):
    """Every plan that is run counts per bin: no Sort, no Window, no percentile buffer,
    and a value with 40 % of the rows leaves one row per task and bin."""
    from txrisk.operators import quantiles as Q
    plans = []
    settle = Q._settle

    def spy(values, by, opens, bins, few, fields):
        plans.append(values)
        return settle(values, by, opens, bins, few, fields)
    monkeypatch.setattr(Q, "_settle", spy)
    df = spark.range(100_000).select(F.when(F.col("id") % 5 < 2, 7.0).otherwise(F.col("id") / 3.0).alias("x"))
    got = Q.percentile_table(df, {"x": [0.1, 0.5]}, few_rows=100, bins=64).first()["x"]
    x = np.where(np.arange(100_000) % 5 < 2, 7.0, np.arange(100_000) / 3.0)
    np.testing.assert_allclose(got, np.percentile(x, [10, 50]), rtol=1e-12)
    assert 2 <= len(plans) <= 6
    for p in plans:
        text = p._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in text and "Window" not in text and "percentile" not in text
