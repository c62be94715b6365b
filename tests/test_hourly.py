"""The stored table with hourly pressure."""

import datetime as dt

from pyspark.sql import functions as F

from txrisk.plans import q_build as B


def test_hourly_table_holds_what_slices_read(spark, tmp_path):
    """Pressure of the last hour over all events, and no feature column joined or stored beside it."""
    t0 = dt.datetime(2024, 1, 26, 22)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), i % 5, ["purchase", "view", "click"][i % 3], 1.5 * i, f'{{"k": {i % 30}}}')
            for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
         .write.parquet(str(tmp_path / "events.parquet"))
    out = B.dataset_hourly(spark, str(tmp_path))
    assert set(out.columns) == {*B.HOURLY_COLS, "hour_pressure"}
    want = {i: float(min(i, 60 // 7)) for i in range(60)}
    assert {r.tx_id: r.hour_pressure for r in out.collect()} == want
    full = B.dataset(spark, str(tmp_path)).select(*B.HOURLY_COLS)
    assert out.select(*B.HOURLY_COLS).exceptAll(full).isEmpty() and full.count() == out.where(F.col("split").isNotNull()).count()


def test_runs_are_made_after_the_join(spark, tmp_path, monkeypatch):
    """The stored scores of every run, copies of a key included, from one join of one row per transaction."""
    import re
    from txrisk.plans import q_metrics as Q
    from txrisk.operators.baselines import rule_scores
    from txrisk.sources.testbind import BLEND_RUNS, blend_scores
    t0 = dt.datetime(2024, 1, 20)
    rows = [(i, t0 + dt.timedelta(hours=4 * i), i % 5, "purchase", 1.5 * i, f'{{"k": {i % 30}}}') for i in range(60)]
    rows += rows[:3]  # keys that come twice
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
         .write.parquet(str(tmp_path / "events.parquet"))
    plans = []
    write = Q.write_scores
    monkeypatch.setattr(Q, "write_scores", lambda df, path, **kw: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or write(df, path, **kw))
    names = ["run_id", "tx_id", "revert_score", "mev_score", "drop_score", "split"]
    got = spark.read.parquet(Q.score_table(spark, str(tmp_path))).select(names)
    ds = B.dataset(spark, str(tmp_path))
    want = rule_scores(ds, Q.rule_thresholds(spark, str(tmp_path), ds)).withColumn("run_id", F.lit("rules"))
    for r, w in BLEND_RUNS.items():
        want = want.unionByName(blend_scores(ds, r, w))
    want = want.join(ds.select("tx_id", "split"), "tx_id").selectExpr(
        "run_id", "tx_id", *[f"cast({n} AS double) {n}" for n in names[2:5]], "split")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert len(re.findall(r"\bJoin Inner", plans[0])) == 1 and "Union" not in plans[0]
