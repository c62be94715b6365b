"""Metric operators against brute-force definitions (ties included)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators import metrics as M
from txrisk.operators.calibrate import best_f1_threshold
from txrisk.operators.scan import plan_ranges, running_totals
from txrisk.operators.slices import day_of


def _auc_brute(s, y):
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def _ap_brute(s, y):
    P = y.sum()
    ap = 0.0
    for t in np.unique(s):
        sel = s >= t
        prec = y[sel].sum() / sel.sum()
        ap += prec * y[s == t].sum() / P
    return ap


def _scored(spark, n=600, seed=3, levels=15):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.2).astype(int)
    s = np.round(rng.random(n) * 0.6 + 0.4 * y * rng.random(n), 2)
    s = np.floor(s * levels) / levels  # heavy ties
    g = np.where(rng.random(n) < 0.5, "a", "b")
    pdf = pd.DataFrame({"tx_id": np.arange(n), "score": s, "label": y.astype(float), "grp": g})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("rows_per_range", [2_000_000, 3])
def test_auc_ap_match_brute_force_with_ties(spark, rows_per_range):
    df, pdf = _scored(spark)
    curve = M.score_curve(df, "score", "label", ["grp"], rows_per_range=rows_per_range)
    auc = M.roc_auc(curve, ["grp"]).toPandas().set_index("grp")["auc"]
    ap = M.average_precision(curve, ["grp"]).toPandas().set_index("grp")["ap"]
    for g, part in pdf.groupby("grp"):
        s, y = part["score"].to_numpy(), part["label"].to_numpy().astype(int)
        assert auc[g] == pytest.approx(_auc_brute(s, y), abs=1e-12)
        assert ap[g] == pytest.approx(_ap_brute(s, y), abs=1e-12)


def test_pr_curve_has_terminal_point(spark):
    df, pdf = _scored(spark)
    pts = M.pr_curve(M.score_curve(df, "score", "label"), "score").toPandas()
    assert len(pts) == pdf["score"].nunique() + 1
    term = pts[pts["threshold"].isna()].iloc[0]
    assert (term["precision"], term["recall"]) == (1.0, 0.0)
    top = pts.dropna().sort_values("threshold").iloc[0]
    assert top["recall"] == pytest.approx(1.0)


def test_precision_recall_at_k_clamp_and_ties(spark):
    df, pdf = _scored(spark, n=80)
    hits = M.top_k_hits(df, [10, 100], "score", "label", [], "tx_id").first()
    order = pdf.sort_values(["score", "tx_id"], ascending=[False, True])
    assert hits["hits_10"] == order["label"].iloc[:10].sum()
    assert hits["hits_100"] == order["label"].sum()  # k > n clamps to n
    p = df.agg(M.precision_at_k(F.lit(hits["hits_100"]), 100, F.count(F.lit(1))).alias("p")).first()["p"]
    assert p == pytest.approx(order["label"].mean())


def test_metric_bundle_guards(spark):
    rows = [(i, "revert", 0.9 if i % 2 else 0.1, float(i % 2)) for i in range(9)]  # < 10 valid
    rows += [(100 + i, "mev", 0.5, 0.0) for i in range(20)]  # no positive
    rows += [(200 + i, "drop", 0.7, 1.0) for i in range(12)]  # single class
    rows += [(300, "drop", 0.2, -1.0)]  # censored, masked
    df = spark.createDataFrame(rows, "tx_id long, task string, score double, label double")
    out = {r["metric"]: r["value"] for r in M.metric_bundle(df).collect()}
    assert not any(k.startswith("revert") or k.startswith("mev") for k in out)
    assert out == {"drop_f1": 1.0}  # no AUC with a single class


def test_best_f1_threshold_matches_sweep(spark):
    df, pdf = _scored(spark)
    got = best_f1_threshold(df).first()
    s, y = pdf["score"].to_numpy(), pdf["label"].to_numpy()
    best, arg = -1, None
    for t in sorted(np.unique(s), reverse=True):
        pred = s >= t
        tp = (pred & (y == 1)).sum()
        f1 = 2 * tp / (pred.sum() + y.sum())
        if f1 > best:
            best, arg = f1, t
    assert got["threshold"] == pytest.approx(arg)
    assert got["best_f1"] == pytest.approx(best)
    few = spark.createDataFrame([(1, 0.3, 0.0)], "tx_id long, score double, label double")
    assert tuple(best_f1_threshold(few).first()) == (0.5, 0.0)


@pytest.mark.parametrize("n", [7, 10, 13, 100, 1001])
def test_day_cut_equals_linspace(spark, n):
    edges = np.linspace(0, n, 8).astype(int)
    exp = np.searchsorted(edges, np.arange(n), side="right") - 1
    df = spark.range(n).select(F.col("id").alias("i"), F.lit(n).alias("n"))
    got = [r["d"] for r in df.select(day_of("i", "n").alias("d")).orderBy("i").collect()]
    assert got == list(exp)


def test_running_totals_two_level_equals_one_level(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "x", "y"], 500, p=[0.8, 0.1, 0.1]),
                        "o": rng.integers(0, 50, 500), "id": np.arange(500), "v": rng.integers(0, 5, 500)})
    df = spark.createDataFrame(pdf)
    r = plan_ranges(df, "o", rows_per_range=40)
    assert r.n > 1
    d = r.assign(df, "_rng", "o")
    got = running_totals(d, ["k"], "_rng", r.n, [F.col("o"), F.col("id")],
                         {"s": (F.col("v").cast("bigint"), True)}).toPandas().set_index("id")["s"]
    exp = pdf.sort_values(["o", "id"]).groupby("k")["v"].cumsum()
    assert (got.sort_index() == exp.sort_index()).all()


def test_bootstrap_is_deterministic_and_brackets_point(spark):
    from txrisk.operators.bootstrap import bootstrap_ci
    df, _ = _scored(spark, n=300)
    a = bootstrap_ci(df, "auc", reps=30, seed=5).first()
    b = bootstrap_ci(df.repartition(5), "auc", reps=30, seed=5).first()
    assert tuple(a) == pytest.approx(tuple(b))
    assert a["lower"] <= a["point"] <= a["upper"]


@pytest.mark.parametrize("rows_per_range", [10**9, 50])
def test_exact_percentiles_match_numpy(spark, rows_per_range):
    from txrisk.operators.quantiles import exact_percentiles
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=700), 2)
    x[::50] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.05, 0.1, 0.5, 0.75, 1.0]
    got = exact_percentiles(df, "x", probs, rows_per_range=rows_per_range)
    exp = np.nanpercentile(x, [p * 100 for p in probs])
    np.testing.assert_allclose(got, exp, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("rows_per_range", [10**9, 40])
def test_first_n_exact(spark, rows_per_range):
    from txrisk.operators.sampling import first_n
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"timestamp_ms": rng.integers(0, 60, 400), "tx_id": np.arange(400)})
    df = spark.createDataFrame(pdf)
    got = first_n(df, 123, rows_per_range=rows_per_range).toPandas().sort_values(["timestamp_ms", "tx_id"])
    exp = pdf.sort_values(["timestamp_ms", "tx_id"]).head(123)
    assert list(got["tx_id"]) == list(exp["tx_id"])


@pytest.mark.parametrize("metric", ["f1", "auc", "ap", "p_at_k"])
def test_grouped_bootstrap_matches_row_bootstrap(spark, metric):
    """Group-level Poisson(n) weights have the law of the summed row weights:
    same point, near-identical interval (P@k: identical per-row draws)."""
    from txrisk.operators.bootstrap import bootstrap_ci, grouped_bootstrap_ci
    df, _ = _scored(spark, n=600)
    rows = bootstrap_ci(df, metric, reps=200, seed=11, k=50).first()
    grp = grouped_bootstrap_ci(df, metric, reps=200, seed=11, k=50).first()
    assert grp["point"] == pytest.approx(rows["point"], abs=1e-12)
    tol = 1e-12 if metric == "p_at_k" else 0.03
    assert grp["lower"] == pytest.approx(rows["lower"], abs=tol)
    assert grp["upper"] == pytest.approx(rows["upper"], abs=tol)


def test_grouped_metric_escape_hatch(spark):
    df, pdf = _scored(spark)

    def auc(s, y):  # defined here so the worker receives it by value
        import numpy as np
        pos, neg = s[y == 1], s[y == 0]
        return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) \
            / (len(pos) * len(neg))
    got = M.grouped_metric(df, ["grp"], auc, "auc").toPandas().set_index("grp")["auc"]
    curve = M.score_curve(df, "score", "label", ["grp"])
    exp = M.roc_auc(curve, ["grp"]).toPandas().set_index("grp")["auc"]
    for g in exp.index:
        assert got[g] == pytest.approx(exp[g], abs=1e-12)
    with pytest.raises(ValueError):
        M.grouped_metric(df, ["grp"], auc, max_group_rows=10)


from hypothesis import given, settings, HealthCheck, strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=2, max_size=60))
def test_property_auc_ap_any_ties(spark, pairs):
    """Random scores on a 7-level grid (heavy ties) and labels: AUC and AP equal
    their brute-force definitions (NULL when a class is missing)."""
    s = np.array([p[0] / 6 for p in pairs])
    y = np.array([int(p[1]) for p in pairs])
    df = spark.createDataFrame(pd.DataFrame({"tx_id": np.arange(len(s)), "score": s,
                                             "label": y.astype(float)}))
    curve = M.score_curve(df)
    auc = M.roc_auc(curve).first()["auc"]
    ap = M.average_precision(curve).first()["ap"]
    exp_auc = _auc_brute(s, y)
    assert (auc is None) == (exp_auc is None)
    if exp_auc is not None:
        assert auc == pytest.approx(exp_auc, abs=1e-12)
    if y.sum() > 0:
        assert ap == pytest.approx(_ap_brute(s, y), abs=1e-12)
    else:
        assert ap is None


@pytest.mark.parametrize("rows_per_range", [10**9, 50])
def test_exact_percentiles_many_paths_agree(spark, rows_per_range):
    from txrisk.operators.quantiles import exact_percentiles_many
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": np.round(rng.random(300), 1)})
    pdf.loc[::40, "a"] = np.nan
    got = exact_percentiles_many(spark.createDataFrame(pdf), [("a", [0.05, 0.5]), ("b", [0.1])],
                                 rows_per_range=rows_per_range)
    np.testing.assert_allclose(got[0], np.nanpercentile(pdf["a"], [5, 50]), rtol=1e-12)
    np.testing.assert_allclose(got[1], np.percentile(pdf["b"], [10]), rtol=1e-12)


def test_rule_scores_at_the_threshold(spark):
    """A value equal to a threshold that rounds down at float32 is not below it."""
    from txrisk.operators.baselines import RuleThresholds, rule_scores
    x = 0.7  # float32 rounds it down
    import numpy as np
    assert float(np.float32(x)) < x
    df = spark.createDataFrame([(1, x, x, x, 1)], "tx_id long, log_gas double, log_gas_tip double, "
                                                  "log_gas_fee double, data_4bytes_hash long")
    r = rule_scores(df, RuleThresholds(log_gas_fee_threshold=x, log_gas_tip_median=x / 2, log_gas_threshold=x)).first()
    assert (r.revert_score, r.mev_score, r.drop_score) == (0.0, 0.0, 0.0)


def test_poisson_draws_of_large_groups(spark):
    from txrisk.functions.scalar import poisson_n
    df = spark.range(2000).selectExpr("CAST(3e9 AS DOUBLE) AS n", "(id + 0.5) / 2000 AS u")
    m = df.select(poisson_n("n", "u").alias("w")).selectExpr("min(w) a", "avg(w) m", "stddev(w) s").first()
    assert m.a > 2**31 and abs(m.m - 3e9) < 6e3 and abs(m.s / 3e9**0.5 - 1) < 0.1


def test_session_keeps_what_is_set(spark):
    from txrisk.session import get_spark
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "777")
    try:
        assert get_spark().conf.get("spark.sql.shuffle.partitions") == "777"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_curve_metrics_equal_the_single_ones(spark):
    """One aggregate over the curve, with NULL scores, ties, one-class groups and many ranges."""
    rng = np.random.default_rng(5)
    rows = [(g, i, None if i % 17 == 0 else float(np.round(rng.random(), 1)),
             float(rng.random() < p)) for g, p in (("a", 0.3), ("b", 1.0), ("c", 0.0)) for i in range(200)]
    df = spark.createDataFrame(rows, "grp string, tx_id long, score double, label double")
    want = M.confusion(df, (F.col("score") > 0.5).cast("int"), "label", ["grp"])
    plain = M.score_curve(df, by=["grp"])
    want = (want.join(M.roc_auc(plain, ["grp"]), "grp").join(M.average_precision(plain, ["grp"]), "grp")
            .orderBy("grp").collect())
    for per_range in (2_000_000, 3):
        got = M.curve_metrics(M.score_curve(df, by=["grp"], above=0.5, rows_per_range=per_range), ["grp"])
        for a, b in zip(got.orderBy("grp").collect(), want):
            for c in ("tp", "fp", "fn", "tn", "n_valid", "n_pos"):
                assert a[c] == b[c], (c, a, b)
            for c in ("auc", "ap"):
                assert (a[c] is None) == (b[c] is None) and (a[c] is None or abs(a[c] - b[c]) < 1e-12)


def test_linear_model_survives_null_values(spark):
    """A NULL or NaN value counts as the train mean; the three heads chain without a join."""
    from txrisk import schema as S
    from txrisk.operators.baselines import fit_logreg, score_models
    rng = np.random.default_rng(3)
    cols = list(S.NUMERIC_FEATURES[:2])
    rows = [(i, None if i == 5 else float(x), float("nan") if i == 6 else 3.0, float(x + rng.normal() > 0),
             float(i % 3 == 0), float(i % 4 == 0)) for i, x in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, ", ".join(["tx_id long", *[f"{c} double" for c in cols],
                                                *[f"{c} double" for c in S.TASKS.values()]]))
    fs = type("Cols", (), {"columns": cols})()
    out = score_models(fit_logreg(df, fs, max_iter=20), df, ["tx_id"])
    got = out.collect()
    assert len(got) == 300 and all(0 <= r.revert_score <= 1 for r in got)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
