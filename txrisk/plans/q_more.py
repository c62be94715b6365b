"""Registered queries: sequences, Δt corruption, losses, sampling, weights,
manifest, MLlib baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.scalar import calibrate_b, feature_fingerprint, softplus_delta
from txrisk.operators import metrics as M
from txrisk.operators import sampling as T
from txrisk.operators import sequences as Q
from txrisk.operators.baselines import class_weights, standardize_stats
from txrisk.operators.loss import loss_report
from txrisk.plans.build import round_doubles
from txrisk.plans.q_build import dataset
from txrisk.plans.q_metrics import scored_runs, scored_runs_sql
from txrisk.plans.registry import register
from txrisk.plans.sqltext import dataset_sql, uniform_sql
from txrisk.sources.sinks import manifest_frame

SEQ_LEN, WARMUP, SEED = 1024, 64, 42  # the sequence models' defaults


def _split_rows(spark, sf_dir, split="train"):
    d = dataset(spark, sf_dir).where(F.col("split") == split)
    i0 = d.agg(F.min("row_idx")).first()[0] or 0
    return d.withColumn("_i", F.col("row_idx") - F.lit(i0))


def _windows(spark, sf_dir):
    return Q.window_rows(_split_rows(spark, sf_dir), SEQ_LEN, WARMUP)


_WIN_SQL = f"""WITH {dataset_sql()},
tr AS (SELECT *, row_idx - min(row_idx) OVER () AS _i FROM ds WHERE split = 'train'),
w AS (SELECT *, CAST(floor(_i / {SEQ_LEN}) AS BIGINT) AS window_id, CAST(_i % {SEQ_LEN} AS INTEGER) AS pos,
             count(*) OVER () AS n_all FROM tr),
w2 AS (SELECT * FROM w WHERE window_id < greatest(1, floor((n_all - {SEQ_LEN}) / {SEQ_LEN}) + 1)),
ws AS (SELECT window_id, count(*) AS n_rows, count(*) FILTER (WHERE pos >= {WARMUP}) AS n_mask,
              coalesce(max(is_mev_victim > 0), false) AS has_positive,
              arg_min(tx_id, pos) AS first_tx, arg_max(tx_id, pos) AS last_tx FROM w2 GROUP BY window_id)"""


@register("sequence_windows", _WIN_SQL + " SELECT * FROM ws")
def q_sequence_windows(spark, sf_dir):
    """W5 + W6 + A16: 1024-row tumbling windows of train, warm-up mask, any-positive flag."""
    return Q.window_summary(_windows(spark, sf_dir))


@register("shuffled_delta", _WIN_SQL + f""",
s AS (SELECT window_id, pos, timestamp_delta_s AS v,
        row_number() OVER (PARTITION BY window_id ORDER BY {uniform_sql(str(SEED), 'window_id', 'pos')}, pos) - 1
          AS r FROM w2)
SELECT w2.window_id, w2.pos, w2.tx_id, round(s.v, 6) AS timestamp_delta_s_shuffled
FROM w2 JOIN s ON w2.window_id = s.window_id AND w2.pos = s.r""")
def q_shuffled_delta(spark, sf_dir):
    """Δt permuted inside each window by a seeded per-window order."""
    out = Q.shuffle_within_window(_windows(spark, sf_dir), seed=SEED)
    return round_doubles(out.select("window_id", "pos", "tx_id", "timestamp_delta_s_shuffled"))


_BINS_SQL = f"""WITH {dataset_sql()},
tr AS (SELECT timestamp_delta_s AS x FROM ds WHERE split = 'train'),
np AS (SELECT count(*) FILTER (WHERE x > 0) AS c FROM tr),
v AS (SELECT x FROM tr, np WHERE c = 0 OR x > 0),
e AS (SELECT CAST(CAST(quantile_cont(x, 0.25) AS FLOAT) AS DOUBLE) AS e1,
             CAST(CAST(quantile_cont(x, 0.5) AS FLOAT) AS DOUBLE) AS e2,
             CAST(CAST(quantile_cont(x, 0.75) AS FLOAT) AS DOUBLE) AS e3, median(x) AS m_all FROM v),
b AS (SELECT x, CAST(x >= e1 AS INTEGER) + CAST(x >= e2 AS INTEGER) + CAST(x >= e3 AS INTEGER) AS bin FROM v, e),
bm AS (SELECT bin, median(x) AS m FROM b GROUP BY bin),
mm AS (SELECT max(CASE WHEN r.range = 0 THEN coalesce(m, m_all) END) AS m0,
              max(CASE WHEN r.range = 1 THEN coalesce(m, m_all) END) AS m1,
              max(CASE WHEN r.range = 2 THEN coalesce(m, m_all) END) AS m2,
              max(CASE WHEN r.range = 3 THEN coalesce(m, m_all) END) AS m3
       FROM range(4) r LEFT JOIN bm ON bm.bin = r.range, e),
bins AS (SELECT e1, e2, e3, CAST(CAST(m0 AS FLOAT) AS DOUBLE) AS m0, CAST(CAST(m1 AS FLOAT) AS DOUBLE) AS m1,
                CAST(CAST(m2 AS FLOAT) AS DOUBLE) AS m2, CAST(CAST(m3 AS FLOAT) AS DOUBLE) AS m3, m_all
         FROM e, mm)"""


def _bins(spark, sf_dir):
    tr = dataset(spark, sf_dir).where(F.col("split") == "train")
    b = Q.delta_bins(tr)  # 3 edges + 4 medians + 1 median
    return b["edges"], b["medians"], b["median_pos"]


@register("delta_bins", _BINS_SQL + f"""
SELECT round(e1, 6) AS e1, round(e2, 6) AS e2, round(e3, 6) AS e3, round(m0, 6) AS m0, round(m1, 6) AS m1,
  round(m2, 6) AS m2, round(m3, 6) AS m3, round(m_all, 6) AS median_pos,
  round(ln(exp(sqrt(0.001 * 0.1)) - 1) - ln(1 + greatest(m_all, 0.001)), 6) AS calib_b FROM bins""")
def q_delta_bins(spark, sf_dir):
    """A7 + A12 + P17 + F13: Δt quantile bins on train and the adapter bias b."""
    edges, medians, med = _bins(spark, sf_dir)
    b = spark.createDataFrame([(*edges, *medians, med)],
                              "e1 double, e2 double, e3 double, m0 double, m1 double, m2 double, "
                              "m3 double, median_pos double")
    return round_doubles(b.withColumn("calib_b", calibrate_b(F.col("median_pos"))))


@register("delta_transforms", _BINS_SQL + """,
te AS (SELECT tx_id, timestamp_delta_s AS x FROM ds WHERE split = 'test'),
cb AS (SELECT ln(exp(sqrt(0.001 * 0.1)) - 1) - ln(1 + greatest(m_all, 0.001)) AS b FROM bins),
z AS (SELECT tx_id, x, ln(1 + least(greatest(x, 0.001), 300.0)) + b AS z FROM te, cb)
SELECT z.tx_id,
  round(CASE WHEN x <= e1 THEN m0 WHEN x <= e2 THEN m1 WHEN x <= e3 THEN m2 ELSE m3 END, 6)
    AS timestamp_delta_s_quantized,
  round(greatest(z, 0.0) + ln(1 + exp(-abs(z))), 6) AS adapter_delta
FROM z, bins""")
def q_delta_transforms(spark, sf_dir):
    """F14 + J4 + F12: test Δt snapped to train bin medians (right-closed) and
    the physical-time adapter transform with the calibrated b (a = 1)."""
    edges, medians, med = _bins(spark, sf_dir)
    import math
    b = math.log(math.expm1(math.sqrt(0.001 * 0.1))) - math.log1p(max(med, 0.001))
    te = dataset(spark, sf_dir).where(F.col("split") == "test")
    out = Q.quantize_delta(te, edges, medians).select(
        "tx_id", "timestamp_delta_s_quantized",
        softplus_delta("timestamp_delta_s", 1.0, b).alias("adapter_delta"))
    return round_doubles(out)


def _loss_sql() -> str:
    def sp(x):
        return f"(greatest({x}, 0.0) + ln(1 + exp(-abs({x}))))"

    def lg(p):
        q = f"least(greatest({p}, 1e-7), 1 - 1e-7)"
        return f"ln({q} / (1 - {q}))"

    def bce(z, y, pw="1.0"):
        return f"(-({pw} * {y} * (-{sp('-(' + z + ')')}) + (1 - {y}) * (-{sp(z)})))"
    zr, zm, zd = lg("revert_score"), lg("mev_score"), lg("drop_score")
    yr, ym, yd = ("CAST(is_reverted AS DOUBLE)", "CAST(is_mev_victim AS DOUBLE)", "CAST(is_dropped AS DOUBLE)")
    p = f"(1 / (1 + exp(-({zm}))))"
    pt = f"({ym} * {p} + (1 - {ym}) * (1 - {p}))"
    focal = f"(({ym} * 0.95 + (1 - {ym}) * 0.05) * pow(1 - {pt}, 2.0) * {bce(zm, ym)})"
    return scored_runs_sql() + f"""
, lr AS (SELECT run_id,
    coalesce(avg(CASE WHEN is_reverted >= 0 THEN {bce(zr, yr, '10.0')} END), 0.0) AS revert_loss,
    avg({focal}) AS mev_loss,
    coalesce(avg(CASE WHEN is_dropped >= 0 THEN {bce(zd, yd)} END), 0.0) AS drop_loss FROM scored GROUP BY run_id)
SELECT run_id, round(revert_loss, 6) AS revert_loss, round(mev_loss, 6) AS mev_loss,
  round(drop_loss, 6) AS drop_loss, round(revert_loss + 2.0 * mev_loss + 0.5 * drop_loss, 6) AS total_loss
FROM lr"""


@register("loss_report", _loss_sql())
def q_loss_report(spark, sf_dir):
    """A14 + F16 + F18: masked multi-task loss per run (WBCE, focal, BCE)."""
    return round_doubles(loss_report(scored_runs(spark, sf_dir), ["run_id"]))


@register("minibatches", f"""WITH {dataset_sql()}
SELECT tx_id, CAST(floor((row_number() OVER (ORDER BY {uniform_sql(str(SEED), '0', 'tx_id')}, tx_id) - 1) / 32)
  AS BIGINT) AS batch_id FROM ds WHERE split = 'train'""")
def q_minibatches(spark, sf_dir):
    """Shuffled mini-batches of 32 train rows for epoch 0."""
    tr = dataset(spark, sf_dir).where(F.col("split") == "train").select("tx_id")
    return T.minibatches(tr, 32, epoch=0, seed=SEED).select("tx_id", "batch_id")


@register("label_shuffle", f"""WITH {dataset_sql()},
v AS (SELECT * FROM ds WHERE split = 'train' AND is_reverted >= 0),
a AS (SELECT tx_id, row_number() OVER (ORDER BY timestamp_ms, tx_id) AS i FROM v),
b AS (SELECT is_reverted, row_number() OVER (ORDER BY {uniform_sql(str(SEED), "'shuffle'", 'tx_id')}, tx_id) AS i
      FROM v)
SELECT a.tx_id, b.is_reverted FROM a JOIN b USING (i)""")
def q_label_shuffle(spark, sf_dir):
    """P9 + T4: all valid train rows, labels permuted by a seeded order."""
    tr = dataset(spark, sf_dir).where(F.col("split") == "train")
    d = tr.where(F.col("is_reverted") >= 0).select(S.SORT_KEY, "tx_id", "is_reverted")
    return T.shuffle_labels(d, "is_reverted", seed=SEED).select("tx_id", "is_reverted")


@register("first_train_rows", f"""WITH {dataset_sql()}
SELECT tx_id, timestamp_ms FROM ds WHERE split = 'train' ORDER BY timestamp_ms, tx_id LIMIT 1000""")
def q_first_train_rows(spark, sf_dir):
    """The first 1 000 train rows in time order (the cut is the feature)."""
    tr = dataset(spark, sf_dir).where(F.col("split") == "train")
    return T.first_n(tr, 1000).select("tx_id", S.SORT_KEY)


_PAS_SQL = _WIN_SQL + f""",
nw AS (SELECT count(*) AS n_win, count(*) FILTER (WHERE has_positive) AS n_pos FROM ws),
pw AS (SELECT window_id, row_number() OVER (ORDER BY window_id) - 1 AS pi FROM ws WHERE has_positive),
aw AS (SELECT window_id, row_number() OVER (ORDER BY window_id) - 1 AS ai FROM ws),
d AS (SELECT unnest(range(n_win)) AS draw FROM nw),
dd AS (SELECT draw, {uniform_sql(str(SEED), "'pick'", 'draw')} AS pick, {uniform_sql(str(SEED), "'idx'", 'draw')} AS v,
              n_win, n_pos FROM d, nw),
ee AS (SELECT draw, (pick < 0.3 AND n_pos > 0) AS from_positive,
         CAST(floor(CASE WHEN pick < 0.3 AND n_pos > 0 THEN v * n_pos ELSE v * n_win END) AS BIGINT) AS j FROM dd),
draws AS (SELECT draw, window_id, from_positive FROM ee JOIN pw ON from_positive AND j = pi
          UNION ALL SELECT draw, window_id, from_positive FROM ee JOIN aw ON NOT from_positive AND j = ai)"""


@register("positive_aware_sample", _PAS_SQL + " SELECT * FROM draws")
def q_positive_aware_sample(spark, sf_dir):
    """T3 + J3: one epoch of window draws, oversampling windows with a MEV positive (p = 0.3)."""
    ws = Q.window_summary(_windows(spark, sf_dir))
    return T.positive_aware_sample(ws, p_pos=0.3, seed=SEED)


@register("sampled_window_rows", _PAS_SQL + """
SELECT d.draw, d.window_id, count(*) AS n_rows, CAST(sum(w2.is_mev_victim) AS DOUBLE) AS n_mev,
       count(*) FILTER (WHERE w2.pos >= 64) AS n_mask
FROM draws d JOIN w2 ON d.window_id = w2.window_id GROUP BY d.draw, d.window_id""")
def q_sampled_window_rows(spark, sf_dir):
    """T3 + J3: the rows of every drawn window (a window drawn twice appears
    twice), summarised per draw."""
    rows = _windows(spark, sf_dir)
    draws = T.positive_aware_sample(Q.window_summary(rows), p_pos=0.3, seed=SEED)
    g = Q.gather_windows(draws, rows)
    return g.groupBy("draw", "window_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("is_mev_victim").cast("double")).alias("n_mev"),
        F.count_if("mask").alias("n_mask"))


@register("class_weights", f"""WITH {dataset_sql()},
tr AS (SELECT * FROM ds WHERE split = 'train'),
u AS (SELECT 'revert' AS task, is_reverted AS y FROM tr UNION ALL SELECT 'mev', is_mev_victim FROM tr
      UNION ALL SELECT 'drop', is_dropped FROM tr),
c AS (SELECT task, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM u GROUP BY task)
SELECT task, round(CASE WHEN p > 0 AND n > 0 THEN n / CAST(p AS DOUBLE) ELSE 1.0 END, 6) AS pos_weight,
  round(CASE WHEN n > 0 THEN (p + n) / (2.0 * n) END, 6) AS weight_neg,
  round(CASE WHEN p > 0 THEN (p + n) / (2.0 * p) END, 6) AS weight_pos FROM c""")
def q_class_weights(spark, sf_dir):
    """A8 + A9: neg/pos ratio and balanced class weights per task on train."""
    tr = dataset(spark, sf_dir).where(F.col("split") == "train")
    return round_doubles(class_weights(tr))


_NUM = S.NUMERIC_FEATURES


@register("standardize_stats", f"""WITH {dataset_sql()}
SELECT {', '.join([f'round(avg({c}), 6) AS {c}_mean' for c in _NUM] + [f'round(stddev_pop({c}), 6) AS {c}_std' for c in _NUM])}
FROM ds WHERE split = 'train'""")
def q_standardize_stats(spark, sf_dir):
    """Means and population standard deviations of the 11 numerics on train."""
    tr = dataset(spark, sf_dir).where(F.col("split") == "train")
    out = standardize_stats(tr, _NUM)
    return round_doubles(out.select(*[F.col(c).cast("double").alias(c) for c in out.columns]))


_RATES = ", ".join(f"round(coalesce(avg(CASE WHEN {l} >= 0 THEN CAST({l} AS DOUBLE) END), 0.0), 6) AS rate_{l}"
                   for l in S.LABEL_COLUMNS)


@register("manifest", f"""WITH {dataset_sql()}
SELECT 'full' AS mode, split, count(*) AS rows, {_RATES}, '{feature_fingerprint(S.FEATURE_COLUMNS)}' AS feature_hash
FROM ds GROUP BY split""")
def q_manifest(spark, sf_dir):
    """S4 + F17: per-split rows and label rates with the feature-list fingerprint."""
    m = manifest_frame(dataset(spark, sf_dir))
    return round_doubles(m.select("mode", "split", "rows",
                                  *[F.col(f"label_rates.{l}").alias(f"rate_{l}") for l in S.LABEL_COLUMNS],
                                  "feature_hash"))


@register("logreg_baseline")
def q_logreg(spark, sf_dir):
    """L3 + L5 + S5 + P6 + A9 + A17: MLlib balanced logistic regression on the
    11 standardised numerics per task; test-split metric bundle.  (Iterative
    solver: no SQL twin.)"""
    from txrisk.operators.baselines import fit_logreg, score_models
    ds = dataset(spark, sf_dir)
    models = fit_logreg(ds.where(F.col("split") == "train"))
    te = ds.where(F.col("split") == "test")
    scores = score_models(models, te, ["tx_id", *S.LABEL_COLUMNS]) \
        .withColumn("run_id", F.lit("logreg"))
    long = M.unpivot_tasks(scores, keep=["run_id", "tx_id"])
    return round_doubles(M.metric_bundle(long, by=["run_id"]))


@register("leakage_audit")
def q_leakage_audit(spark, sf_dir):
    """L1 + T4 + T5 + T6: boosted trees on shuffled labels must not beat AUC 0.55."""
    from txrisk.operators.baselines import leakage_audit
    tr = dataset(spark, sf_dir).where(F.col("split") == "train")
    passed, auc = leakage_audit(tr)
    return spark.createDataFrame([(bool(passed), None if auc is None else float(auc))],
                                 "passed boolean, shuffled_auc double")


@register("corruption_audit")
def q_corruption_audit(spark, sf_dir):
    """M21 + W7 + A7 + F14 + L5: metric bundle of an MLlib baseline on the test
    split with Δt intact, shuffled within 1024-row windows, or quantized to
    train-bin medians.  (Model fit is iterative: no SQL twin.)"""
    from txrisk.operators.baselines import fit_logreg
    from txrisk.plans.evaluate import corruption_audit
    ds = dataset(spark, sf_dir)
    models = fit_logreg(ds.where(F.col("split") == "train"))
    return round_doubles(corruption_audit(models, ds, "test", SEQ_LEN, WARMUP, SEED))


@register("gbt_baseline")
def q_gbt(spark, sf_dir):
    """L2 + A8 + S11: boosted trees per task (depth 8, step 0.05, >= 200 rows per
    leaf, 0.9 row sampling, neg/pos class weight, up to 1000 rounds stopped on the
    val split); saved, reloaded and scored on test.  (No SQL twin.)"""
    import os
    import uuid
    from txrisk.operators.baselines import fit_gbt, score_models
    from txrisk.plans.evaluate import load_models, save_models
    from txrisk.session import checkpoint_dir
    ds = dataset(spark, sf_dir)
    models = fit_gbt(ds.where(F.col("split") == "train"), max_iter=1000,
                     val=ds.where(F.col("split") == "val"))
    path = os.path.join(checkpoint_dir(spark), "models", f"gbt-{uuid.uuid4().hex[:8]}")
    save_models(models, path)
    te = ds.where(F.col("split") == "test")
    scores = score_models(load_models(path), te, ["tx_id", *S.LABEL_COLUMNS]) \
        .withColumn("run_id", F.lit("gbt"))
    return round_doubles(M.metric_bundle(M.unpivot_tasks(scores, keep=["run_id", "tx_id"]), by=["run_id"]))


@register("gbt_ranked_rounds")
def q_gbt_ranked(spark, sf_dir):
    """L2 + A8: boosted trees per task with the rounds that rank the val split best (AUC; AP for MEV).
    Shallow and short beside the defaults (depth 8, 1000 rounds, patience 50): a round costs the same
    jobs on a small table as on a large one.  (Fitted trees: no SQL twin.)"""
    from txrisk.operators.boosted import fit_ranked_gbt, round_report
    ds = dataset(spark, sf_dir)
    fits = fit_ranked_gbt(ds.where(F.col("split") == "train"), ds.where(F.col("split") == "val"),
                          max_iter=24, patience=8, max_depth=4, step=0.2)
    return round_doubles(round_report(spark, fits))


@register("logreg_as_columns")
def q_logreg_as_columns(spark, sf_dir):
    """L3 + L5 + S11: the linear heads written as a table of coefficients, read back and scored on the
    test split as plain column expressions; metric bundle.  (Iterative solver: no SQL twin.)"""
    import os
    import uuid
    from txrisk.operators.baselines import fit_logreg
    from txrisk.operators.boosted import HEADS, linear_scores, linear_table
    from txrisk.session import checkpoint_dir
    ds = dataset(spark, sf_dir)
    train = ds.where(F.col("split") == "train")
    path = os.path.join(checkpoint_dir(spark), "models", f"heads-{uuid.uuid4().hex}")
    linear_table(train, fit_logreg(train), S.FeatureSet.preset("numeric_only").columns).write.parquet(path)
    heads = spark.read.schema(HEADS).parquet(path).collect()  # one row per task and column
    scores = linear_scores(ds.where(F.col("split") == "test"), heads, ["tx_id", *S.LABEL_COLUMNS]) \
        .withColumn("run_id", F.lit("logreg"))
    return round_doubles(M.metric_bundle(M.unpivot_tasks(scores, keep=["run_id", "tx_id"]), by=["run_id"]))


def _store_sql() -> str:
    from txrisk.plans.q_metrics import bundle_sql
    inner = scored_runs_sql() + bundle_sql("run_id")
    return (f"SELECT run_id, 'all' AS slice, metric, value, CAST(NULL AS DOUBLE) AS lower, "
            f"CAST(NULL AS DOUBLE) AS upper FROM ({inner})")


@register("metrics_store_roundtrip", _store_sql())
def q_metrics_store(spark, sf_dir):
    """S6 + S7 + S8 + S9: scores written keyed by (run, split), read back per
    run, metrics appended to the long store, latest value per metric."""
    import os
    import uuid
    from txrisk.plans.evaluate import store_scores_and_metrics
    from txrisk.session import checkpoint_dir
    root = os.path.join(checkpoint_dir(spark), "eval", uuid.uuid4().hex[:8])
    scores = scored_runs(spark, sf_dir).select("run_id", "tx_id", "revert_score", "mev_score", "drop_score")
    out = store_scores_and_metrics(spark, scores, dataset(spark, sf_dir), root)
    return round_doubles(out)


@register("mlp_baseline")
def q_mlp(spark, sf_dir):
    """L6 (optional): MLlib multilayer perceptron per task on the 11
    standardised numerics; test-split metric bundle of scores that are
    stored once, as the metrics read them several times.  (No SQL twin.)"""
    import os
    import uuid
    from txrisk.operators.baselines import fit_mlp, score_models
    from txrisk.session import checkpoint_dir
    ds = dataset(spark, sf_dir)
    models = fit_mlp(ds.where(F.col("split") == "train"))
    te = ds.where(F.col("split") == "test")
    scores = score_models(models, te, ["tx_id", *S.LABEL_COLUMNS])
    path = os.path.join(checkpoint_dir(spark), "eval", f"mlp-{uuid.uuid4().hex}")
    scores.write.parquet(path)
    scores = spark.read.schema(scores.schema).parquet(path).withColumn("run_id", F.lit("mlp"))
    return round_doubles(M.metric_bundle(M.unpivot_tasks(scores, keep=["run_id", "tx_id"]), by=["run_id"]))
