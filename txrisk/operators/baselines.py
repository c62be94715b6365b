"""Baselines: the rule model (L4: A6 fit + F11 scoring, exact), plus MLlib
re-aims of the linear (L3) and boosted-tree (L2) baselines, the shuffled-label
leakage audit (L1) and batch scoring (L5).  Class weights (A8, A9) and
standardisation statistics (A17) are plain aggregates.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import schema as S


# ---------------------------------------------------------------------------
# L4 rule baseline
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class RuleThresholds:
    log_gas_fee_threshold: float
    log_gas_tip_median: float
    log_gas_threshold: float

    def to_json(self) -> str:  # S10
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "RuleThresholds":
        return cls(**json.loads(text))

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line under ``path``, on any file system Spark writes to."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RuleThresholds":
        return cls.from_json(spark.read.text(path).first()["value"])


def fit_rule_thresholds(train: DataFrame, drop_pct: float = 5.0) -> RuleThresholds:
    """NaN-skipping exact percentiles (numpy-linear) of three continuous
    columns, selected by counts in the same jobs: no task holds or sorts them."""
    from txrisk.operators.quantiles import exact_percentiles_many
    (fee,), (tip,), (gas,) = exact_percentiles_many(
        train, [("log_gas_fee", [drop_pct / 100.0]), ("log_gas_tip", [0.5]), ("log_gas", [0.10])])
    return RuleThresholds(log_gas_fee_threshold=fee, log_gas_tip_median=tip, log_gas_threshold=gas)


def rule_threshold_frame(train: DataFrame, drop_pct: float = 5.0) -> DataFrame:
    """A6 / S10 as a one-row DataFrame."""
    t = fit_rule_thresholds(train, drop_pct)
    return train.sparkSession.createDataFrame(
        [(t.log_gas_fee_threshold, t.log_gas_tip_median, t.log_gas_threshold)],
        "log_gas_fee_threshold double, log_gas_tip_median double, log_gas_threshold double")


def rule_columns(t: RuleThresholds) -> dict:
    """three 0/1 float scores.  Features and thresholds are both compared
    at float32, so a value equal to a threshold is never below it."""
    f = lambda c: F.col(c).cast("float")
    at = lambda x: F.lit(x).cast("float")
    return {
        "revert_score": (f("log_gas") < at(t.log_gas_threshold)).cast("float"),
        "mev_score": ((F.col("data_4bytes_hash") != 0) & (f("log_gas_tip") > at(2.0 * t.log_gas_tip_median)))
        .cast("float"),
        "drop_score": (f("log_gas_fee") < at(t.log_gas_fee_threshold)).cast("float"),
    }


def rule_scores(df: DataFrame, t: RuleThresholds, keep: list[str] = ("tx_id",)) -> DataFrame:
    """F11 as a table: ``keep`` and the scores of ``rule_columns``."""
    return df.select(*keep, *[c.alias(k) for k, c in rule_columns(t).items()])


# ---------------------------------------------------------------------------
# A8, A9, A17
# ---------------------------------------------------------------------------
def pos_weight(df: DataFrame, label: str) -> DataFrame:
    """neg/pos over valid rows, 1.0 if a class is empty."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(F.when((pos > 0) & (neg > 0), neg / pos.cast("double")).otherwise(F.lit(1.0))
                  .alias("pos_weight"))


def balanced_weight_col(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """N / (2 n_c) per class as a weight column (broadcast of a <= 2-row table)."""
    v = df.where(F.col(label) >= 0)
    cnt = v.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = v.count()
    w = cnt.select(label, (F.lit(float(total)) / (2.0 * F.col("_nc"))).alias(out))
    return v.join(F.broadcast(w), label)


def class_weights(df: DataFrame) -> DataFrame:
    """A8 + A9 of every task in one aggregate: task, pos_weight, weight_neg, weight_pos."""
    n = df.agg(*[F.count_if(F.col(lab) == y).alias(f"{t}_{y}") for t, lab in S.TASKS.items() for y in (0, 1)])
    per = n.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(f"{t}_0").alias("neg"), F.col(f"{t}_1").alias("pos"))
        for t in S.TASKS])).alias("c")).select("c.*")
    neg, pos = F.col("neg"), F.col("pos")
    both = (neg > 0) & (pos > 0)
    return per.select("task", F.when(both, neg / pos.cast("double")).otherwise(F.lit(1.0)).alias("pos_weight"),
                      F.when(neg > 0, (neg + pos) / (2.0 * neg)).alias("weight_neg"),
                      F.when(pos > 0, (neg + pos) / (2.0 * pos)).alias("weight_pos"))


def standardize_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Column means and population standard deviations of the values that
    are neither NULL nor NaN (one row)."""
    x = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.agg(*[F.avg(x(c)).alias(f"{c}_mean") for c in cols],
                  *[F.stddev_pop(x(c)).alias(f"{c}_std") for c in cols])


# ---------------------------------------------------------------------------
# MLlib baselines
# ---------------------------------------------------------------------------
def _assembler(cols, out="features"):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")


def _outputs(task: str) -> dict:
    """Column names of one head, so that the heads chain on one DataFrame."""
    return {"featuresCol": f"_{task}_features", "probabilityCol": f"_{task}_prob",
            "rawPredictionCol": f"_{task}_raw", "predictionCol": f"_{task}_pred"}


def _standardized(stats, cols, task: str) -> list:
    """Stages that scale by statistics of all train rows (A17).  A NULL or NaN
    value counts as the train mean, a column without spread as 0."""
    from pyspark.ml.feature import SQLTransformer
    z = {c: f"_{task}_z_{c}" for c in cols}
    parts = []
    for c in cols:
        mean, std = stats[f"{c}_mean"] or 0.0, stats[f"{c}_std"] or 0.0
        x = f"coalesce(nanvl(cast({c} AS double), CAST({mean!r} AS double)), CAST({mean!r} AS double))"
        parts.append(f"({x} - CAST({mean!r} AS double)) / CAST({std or 1.0!r} AS double) AS {z[c]}")
    return [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"),
            _assembler(z.values(), f"_{task}_features")]


def fit_logreg(train: DataFrame, features: S.FeatureSet = S.FeatureSet.preset("numeric_only"),
               C: float = 1.0, max_iter: int = 100) -> dict:
    """L3: standardise the numerics, one balanced L2 log-loss head per task,
    regParam = 1 / (C * N) (the reference's alpha).  Returns task -> PipelineModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    stats = standardize_stats(train, features.columns).first()
    models = {}
    for task, lab in S.TASKS.items():
        d = balanced_weight_col(train.select(*features.columns, lab), lab)
        n = d.count()
        pipe = Pipeline(stages=[
            *_standardized(stats, features.columns, task),
            LogisticRegression(**_outputs(task), labelCol=lab, weightCol="weight",
                               regParam=1.0 / max(1.0, C * n), elasticNetParam=0.0,
                               standardization=False, maxIter=max_iter),
        ])
        models[task] = pipe.fit(d.withColumn(lab, F.col(lab).cast("double")))
    return models


def fit_gbt(train: DataFrame, features: S.FeatureSet = S.FeatureSet(), max_depth: int = 8,
            max_iter: int = 100, step: float = 0.05, min_instances: int = 200,
            subsample: float = 0.9, val: DataFrame | None = None, seed: int = 42) -> dict:
    """L2: one boosted-tree classifier per task, positive class weighted by
    neg/pos (A8); optional validation rows for early stopping."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    models = {}
    for task, lab in S.TASKS.items():
        d = train.select(*features.columns, lab).where(F.col(lab) >= 0).withColumn("_val", F.lit(False))
        if val is not None:
            d = d.unionByName(val.select(*features.columns, lab).where(F.col(lab) >= 0)
                              .withColumn("_val", F.lit(True)))
        pw = pos_weight(d.where(~F.col("_val")), lab).first()["pos_weight"]
        d = d.withColumn("weight", F.when(F.col(lab) == 1, F.lit(pw)).otherwise(F.lit(1.0)))
        names = {k: v for k, v in _outputs(task).items() if k in ("featuresCol", "predictionCol")}
        gbt = GBTClassifier(**names, labelCol=lab, weightCol="weight",
                            maxDepth=max_depth, maxIter=max_iter, stepSize=step,
                            minInstancesPerNode=min_instances, subsamplingRate=subsample,
                            featureSubsetStrategy="0.9", seed=seed, maxBins=64)
        gbt = gbt.setProbabilityCol(f"_{task}_prob").setRawPredictionCol(f"_{task}_raw")
        if val is not None:
            gbt = gbt.setValidationIndicatorCol("_val")
        models[task] = Pipeline(stages=[_assembler(features.columns, f"_{task}_features"), gbt]).fit(
            d.withColumn(lab, F.col(lab).cast("double")))
    return models


def fit_mlp(train: DataFrame, features: S.FeatureSet = S.FeatureSet.preset("numeric_only"),
            hidden: int = 256, max_iter: int = 10, seed: int = 42) -> dict:
    """L6 (optional re-aim): per task an MLlib multilayer perceptron
    [inputs, 256, 256, 2] on standardised features, valid rows only.  MLlib
    hidden units are sigmoid and the fit is L-BFGS, so this is a tabular
    neural baseline, not the reference's GELU / embedding / focal-loss net.
    One L-BFGS iteration is one pass over the data: 10 = the reference's 10 epochs.

    MLlib gives the first weights and the models; the passes run in
    ``perceptron.fit_weights``, whose matrix products take a fraction of MLlib's time."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.linalg import Vectors
    from txrisk.operators.perceptron import fit_weights, spread
    cols = features.columns
    stats = standardize_stats(train, cols).first()
    layers = [len(cols), hidden, hidden, 2]
    spark = train.sparkSession
    seen = spread(train.select(*cols, *[F.col(lab).cast("double").alias(lab) for lab in S.TASKS.values()])).persist()
    blank = spark.createDataFrame([(*[0.0] * len(cols), 0.0)], ", ".join(f"`{c}` double" for c in [*cols, "_y"]))

    def head(task: str, lab: str, **start):
        return Pipeline(stages=[
            *_standardized(stats, cols, task),
            MultilayerPerceptronClassifier(**_outputs(task), labelCol=lab, layers=layers, maxIter=0, **start),
        ]).fit(blank.withColumnRenamed("_y", lab))

    try:
        heads = []
        for task, lab in S.TASKS.items():
            first = head(task, lab, seed=seed).stages[-1].weights.toArray()
            scaled = _standardized(stats, cols, task)[0].transform(seen.where(F.col(lab) >= 0))
            heads.append((scaled.select(*[f"_{task}_z_{c}" for c in cols], lab), lab, first))
        weights = fit_weights(heads, layers, max_iter)
    finally:
        seen.unpersist()
    return {task: head(task, lab, initialWeights=Vectors.dense(w)) for (task, lab), w in zip(S.TASKS.items(), weights)}


def score_models(models: dict, df: DataFrame, keep: list[str] = ("tx_id",)) -> DataFrame:
    """Three heads -> (keep…, revert_score, mev_score, drop_score), chained
    on one DataFrame: the rows are read once and joined with nothing.  Perceptrons score
    batches of rows (``perceptron.with_probabilities``), where MLlib multiplies row by row."""
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel
    from pyspark.ml.functions import vector_to_array
    from txrisk.operators.perceptron import with_probabilities
    if all(isinstance(m.stages[-1], MultilayerPerceptronClassificationModel) for m in models.values()):
        nets = {}
        for t, m in models.items():
            scaler, assembler, net = m.stages
            df = scaler.transform(df)
            nets[f"{t}_score"] = (assembler.getInputCols(), net.getLayers(), net.weights.toArray())
        scores = with_probabilities(df, nets, list(keep))
        return scores.select(*keep, *[F.col(s).cast("float").alias(s) for s in nets])
    for m in models.values():
        df = m.transform(df)
    return df.select(*keep, *[vector_to_array(f"_{t}_prob")[1].cast("float").alias(f"{t}_score") for t in models])


def leakage_audit(train: DataFrame, features: list[str] = tuple(S.FEATURE_COLUMNS),
                  label: str = "is_reverted", n: int = 50_000, seed: int = 42,
                  limit: float = 0.55, min_valid: int = 200, min_pos: int = 10):
    """L1: fit boosted trees (50 x depth 4) on labels shuffled against the
    features and score the held-out half; AUC above ``limit`` means leakage.

    T6 first n rows by time -> P9 valid -> T4 label permutation -> T5 50/50
    split by time index.  Returns (passed, auc); auc is None when skipped.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from txrisk.operators.sampling import first_n, half_split, shuffle_labels
    from txrisk.operators.metrics import roc_auc, score_curve
    d = first_n(train, n).where(F.col(label) >= 0)
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    if stats["n"] < min_valid or (stats["p"] or 0) < min_pos:
        return True, None
    d = shuffle_labels(d, label, seed=seed)
    fit_part, eval_part = half_split(d)
    model = Pipeline(stages=[_assembler(features),
                             GBTClassifier(featuresCol="features", labelCol=label, maxIter=50,
                                           maxDepth=4, seed=seed)]).fit(
        fit_part.withColumn(label, F.col(label).cast("double")))
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(eval_part).select(vector_to_array("probability")[1].alias("score"),
                                               F.col(label).alias("label"))
    auc = roc_auc(score_curve(scored, "score", "label")).first()["auc"]
    return (auc is None or auc <= limit), auc
