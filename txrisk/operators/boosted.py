"""Boosted trees whose number of rounds is chosen by a ranking
metric on validation rows (AUC, or AP for the rare MEV label), and models as
tables that score plain columns.

MLlib fits the rounds and its saved model is read back as a table of nodes.  A
fit of n rounds begins with the rounds of any shorter fit with the same seed, so
rounds are fitted in doubling blocks that end at the most rounds asked for, until
``patience`` rounds bring nothing better: in all fewer than twice the last block.  Margins of the
validation rows are carried from block to block in written tables; each block's
rounds share one exact score curve.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.operators import metrics as M
from txrisk.operators.baselines import _assembler, pos_weight, standardize_stats
from txrisk.session import checkpoint_dir, ship_package

RANKING = {"revert": "auc", "mev": "ap", "drop": "auc"}  # what chooses the rounds of each task
NODES = ("tree int, node int, feature int, threshold double, left int, right int, value double, weight double, "
         "columns array<string>")
BLOCK = 50  # rounds that share a score curve


# ---------------------------------------------------------------------------
# Trees as a table
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class BoostedTrees:
    """Nodes of all trees, one tree after another; ``feature`` is -1 at a leaf."""
    columns: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray     # places of the children among all nodes
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    @property
    def rounds(self) -> int:
        return len(self.roots)

    def first(self, rounds: int) -> BoostedTrees:
        """The model after so many rounds."""
        end = self.roots[rounds] if rounds < self.rounds else len(self.feature)
        cut = {c: getattr(self, c)[:end] for c in ("feature", "threshold", "left", "right", "value")}
        return replace(self, **cut, roots=self.roots[:rounds], weights=self.weights[:rounds])

    def outputs(self, x: np.ndarray, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
        """What each tree from ``start`` on adds to the margin of each row of
        ``x``.  A missing value (NaN) is not below any threshold and goes right."""
        rows = np.arange(len(x))
        for t in range(start, self.rounds if stop is None else stop):
            at = np.full(len(x), self.roots[t])
            inner = rows[self.feature[at] >= 0]
            while len(inner):
                node = at[inner]
                below = x[inner, self.feature[node]] <= self.threshold[node]
                at[inner] = np.where(below, self.left[node], self.right[node])
                inner = inner[self.feature[at[inner]] >= 0]
            yield self.weights[t] * self.value[at]

    def sql(self) -> str:
        """The score as an SQL expression over the columns, for engines without this
        library; as long as the model has nodes.  Columns must not be NULL or NaN."""
        def walk(i: int) -> str:
            if self.feature[i] < 0:
                return f"CAST({float(self.value[i])!r} AS DOUBLE)"
            return (f"CASE WHEN {self.columns[self.feature[i]]} <= CAST({float(self.threshold[i])!r} AS DOUBLE) "
                    f"THEN {walk(self.left[i])} ELSE {walk(self.right[i])} END")
        margin = " + ".join(f"CAST({float(w)!r} AS DOUBLE) * ({walk(r)})" for r, w in zip(self.roots, self.weights))
        return f"1 / (1 + exp(-2 * ({margin or 'CAST(0 AS DOUBLE)'})))"

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node (NODES), as many as the model has."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        base = self.roots[tree] if self.rounds else tree
        rows = [(int(t), i - int(b), int(f), float(x), int(lo - b), int(hi - b), float(v), float(self.weights[t]),
                 list(self.columns))
                for i, (t, b, f, x, lo, hi, v) in enumerate(zip(tree, base, self.feature, self.threshold, self.left,
                                                                self.right, self.value))]
        return spark.createDataFrame(rows, NODES)

    @classmethod
    def from_table(cls, nodes: DataFrame, columns: list[str]) -> BoostedTrees:
        """From rows tree, node, feature, threshold, left, right, value, weight; children by node number."""
        n = nodes.select("tree", "node", "feature", "threshold", "left", "right", "value", "weight").toPandas()
        n = n.sort_values(["tree", "node"])
        tree = n["tree"].to_numpy()
        roots = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if len(n) else np.zeros(0, np.int64)
        base = np.repeat(roots, np.diff(np.append(roots, len(n))))
        child = lambda c: np.maximum(n[c].to_numpy() + base, 0)
        return cls(tuple(columns), n["feature"].to_numpy(), n["threshold"].to_numpy(np.float64), child("left"),
                   child("right"), n["value"].to_numpy(np.float64), roots, n["weight"].to_numpy(np.float64)[roots])


def read_trees(spark: SparkSession, model, columns: list[str]) -> BoostedTrees:
    """The trees of a fitted MLlib GBT classifier, from what it saves."""
    path = os.path.join(checkpoint_dir(spark), "models", f"trees-{uuid.uuid4().hex}")
    model.write().save(path)
    d = spark.read.parquet(os.path.join(path, "data")).select("treeID", "nodeData.*")
    nodes = d.select(F.col("treeID").alias("tree"), F.col("id").alias("node"),
                     F.when(F.col("leftChild") < 0, F.lit(-1)).otherwise(F.col("split.featureIndex")).alias("feature"),
                     F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
                     F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                     F.col("prediction").alias("value"), F.lit(1.0).alias("weight"))
    return replace(BoostedTrees.from_table(nodes, columns), weights=np.array(model.treeWeights, np.float64))


def save_trees(models: dict[str, BoostedTrees], spark: SparkSession, path: str) -> None:
    """The node tables of all tasks under ``path``."""
    for task, m in models.items():
        m.table(spark).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, task))


def load_trees(spark: SparkSession, path: str) -> dict[str, BoostedTrees]:
    out = {}
    for task in S.TASKS:
        nodes = spark.read.schema(NODES).parquet(os.path.join(path, task))
        out[task] = BoostedTrees.from_table(nodes, nodes.select("columns").first()["columns"])
    return out


def _matrix(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """Feature columns as doubles, NULL as NaN."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1) \
        if columns else np.zeros((batch.num_rows, 0))


def _doubles(df: DataFrame, columns: tuple[str, ...], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(f"_x_{c}") for c in columns])


def tree_scores(df: DataFrame, models: dict[str, BoostedTrees], keep: list[str] = ("tx_id",)) -> DataFrame:
    """(keep…, one float ``{task}_score`` per model) in one pass over plain
    columns.  The models, as large as their rounds and depth, go to each task once."""
    spark = df.sparkSession
    ship_package(spark)
    columns = tuple(dict.fromkeys(c for m in models.values() for c in m.columns))
    slim = _doubles(df, columns, list(keep))
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: b.column(c) for c in keep}
            for task, m in shared.value.items():
                margin = np.zeros(b.num_rows)
                for add in m.outputs(_matrix(b, tuple(f"_x_{c}" for c in m.columns))):
                    margin += add
                out[f"{task}_score"] = pa.array((1.0 / (1.0 + np.exp(-2.0 * margin))).astype(np.float32))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keep]
    return slim.mapInArrow(run, ", ".join([*fields, *[f"{t}_score float" for t in models]]))


# ---------------------------------------------------------------------------
# Rounds chosen by a ranking metric
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Ranked:
    model: BoostedTrees          # the chosen rounds only
    metric: str
    values: tuple[float | None, ...]  # after each round that was looked at
    pos_weight: float

    @property
    def best(self) -> int:
        return best_round(self.values)


def best_round(values) -> int:
    """The first round (from 1) with the greatest value.  An undefined value (one
    class only) is below all others; if all are, the first round is taken."""
    v = [-np.inf if x is None else x for x in values]
    return int(np.argmax(v)) + 1 if v else 0


def staged_values(rows: DataFrame, trees: BoostedTrees, metric: str, start: int, stop: int) -> list[float | None]:
    """The metric after each of the rounds start + 1 to stop.  ``rows`` has
    features, label and ``margin`` after ``start`` rounds."""
    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = shared.value
            margin = b.column("margin").to_numpy().copy()
            for t, add in enumerate(m.outputs(_matrix(b, tuple(f"_x_{c}" for c in m.columns)), start, stop)):
                margin += add
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(margin), start + t + 1, np.int32)), pa.array(margin), b.column("label")],
                    ["round", "score", "label"])

    staged = rows.mapInArrow(run, "round int, score double, label double")
    n = rows.count()
    curve = M.score_curve(staged, "score", "label", ["round"], max_group_rows=n)
    found = M.curve_metrics(curve.withColumns({"n_above": F.lit(0), "pos_above": F.lit(0)}), ["round"])
    by = {r["round"]: r[metric] for r in found.select("round", metric).collect()}  # one row per round
    return [by.get(i) for i in range(start + 1, stop + 1)]


def advance(rows: DataFrame, trees: BoostedTrees, start: int, stop: int) -> DataFrame:
    """``rows`` with ``margin`` after ``stop`` rounds."""
    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = shared.value
            margin = b.column("margin").to_numpy().copy()
            for add in m.outputs(_matrix(b, tuple(f"_x_{c}" for c in m.columns)), start, stop):
                margin += add
            yield b.set_column(b.schema.get_field_index("margin"), "margin", pa.array(margin))

    return rows.mapInArrow(run, rows.schema)


def first_block(max_iter: int, patience: int) -> int:
    """The least share max_iter / 2^k (rounded up) that has 2 x ``patience`` rounds; max_iter if it has fewer."""
    fitted = max_iter
    while -(-fitted // 2) >= 2 * patience and fitted > 1:
        fitted = -(-fitted // 2)
    return fitted


def fit_ranked_gbt(train: DataFrame, val: DataFrame, features: S.FeatureSet = S.FeatureSet(), max_iter: int = 1000,
                   patience: int = 50, max_depth: int = 8, step: float = 0.05, min_instances: int = 200,
                   subsample: float = 0.9, seed: int = 42, tasks: dict | None = None,
                   block: int = BLOCK) -> dict[str, Ranked]:
    """L2: per task boosted trees as ``fit_gbt`` fits them, with as many rounds as
    rank the validation rows best; fitting ends once ``patience`` rounds bring
    nothing better, or at ``max_iter``.  Rows with an unknown label are left out.
    Without valid validation rows of both classes one round is kept."""
    from pyspark.ml.classification import GBTClassifier
    spark = train.sparkSession
    cols = features.columns
    out = {}
    for task, lab in (tasks or S.TASKS).items():
        metric = RANKING.get(task, "auc")
        d = train.select(*cols, F.col(lab).cast("double").alias(lab)).where(F.col(lab) >= 0)
        pw = pos_weight(d, lab).first()["pos_weight"]
        d = _assembler(cols).transform(d.withColumn("weight", F.when(F.col(lab) == 1, F.lit(pw)).otherwise(F.lit(1.0))))
        rows = _doubles(val.where(F.col(lab) >= 0).withColumns(
            {"label": F.col(lab).cast("double"), "margin": F.lit(0.0)}), tuple(cols), ["label", "margin"])
        values: list[float | None] = []
        fitted = first_block(max_iter, patience)
        while True:
            trees = read_trees(spark, GBTClassifier(
                featuresCol="features", labelCol=lab, weightCol="weight", maxDepth=max_depth, maxIter=fitted,
                stepSize=step, minInstancesPerNode=min_instances, subsamplingRate=subsample,
                featureSubsetStrategy="0.9", seed=seed, maxBins=64).fit(d), cols)
            while len(values) < trees.rounds and len(values) - best_round(values) < patience:
                at, to = len(values), min(len(values) + block, trees.rounds)
                values += staged_values(rows, trees, metric, at, to)
                if len(values) - best_round(values) >= patience or to >= max_iter:
                    break  # no later round is looked at
                path = os.path.join(checkpoint_dir(spark), "models", f"margins-{uuid.uuid4().hex}")
                carried = advance(rows, trees, at, to)
                carried.write.parquet(path)
                rows = spark.read.schema(carried.schema).parquet(path)
            if len(values) - best_round(values) >= patience or trees.rounds < fitted or fitted >= max_iter:
                break
            fitted = min(max_iter, 2 * fitted)
        # rounds after the one where patience ran out were looked at with their block only
        stop = next((i for i in range(1, len(values) + 1) if i - best_round(values[:i]) >= patience), len(values))
        values = values[:stop]
        out[task] = Ranked(trees.first(best_round(values)), metric, tuple(values), pw)
    return out


def round_report(spark: SparkSession, fits: dict[str, Ranked]) -> DataFrame:
    """task, metric, best_round, best_value, rounds looked at, pos_weight."""
    rows = [(t, f.metric, f.best, f.values[f.best - 1] if f.values else None, len(f.values), float(f.pos_weight))
            for t, f in fits.items()]
    return spark.createDataFrame(rows, "task string, metric string, best_round int, best_value double, rounds int, "
                                       "pos_weight double")


# ---------------------------------------------------------------------------
# Linear heads as a table and as expressions
# ---------------------------------------------------------------------------
HEADS = "task string, column string, mean double, std double, weight double"


def linear_heads(models: dict, train_stats, columns: list[str]) -> list[tuple]:
    """L3: rows of HEADS from fitted pipelines whose last stage is a logistic
    regression on standardised ``columns``; a row without a column holds the intercept."""
    rows = []
    for task, m in models.items():
        lr = m.stages[-1]
        for c, w in zip(columns, lr.coefficients.toArray()):
            rows.append((task, c, float(train_stats[f"{c}_mean"] or 0.0), float(train_stats[f"{c}_std"] or 1.0), float(w)))
        rows.append((task, None, 0.0, 1.0, float(lr.intercept)))
    return rows


def linear_table(train: DataFrame, models: dict, columns: list[str]) -> DataFrame:
    """The heads of ``fit_logreg`` as a table of coefficients."""
    return train.sparkSession.createDataFrame(
        linear_heads(models, standardize_stats(train, columns).first(), columns), HEADS)


def linear_sql(heads: list, task: str) -> str:
    """A head's score as an SQL expression; NULL and NaN count as the train mean."""
    parts = []
    for r in heads:
        t, c, mean, std, w = tuple(r)
        if t == task and c is not None:
            z = (f"(CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) THEN CAST(0 AS DOUBLE) ELSE (CAST({c} AS DOUBLE) - "
                 f"CAST({mean!r} AS DOUBLE)) / CAST({std!r} AS DOUBLE) END)")
            parts.append(f"CAST({w!r} AS DOUBLE) * {z}")
    b = next(r[4] for r in map(tuple, heads) if r[0] == task and r[1] is None)
    return f"1 / (1 + exp(-({' + '.join([f'CAST({b!r} AS DOUBLE)', *parts])})))"


def linear_scores(df: DataFrame, heads: list, keep: list[str] = ("tx_id",)) -> DataFrame:
    """(keep…, ``{task}_score``) as plain expressions over the columns: no
    vectors, no Python, inside the scan's code generation."""
    tasks = list(dict.fromkeys(tuple(r)[0] for r in heads))
    score: dict[str, Column] = {t: F.expr(linear_sql(heads, t)).cast("float") for t in tasks}
    return df.select(*keep, *[c.alias(f"{t}_score") for t, c in score.items()])
