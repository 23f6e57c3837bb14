"""Models on trace tables: Spark ML pipelines, and fits whose sums are taken in tasks and whose steps on the driver."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wellspring.operators.ranking import with_scalars
from wellspring.operators.splits import shuffle_key
from wellspring.session import durable


def vectors(df: DataFrame, x: str = "x", seed: int = 0, pid: str = "pixel_id") -> DataFrame:
    """Add ``features``."""
    return three_way(df.withColumn("features", array_to_vector(F.col(x))), pid, seed)


def three_way(df: DataFrame, pid: str, seed: int = 0) -> DataFrame:
    """Add hash-based flags: ``is_test`` (about 15 %, never fitted on), ``is_val`` (15 %, stops the fit); the rest trains."""
    digit = F.conv(F.substring(shuffle_key(seed, pid), 1, 4), 16, 10).cast("int")
    return df.withColumns({"is_test": digit < int(0.15 * 65536), "is_val": (digit >= int(0.15 * 65536)) & (digit < int(0.30 * 65536))})


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weight positives by n_neg / n_pos."""
    w = df.agg(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("_pw"))
    return with_scalars(df, w).withColumn("weight", F.when(F.col(label) == 1, F.col("_pw")).otherwise(1.0)).drop("_pw")


def boosted_classifier(df: DataFrame, label: str, rounds: int = 20, depth: int = 3, seed: int = 0) -> PipelineModel:
    gbt = GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="is_val")
    return Pipeline(stages=[gbt]).fit(df)


def boosted_regressor(df: DataFrame, label: str, loss: str = "squared", rounds: int = 20, depth: int = 3, seed: int = 0, slope: float = 1.0):
    """Squared or absolute loss by Spark's boosting, ``huber`` by ``huber_boost``; rows flagged ``is_val`` stop the fit."""
    if loss == "huber":
        return huber_boost(df, label, slope, rounds, depth, seed)
    gbt = GBTRegressor(labelCol=label, lossType=loss, maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="is_val")
    return Pipeline(stages=[gbt]).fit(df)


class BoostedTrees:
    """A start value and trees, each with a value per leaf, that are added with one rate."""

    def __init__(self, start: float, rate: float, trees: list[tuple]):
        self.start, self.rate, self.trees = start, rate, trees

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("prediction", F.lit(self.start))
        for tree, values in self.trees:
            out = _leaves(tree, out).withColumn("prediction", F.col("prediction") + F.lit(self.rate) * _leaf_value(values)).drop("_leaf", "_tree")
        return out


def _leaves(tree, df: DataFrame) -> DataFrame:
    return tree.setPredictionCol("_tree").setLeafCol("_leaf").transform(df)


def _leaf_value(values: dict[float, float]) -> Column:
    """Value of the row's leaf; at most 2^depth entries."""
    table = F.create_map(*[F.lit(float(v)) for pair in values.items() for v in pair])
    return F.coalesce(F.element_at(table, F.col("_leaf")), F.lit(0.0))


def huber_boost(df: DataFrame, label: str, slope: float = 1.0, rounds: int = 20, depth: int = 3, seed: int = 0, rate: float = 0.3, patience: int = 5) -> BoostedTrees:
    """Stage-wise trees on the pseudo-Huber loss slope^2 (sqrt(1 + (r / slope)^2) - 1).

    A tree splits the residuals with weights w = gradient / residual, the curvature of the parabola that bounds the loss from above.
    Its leaves take Newton values sum(gradient) / sum(curvature); where outliers leave next to no curvature, half of sum(w) stands in, so that
    no leaf moves more than twice as far as that parabola's minimum. For a large slope this is squared loss. Rows flagged ``is_val`` choose the number of trees.
    """
    rows = df.filter(F.col(label).isNotNull())
    flag = F.col("is_val") if "is_val" in df.columns else F.lit(False)
    start = rows.filter(~flag).agg(F.percentile_approx(label, 0.5)).first()[0]
    trees: list[tuple] = []
    if start is None:
        return BoostedTrees(0.0, rate, trees)
    away = (F.col(label) - F.col("_f")) / F.lit(float(slope))
    bend = F.sqrt(1.0 + away * away)
    rows = durable(rows.withColumns({"_f": F.lit(float(start)), "_val": flag}))
    best, keep = math.inf, 0
    for turn in range(rounds):
        pulled = rows.filter("NOT _val").withColumns({"_r": F.col(label) - F.col("_f"), "_w": 1.0 / bend, "_h": F.pow(bend, -3.0)})
        tree = DecisionTreeRegressor(labelCol="_r", featuresCol="features", weightCol="_w", maxDepth=depth, seed=seed + turn).fit(pulled)
        sums = _leaves(tree, pulled).groupBy("_leaf").agg(F.sum(F.col("_w") * F.col("_r")).alias("g"), F.sum("_h").alias("h"), F.sum("_w").alias("w")).collect()  # one row a leaf
        values = {q["_leaf"]: q["g"] / max(q["h"], q["w"] / 2) for q in sums if q["w"] > 0}
        rows = _leaves(tree, rows).withColumn("_f", F.col("_f") + F.lit(rate) * _leaf_value(values)).drop("_leaf", "_tree")
        if turn % 5 == 4:
            rows = durable(rows)  # the plan does not grow with the rounds
        trees.append((tree, values))
        loss = rows.groupBy("_val").agg(F.avg(bend - 1.0).alias("l")).collect()  # two rows
        now = {q["_val"]: q["l"] for q in loss}
        now = now.get(True, now.get(False, math.inf))
        if now < best:
            best, keep = now, len(trees)
        elif len(trees) - keep >= patience:
            break
    return BoostedTrees(float(start), rate, trees[:keep])


# --- sums taken in tasks --------------------------------------------------------------------
def summed(df: DataFrame, columns, size: int, fn) -> np.ndarray:
    """Sum of ``fn(columns...)``, a vector of ``size`` numbers per batch, over all rows.

    A task adds up its batches, a second round of tasks adds up to 64 of those sums each, so what reaches the driver are few vectors of fixed size.
    """
    def add(frames, values):
        total = np.zeros(size)
        for pdf in frames:
            if len(pdf):
                total += values(pdf)
        yield pd.DataFrame({"v": [total.tobytes()]})

    first = df.select(*columns).mapInPandas(lambda f: add(f, lambda pdf: fn(*[pdf[c] for c in pdf.columns])), "v binary")
    parts = first.rdd.getNumPartitions()
    second = lambda f: add(f, lambda pdf: np.sum([np.frombuffer(b) for b in pdf["v"]], axis=0))
    while parts > 64:
        parts = math.ceil(parts / 64)
        first = first.coalesce(parts).mapInPandas(second, "v binary")
    return np.sum([np.frombuffer(r["v"]) for r in first.collect()], axis=0)


def matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float)


class DenseNet:
    """Weights of a fully connected network with ReLU layers and one logistic output."""

    def __init__(self, sizes: list[int], flat: np.ndarray):
        self.sizes, self.flat = list(sizes), np.asarray(flat, float)

    @classmethod
    def fresh(cls, sizes: list[int], seed: int) -> DenseNet:
        rng, parts = np.random.default_rng(seed), []
        for a, b in zip(sizes, sizes[1:]):
            parts += [rng.normal(scale=math.sqrt(2 / a), size=a * b), np.zeros(b)]
        return cls(sizes, np.concatenate(parts))

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((self.flat[at : at + a * b].reshape(a, b), self.flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.layers()[:-1]:
            x = np.maximum(x @ w + b, 0)
        w, b = self.layers()[-1]
        return 1 / (1 + np.exp(-np.clip((x @ w + b)[:, 0], -500, 500)))

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted cross-entropy, summed, and its gradient."""
        layers, acts = self.layers(), [x]
        for w, b in layers[:-1]:
            acts.append(np.maximum(acts[-1] @ w + b, 0))
        z = (acts[-1] @ layers[-1][0] + layers[-1][1])[:, 0]
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum()
        back = (weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))[:, None]
        parts: list[np.ndarray] = []
        for i in range(len(layers) - 1, -1, -1):
            parts = [(acts[i].T @ back).ravel(), back.sum(axis=0), *parts]
            if i:
                back = (back @ layers[i][0].T) * (acts[i] > 0)
        return loss, np.concatenate(parts)


def dense_classifier(df: DataFrame, label: str, x: str = "x", hidden=(64, 32, 16), weight: str | None = "weight", rounds: int = 60, seed: int = 0, patience: int = 10, memory: int = 10) -> DenseNet:
    """Dense network on array column ``x`` by limited-memory quasi-Newton steps; rows flagged ``is_val`` choose the weights.

    Each trial point costs one pass: tasks sum weighted losses and gradients, the driver holds only vectors of the model's size.
    """
    flag = F.col("is_val") if "is_val" in df.columns else F.lit(False)
    rows = df.filter(F.col(x).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(x, F.col(label).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), flag.alias("_val"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    width = rows.agg(F.max(F.size(x))).first()[0]
    if width is None:
        return DenseNet.fresh([1, *hidden, 1], seed)
    net = DenseNet.fresh([width, *hidden, 1], seed)
    size = len(net.flat)

    def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray, float]:
        at = DenseNet(net.sizes, flat)

        def part(xs, ys, ws, vals):
            mat, y, w, val = matrix(xs), ys.to_numpy(), ws.to_numpy(), vals.to_numpy(bool)
            loss, slope = at.loss_and_gradient(mat[~val], y[~val], w[~val])
            held = at.loss_and_gradient(mat[val], y[val], w[val])[0] if val.any() else 0.0
            return np.concatenate([[loss, w[~val].sum(), held, w[val].sum()], slope])

        total = summed(rows, [x, "_y", "_w", "_val"], size + 4, part)
        count = max(total[1], 1e-12)
        return total[0] / count, total[4:] / count, total[2] / total[3] if total[3] > 0 else total[0] / count

    flat, past = net.flat, []
    loss, slope, held = evaluate(flat)
    best, chosen, since = held, flat, 0
    for _ in range(rounds):
        step = _quasi_newton(slope, past)
        rate = 1.0 if past else min(1.0, 1.0 / max(np.abs(slope).sum(), 1e-12))
        for _ in range(12):  # halve until the loss falls enough
            trial = flat - rate * step
            new_loss, new_slope, new_held = evaluate(trial)
            if new_loss <= loss - 1e-4 * rate * (slope @ step):
                break
            rate /= 2
        else:
            break
        moved, turned = trial - flat, new_slope - slope
        if moved @ turned > 1e-10:
            past = [*past, (moved, turned)][-memory:]
        small = abs(loss - new_loss) <= 1e-7 * max(abs(loss), 1e-12)
        flat, loss, slope = trial, new_loss, new_slope
        since = since + 1
        if new_held < best:
            best, chosen, since = new_held, flat, 0
        if small or since >= patience:
            break
    rows.unpersist()
    return DenseNet(net.sizes, chosen)


def _quasi_newton(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Inverse curvature times the gradient, from the last steps and the changes of gradient they made."""
    q, used = slope.copy(), []
    for moved, turned in reversed(past):
        a = (moved @ q) / (moved @ turned)
        q -= a * turned
        used.append(a)
    if past:
        moved, turned = past[-1]
        q *= (moved @ turned) / (turned @ turned)
    for (moved, turned), a in zip(past, reversed(used)):
        q += moved * (a - (turned @ q) / (moved @ turned))
    return q


def logistic_classifier(df: DataFrame, label: str) -> PipelineModel:
    """Class-weighted logistic regression."""
    return Pipeline(stages=[LogisticRegression(labelCol=label, weightCol="weight", maxIter=50)]).fit(df)


def store_net(net: DenseNet, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(json.dumps(net.sizes), net.flat.tolist())], "sizes string, weights array<double>").write.parquet(path)


def load_net(spark: SparkSession, path: str) -> DenseNet:
    row = spark.read.parquet(path).first()  # one row: the model
    return DenseNet(json.loads(row["sizes"]), np.array(row["weights"]))


def batch_score(spark: SparkSession, path: str, x: Column, batch_size: int = 4096) -> Column:
    """Score of a stored network for array column ``x``, in batches; a worker unpacks the model once."""
    net = load_net(spark, path)
    shared = spark.sparkContext.broadcast((net.sizes, net.flat))  # fixed size, whatever the table

    def loaded():
        model = DenseNet(*shared.value)
        return lambda rows: model.score(rows)

    return predict_batch_udf(loaded, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[net.sizes[0]]])(x)


class Components:
    """Mean and leading directions of some rows; ``error`` is what they leave of a trace."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, share: np.ndarray):
        self.mean, self.axes, self.share = mean, axes, share

    def error(self):
        """Pandas UDF: root mean squared residual of an array column."""
        mean, axes = self.mean, self.axes

        @F.pandas_udf("double")
        def residual(x: pd.Series) -> pd.Series:
            away = matrix(x) - mean
            return pd.Series(np.sqrt(((away - (away @ axes.T) @ axes) ** 2).mean(axis=1)))

        return residual


def components(df: DataFrame, x: str = "x", k: int = 8) -> Components:
    """Leading ``k`` components of an array column from sums of products taken in tasks; the driver sees one matrix of width squared."""
    rows = df.filter(F.col(x).isNotNull())
    width = rows.agg(F.max(F.size(x))).first()[0]
    if width is None:
        raise ValueError("no rows to take components of")

    def part(xs):
        mat = matrix(xs)
        return np.concatenate([[len(mat)], mat.sum(axis=0), (mat.T @ mat).ravel()])

    total = summed(rows, [x], 1 + width + width * width, part)
    mean = total[1 : 1 + width] / total[0]
    square = total[1 + width :].reshape(width, width) / total[0] - np.outer(mean, mean)
    values, axes = np.linalg.eigh((square + square.T) / 2)
    order = np.argsort(values)[::-1]
    return Components(mean, axes[:, order[:k]].T, values[order[:k]] / max(values.sum(), 1e-300))


def score(model, df: DataFrame, x: str = "x") -> DataFrame:
    """Batch scoring: adds ``y_score`` for a classifier or ``ttp_pred`` for a regressor."""
    if isinstance(model, DenseNet):
        sizes, flat = model.sizes, model.flat
        run = F.pandas_udf(lambda v: pd.Series(DenseNet(sizes, flat).score(matrix(v))), "double")
        return df.withColumn("y_score", run(F.col(x)))
    out = model.transform(df)
    if "probability" in out.columns:
        return out.withColumn("y_score", F.get(vector_to_array("probability"), F.lit(1)))
    return out.withColumnRenamed("prediction", "ttp_pred")


def importance(model: PipelineModel, spark) -> DataFrame:
    """Gain table: one row per sample position (as many rows as a trace has samples)."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "sample int, gain double")


def assembled(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


