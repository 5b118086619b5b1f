"""Model surface: window tensors, recurrent inference in NumPy, linear and tree models of pyspark.ml."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], context: int, stride: int = 1) -> DataFrame:
    """Adds window: array<array<double>> of the last context rows' features, for rows with a full context within keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    rows = rows.withColumns({"window": F.collect_list(values).over(w.rowsBetween(-context + 1, 0)), "_n": F.row_number().over(w)})
    return rows.where((F.col("_n") >= context) & (F.pmod(F.col("_n") - context, F.lit(stride)) == 0)).drop("_n")


def lstm_weights(inputs: int, hidden: int, heads: int = 1, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *n: rng.uniform(-1, 1, n) / np.sqrt(hidden)
    return {"w": small(4 * hidden, inputs), "u": small(4 * hidden, hidden), "b": small(4 * hidden), "v": small(heads, hidden), "c": small(heads)}


def lstm(x: np.ndarray, p: dict[str, np.ndarray], state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Heads' outputs for each row of x (time, inputs) and the state after it; gates in order input, forget, cell, output."""
    n = p["u"].shape[1]
    h, c = state if state is not None else (np.zeros(n), np.zeros(n))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    given, out = x @ p["w"].T + p["b"], []
    for row in given:
        z = row + p["u"] @ h
        c = sig(z[n : 2 * n]) * c + sig(z[:n]) * np.tanh(z[2 * n : 3 * n])
        h = sig(z[3 * n :]) * np.tanh(c)
        out.append(p["v"] @ h + p["c"])
    return np.array(out).reshape(len(x), -1), (h, c)


def lstm_scores(rows: DataFrame, keys: Sequence[str], order: str, features: Sequence[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """Probability of the first head at every row of an event (keys), with the state carried within it; a task holds one event."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*keys, order])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y, _ = lstm(pdf[list(features)].to_numpy(float), weights)
        return pdf[[*keys, order]].assign(probability=1 / (1 + np.exp(-np.clip(y[:, 0], -30, 30))))

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, probability double")


def _prepared(features: Sequence[str]) -> list:
    return [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"), RobustScaler(inputCol="_raw", outputCol="_features", withCentering=True)]


def logistic(rows: DataFrame, features: Sequence[str], label: str, weight: str | None = None, ridge: float = 1e-3):
    """A fitted pipeline of robust scaling and weighted logistic regression."""
    model = LogisticRegression(featuresCol="_features", labelCol=label, regParam=ridge, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[*_prepared(features), model]).fit(rows)


def boosted(rows: DataFrame, features: Sequence[str], label: str, classify: bool = True, rounds: int = 10, depth: int = 4, seed: int = 0):
    """A fitted pipeline of gradient-boosted trees."""
    kind = GBTClassifier if classify else GBTRegressor
    return Pipeline(stages=[*_prepared(features), kind(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)]).fit(rows)


def probabilities(model, rows: DataFrame, name: str = "probability_1") -> DataFrame:
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("_raw", "_features", "rawPrediction", "probability", "prediction")


def freeze(params: dict[str, np.ndarray], names: Sequence[str]) -> str:
    """Weights and ordered feature names as JSON with a digest of its body."""
    body = json.dumps({"names": list(names), "params": {k: v.tolist() for k, v in params.items()}}, sort_keys=True)
    return json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body})


def thaw(text: str, names: Sequence[str]) -> dict[str, np.ndarray]:
    """The weights of a frozen model; raises if it was changed or expects other features, or in another order."""
    frozen = json.loads(text)
    if hashlib.sha256(frozen["body"].encode()).hexdigest() != frozen["sha256"]:
        raise ValueError("the frozen model was changed")
    body = json.loads(frozen["body"])
    if body["names"] != list(names):
        raise ValueError("the frozen model expects other features")
    return {k: np.array(v) for k, v in body["params"].items()}


def assert_features(rows: DataFrame, names: Sequence[str]) -> None:
    """Raises unless rows have the named columns, in this order."""
    have = [c for c in rows.columns if c in set(names)]
    if have != list(names):
        raise ValueError(f"expected {list(names)}, found {have}")


def calibration(rows: DataFrame, member: str, value: str, quantile: float = 0.995) -> DataFrame:
    """Per member the factor that brings its upper quantile to the mean of all members' quantiles."""
    q = rows.groupBy(member).agg(F.percentile(value, F.lit(quantile)).alias("q"))
    mean = F.avg("q").over(Window.partitionBy(F.lit(0)))  # one row per member
    return q.withColumn("factor", F.try_divide(mean, F.col("q")))
