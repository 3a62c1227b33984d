"""Fitted operators on small tables: confidence models, left-out scoring, curve smoothing, and their application."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources.staged import written


def confidence_model(volumes: DataFrame, features: list[str], label: str, c: float = 0.1):
    """Ridge logistic regression of a 0/1 label; the penalty is that of cost ``c`` on summed losses."""
    n = volumes.count()
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(volumes)
    model = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=True, labelCol=label).fit(assembled)
    return model, features


def category_confidence(volumes: DataFrame, categories: list[str], features: list[str], label: str, c: float = 0.1) -> DataFrame:
    """``volumes(vol, category, pages, ..)`` with ``score``: each category by a model of its own, fitted to the volumes that have pages of it.

    The volumes are written once; counts, fits and scores of all categories read them.
    """
    volumes, parts = written(volumes, "category-volumes"), []
    for g in categories:
        own = volumes.where((F.col("category") == g) & (F.col("pages") > 0))
        parts.append(apply_confidence(*confidence_model(own, features, label, c), own))
    return reduce(DataFrame.unionByName, parts)


def apply_confidence(model, features: list[str], volumes: DataFrame) -> DataFrame:
    """``volumes`` with ``score``, the probability of the label."""
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(volumes)
    return model.transform(assembled).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _newton_sums(rows: DataFrame, x_cols: list[str], label: str, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hessian and gradient of the logistic loss at ``w``, summed in each task and then over tasks."""
    d = len(x_cols) + 1

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d * d + d)
        for part in parts:
            x = np.column_stack([np.ones(len(part)), part[x_cols].to_numpy(float)])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            total += np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (p - part[label].to_numpy(float))])
        yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

    sums = rows.select(*x_cols, label).mapInPandas(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    total = sums.orderBy("at").toPandas()["v"].to_numpy()  # as many rows as the model has coefficients, squared
    return total[: d * d].reshape(d, d), total[d * d :]


def leave_one_out(volumes: DataFrame, features: list[str], label: str, key: str = "vol", c: float = 0.1, steps: int = 50, block: int = 1024, tolerance: float = 1e-9) -> DataFrame:
    """``key, score``: each volume scored by a model of all others, as if each had been fitted on its own.

    One model is fitted to all volumes by Newton's method. From there all left-out models go on together,
    each with its own coefficients: their gradients over all rows but their own, and a step by the common
    Hessian without the own row (a rank-one update), until no gradient is left. Rows and models are cut
    into blocks; a block of models meets every block of rows, so a gradient of all models is as many
    matrix products as pairs of blocks, which are spread over the tasks, and no task or driver holds all
    rows or models. The work is that of N fits of N - 1 rows. Features are scaled by all volumes.
    """
    stats = volumes.agg(*[f(F.col(x).cast("double")).alias(f"{n}_{x}") for x in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [((F.col(x) - F.lit(stats[f"m_{x}"])) / F.lit(stats[f"s_{x}"] or 1.0)).alias(x) for x in features]
    rows = written(volumes.select(key, *scaled, F.col(label).cast("double").alias(label)), "leave-one-out")
    d = len(features) + 1
    w, penalty = np.zeros(d), np.eye(d) / c
    for _ in range(steps):
        hessian, gradient = _newton_sums(rows, features, label, w)
        step = np.linalg.solve(hessian + penalty, gradient + penalty @ w)
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    hessian = _newton_sums(rows, features, label, w)[0] + penalty
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    kind = volumes.schema[key].dataType.simpleString()
    schema = f"block string, x binary, y binary, w binary, step double, keys array<{kind}>"

    def stacked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of rows, each with its models at the common fit."""
        for part in parts:
            for i in range(0, len(part), block):
                own = part.iloc[i : i + block]
                x = np.column_stack([np.ones(len(own)), own[features].to_numpy(float)])
                yield pd.DataFrame({"block": [uuid.uuid4().hex], "x": [x.tobytes()], "y": [own[label].to_numpy(float).tobytes()], "w": [np.tile(w, (len(own), 1)).tobytes()], "step": [np.inf], "keys": [own[key].tolist()]})

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The loss gradient of a block of models over one block of rows."""
        for part in parts:
            for b, models, x, y in zip(part["block"], part["w"], part["x"], part["y"], strict=True):
                models, x, y = np.frombuffer(models).reshape(-1, d), np.frombuffer(x).reshape(-1, d), np.frombuffer(y)
                yield pd.DataFrame({"block": [b], "g": [((sigmoid(models @ x.T) - y) @ x).tobytes()]})

    def improved(own: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        """A step of a block of models: their own rows leave the gradient and, by a rank-one update, the Hessian."""
        r = own.iloc[0]
        x, y, models = np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["y"]), np.frombuffer(r["w"]).reshape(-1, d)
        p = sigmoid(np.einsum("ij,ij->i", x, models))
        g = sum(np.frombuffer(b).reshape(-1, d) for b in sums["g"]) - (p - y)[:, None] * x + models @ penalty
        inverse = np.linalg.inv(hessian)
        q = sigmoid(x @ w)
        v, z = q * (1 - q), x @ inverse
        step = g @ inverse
        step += (v * np.einsum("ij,ij->i", step, x) / (1 - v * np.einsum("ij,ij->i", z, x)))[:, None] * z
        return pd.DataFrame({"block": [r["block"]], "x": [r["x"]], "y": [r["y"]], "w": [(models - step).tobytes()], "step": [np.abs(step).max()], "keys": [r["keys"]]})

    blocks = written(rows.mapInPandas(stacked, schema), "leave-one-out-blocks")
    data = blocks.select(F.col("block").alias("with"), "x", "y")
    names = [r.block for r in blocks.select("block").collect()]  # one for each ``block`` rows
    for _ in range(steps if names else 0):
        pairs = blocks.select("block", "w", F.explode(F.array(*map(F.lit, names))).alias("with")).join(data, "with").select("block", "w", "x", "y")
        sums = pairs.mapInPandas(partial, "block string, g binary")
        blocks = written(blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInPandas(improved, schema), "leave-one-out-blocks")
        if blocks.agg(F.max("step")).first()[0] < tolerance:
            break

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, r in part.iterrows():
                x, models = np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["w"]).reshape(-1, d)
                yield pd.DataFrame({key: list(r["keys"]), "score": sigmoid(np.einsum("ij,ij->i", x, models))})

    return blocks.mapInPandas(score, f"{key} {kind}, score double")


def smooth_curves(curves: DataFrame, share: float = 0.3) -> DataFrame:
    """``curve, idx, smoothed`` of ``curves(curve, idx, y)``: local linear regression over the nearest ``share`` of a curve's points, bounded to [0, 1], three digits."""

    def lowess(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx", ignore_index=True)
        x, y = part["idx"].to_numpy(float), part["y"].to_numpy(float)
        k, out = max(2, int(np.ceil(share * len(x)))), np.empty(len(x))
        for i in range(len(x)):
            d = np.abs(x - x[i])
            near = np.argsort(d, kind="stable")[:k]
            w = (1 - (d[near] / max(d[near].max() * 1.0001, 1e-9)) ** 3) ** 3
            fit = np.polyfit(x[near] - x[i], y[near], 1, w=np.sqrt(w)) if len(near) > 2 else [0, y[i]]
            out[i] = fit[-1]
        return pd.DataFrame({"curve": part["curve"], "idx": part["idx"], "smoothed": np.round(np.clip(out, 0, 1), 3)})

    return curves.where("y IS NOT NULL").groupBy("curve").applyInPandas(lowess, "curve string, idx int, smoothed double")


def fractional_logit(volumes: DataFrame, features: list[str], label: str) -> DataFrame:
    """``volumes`` with ``predicted``: a binomial regression of an accuracy in [0, 1]."""
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(volumes)
    model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol=label, predictionCol="predicted", regParam=1e-3).fit(assembled)
    return model.transform(assembled).drop("features")


def support_vector(train: DataFrame, category: str, c: float = 1.4):
    """A linear support vector model of one category, and a logistic calibration of its margin."""
    own = train.withColumn("is", (F.col("category") == category).cast("double"))
    svc = LinearSVC(labelCol="is", regParam=1.0 / (c * max(1, own.count())), maxIter=50).fit(own)
    margin = VectorAssembler(inputCols=["margin"], outputCol="m").transform(svc.transform(own).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("prediction", "rawPrediction"))
    return svc, LogisticRegression(labelCol="is", featuresCol="m").fit(margin)


def score_support_vector(models: tuple, pages: DataFrame) -> DataFrame:
    svc, calibration = models
    margin = VectorAssembler(inputCols=["margin"], outputCol="m").transform(svc.transform(pages).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("prediction", "rawPrediction"))
    return calibration.transform(margin).withColumn("p", vector_to_array("probability")[1]).drop("m", "margin", "probability", "prediction", "rawPrediction")
