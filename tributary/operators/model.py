"""The click model: a weighted linear or boosted head over pair features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.derive import sigmoid


def train_click_model(rows: DataFrame, features: list[str] | str, label: str = "is_click", weight: str | None = "ips", kind: str = "logistic", **params) -> Model:
    """Fit P(label) on numeric columns or one array column, each row weighed by ``weight``."""
    head = (LogisticRegression if kind == "logistic" else GBTClassifier)(featuresCol="__x", labelCol=label, **params)
    if weight:
        head = head.setWeightCol(weight)
    if isinstance(features, str):
        return head.fit(rows.withColumn("__x", array_to_vector(F.col(features))).withColumn(label, F.col(label).cast("double")))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), head]).fit(rows.withColumn(label, F.col(label).cast("double")))


def coefficients(model: Model) -> tuple[list[float], float]:
    """Weights and intercept of a fitted logistic head."""
    head = model.stages[-1] if hasattr(model, "stages") else model
    return [float(x) for x in head.coefficients], float(head.intercept)


@dataclass(frozen=True)
class Optimum:
    """First and second derivatives of the mean weighted log loss in the weights, then the intercept."""

    gradient: np.ndarray
    hessian: np.ndarray

    @property
    def step(self) -> np.ndarray:
        """What a Newton step takes off the weights, then the intercept."""
        return np.linalg.lstsq(self.hessian, self.gradient, rcond=None)[0]

    @property
    def reached(self) -> bool:
        """Whether a Newton step would lower the loss by nothing that counts, less than 1e-18.

        The weights may still be 1e-8 off, which shows in scores of six digits; that step ends within rounding.
        """
        return float(self.gradient @ self.step) < 2e-18


def optimality(rows: DataFrame, features: list[str], weights: list[float], intercept: float, label: str = "is_click", weight: str | None = "ips") -> Optimum:
    """How far a logistic head is from the best one of its rows: one pass, sums by the size of the head.

    A missing feature counts as 0, as in ``linear_score``; rows without a label or weight have none.
    """
    x = [*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], F.lit(1.0)]
    w, d = F.col(weight).cast("double") if weight else F.lit(1.0), len(x)
    scored = linear_score(rows, features, weights, intercept).select(*[v.alias(f"x{i}") for i, v in enumerate(x)], w.alias("w"), F.col(label).cast("double").alias("y"), F.col("score").alias("p"))
    scored = scored.where(F.col("w").isNotNull() & F.col("y").isNotNull())
    first = [F.sum(F.col("w") * (F.col("p") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(d)]
    second = [F.sum(F.col("w") * F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
    found = scored.agg(F.sum("w").alias("all"), *first, *second).first()
    if not found["all"]:
        raise ValueError("no row has a label and a weight")
    hessian = np.array([[found[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    return Optimum(np.array([found[f"g{i}"] for i in range(d)]) / found["all"], hessian / found["all"])


def refine(rows: DataFrame, features: list[str], weights: list[float], intercept: float, label: str = "is_click", weight: str | None = "ips", steps: int = 20) -> tuple[list[float], float]:
    """The best logistic head of the rows, by Newton steps from one that is near it, such as a fitted one.

    ``rows`` are read once a step: write them first if they are costly.  Raises if the optimum is not reached, as
    with classes that a plane separates, which have none.
    """
    at = np.array([*weights, intercept], float)
    for _ in range(steps):
        here = optimality(rows, features, at[:-1].tolist(), float(at[-1]), label, weight)
        at = at - here.step  # the last one too: the loss is flat there long before the weights are exact
        if here.reached:
            return at[:-1].tolist(), float(at[-1])
    raise ValueError(f"no optimum after {steps} steps; the gradient is {here.gradient.tolist()}")


def linear_score(rows: DataFrame, features: list[str], weights: list[float], intercept: float) -> DataFrame:
    """Add logit and probability of a click from given weights; a missing feature counts as 0."""
    z = F.lit(float(intercept))
    for name, w in zip(features, weights, strict=True):
        z = z + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * float(w)
    return rows.withColumn("logit", z).withColumn("score", sigmoid("logit"))


def score(model: Model, rows: DataFrame, features: list[str] | str) -> DataFrame:
    """Add logit and probability of a click."""
    if isinstance(features, str):
        rows = rows.withColumn("__x", array_to_vector(F.col(features)))
    out = model.transform(rows)
    return out.withColumn("logit", vector_to_array("rawPrediction")[1]).withColumn("score", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")
