"""Regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.statistics import NAMES, statistics
from grainmill.llm.text import written


@dataclass(frozen=True)
class QdaRules:
    """``shrinkage`` is the weight of the pooled covariance in each class; ``ridge`` is added to the
    diagonal, as a part of the pooled variance and as ``floor``."""

    shrinkage: float = 0.3
    ridge: float = 1e-3
    floor: float = 1e-5


@dataclass(frozen=True)
class Moments:
    """Sums over the rows of one class: of 1, x and the products of x."""

    n: float
    total: np.ndarray
    products: np.ndarray


@dataclass(frozen=True)
class Qda:
    """Means, inverse Cholesky factors and log densities' constants of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    @staticmethod
    def fit(classes: dict[int, Moments], rules: QdaRules = QdaRules()) -> "Qda | float":
        """The model, or the share of label 1 (0.5 without rows) if a class has no rows."""
        n = [classes[k].n if k in classes else 0 for k in (0, 1)]
        if not all(n):
            return n[1] / sum(n) if sum(n) else 0.5
        means = [classes[k].total / n[k] for k in (0, 1)]
        spreads = [classes[k].products / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (n[0] * spreads[0] + n[1] * spreads[1]) / sum(n)
        add = np.diag(rules.ridge * np.maximum(np.diag(pooled), 0) + rules.floor)
        factors, constants = [], []
        for k in (0, 1):
            factor = np.linalg.cholesky((1 - rules.shrinkage) * spreads[k] + rules.shrinkage * pooled + add)
            factors.append(np.linalg.inv(factor))
            constants.append(np.log(n[k] / sum(n)) - np.log(np.diag(factor)).sum())
        return Qda(np.array(means), np.array(factors), np.array(constants))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, from half the difference of squared Mahalanobis distances."""
        density = [self.constants[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1: the log odds per statistic, through the logistic function."""
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / x.shape[1], -700, 700)))


def class_moments(rows: DataFrame, label: str, features: str) -> dict[int, Moments]:
    """The moments of each class, over all rows.

    A task sums its own rows; what is shuffled and gathered has the size of a
    covariance matrix a task and a class, and the driver gets two of these.
    """
    d = len(NAMES)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y = batch.column("y").to_numpy()
            for k, sums in held.items():
                own = x[y == k]
                sums += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([s.tolist() for s in held.values()], pa.list_(pa.float64()))], ["y", "sums"])

    parts = rows.select(F.col(label).cast("int").alias("y"), F.col(features).alias("x")).where("y IN (0, 1)").mapInArrow(summed, "y int, sums array<double>")
    cells = parts.select("y", F.posexplode("sums").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    sums = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for c in cells:
        sums[c["y"]][c["i"]] = c["v"]
    return {k: Moments(s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)) for k, s in sums.items() if s[0]}


def quality_score(features: Column, model: Qda | float) -> Column:
    """The score of a column of statistics; the model is a few KB and travels with the task."""

    @F.arrow_udf("double")
    def scored(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy().reshape(-1, len(NAMES))
        return pa.array(np.full(len(x), model) if isinstance(model, float) else model.score(x))

    return scored(features)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is 0 modulo ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rules: QdaRules = QdaRules()) -> DataFrame:
    """(doc_id, held_out, score) of every row: the score is nearer to 1 the likelier label 1 is.

    The statistics of every whole text are computed once and written; those of
    labelled rows outside the held-out fold give the class covariances; every
    row is scored.  Only statistics and ids are shuffled, never texts.

    A null text counts as empty and is scored like any text.  Labels that are
    null or neither 0 nor 1, and those of null ids, are left out; an id with
    several labels has the largest.  Repeated rows get equal scores.  If a class
    has no labelled row every score is the share of label 1, or 0.5 without
    labels; an empty table gives an empty one.
    """
    id_ = F.col(f"`{doc_id}`")
    measured = written(docs.select(id_.alias("doc_id"), statistics(F.col(f"`{text}`")).alias("features")), "statistics")
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    model = Qda.fit(class_moments(measured.join(known, "doc_id"), "y", "features"), rules)
    return measured.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("features"), model).alias("score"))
