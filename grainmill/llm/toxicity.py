"""Toxicity scores from class-conditional Kneser-Ney models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.kneser_ney import Counts, KneserNey, KneserNeyRules, evidence, trigrams
from grainmill.llm.quality_classifier import is_held_out
from grainmill.llm.text import chunks, written

_PARTS = 1 << 20


@dataclass(frozen=True)
class ToxicityRules:
    """``most_rows``: about how many labelled rows of class 0 and of class 1 the models are fitted on, the
    first by a hash of the id.  More ordinary rows than toxic ones make the shared backoff mostly ordinary,
    so that what only toxic rows hold stands out.  ``ridge`` keeps the slopes of the calibration finite."""

    model: KneserNeyRules = KneserNeyRules()
    most_rows: tuple[int, int] = (24_000, 2_000)
    ridge: float = 0.05


@dataclass(frozen=True)
class ToxicityModel:
    """The class models and the weights of the logistic curve: one for each evidence, and the offset."""

    models: KneserNey
    weights: tuple[float, ...]

    def probability(self, evidences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidences @ np.array(self.weights[:-1]) + self.weights[-1], -700, 700)))


def _sample(labels: DataFrame, label: str, most: tuple[int, int]) -> DataFrame:
    """(doc_id, y, late) of about ``most`` labelled ids by class; ``late`` marks those kept for calibration."""
    known = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    wanted = [F.lit(most[y] / max(sizes.get(y, 0), most[y])) for y in (0, 1)]
    share = F.when(F.col("y") == 1, wanted[1]).otherwise(wanted[0])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)) < share * _PARTS)
    return chosen.withColumn("late", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4)


def _triples(texts: DataFrame) -> DataFrame:
    """(y, t, u, w, early) for each different trigram of a class; ``early`` if a row outside the calibration part has it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, early = batch.column("y").to_numpy(), ~batch.column("late").to_numpy(zero_copy_only=False)
            base = 0
            for chunk in chunks(batch.column("text")):
                document, *words = trigrams(chunk)
                own = slice(base, base + chunk.n)
                rows = np.rec.fromarrays([y[own][document], early[own][document], *words], names="y,early,t,u,w")
                rows = np.unique(rows)
                base += chunk.n
                columns = [pa.array(rows["y"].astype(np.int32)), pa.array(rows["early"].astype(bool)), *(pa.array(np.ascontiguousarray(rows[c]).view(np.int64)) for c in "tuw")]
                yield pa.RecordBatch.from_arrays(columns, ["y", "early", "t", "u", "w"])

    rows = texts.mapInArrow(found, "y int, early boolean, t bigint, u bigint, w bigint")
    return rows.groupBy("y", "t", "u", "w").agg(F.max("early").alias("early"))


def _gathered(table: DataFrame, *names: str) -> list[np.ndarray]:
    """The key columns as unsigned hashes and the two columns of each of ``names``."""
    frame = table.toPandas()
    keys = [frame[c].to_numpy(np.int64).view(np.uint64) for c in ("u", "w") if c in frame]
    return keys + [frame[[f"{n}0", f"{n}1"]].to_numpy(float) for n in names]


def _counts(pairs: DataFrame, rules: ToxicityRules, early: bool) -> Counts:
    """Continuation counts of the sample, all of it or its early part.

    What the discount takes wholly stays with the executors as sums, so the
    driver gathers words, pairs and contexts of repeated expressions only.
    """
    n = F.col("n_early" if early else "n")
    use = pairs.where(n > 0)
    by_class = lambda value, name: [F.sum(F.when(F.col("y") == k, value).otherwise(0)).alias(f"{name}{k}") for k in (0, 1)]
    most = F.lit(float(rules.model.discount))
    each_word = written(use.groupBy("w").agg(*by_class(F.lit(1), "n")), "words")
    words, word_counts = _gathered(each_word.where(F.col("n0") + F.col("n1") > most), "n")
    less = lambda c: F.coalesce(F.sum(F.least(c.cast("double"), most)), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n0, n1 = F.col("n0"), F.col("n1")
    sums = each_word.agg(total(n0), total(n1), less(n0), less(n1), less(n0 + n1), F.count(F.lit(1))).first()
    repeated = written(use.where(n > most).groupBy("u", "w").agg(*by_class(n, "n")), "repeated")
    firsts, seconds, pair_counts = _gathered(repeated, "n")
    within = use.join(repeated.select("u").distinct(), "u", "left_semi")
    held = F.least(n.cast("double"), most)
    contexts, totals, kept_back = _gathered(within.groupBy("u").agg(*by_class(n, "n"), *by_class(held, "h")), "n", "h")
    return Counts(words, word_counts, firsts, seconds, pair_counts, contexts, totals, kept_back, np.array(sums[:2], float), np.array(sums[2:4], float), float(sums[4]), int(sums[5]))


def calibrate(evidences: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, ...]:
    """Weights and offset of a logistic curve through (evidences, label), by damped Newton steps."""
    if not len(y) or y.min() == y.max():
        return (1.0,) * evidences.shape[1] + (-1.0,)
    x = np.column_stack([evidences, np.ones(len(y))])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (len(beta) - 1) + [ridge / 100])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - penalty @ beta)
        beta += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def _evidences(texts: pa.Array, models: KneserNey, strongest: int) -> np.ndarray:
    return np.concatenate([evidence(chunk, models, strongest) for chunk in chunks(texts)] or [np.empty((0, 2))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rules: ToxicityRules = ToxicityRules()) -> ToxicityModel:
    """Models from a bounded sample of labelled rows outside the held-out fold.

    The curve from evidence to probability is calibrated on a fifth of the
    sample with models of the rest, and the models are then fitted to all of it.
    """
    sample = written(_sample(labels.withColumnRenamed(doc_id, "doc_id"), label, rules.most_rows), "sample")
    # About the sum of most_rows ids at most: bounded whatever the corpus.
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "doc_id")
    triples = _triples(texts.select("y", "late", "text"))
    pairs = triples.groupBy("y", "u", "w").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("early").cast("long")).alias("n_early"))
    pairs = written(pairs, "pairs")
    early, strongest = KneserNey(_counts(pairs, rules, early=True), rules.model), rules.model.strongest

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _evidences(batch.column("text"), early, strongest)
            yield pa.RecordBatch.from_arrays([batch.column("y"), *map(pa.array, found.T)], ["y", "mean", "top"])

    held = texts.where("late").select("y", "text").mapInArrow(measured, "y int, mean double, top double").toPandas()
    weights = calibrate(held[["mean", "top"]].to_numpy(float), held["y"].to_numpy(float), rules.ridge)
    return ToxicityModel(KneserNey(_counts(pairs, rules, early=False), rules.model), weights)


def toxicity(text: Column, model: ToxicityModel, strongest: int) -> Column:
    """The probability of label 1 of a text column."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.probability(_evidences(texts, model.models, strongest)))

    return scored(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """(doc_id, held_out, score) of every row: the score is nearer to 1 the likelier label 1 is.

    The log-likelihoods of every whole text under two Kneser-Ney models, toxic
    and ordinary, are normalised by length, compared and calibrated.  Scoring is
    one pass without a shuffle.

    A null text counts as empty; a text without words has no evidence and gets
    the curve's value at ratio zero.  Null and other labels and null ids are left
    out; an id with several labels has the largest.  Without rows of both
    classes the curve is a fixed one.  Repeated rows get equal scores; an empty
    table gives an empty one; other columns do not matter, whatever their names.
    """
    model = fit_toxicity(docs, labels, doc_id, text, label, rules)
    id_ = F.col(f"`{doc_id}`")
    score = toxicity(F.col(f"`{text}`"), model, rules.model.strongest)
    return docs.select(id_.alias("doc_id"), is_held_out(id_).alias("held_out"), score.alias("score"))
