"""Small linear models fitted on bounded samples: averaged hinge-loss machines and logistic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltomics.llm.common import free_name


def bounded_sample(rows: DataFrame, label: str, text: str, bound: int) -> DataFrame:
    """About ``bound`` distinct texts of every label value, chosen by a hash of the text.

    One count per label sets the rate; copies of one text are one row, so a group of copies cannot fill
    the sample.  Every label value is kept; the rates, one row for each, are what is broadcast.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()
    rate = free_name(rows, "_rate")
    # From an Arrow table: rows of Python would need workers of another kind on the executors, which then wait beside the others.
    names, shares = [r[0] for r in counts], [min(1.0, bound / r["count"]) for r in counts]
    rates = rows.sparkSession.createDataFrame(pa.table({label: pa.array(names, pa.string()), rate: pa.array(shares, pa.float64())}))
    share = F.pmod(F.xxhash64(text), F.lit(1 << 20)) / float(1 << 20)
    return rows.join(F.broadcast(rates), label).where(share < F.col(rate)).drop(rate).dropDuplicates([label, text])


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``label, text`` of about ``bound`` labelled documents of either label value, each text once.

    The label rows are sampled before they meet the texts, so the documents are not shuffled; the sample,
    at most about ``bound`` rows for each of two label values, is what is broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", label).distinct()
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    rate = F.lit(0.0)
    for value, count in counts.items():
        rate = F.when(F.col(label) == value, F.lit(min(1.0, bound / count))).otherwise(rate)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(known.where(share < rate)), "doc_id").select(label, "text").dropDuplicates()


def hinge_machine(points: np.ndarray, signs: np.ndarray, passes: int = 30, penalty: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine: averaged subgradient steps, classes weighted alike."""
    random = np.random.default_rng(seed)
    weights, bias = np.zeros(points.shape[1]), 0.0
    mean, mean_bias, taken, step = weights.copy(), 0.0, 0, 0
    weight = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum())) * len(signs)
    for turn in range(passes):
        for part in np.array_split(random.permutation(len(signs)), max(1, len(signs) // 64)):
            step += 1
            rate = 1.0 / (1.0 + penalty * step)
            inside = signs[part] * (points[part] @ weights + bias) < 1
            pull = (signs[part] * weight[part])[inside] / len(part)
            weights = weights * (1 - rate * penalty) + rate * (pull @ points[part][inside])
            bias += rate * pull.sum()
            if turn >= passes // 2:
                mean, mean_bias, taken = mean + weights, mean_bias + bias, taken + 1
    return mean / max(1, taken), mean_bias / max(1, taken)


def logistic_fit(points: np.ndarray, truth: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression (the last one is the bias), by Newton steps."""
    full = np.hstack([points, np.ones((len(points), 1))])
    weights = np.zeros(full.shape[1])
    ridge = penalty * len(full) * np.eye(full.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(full @ weights, -30, 30)))
        slope = full.T @ (truth - chance) - ridge @ weights
        curve = (full * (chance * (1 - chance))[:, None]).T @ full + ridge
        move = np.linalg.solve(curve + 1e-9 * np.eye(len(curve)), slope)
        weights += move
        if np.abs(move).max() < 1e-8:
            break
    return weights
