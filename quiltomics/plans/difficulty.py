"""Train/test separability of challenges, from raw rows to the ranked report."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltomics.operators import scoring
from quiltomics.operators.calibration import hash_of
from quiltomics.operators.matrix import is_finite
from quiltomics.operators.ordering import rank_by_hash
from quiltomics.session import settled


@dataclass(frozen=True)
class DifficultyConfig:
    """Sizes of the evaluation; the caps bound every group that meets in one task."""

    seed: int = 42
    repeats: int = 5
    folds: int = 5
    max_observations: int = 5000
    min_observations: int = 100
    max_features: int = 2000
    components: int = 50
    logistic_c: float = 1.0


FOLD_SCHEMA = "split_id string, repeat int, fold int, auroc double, selected_features long, error string"


def whitened_pca(train: np.ndarray, held_out: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of both parts on the leading components of the first, with unit variance."""
    mean = train.mean(axis=0)
    centred = train - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / (len(train) - 1))
    order = np.argsort(values)[::-1][:k]
    basis = vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-12))
    return centred @ basis, (held_out - mean) @ basis


def ridge_logistic(x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray:
    """L2 logistic coefficients, intercept first and free, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(design.shape[1], 1.0 / c)
    penalty[0] = 0.0
    weights = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ weights, -35, 35)))
        gradient = design.T @ (p - y) + penalty * weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-10)
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def rank_auroc(score: np.ndarray, positive: np.ndarray) -> float:
    """Rank-sum area under the curve."""
    ranks = pd.Series(score).rank().to_numpy()
    n1 = int(positive.sum())
    n0 = len(positive) - n1
    return float((ranks[positive].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def sample_and_folds(rows: DataFrame, config: DifficultyConfig) -> DataFrame:
    """Balanced sample of each challenge and repeat with its stratified fold.

    ``rows`` is ``split_id, obs_id, domain`` and more.  The hash rank inside (challenge,
    repeat, domain) picks the sample and deals the folds.
    """
    sizes = rows.groupBy("split_id").agg(
        F.least(
            F.count_if(F.col("domain") == "train"), F.count_if(F.col("domain") == "test"), F.lit(config.max_observations)
        ).alias("sample_count")
    )
    repeated = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(config.repeats - 1))))
    hashed = repeated.withColumn("_h", hash_of(config.seed, "repeat", "obs_id"))
    side = ["split_id", "repeat", "domain"]
    ranked = rank_by_hash(hashed.select(*side, "obs_id", "_h"), "_h", side, "_rank", F.lit(config.max_observations))
    chosen = (
        ranked.join(sizes.where(F.col("sample_count") >= config.min_observations), "split_id")
        .where(F.col("_rank") <= F.col("sample_count"))
        .withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(config.folds)).cast("int"))
        .drop("_h", "_rank")
    )
    return chosen.join(rows, ["split_id", "domain", "obs_id"])


def fold_features(sampled: DataFrame, config: DifficultyConfig) -> DataFrame:
    """Features of every fold, ``place`` from 1: the largest variances over the rows outside the fold.

    Sums are taken once per fold and subtracted from the sums over all folds.  Counts are whole numbers,
    so a constant feature has a spread of exactly zero.
    """
    key = ["split_id", "repeat"]
    entry = F.explode(F.arrays_zip("indices", "values")).alias("_e")
    entries = sampled.select(*key, "fold", entry).select(
        *key, "fold", F.col("_e.indices").cast("long").alias("feature"), F.col("_e.values").cast("double").alias("_v")
    )
    inside = entries.groupBy(*key, "fold", "feature").agg(
        F.sum("_v").alias("_own"), F.sum(F.col("_v") * F.col("_v")).alias("_own_squares")
    )
    everywhere = inside.groupBy(*key, "feature").agg(
        F.sum("_own").alias("_sum"), F.sum("_own_squares").alias("_squares")
    )
    # One row per fold of a challenge and repeat.
    sizes = sampled.groupBy(*key, "fold").agg(F.count(F.lit(1)).alias("_rows"))
    outside = F.sum("_rows").over(Window.partitionBy(*key)) - F.col("_rows")
    sizes = sizes.select(*key, "fold", outside.alias("_n"))
    own, squares = F.coalesce("_own", F.lit(0.0)), F.coalesce("_own_squares", F.lit(0.0))
    spread = F.col("_n") * (F.col("_squares") - squares) - F.pow(F.col("_sum") - own, 2)
    ranked = (
        everywhere.join(sizes, key)
        .join(inside, [*key, "fold", "feature"], "left")
        .select(*key, "fold", "feature", spread.alias("_spread"))
        .where(is_finite("_spread") & (F.col("_spread") > 0))
    )
    # One fold's window holds at most one row per feature of the challenge's axis.
    order = Window.partitionBy(*key, "fold").orderBy(F.desc("_spread"), "feature")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.max_features).drop("_spread")


def fold_scores(sampled: DataFrame, config: DifficultyConfig) -> DataFrame:
    """AUC of every held-out fold.

    ``sampled`` carries sparse rows ``indices, values`` on the challenge's common axis.  One group is one
    fold of one repeat of one challenge: at most twice ``max_observations`` rows on ``max_features`` columns.
    """
    key = ["split_id", "repeat", "fold"]
    folds = F.explode(F.sequence(F.lit(0), F.lit(config.folds - 1)))
    rows = sampled.select("split_id", "repeat", F.col("fold").alias("own_fold"), "domain", "obs_id", "indices", "values")
    rows = rows.withColumn("fold", folds)

    def evaluate(keys: tuple, pdf: pd.DataFrame, features: pd.DataFrame) -> pd.DataFrame:
        result = [*keys, None, None, None]
        if len(pdf):
            try:
                result[3:5] = _held_out_auroc(pdf.sort_values(["domain", "obs_id"]), features, keys[2], config)
            except (ValueError, np.linalg.LinAlgError) as error:
                result[5] = str(error)
        return pd.DataFrame([result], columns=["split_id", "repeat", "fold", "auroc", "selected_features", "error"])

    # At most ``max_features`` names per fold.
    chosen = settled(fold_features(sampled, config), "fold-features")
    grouped = rows.groupBy(*key).cogroup(chosen.groupBy(*key))
    return grouped.applyInPandas(evaluate, FOLD_SCHEMA)


def _held_out_auroc(pdf: pd.DataFrame, features: pd.DataFrame, fold: int, config: DifficultyConfig) -> tuple[float, int]:
    """Fit on the rows of the other folds, score the rows of this one."""
    held, test = (pdf["own_fold"] == fold).to_numpy(), (pdf["domain"] == "test").to_numpy()
    enough = min(len(features), int((~held).sum()))
    if enough < config.components:
        raise ValueError(f"only {len(features)} variable features in a fold")
    names = np.sort(features["feature"].to_numpy())
    owner = np.repeat(np.arange(len(pdf)), pdf["indices"].str.len())
    index, value = (np.concatenate(pdf[c].tolist()) for c in ("indices", "values"))
    column = np.minimum(np.searchsorted(names, index), len(names) - 1)
    known = names[column] == index
    matrix = np.zeros((len(pdf), len(names)))
    matrix[owner[known], column[known]] = value[known]
    fitted, scores = whitened_pca(matrix[~held], matrix[held], config.components)
    weights = ridge_logistic(fitted, test[~held].astype(float), config.logistic_c)
    return rank_auroc(scores @ weights[1:] + weights[0], test[held]), len(names)


def challenge_report(challenges: DataFrame, folds: DataFrame) -> DataFrame:
    """One row per challenge: scores and rankings, or a failure that is kept with nulls.

    ``challenges`` is ``split_id, challenge_type`` and more, with ``problem`` where the
    catalogue already rules a challenge out; it also fails without fold scores or with
    a failed fold.
    """
    if "problem" not in challenges.columns:
        challenges = challenges.withColumn("problem", F.lit(None).cast("string"))
    per_challenge = folds.groupBy("split_id").agg(
        F.avg("auroc").alias("mean_auroc"),
        F.stddev_pop("auroc").alias("std_auroc"),
        F.min("selected_features").alias("selected_feature_count_min"),
        F.max("selected_features").alias("selected_feature_count_max"),
        F.max("error").alias("error"),
    )
    joined = challenges.join(per_challenge, "split_id", "left").withColumn(
        "status",
        F.when(
            F.col("problem").isNull() & F.col("error").isNull() & F.col("mean_auroc").isNotNull(), "success"
        ).otherwise("failed"),
    )
    joined = joined.withColumn(
        "error",
        F.when(F.col("status") == "failed", F.coalesce("problem", "error", F.lit("too few valid observations or features"))),
    ).drop("problem")
    success = F.col("status") == "success"
    for name in ("mean_auroc", "std_auroc", "selected_feature_count_min", "selected_feature_count_max"):
        joined = joined.withColumn(name, F.when(success, F.col(name)))
    # One row per challenge, as have both rankings: unwritten, each would stand several times in one plan, which the
    # driver holds and plans again after every stage.
    joined = settled(joined, "scores")
    good = joined.where(success).select("split_id", "challenge_type", "mean_auroc")
    ranked = settled(scoring.challenge_rankings(good).drop("mean_auroc", "challenge_type"), "rankings")
    repeats = folds.groupBy("split_id", "repeat").agg(F.avg("auroc").alias("auroc")).join(
        good.select("split_id"), "split_id", "left_semi"
    )
    spread = settled(scoring.repeat_percentile_std(repeats), "spread")
    return (
        joined.join(ranked, "split_id", "left")
        .join(spread, "split_id", "left")
        .withColumn("domain_shift_score", F.when(success, scoring.shift_score(F.col("mean_auroc"))))
    )


def evaluate(challenges: DataFrame, rows: DataFrame, config: DifficultyConfig) -> DataFrame:
    """The whole report for all challenges in one plan."""
    # Rows and sample are read several times: for sizes, ranks, feature sums and fits.
    rows = settled(rows, "difficulty-rows")
    folds = fold_scores(settled(sample_and_folds(rows, config), "difficulty-samples"), config)
    # The scores feed several rankings: a few rows per challenge, computed once.
    return challenge_report(challenges, settled(folds, "folds"))


def challenge_problems(challenges: DataFrame, common: DataFrame, config: DifficultyConfig) -> DataFrame:
    """Reasons a challenge cannot be evaluated at all.

    ``challenges`` is ``split_id, status, train_value_type, test_value_type``;
    ``common`` is ``split_id, n_common``, the fully measured features of both sides.
    """
    joined = challenges.join(common, "split_id", "left")
    return joined.withColumn(
        "problem",
        F.when(F.col("status") != "complete", F.concat(F.lit("incomplete: "), F.col("status")))
        .when(F.col("train_value_type") != F.col("test_value_type"), "value types differ")
        .when(F.coalesce("n_common", F.lit(0)) <= config.components, "too few common features"),
    ).drop("n_common", "status")


def challenge_rows(
    entries: DataFrame, observations: DataFrame, common: DataFrame, value_type: str, target_sum: float = 10000.0
) -> DataFrame:
    """Valid, normalised sparse rows of both sides on the common feature axis.

    ``entries`` is ``split_id, domain, obs_id, feature_id, value``, ``observations`` the
    matrix rows ``split_id, domain, obs_id`` and ``common`` the fully measured features
    ``split_id, feature_id, feature_ord``.  Counts are scaled per row and logged; other
    values stay as declared.  Everything after the feature join is grouped by row, so
    one shuffle carries the entries.
    """
    keys = ["split_id", "domain", "obs_id"]
    value = F.col("value").cast("double")
    finite = is_finite("value")
    kept = entries.join(common, ["split_id", "feature_id"])
    rows = kept.groupBy(*keys).agg(
        F.bool_and(finite).alias("_finite"),
        F.min(F.when(finite, value)).alias("_low"),
        F.sum(F.when(finite, value)).alias("_total"),
        F.array_sort(F.collect_list(F.struct("feature_ord", value.alias("value")))).alias("_cells"),
    )
    every = observations.select(*keys).join(rows, keys, "left")
    valid = F.coalesce("_finite", F.lit(True))
    cell = F.transform("_cells", lambda c: c["value"])
    if value_type == "counts":
        valid = valid & F.coalesce(F.col("_low") >= 0, F.lit(True)) & (F.coalesce("_total", F.lit(0.0)) > 0)
        cell = F.transform("_cells", lambda c: F.log1p(c["value"] * (F.lit(target_sum) / F.col("_total"))))
    return every.where(valid).select(
        *keys,
        F.coalesce(F.transform("_cells", lambda c: c["feature_ord"].cast("int")), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(cell, F.array().cast("array<double>")).alias("values"),
    )


def as_sparse(vector: str | Column) -> tuple[Column, Column]:
    """Indices and values of a dense array column."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(vector, lambda _v, i: i), vector


def ml_representation(train: DataFrame, held_out: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Whitened principal components with Spark ML, fitted on the first part only."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    pipeline = Pipeline(
        stages=[
            StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False),
            PCA(inputCol="_c", outputCol="_p", k=k),
            StandardScaler(inputCol="_p", outputCol="representation", withMean=True, withStd=True),
        ]
    )
    model = pipeline.fit(train.withColumn("_v", array_to_vector("vector")))
    parts = [model.transform(p.withColumn("_v", array_to_vector("vector"))).drop("_v", "_c", "_p") for p in (train, held_out)]
    return parts[0], parts[1]


def ml_domain_probability(train: DataFrame, held_out: DataFrame, c: float, n: int) -> DataFrame:
    """Held-out probability of the test domain with Spark ML's L2 logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    label = (F.col("domain") == "test").cast("double")
    model = LogisticRegression(
        featuresCol="representation",
        labelCol="label",
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
    ).fit(train.withColumn("label", label))
    scored = model.transform(held_out.withColumn("label", label))
    return scored.withColumn("probability", vector_to_array("probability")[1])
