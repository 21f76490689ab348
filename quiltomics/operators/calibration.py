"""Splits of held-out rows, isotonic and logistic calibration, prediction status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltomics.operators.isotonic import interpolate, isotonic_fit as isotonic_fit
from quiltomics.operators.ordering import (
    linear_quantiles,
    numbered,
    rank_by_hash,
    smallest_by_hash,
)
from quiltomics.operators.scoring import top_two


def alternating_split(
    rows: DataFrame, strata: Sequence[str], order: str, names: Sequence[str], least: int = 0
) -> DataFrame:
    """Deal the rows of each stratum in turn to the named parts; a part of fewer than ``least`` rows is refused."""
    dealt = numbered(rows, [F.col(order)], strata, "_turn")
    parts = F.array(*[F.lit(n) for n in names])
    split = dealt.withColumn(
        "part", F.element_at(parts, (F.pmod("_turn", F.lit(len(names))) + 1).cast("int"))
    ).drop("_turn")
    if least:
        found = dict(split.groupBy("part").count().collect())
        short = [n for n in names if found.get(n, 0) < least]
        if short:
            raise ValueError(f"fewer than {least} rows to calibrate on: {', '.join(short)}")
    return split


def hash_of(seed: int, *columns: str | Column) -> Column:
    """Stable priority: SHA-256 of the NUL-separated seed and columns."""
    items = [F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in columns]]
    return F.sha2(F.concat_ws("\0", *[i.cast("string") for i in items]), 256)


def stratified_folds(rows: DataFrame, stratum: str, key: str, folds: int, seed: int) -> DataFrame:
    """Fold of each row: a hash shuffle of every class, dealt in turn."""
    hashed = rows.withColumn("_h", hash_of(seed, key))
    return (
        rank_by_hash(hashed, "_h", [stratum], "_rank")
        .withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int"))
        .drop("_h", "_rank")
    )


def balanced_sample(rows: DataFrame, side: str, key: str, repeats: int, cap: int, seed: int) -> DataFrame:
    """Per repeat the same number of rows of each side, without replacement."""
    per_side = rows.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    size = per_side.agg(F.least(F.min("n"), F.lit(cap)).alias("m"))
    repeated = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hashed = repeated.withColumn("_h", hash_of(seed, "repeat", key))
    return smallest_by_hash(hashed, "_h", ["repeat", side], size.scalar()).drop("_h")


def reliability(best: Column, delta: Column, weight: float) -> Column:
    """``best + weight * delta`` with a missing delta as zero."""
    return best + weight * F.coalesce(delta, F.lit(0.0))


def uncertain_thresholds(rows: DataFrame, score_quantile: float, delta_quantile: float, minimum: int = 20) -> DataFrame:
    """Quantiles of best and delta among the correct rows; null below ``minimum`` rows."""
    correct = rows.where("correct")
    measures = []
    for name, column, fraction in (
        ("uncertain_min_score", "best", score_quantile),
        ("uncertain_min_delta", "delta", delta_quantile),
    ):
        usable = correct.where(F.col(column).isNotNull())
        enough = usable.agg((F.count(F.lit(1)) >= minimum).alias("e"))
        measures.append(
            linear_quantiles(usable, column, {name: fraction}).withColumn(
                "value", F.when(enough.scalar(), F.col("value"))
            )
        )
    return measures[0].unionByName(measures[1])


def score_status(
    scores: DataFrame,
    pruned: DataFrame,
    knots: DataFrame,
    ontology: DataFrame,
    delta_weight: float,
    min_delta: float,
    min_score: float,
) -> DataFrame:
    """Label, calibrated confidence and status of matching scores.

    ``pruned`` is ``obs_id, pruned_label``; ``ontology`` is ``label, ontology_id``.
    """
    best = top_two(scores).withColumn("raw", reliability(F.col("best"), F.col("delta"), delta_weight))
    judged = interpolate(best, "raw", knots).join(pruned, "obs_id", "left")
    missing = F.col("pruned_label").isNull() | (F.col("pruned_label") == "")
    delta_below = F.col("delta") < min_delta
    score_below = F.col("best") < min_score
    labelled = (
        judged.withColumn("pruned_missing", missing)
        .withColumn("delta_below", delta_below)
        .withColumn("score_below", score_below)
        .withColumn("label", F.when(missing, F.col("label")).otherwise(F.col("pruned_label")))
        # SQL's three-valued OR: an unknown delta leaves the verdict open unless another test fails.
        .withColumn("uncertain", F.col("pruned_missing") | F.col("delta_below") | F.col("score_below"))
    )
    return with_ontology(
        labelled.withColumn("status", F.when(F.col("uncertain"), "Uncertain").when(~F.col("uncertain"), "Predicted")),
        ontology,
    )


def with_ontology(predictions: DataFrame, ontology: DataFrame) -> DataFrame:
    """Ontology id of the label, for confident rows only."""
    return (
        predictions.join(ontology.withColumnRenamed("ontology_id", "_oid"), "label", "left")
        .withColumn("ontology_id", F.when(F.col("status") == "Predicted", F.col("_oid")))
        .drop("_oid")
    )


def align_weights(targets: DataFrame, weights: DataFrame) -> DataFrame:
    """Every target with every label; targets or labels without a weight get zero."""
    # As many labels as reference types.
    labels = weights.agg(F.array_sort(F.collect_set(F.struct("label_ord", "label"))).alias("l"))
    return (
        targets.select("obs_id", F.explode(labels.scalar()).alias("l"))
        .select("obs_id", "l.label_ord", "l.label")
        .join(weights.select("obs_id", "label", "weight"), ["obs_id", "label"], "left")
        .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    )


def composition_features(weights: DataFrame) -> DataFrame:
    """Normalised composition per observation: top two, delta, entropy, effective types."""
    usable = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.abs("weight") < float("inf")) & (F.col("weight") > 0)
    # One array of at most one item per label.
    rows = (
        weights.groupBy("obs_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct((-F.when(usable, F.col("weight")).otherwise(0.0)).alias("w"), "label_ord", "label")
                )
            ).alias("r")
        )
        .withColumn("total", F.aggregate("r", F.lit(0.0), lambda a, i: a - i["w"]))
        .withColumn("converged", F.col("total") > 0)
        .withColumn("k", F.size("r"))
        .withColumn("_scale", F.when(F.col("converged"), F.col("total")).otherwise(1.0))
        .withColumn("p", F.transform("r", lambda i: -i["w"] / F.col("_scale")))
    )
    surprise = F.aggregate(
        "p", F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(v)).otherwise(0.0)
    )
    top, second = F.element_at("p", 1), F.coalesce(F.try_element_at("p", F.lit(2)), F.element_at("p", 1))
    return rows.withColumn("_h", surprise).select(
        "obs_id",
        F.element_at("r", 1)["label"].alias("label"),
        top.alias("top_weight"),
        second.alias("second_weight"),
        (top - second).alias("delta"),
        (F.col("_h") / F.when(F.col("k") > 1, F.ln(F.col("k"))).otherwise(1.0)).alias("entropy"),
        F.exp("_h").alias("effective_types"),
        "converged",
    )


def logistic(coefficients: Mapping[str, float]) -> Column:
    """Probability from an intercept and named coefficients."""
    eta = F.lit(float(coefficients["intercept"]))
    for name, value in coefficients.items():
        if name != "intercept":
            eta = eta + F.lit(float(value)) * F.col(name)
    return 1 / (1 + F.exp(-eta))


def composition_status(
    weights: DataFrame,
    coefficients: Mapping[str, float],
    knots: DataFrame,
    ontology: DataFrame,
    min_confidence: float,
    min_top: float,
    min_delta: float,
    max_entropy: float,
) -> DataFrame:
    """Label, calibrated confidence and status of a composition; Uncertain outranks Mixed."""
    features = composition_features(weights).withColumn("probability", logistic(coefficients))
    judged = interpolate(features, "probability", knots)
    judged = (
        judged.withColumn("confidence_below", F.col("confidence") < min_confidence)
        .withColumn("top_below", F.col("top_weight") < min_top)
        .withColumn("delta_below", F.col("delta") < min_delta)
        .withColumn("entropy_above", F.col("entropy") > max_entropy)
    )
    status = (
        F.when(~F.col("converged") | F.col("confidence_below"), "Uncertain")
        .when(F.col("top_below") | F.col("delta_below") | F.col("entropy_above"), "Mixed")
        .otherwise("Predicted")
    )
    return with_ontology(judged.withColumn("status", status), ontology)


def status_reasons(predictions: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Rows per rejection reason (boolean columns)."""
    return predictions.select(
        F.explode(
            F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("hit")) for r in reasons])
        ).alias("p")
    ).groupBy("p.reason").agg(F.count_if("p.hit").alias("n"))


def source_predictions(labelled: DataFrame, ontology: DataFrame) -> DataFrame:
    """Predictions from complete source labels: status Source and no confidence."""
    return labelled.join(ontology.withColumnRenamed("source_label", "label"), "label", "left").select(
        "obs_id",
        "label",
        "ontology_id",
        F.lit("Source").alias("status"),
        F.lit(None).cast("double").alias("confidence"),
    )


def display_label(label: str | Column, status: str | Column) -> Column:
    """The status replaces the label of Mixed and Uncertain predictions."""
    status = F.col(status) if isinstance(status, str) else status
    label = F.col(label) if isinstance(label, str) else label
    return F.when(status.isin("Mixed", "Uncertain"), status).otherwise(label)


def category_counts(predictions: DataFrame) -> DataFrame:
    """Rows per category and sample, zero where a sample lacks a category; null sample is the whole."""
    categories = predictions.agg(F.array_sort(F.collect_set("category")).alias("c"))
    counts = predictions.groupBy("sample_id", "category").agg(F.count(F.lit(1)).alias("n"))
    filled = (
        predictions.select("sample_id")
        .distinct()
        .select("sample_id", F.explode(categories.scalar()).alias("category"))
        .join(counts, ["sample_id", "category"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    whole = counts.groupBy("category").agg(F.sum("n").alias("n"))
    return filled.unionByName(whole.select(F.lit(None).cast("string").alias("sample_id"), "category", "n"))


def category_mismatches(counts: DataFrame, n_obs: Column) -> DataFrame:
    """Levels of the category table that do not add up."""
    levels = counts.groupBy(F.col("sample_id").isNull().alias("whole"), "category").agg(F.sum("n").alias("n"))
    per_category = (
        levels.groupBy("category")
        .agg(
            F.sum(F.when(F.col("whole"), F.col("n"))).alias("whole"),
            F.sum(F.when(~F.col("whole"), F.col("n"))).alias("samples"),
        )
        .where(~F.col("whole").eqNullSafe(F.col("samples")))
        .select(F.concat(F.lit("category:"), F.col("category")).alias("level"), "whole", "samples")
    )
    total = (
        levels.agg(
            F.sum(F.when(F.col("whole"), F.col("n"))).alias("whole"),
            F.sum(F.when(~F.col("whole"), F.col("n"))).alias("samples"),
        )
        .withColumn("_n", n_obs)
        .where("whole <> _n OR samples <> _n")
        .select(F.lit("observations").alias("level"), "whole", "samples")
    )
    return per_category.unionByName(total)


def legend(type_counts: DataFrame, categories: DataFrame) -> DataFrame:
    """Count and share of each category; ids without a category keep a fallback label."""
    total = type_counts.agg(F.sum("n").alias("t"))
    return (
        type_counts.join(categories, "type_id", "full_outer")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select(
            "type_id",
            F.coalesce("label", F.concat(F.lit("Unknown "), F.col("type_id").cast("string"))).alias("label"),
            "n",
            F.coalesce(F.try_divide(F.col("n"), total.scalar()), F.lit(0.0)).alias("share"),
        )
    )


def misaligned_predictions(predictions: DataFrame, observations: DataFrame) -> DataFrame:
    """Predictions whose id, order or coordinates differ from the observations."""
    left = predictions.select("obs_id", F.col("obs_ord").alias("p_ord"), F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    right = observations.select("obs_id", F.col("obs_ord").alias("o_ord"), F.col("x").alias("o_x"), F.col("y").alias("o_y"))
    problem = (
        F.when(F.col("o_ord").isNull(), "unknown_observation")
        .when(F.col("p_ord").isNull(), "missing_prediction")
        .when(F.col("p_ord") != F.col("o_ord"), "order")
        .when(~F.col("p_x").eqNullSafe(F.col("o_x")) | ~F.col("p_y").eqNullSafe(F.col("o_y")), "coordinates")
    )
    return left.join(right, "obs_id", "full_outer").select("obs_id", problem.alias("problem")).where(
        "problem IS NOT NULL"
    )


def fit_logistic(rows: DataFrame, features: Sequence[str], outcome: str) -> dict[str, float]:
    """Unpenalised logistic coefficients; the model itself is a handful of numbers."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=list(features), outputCol="_x").transform(
        rows.withColumn("_y", F.col(outcome).cast("double"))
    )
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", regParam=0.0, maxIter=200, tol=1e-9
    ).fit(assembled.select("_x", "_y"))
    result = {"intercept": float(model.intercept)}
    result.update({n: float(c) for n, c in zip(features, np.asarray(model.coefficients), strict=True)})
    return result
