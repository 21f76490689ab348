"""Training samples: one row per observation with dense vectors and masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alignment(memberships: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modality rows with their observation, and the rows that have none."""
    ids = observations.select("obs_id", F.col("obs_ord").alias("top_ord"))
    rows = memberships.select("modality", "obs_id")
    return rows.join(ids, "obs_id"), rows.join(ids, "obs_id", "left_anti")


def gather_rows(observations: DataFrame, memberships: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """Every observation with one presence flag per chosen modality."""
    flags = memberships.where(F.col("modality").isin(*modalities)).groupBy("obs_id").agg(
        *[F.bool_or(F.col("modality") == m).alias(f"{m}_present") for m in modalities]
    )
    joined = observations.join(flags, "obs_id", "left")
    for m in modalities:
        joined = joined.withColumn(f"{m}_present", F.coalesce(f"{m}_present", F.lit(False)))
    return joined


def paired(memberships: DataFrame, left: str, right: str) -> DataFrame:
    """Observations in both modalities with their ordinal."""
    return (
        memberships.where(F.col("modality").isin(left, right))
        .groupBy("obs_id")
        .agg(F.countDistinct("modality").alias("_n"), F.min("obs_ord").alias("obs_ord"))
        .where("_n = 2")
        .select("obs_id", "obs_ord")
    )


def dense(cells: str | Column, size: Column) -> Column:
    """Dense array from sorted ``(ord, value)`` pairs: each value after its run of zeros."""
    cells = F.col(cells) if isinstance(cells, str) else cells
    filled = F.coalesce(cells, F.array().cast("array<struct<ord:bigint,value:double>>"))

    def zeros(count: Column) -> Column:
        return F.array_repeat(F.lit(0.0), count.cast("int"))

    pieces = F.transform(
        filled,
        lambda e, i: F.concat(
            zeros(e["ord"] - F.when(i == 0, -1).otherwise(F.try_element_at(filled, i)["ord"]) - 1),
            F.array(e["value"]),
        ),
    )
    last = F.when(F.size(filled) == 0, -1).otherwise(F.try_element_at(filled, F.lit(-1))["ord"])
    return F.concat(F.flatten(pieces), zeros(size - last - 1))


def source_masks(mask: DataFrame) -> DataFrame:
    """Measurement mask of each source and modality as one boolean array in feature order.

    ``mask`` is ``modality, source_id, feature_ord, measured`` and covers the axis.
    """
    items = F.array_sort(F.collect_list(F.struct("feature_ord", "measured")))
    return mask.groupBy("source_id", "modality").agg(
        F.transform(items, lambda i: i["measured"]).alias("feature_mask")
    )


def training_samples(
    observations: DataFrame,
    memberships: DataFrame,
    entries: DataFrame,
    sizes: dict[str, Column],
    masks: DataFrame | None = None,
    obs_columns: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """One sample per observation: ``<m>``, ``<m>_present`` and ``<m>_mask`` per modality.

    ``entries`` is ``modality, obs_id, feature_ord, value`` on the sample axes and
    ``sizes`` gives the length of each axis.  A matrix row is the largest group.
    """
    cells = entries.groupBy("obs_id").agg(
        *[
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("modality") == m,
                        F.struct(
                            F.col("feature_ord").cast("long").alias("ord"),
                            F.col("value").cast("double").alias("value"),
                        ),
                    )
                )
            ).alias(f"_{m}")
            for m in sizes
        ]
    )
    rows = gather_rows(observations, memberships, list(sizes)).join(cells, "obs_id", "left")
    result = rows.select(
        "obs_id",
        "obs_ord",
        "source_dataset_id",
        *obs_columns,
        F.array("x", "y").alias("spatial"),
        *[F.col(f"{m}_present") for m in sizes],
        *[dense(f"_{m}", size).alias(m) for m, size in sizes.items()],
    )
    for m, size in sizes.items():
        all_true = F.array_repeat(F.lit(True), size.cast("int"))
        all_false = F.array_repeat(F.lit(False), size.cast("int"))
        if masks is None:
            stored = all_true
        else:
            own = masks.where(F.col("modality") == m).select(
                F.col("source_id").alias("source_dataset_id"), F.col("feature_mask").alias("_mask")
            )
            result = result.join(own, "source_dataset_id", "left")
            stored = F.coalesce("_mask", all_true)
        result = result.withColumn(
            f"{m}_mask", F.when(F.col(f"{m}_present"), stored).otherwise(all_false)
        ).drop("_mask")
    return result


def prediction_pairs(samples: DataFrame, left: str, right: str) -> DataFrame:
    """(x, y) vectors of the paired observations; none at all if a used feature is unmeasured."""
    both = samples.where(F.col(f"{left}_present") & F.col(f"{right}_present"))

    def complete(m: str) -> Column:
        return F.forall(f"{m}_mask", lambda v: v)

    usable = both.agg(
        F.coalesce(F.bool_and(complete(left) & complete(right)), F.lit(True)).alias("u")
    )
    return both.where(usable.scalar()).select(
        "obs_id", "obs_ord", F.col(left).alias("x"), F.col(right).alias("y")
    )


def missing_obs_values(observations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing or non-finite values per chosen observation column."""

    def missing(name: str) -> Column:
        number = F.col(name).try_cast("double")
        return F.col(name).isNull() | F.coalesce(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(False))

    return observations.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), missing(c).alias("bad")) for c in columns])
        ).alias("p")
    ).groupBy("p.column").agg(F.count_if("p.bad").alias("n_missing"))


def map_samples(
    samples: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply a user transform to Arrow batches of samples (also the hook to rebuild a sample)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return samples.mapInPandas(run, schema)


def map_pairs(
    pairs: DataFrame,
    input_transform: Callable[[pd.Series], pd.Series] | None = None,
    target_transform: Callable[[pd.Series], pd.Series] | None = None,
) -> DataFrame:
    """Transform the x and y vectors with vectorised functions."""
    result = pairs
    for name, function in (("x", input_transform), ("y", target_transform)):
        if function is not None:
            result = result.withColumn(name, F.pandas_udf(function, "array<double>")(F.col(name)))
    return result
