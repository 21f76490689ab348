"""Composite split products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltomics.operators import features as X
from quiltomics.operators.splits import spatial_sides
from quiltomics.session import dealt


def spatial_split(observations: DataFrame, regions: DataFrame, split_id: str) -> DataFrame:
    """Train and test observations of a region split with their provenance."""
    return spatial_sides(observations, regions).withColumn("split_id", F.lit(split_id))


def empty_modalities(product: DataFrame, memberships: DataFrame) -> DataFrame:
    """(side, modality) pairs without an observation."""
    expected = memberships.select("modality").distinct().select(
        "modality", F.explode(F.array(F.lit("train"), F.lit("test"))).alias("side")
    )
    present = product.select("obs_id", "side").join(memberships.select("obs_id", "modality"), "obs_id").select(
        "side", "modality"
    ).distinct()
    return expected.join(present, ["side", "modality"], "left_anti")


def split_contents(product: DataFrame, entries: DataFrame) -> DataFrame:
    """Observations, entries and total per side and modality."""
    sides = product.select("obs_id", "side")
    # Counts first per observation, so that the shuffle carries rows, not entries.
    rows = entries.groupBy("modality", "obs_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return rows.join(sides, "obs_id").groupBy("side", "modality").agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum("n").alias("n_entries"), F.sum("v").alias("total")
    )


def merged_axis(features: DataFrame, policy: str, reference: str | None = None) -> DataFrame:
    """``feature_id, target_ord`` of the sources' merged axis.

    Refused: an empty intersection, ``preserve`` on axes that differ, and a reference without an axis.
    """
    if policy == "intersection":
        target = X.intersection(features)
        if target.isEmpty():
            raise ValueError("the sources have no feature in common")
        return target
    if policy == "union":
        return X.union(features)
    if policy == "preserve":
        if not X.preserve_mismatches(features).where("n_mismatch > 0").isEmpty():
            raise ValueError("the preserve policy needs equal axes in all sources")
        return X.union(features)
    if policy != "reference":
        raise ValueError(f"unknown feature policy {policy!r}")
    if reference is None:
        raise ValueError("the reference policy needs a reference source")
    target = X.reference_axis(features, reference)
    if target.isEmpty():
        raise ValueError(f"the reference source {reference!r} has no feature axis")
    return target


def compose_entries(
    entries: DataFrame,
    features: DataFrame,
    policy: str,
    reference: str | None = None,
    target: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Stacked entries of all sources on the merged axis of one policy (``target``, if it is at hand).

    ``entries`` is ``source_id, obs_id, feature_id, value``; ``features`` the source axes.
    A feature a source did not measure holds no entry of that source.  With ``rows``, the number of entries or
    a bound of it, entries meet the axis on as many tasks as that asks for.
    """
    axis = merged_axis(features, policy, reference) if target is None else target
    # Measured features get their place first, so that entries move once.
    placed = X.align_entries(features.select("source_id", "feature_id").distinct(), axis)
    moved = entries if rows is None else dealt(entries, rows, "source_id", "feature_id")
    return moved.join(placed, ["source_id", "feature_id"]).select(
        F.concat_ws("::", "source_id", "obs_id").alias("obs_id"), "source_id", "feature_id", "target_ord", "value"
    )


def compose_harmonised(entries: DataFrame, mapped: DataFrame) -> DataFrame:
    """Stacked entries on the canonical features that every source can express."""
    target = X.intersection(mapped, "canonical_id")
    kept = mapped.join(target, "canonical_id").select("source_id", "feature_id", "canonical_id", "target_ord")
    return (
        entries.join(kept, ["source_id", "feature_id"])
        .groupBy("source_id", "obs_id", "canonical_id", "target_ord")
        .agg(F.sum("value").alias("value"))
        .select(
            F.concat_ws("::", "source_id", "obs_id").alias("obs_id"), "source_id", "canonical_id", "target_ord", "value"
        )
    )
