"""Selection of reference cells, stable samples, pseudo-spots."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltomics.operators.calibration import hash_of
from quiltomics.operators.ordering import numbered, smallest_by_hash, top_n
from quiltomics.schema import EXCLUDED_ONTOLOGY_IDS


@dataclass(frozen=True)
class Sampling:
    """Thresholds and caps of a reference selection."""

    holdout_donor: str
    min_train: int
    min_holdout: int
    max_train: int
    max_holdout: int
    seed: int


@dataclass(frozen=True)
class SpotDesign:
    """Make-up of the pseudo-spots."""

    cells_per_spot: int
    pure_per_type: int
    mixed_spots: int
    types_per_mixed: int
    dominant_fraction: float


def drop_generic(cells: DataFrame) -> DataFrame:
    """Trim, then drop cells without a specific type or with an excluded ontology id."""
    trimmed = cells
    for name in ("donor_id", "cell_type", "ontology_id"):
        trimmed = trimmed.withColumn(name, F.trim(name))
    return trimmed.where(
        F.col("cell_type").isNotNull()
        & F.col("ontology_id").isNotNull()
        & (F.col("cell_type") != "")
        & (F.lower("cell_type") != "unknown")
        & ~F.col("ontology_id").isin(*EXCLUDED_ONTOLOGY_IDS)
    )


def split_donor(cells: DataFrame, donor: str) -> DataFrame:
    """Whole-donor holdout."""
    return cells.withColumn("partition", F.when(F.col("donor_id") == donor, "holdout").otherwise("train"))


def retained_types(cells: DataFrame, min_train: int, min_holdout: int) -> DataFrame:
    """Types with enough training cells, flagged if the holdout has enough as well."""
    counts = cells.groupBy("ontology_id").agg(
        F.count_if(F.col("partition") == "train").alias("n_train"),
        F.count_if(F.col("partition") == "holdout").alias("n_holdout"),
    )
    return counts.where(F.col("n_train") >= min_train).withColumn(
        "calibrates", F.col("n_holdout") >= min_holdout
    )


def stable_sample(cells: DataFrame, group: str, limit: Column, seed: int) -> DataFrame:
    """Per partition and group the cells with the smallest SHA-256 of (seed, partition, id)."""
    hashed = cells.withColumn("_h", hash_of(seed, "partition", "cell_id"))
    return smallest_by_hash(hashed, "_h", ["partition", group], limit).drop("_h")


def select_partitions(cells: DataFrame, sampling: Sampling) -> DataFrame:
    """Aligned training and held-out cells: thresholds per type, stable caps per type."""
    split = split_donor(drop_generic(cells), sampling.holdout_donor)
    types = retained_types(split, sampling.min_train, sampling.min_holdout).select(
        "ontology_id", "calibrates"
    )
    eligible = split.join(types, "ontology_id").where("partition = 'train' OR calibrates")
    limit = F.when(F.col("partition") == "train", sampling.max_train).otherwise(sampling.max_holdout)
    return stable_sample(eligible.drop("calibrates"), "ontology_id", limit, sampling.seed)


def ordered_partitions(selected: DataFrame) -> DataFrame:
    """Selection in its published order."""
    return selected.orderBy("partition", "ontology_id", "cell_id")


def ontology_conflicts(cells: DataFrame) -> DataFrame:
    """Names with several ontology ids and ids with several names."""
    names = cells.groupBy("cell_type").agg(F.countDistinct("ontology_id").alias("n")).select(
        F.lit("name").alias("side"), F.col("cell_type").alias("id"), "n"
    )
    ids = cells.groupBy("ontology_id").agg(F.countDistinct("cell_type").alias("n")).select(
        F.lit("ontology").alias("side"), F.col("ontology_id").alias("id"), "n"
    )
    return names.unionByName(ids).where("n > 1")


def discovery(cells: DataFrame) -> DataFrame:
    """Per dataset: cells, donors, types and types seen in at least two donors."""
    per_type = cells.groupBy("dataset_id", "ontology_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("donor_id").alias("d")
    )
    types = per_type.groupBy("dataset_id").agg(
        F.sum("n").alias("cells"),
        F.count(F.lit(1)).alias("types"),
        F.count_if(F.col("d") >= 2).alias("multi_donor_types"),
    )
    donors = cells.groupBy("dataset_id").agg(F.countDistinct("donor_id").alias("donors"))
    return types.join(donors, "dataset_id").select(
        "dataset_id", "cells", "donors", "types", "multi_donor_types"
    )


def top_donors(cells: DataFrame, n: int = 20) -> DataFrame:
    """The largest donors of each dataset, ties by donor id."""
    counts = cells.groupBy("dataset_id", "donor_id").agg(F.count(F.lit(1)).alias("cells"))
    return top_n(counts, ["dataset_id"], [F.desc("cells"), F.asc("donor_id")], n)


def discovery_order(found: DataFrame, limit: int) -> DataFrame:
    """Best sources first."""
    return found.orderBy(
        F.desc("multi_donor_types"), F.desc("donors"), F.desc("cells"), F.asc("dataset_id")
    ).limit(limit)


def category_values(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Distinct values of several columns that contain a text, ignoring case."""
    values = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        ).alias("p")
    ).select("p.column", "p.value")
    return values.where(F.contains(F.lower("value"), F.lit(needle.lower()))).distinct()


def spot_draws(types: DataFrame, design: SpotDesign) -> DataFrame:
    """The draws of every pseudo-spot: pure spots type by type, then the mixed ones.

    ``types`` is ``cell_type``; the plan has one row per draw, a size the recipe sets.
    """
    # One row per cell type.
    ranked = types.select(
        "cell_type", (F.row_number().over(Window.orderBy("cell_type")) - 1).cast("long").alias("type_ord")
    )
    n_types = types.agg(F.count(F.lit(1)).alias("t")).scalar()
    pure = ranked.select(
        F.explode(F.sequence(F.lit(0), F.lit(design.pure_per_type - 1))).alias("index"), "cell_type", "type_ord"
    ).select(
        F.lit(0).alias("phase"),
        (F.col("type_ord") * design.pure_per_type + F.col("index")).alias("spot"),
        F.lit(0).alias("slot"),
        "cell_type",
        F.lit(design.cells_per_spot).alias("n"),
    )
    dominant = max(1, math.ceil(design.cells_per_spot * design.dominant_fraction))
    others = design.types_per_mixed - 1
    rest = design.cells_per_spot - dominant
    sizes = [dominant] + [rest // others + (1 if i < rest % others else 0) for i in range(others)]
    slots = F.posexplode(F.array(*[F.lit(s) for s in sizes])).alias("slot", "n")
    mixed = (
        types.sparkSession.range(design.mixed_spots)
        .select(F.col("id").alias("index"), slots)
        .withColumn("_t", n_types)
        .withColumn("type_ord", F.pmod(F.col("index") + F.col("slot"), F.col("_t")))
        .join(ranked, "type_ord")
        .select(
            F.lit(1).alias("phase"),
            (F.col("_t") * design.pure_per_type + F.col("index")).alias("spot"),
            "slot",
            "cell_type",
            "n",
        )
    )
    return pure.unionByName(mixed)


def cyclic_draw(draws: DataFrame, pool: DataFrame) -> DataFrame:
    """Cells of every draw, taken cyclically per type.

    The cursor moves on by one less than the number drawn, so a draw begins with the
    last cell of the one before.  ``pool`` is ``cell_type, position, cell_id``.
    """
    sizes = pool.groupBy("cell_type").agg(F.count(F.lit(1)).alias("pool_size"))
    earlier = (
        Window.partitionBy("cell_type")
        .orderBy("phase", "spot", "slot")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    started = draws.withColumn("start", F.coalesce(F.sum(F.col("n") - 1).over(earlier), F.lit(0)))
    taken = (
        started.join(sizes, "cell_type")
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("position", F.pmod(F.col("start") + F.col("k"), F.col("pool_size")))
    )
    return taken.join(pool, ["cell_type", "position"]).select("spot", "phase", "slot", "k", "cell_type", "cell_id")


def holdout_pool(cells: DataFrame, order: str = "cell_id") -> DataFrame:
    """Cells of each type with their position in the pool."""
    return numbered(cells, [F.col(order)], ["cell_type"], "position").select("cell_type", "position", "cell_id")


def spot_sums(drawn: DataFrame, entries: DataFrame) -> DataFrame:
    """Counts per pseudo-spot and feature; a cell drawn twice counts twice."""
    picked = drawn.select("spot", F.col("cell_id").cast("string").alias("obs_id"))
    return entries.join(picked, "obs_id").groupBy("spot", "feature_id").agg(F.sum("value").alias("value"))


def spot_truth(draws: DataFrame) -> DataFrame:
    """Dominant type of each spot and whether it is mixed."""
    return draws.where("slot = 0").select(
        "spot", F.col("cell_type").alias("truth"), (F.col("phase") == 1).alias("mixed")
    )
