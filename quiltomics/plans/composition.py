"""Composition of whole sources into the train and test products of a challenge.

A side stacks its sources: observations with coordinates and labels, memberships, the merged feature axis of every
modality, entries on it, which source measured what, and one row of metadata.  What is measured is kept as the
pairs that are (absent pairs are not), and only where a source lacks a feature of the axis.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltomics.operators.matrix import pairing_type
from quiltomics.operators.splits import apply_coordinate_rule, compose_sources
from quiltomics.plans.splits import merged_axis
from quiltomics.session import settled
from quiltomics.sources.publishing import Publication, Tables


def _of(df: DataFrame, column: str, sources: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(*sources))


def _aligned(entries: DataFrame, axes: DataFrame) -> DataFrame:
    """Entries on the axes: one join on what every source measured, for all sides and modalities at once."""
    placed = entries.join(axes, ["modality", "source_id", "feature_id"])
    return placed.select("side", "modality", F.concat_ws("::", "source_id", "obs_id").alias("obs_id"), "feature_id", "target_ord", "value")


def compose_side(
    tables: Tables, sources: Sequence[str], side: str, split_id: str, policy: str, reference: str | None = None, challenge_type: str = ""
) -> dict[str, DataFrame]:
    """One side's product.

    ``tables`` holds ``observations`` (``source_dataset_id, obs_id, sample_id, x, y, cell_type``, and ``attrs`` where
    coordinate rules are given), ``memberships`` (``source_id, modality, obs_id``), ``features`` (``modality, source_id,
    source_ord, feature_id, feature_ord``), ``entries`` (``modality, source_id, obs_id, feature_id, value``) and, if
    coordinates are to be taken from elsewhere, ``coordinate_rules``.  The reference policy takes the
    reference's axis where the reference is one of the side's sources, else the axis of its first source that has one.
    """
    made, placing = _side(tables, sources, side, split_id, policy, reference, challenge_type)
    entries = _aligned(_of(tables["entries"], "source_id", sources), placing)
    return made | {"entries": entries.select("modality", "obs_id", "feature_id", "target_ord", "value", "side")}


def _side(
    tables: Tables, sources: Sequence[str], side: str, split_id: str, policy: str, reference: str | None, challenge_type: str
) -> tuple[dict[str, DataFrame], DataFrame]:
    """A side without its entries, and where they go: ``side, modality, source_id, feature_id, target_ord``."""
    own = _of(tables["observations"], "source_dataset_id", sources)
    observations = own
    if "coordinate_rules" in tables:
        placed = apply_coordinate_rule(own, tables["coordinate_rules"])
        observations = placed.withColumns({"x": F.col("new_x").cast("double"), "y": F.col("new_y").cast("double")})
    observations = compose_sources(observations)
    members = _of(tables["memberships"], "source_id", sources).select(
        F.concat_ws("::", "source_id", "obs_id").alias("obs_id"), F.col("source_id").alias("source_dataset_id"), "modality"
    )
    features = settled(_of(tables["features"], "source_id", sources), "side-axes")  # read many times below
    modalities = sorted(r["modality"] for r in features.select("modality").distinct().collect())  # a few
    axes, placing, measured, gaps = [], [], [], False
    for modality in modalities:
        axis_rows = features.where(F.col("modality") == modality)
        having = [r["source_id"] for r in axis_rows.groupBy("source_id").agg(F.min("source_ord").alias("o")).orderBy("o", "source_id").collect()]
        base = (reference if reference in having else having[0]) if policy == "reference" else None
        target = settled(merged_axis(axis_rows, policy, base), "axis")
        axes.append(target.select(F.lit(modality).alias("modality"), "feature_id", "target_ord"))
        pairs = axis_rows.select("source_id", "feature_id").distinct().join(target, "feature_id")
        pairs = settled(pairs.select(F.lit(modality).alias("modality"), "source_id", "feature_id", "target_ord"), "pairs")
        placing.append(pairs)
        if pairs.count() < target.count() * len(having):
            gaps = True
            measured.append(pairs)
    empty = features.sparkSession.createDataFrame([], "modality string, source_id string, feature_id string, target_ord long")
    pairing = pairing_type(members.withColumn("dataset_id", F.lit(side))).select("pairing_type")
    metadata = observations.agg(F.count(F.lit(1)).alias("n_obs")).select(
        F.lit(f"{split_id}_{side}").alias("dataset_id"),
        F.lit(split_id).alias("split_id"),
        F.lit(side).alias("dataset_type"),
        F.lit(challenge_type).alias("challenge_type"),
        F.lit("subset" if len(sources) == 1 else "composite").alias("construction_type"),
        F.array(*[F.lit(s) for s in sources]).alias("source_dataset_ids"),
        F.lit(policy).alias("feature_merge_policy"),
        F.lit(reference if policy == "reference" else None).cast("string").alias("reference_dataset_id"),
        F.lit(gaps).alias("has_unmeasured_features"),
        pairing.scalar().alias("pairing_type"),
        "n_obs",
    )

    def sided(df: DataFrame) -> DataFrame:
        return df.withColumn("side", F.lit(side))

    return {
        "observations": sided(observations),
        "memberships": sided(members),
        "features": sided(reduce(DataFrame.unionByName, axes)),
        "measured": sided(reduce(DataFrame.unionByName, measured, empty)),
        "metadata": sided(metadata),
    }, sided(reduce(DataFrame.unionByName, placing))


def composition_findings(product: Tables) -> DataFrame:
    """What forbids a product: ``dataset_id, code, severity``."""
    observations, members, metadata = product["observations"], product["memberships"], product["metadata"]
    ids = metadata.select("side", "dataset_id")

    def finding(sides: DataFrame, code: str) -> DataFrame:
        return sides.select("side").distinct().join(ids, "side").select("dataset_id", F.lit(code).alias("code"), F.lit("error").alias("severity"))

    repeated = observations.groupBy("side", "obs_id").count().where("count > 1")
    shared = observations.groupBy("source_dataset_id").agg(F.count_if(F.col("side") == "train").alias("a"), F.count_if(F.col("side") == "test").alias("b"))
    sources = metadata.select("side", F.explode("source_dataset_ids").alias("source_dataset_id"))
    bare = sources.join(observations, ["side", "source_dataset_id"], "left_anti")
    axes = product["features"].select("side", "modality").distinct()
    unfilled = axes.join(members.select("side", "modality").distinct(), ["side", "modality"], "left_anti")
    lone = axes.groupBy("modality").agg(F.countDistinct("side").alias("n"), F.min("side").alias("side")).where("n < 2")
    unknown = product["entries"].join(members, ["side", "obs_id", "modality"], "left_anti")
    nowhere = observations.where(F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y"))
    both = observations.join(shared.where("a > 0 AND b > 0"), "source_dataset_id", "left_semi")
    found = [
        finding(repeated, "duplicate_obs_names"), finding(both, "train_test_source_overlap"), finding(bare, "empty_source"),
        finding(unfilled, "empty_modality_obs"), finding(lone, "modality_on_one_side"), finding(unknown, "unknown_entry"),
        finding(nowhere, "nonfinite_coordinates"),
    ]
    return reduce(DataFrame.unionByName, found)


def composed(
    tables: Tables, sides: Mapping[str, Sequence[str]], split_id: str, policy: str, reference: str | None = None, challenge_type: str = ""
) -> dict[str, DataFrame]:
    """Both sides' products, stacked table by table.

    What a side reads several times is written once for all sides, and the entries of all sides are aligned in one pass.
    """
    every = sorted({s for sources in sides.values() for s in sources})
    keys = {"observations": "source_dataset_id", "memberships": "source_id", "features": "source_id"}
    once = {**tables} | {name: settled(_of(tables[name], key, every), name) for name, key in keys.items()}
    made = [_side(once, sources, side, split_id, policy, reference, challenge_type) for side, sources in sides.items()]
    product = {name: reduce(DataFrame.unionByName, [m[name] for m, _ in made]) for name in made[0][0]}
    placing = reduce(DataFrame.unionByName, [placed for _, placed in made])
    entries = _aligned(_of(tables["entries"], "source_id", every), placing)
    return product | {"entries": entries.select("modality", "obs_id", "feature_id", "target_ord", "value", "side")}


def publish_composition(spark: SparkSession, root: str, product: Tables) -> Publication:
    """Write train and test as one generation, after the checks; a failing one writes nothing."""
    publication = Publication(spark, root)
    partitions = {name: ["side"] for name in product}
    publication.publish(product, composition_findings, partitions)
    return publication
