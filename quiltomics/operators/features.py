"""Feature axes: mapping, merging policies, measurement masks and count harmonisation.

A feature axis is a table ``source_id, source_ord, feature_id, feature_ord``; Spark rows
carry no order, so every ordered axis keeps its ordinals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltomics.operators.ordering import numbered


def fully_measured(measured: DataFrame) -> DataFrame:
    """Features that every source measured."""
    return (
        measured.groupBy("feature_id")
        .agg(F.bool_and("measured").alias("_all"))
        .where("_all")
        .select("feature_id")
    )


def common_features(train: DataFrame, test: DataFrame) -> DataFrame:
    """Features on both sides with their ordinals there."""
    left = train.select("feature_id", F.col("feature_ord").alias("train_ord"))
    right = test.select("feature_id", F.col("feature_ord").alias("test_ord"))
    return left.join(right, "feature_id")


def overlap_fraction(train: DataFrame, test: DataFrame) -> DataFrame:
    """Common features over the smaller of the two axes."""
    sides = (
        train.select("feature_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(test.select("feature_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy("feature_id")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    return sides.agg(
        F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), F.sum(F.col("a") * F.col("b")).alias("n_common")
    ).withColumn("fraction", F.try_divide("n_common", F.least("n_train", "n_test")))


def shared_genes(target: DataFrame, reference: DataFrame, minimum: int) -> DataFrame:
    """Number of genes in both panels and whether it passes the gate."""
    common = target.select("feature_id").distinct().join(
        reference.select("feature_id").distinct(), "feature_id"
    )
    return common.agg(F.count(F.lit(1)).alias("shared")).withColumn(
        "passes", F.col("shared") >= minimum
    )


def target_panel(features: DataFrame) -> DataFrame:
    """Distinct non-blank trimmed feature ids."""
    return features.select(F.trim("feature_id").alias("feature_id")).where("feature_id <> ''").distinct()


def map_features(features: DataFrame, rules: DataFrame, mapping: DataFrame) -> DataFrame:
    """Raw to canonical features by the rule of each source.

    ``rules`` is ``source_id, kind`` with kind ``identity``, ``var_column`` (the
    ``symbol`` column of ``features``) or ``mapping_file`` (rows of ``mapping``:
    ``source_id, feature_id, mapped_id``).  Only a mapping table drops raw features.
    """
    ruled = features.join(rules, "source_id").join(mapping, ["source_id", "feature_id"], "left")
    canonical = (
        F.when(F.col("kind") == "identity", F.col("feature_id"))
        .when(F.col("kind") == "var_column", F.trim("symbol"))
        .when(F.col("kind") == "mapping_file", F.col("mapped_id"))
    )
    return (
        ruled.withColumn("canonical_id", canonical)
        .where("canonical_id IS NOT NULL")
        .select("source_id", "source_ord", "feature_id", "feature_ord", "canonical_id")
    )


def unknown_mapping_keys(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapping rows whose raw feature the source does not have."""
    return mapping.join(features, ["source_id", "feature_id"], "left_anti")


def measured_mask(features: DataFrame) -> DataFrame:
    """Feature by source truth table, also for sources that lack the feature."""
    # As many values as declared sources.
    sources = features.agg(F.array_sort(F.collect_set("source_id")).alias("s"))
    return (
        features.groupBy("feature_id")
        .agg(F.collect_set("source_id").alias("present"))
        .select(
            "feature_id",
            "present",
            F.explode(sources.scalar()).alias("source_id"),
        )
        .select(
            "feature_id", "source_id", F.array_contains("present", F.col("source_id")).alias("measured")
        )
    )


def all_measured(mask: DataFrame, used_sources: DataFrame) -> DataFrame:
    """Whether the used sources measured every feature."""
    return mask.join(used_sources.select("source_id").distinct(), "source_id", "left_semi").agg(
        F.coalesce(F.bool_and("measured"), F.lit(True)).alias("all_measured")
    )


def _count_sources(features: DataFrame) -> DataFrame:
    return features.agg(F.countDistinct("source_id").alias("k"))


def intersection(features: DataFrame, key: str = "feature_id") -> DataFrame:
    """Features of every source in the order of the first source."""
    shared = (
        features.groupBy(key)
        .agg(
            F.countDistinct("source_id").alias("n"),
            F.min(F.struct("source_ord", "feature_ord")).alias("first"),
        )
        .where(F.col("n") == _count_sources(features).scalar())
        .select(key, F.col("first.feature_ord").alias("_ord"))
    )
    return numbered(shared, [F.col("_ord"), F.col(key)], name="target_ord").select(key, "target_ord")


def union(features: DataFrame, key: str = "feature_id") -> DataFrame:
    """All features in the order of first appearance over the ordered sources."""
    seen = features.groupBy(key).agg(F.min(F.struct("source_ord", "feature_ord")).alias("first"))
    order = [F.col("first.source_ord"), F.col("first.feature_ord"), F.col(key)]
    return numbered(seen, order, name="target_ord").select(key, "target_ord")


def preserve_mismatches(features: DataFrame) -> DataFrame:
    """Per source, how many (position, feature) pairs the other sources do not share."""
    placed = numbered(features, [F.col("feature_ord"), F.col("feature_id")], ["source_id"], "position")
    shared = placed.groupBy("position", "feature_id").agg(F.countDistinct("source_id").alias("n"))
    return (
        placed.join(shared, ["position", "feature_id"])
        .groupBy("source_id")
        .agg(
            F.count(F.lit(1)).alias("n_features"),
            F.count_if(F.col("n") < _count_sources(features).scalar()).alias("n_mismatch"),
        )
    )


def reference_axis(features: DataFrame, reference: str) -> DataFrame:
    """The axis of the reference source."""
    own = features.where(F.col("source_id") == reference)
    return numbered(own, [F.col("feature_ord")], name="target_ord").select("feature_id", "target_ord")


def provenance(mapped: DataFrame) -> DataFrame:
    """Per canonical feature and source the JSON list of raw ids in source order."""
    raw = F.array_sort(F.collect_list(F.struct("feature_ord", "feature_id")))
    return mapped.groupBy("canonical_id", "source_id").agg(
        F.to_json(F.transform(raw, lambda r: r["feature_id"])).alias("raw_ids")
    )


def align_entries(entries: DataFrame, target: DataFrame) -> DataFrame:
    """Entries on the target axis; features outside it go, missing ones stay implicit zeros."""
    return entries.join(target.select("feature_id", "target_ord"), "feature_id")


def harmonize_sum(entries: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sum of the raw features that map to one canonical feature, per observation.

    Both tables carry the join columns they share (``feature_id`` and, if mappings
    differ by source, ``source_id``).
    """
    on = [c for c in ("source_id", "feature_id") if c in mapping.columns and c in entries.columns]
    keys = [c for c in ("dataset_id", "modality", "obs_id") if c in entries.columns]
    return (
        entries.join(mapping.select(*on, "canonical_id"), on)
        .groupBy(*keys, "canonical_id")
        .agg(F.sum("value").alias("value"))
    )


def collapse_symbols(entries: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge features with one symbol by sum; second result lists the merged ids."""
    named = symbols.select("feature_id", F.trim("symbol").alias("canonical_id")).where(
        "canonical_id <> ''"
    )
    ids = named.groupBy("canonical_id").agg(
        F.array_join(F.array_sort(F.collect_set("feature_id")), ",").alias("source_feature_id")
    )
    return harmonize_sum(entries, named), ids
