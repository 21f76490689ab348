"""Catalogue queries: search, filters, facets, pages, challenges and their integrity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltomics.schema import CHALLENGE_TYPES, DERIVED_TYPES


@dataclass(frozen=True)
class CatalogueFilter:
    """Filters of a catalogue page; absent ones are ignored."""

    query: str | None = None
    organism: str | None = None
    tissue: str | None = None
    modality: str | None = None
    technology: str | None = None
    spatial_unit: str | None = None
    challenge_type: str | None = None


def _has(column: str | Column, needle: str) -> Column:
    return F.contains(F.lower(column), F.lit(needle.lower()))


def _any_has(column: str, needle: str) -> Column:
    return F.exists(column, lambda item: F.contains(F.lower(item), F.lit(needle.lower())))


def search(
    datasets: DataFrame, modalities: DataFrame, needle: str, include_split_id: bool = False
) -> DataFrame:
    """Case-insensitive literal substring over the text fields and the technologies."""
    needle = needle.strip()
    by_technology = (
        modalities.where(_any_has("technology", needle))
        .select("dataset_id")
        .distinct()
        .withColumn("_technology", F.lit(True))
    )
    fields = [_has(c, needle) for c in ("dataset_id", "title", "description")]
    fields += [_any_has(c, needle) for c in ("source", "organism", "tissue", "keywords")]
    if include_split_id:
        fields.append(_has("split_id", needle))
    condition = F.coalesce(F.col("_technology"), F.lit(False))
    for field in fields:
        condition = condition | F.coalesce(field, F.lit(False))
    return datasets.join(by_technology, "dataset_id", "left").where(condition).drop("_technology")


def having_modality(datasets: DataFrame, modalities: DataFrame, name: str) -> DataFrame:
    """Datasets with a modality of that name."""
    return datasets.join(modalities.where(F.col("name") == name), "dataset_id", "left_semi")


def having_technology(datasets: DataFrame, modalities: DataFrame, technology: str) -> DataFrame:
    """Datasets with a modality measured by that technology."""
    return datasets.join(
        modalities.where(F.array_contains("technology", technology)), "dataset_id", "left_semi"
    )


def apply_filter(
    datasets: DataFrame, modalities: DataFrame, wanted: CatalogueFilter, include_split_id: bool = False
) -> DataFrame:
    """Conjunction of all supplied filters; the cheap column filters come first."""
    kept = datasets
    if wanted.organism:
        kept = kept.where(F.array_contains("organism", wanted.organism))
    if wanted.tissue:
        kept = kept.where(F.array_contains("tissue", wanted.tissue))
    if wanted.spatial_unit:
        kept = kept.where(F.col("spatial_unit") == wanted.spatial_unit)
    if wanted.challenge_type:
        kept = kept.where(F.col("derivation.challenge_type") == wanted.challenge_type)
    if wanted.modality:
        kept = having_modality(kept, modalities, wanted.modality)
    if wanted.technology:
        kept = having_technology(kept, modalities, wanted.technology)
    if wanted.query and wanted.query.strip():
        kept = search(kept, modalities, wanted.query, include_split_id)
    return kept


def full_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.where(F.col("dataset_type") == "full")


def derived_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.where(F.col("dataset_type").isin(*DERIVED_TYPES))


def database_page(
    datasets: DataFrame, modalities: DataFrame, wanted: CatalogueFilter, offset: int, limit: int
) -> DataFrame:
    """One page of full datasets, newest first, with the total before paging."""
    matching = apply_filter(full_datasets(datasets), modalities, wanted)
    total = matching.agg(F.count(F.lit(1)).alias("total"))
    return (
        matching.orderBy(F.desc("imported_at"), F.asc("dataset_id"))
        .offset(offset)
        .limit(limit)
        .withColumn("total", total.scalar())
    )


def matching_splits(
    datasets: DataFrame, modalities: DataFrame, wanted: CatalogueFilter
) -> DataFrame:
    """Splits with at least one matching side and the newest import among those sides."""
    sides = derived_datasets(datasets).where(F.col("split_id").isNotNull())
    return (
        apply_filter(sides, modalities, wanted, include_split_id=True)
        .groupBy("split_id")
        .agg(F.max("imported_at").alias("recency"))
    )


def build_challenges(datasets: DataFrame) -> DataFrame:
    """Pair the train and test rows of each split; at most one row per side."""
    sides = derived_datasets(datasets).where(F.col("split_id").isNotNull())

    def side(name: str, column: str) -> Column:
        return F.max(F.when(F.col("dataset_type") == name, F.col(column)))

    kind = F.max(F.when(F.col("dataset_type") == "train", F.col("derivation.challenge_type")))
    other = F.max(F.when(F.col("dataset_type") == "test", F.col("derivation.challenge_type")))
    return (
        sides.groupBy("split_id")
        .agg(
            side("train", "dataset_id").alias("train_id"),
            side("test", "dataset_id").alias("test_id"),
            F.coalesce(kind, other).alias("challenge_type"),
        )
        .withColumn(
            "status",
            F.when(F.col("train_id").isNull(), "missing_train")
            .when(F.col("test_id").isNull(), "missing_test")
            .otherwise("complete"),
        )
    )


def challenge_page(
    datasets: DataFrame,
    modalities: DataFrame,
    wanted: CatalogueFilter,
    offset: int,
    limit: int,
    sort: str = "newest",
    aurocs: DataFrame | None = None,
) -> DataFrame:
    """One page of challenges: a challenge qualifies if either side matches, both are shown.

    ``aurocs`` holds ``split_id, auroc``; challenges without a value come last in
    both difficulty orders and ties keep the newest order.
    """
    splits = matching_splits(datasets, modalities, wanted)
    total = splits.agg(F.count(F.lit(1)).alias("total"))
    newest = [F.desc("recency"), F.asc("split_id")]
    if sort == "newest":
        order = newest
    else:
        if aurocs is None:
            splits = splits.withColumn("auroc", F.lit(None).cast("double"))
        else:
            splits = splits.join(aurocs, "split_id", "left")
        value = F.asc("auroc") if sort == "difficulty_asc" else F.desc("auroc")
        order = [F.asc(F.col("auroc").isNull()), value, *newest]
    page = splits.orderBy(*order).offset(offset).limit(limit)
    # At most ``limit`` rows are numbered; the join below loses the order, ``position`` keeps it.
    page = page.withColumn("position", (F.row_number().over(Window.orderBy(*order)) + offset - 1).cast("long"))
    shown = page.join(build_challenges(datasets).join(page.select("split_id"), "split_id", "left_semi"), "split_id")
    return shown.withColumn("total", total.scalar()).orderBy("position")


def duplicate_sides(datasets: DataFrame) -> DataFrame:
    """(split, side) pairs with more than one dataset."""
    return (
        derived_datasets(datasets)
        .groupBy("split_id", "dataset_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def inconsistent_types(datasets: DataFrame) -> DataFrame:
    """Splits whose sides are unidentified, have an invalid type or disagree on it."""
    kind = F.col("derivation.challenge_type")
    invalid = F.max(F.when(kind.isNull() | ~kind.isin(*CHALLENGE_TYPES), 1).otherwise(0))
    return (
        derived_datasets(datasets)
        .groupBy("split_id")
        .agg(F.countDistinct(kind).alias("n_types"), invalid.alias("invalid"))
        .withColumn(
            "problem",
            F.when(F.col("split_id").isNull(), "missing_split_id")
            .when(F.col("invalid") == 1, "invalid_type")
            .when(F.col("n_types") > 1, "inconsistent_type"),
        )
        .where(F.col("problem").isNotNull())
        .select("split_id", "problem", F.col("n_types"))
    )


def facets(datasets: DataFrame, modalities: DataFrame, dataset_types: tuple[str, ...]) -> DataFrame:
    """Distinct values of every facet as (facet, value); one pass over each table."""
    chosen = datasets.where(F.col("dataset_type").isin(*dataset_types))

    def tag(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    none = F.array().cast("array<string>")
    kind = F.col("derivation.challenge_type")
    per_dataset = chosen.select(
        F.explode(
            F.concat(
                tag("organisms", F.coalesce("organism", none)),
                tag("tissues", F.coalesce("tissue", none)),
                tag("spatial_units", F.array("spatial_unit")),
                tag("challenge_types", F.when(kind.isin(*CHALLENGE_TYPES), F.array(kind)).otherwise(none)),
            )
        ).alias("f")
    )
    per_modality = modalities.join(chosen.select("dataset_id"), "dataset_id").select(
        F.explode(
            F.concat(tag("modalities", F.array("name")), tag("technologies", F.col("technology")))
        ).alias("f")
    )
    return per_dataset.unionByName(per_modality).select("f.facet", "f.value").distinct()


def declared_sources(datasets: DataFrame) -> DataFrame:
    """One row per derived dataset and declared source."""
    return derived_datasets(datasets).select(
        "dataset_id",
        "split_id",
        F.size("derivation.source_dataset_ids").alias("n_sources"),
        F.posexplode("derivation.source_dataset_ids").alias("source_ord", "source_id"),
    )


def missing_sources(datasets: DataFrame) -> DataFrame:
    """Declared sources that are absent or not full."""
    full = full_datasets(datasets).select(F.col("dataset_id").alias("source_id"))
    return declared_sources(datasets).join(full, "source_id", "left_anti")


def resolve_sample_sources(datasets: DataFrame) -> DataFrame:
    """Map each sample of a multi-source dataset to its source dataset and sample.

    ``problem`` is null where the sample maps to exactly one declared source that
    lists it.
    """
    samples = (
        derived_datasets(datasets)
        .where(F.size("derivation.source_dataset_ids") > 1)
        .select(
            "dataset_id",
            F.col("derivation.source_dataset_ids").alias("declared"),
            F.explode("sample_ids").alias("sample_id"),
        )
        .withColumn(
            "matches",
            F.filter("declared", lambda s: F.startswith(F.col("sample_id"), F.concat(s, F.lit("::")))),
        )
        .withColumn("source_id", F.when(F.size("matches") == 1, F.element_at("matches", 1)))
        .withColumn(
            "source_sample_id",
            F.expr("substring(sample_id, length(source_id) + 3)"),
        )
    )
    sources = full_datasets(datasets).select(
        F.col("dataset_id").alias("source_id"),
        F.col("title").alias("source_title"),
        F.col("sample_ids").alias("source_samples"),
    )
    return samples.join(sources, "source_id", "left").select(
        "dataset_id",
        "sample_id",
        "source_id",
        "source_sample_id",
        "source_title",
        F.when(F.size("matches") != 1, "ambiguous_source")
        .when(F.col("source_samples").isNull(), "missing_source")
        .when(~F.array_contains("source_samples", F.col("source_sample_id")), "unknown_sample")
        .alias("problem"),
    )


def opposite_sides(datasets: DataFrame) -> DataFrame:
    """For each derived dataset the dataset on the other side of its split."""
    sides = derived_datasets(datasets).select("dataset_id", "split_id", "dataset_type")
    peers = sides.select(
        F.col("dataset_id").alias("peer_id"),
        "split_id",
        F.when(F.col("dataset_type") == "train", "test").otherwise("train").alias("dataset_type"),
    )
    return sides.join(peers, ["split_id", "dataset_type"]).select(
        "dataset_id", "split_id", "dataset_type", "peer_id"
    )


def modality_values(datasets: DataFrame, modalities: DataFrame, dataset_types: tuple[str, ...]) -> DataFrame:
    """Modality rows of the datasets of the given types."""
    chosen = datasets.where(F.col("dataset_type").isin(*dataset_types)).select(
        "dataset_id", "dataset_type"
    )
    return modalities.join(chosen, "dataset_id")


def inventory(datasets: DataFrame) -> DataFrame:
    """Rows per dataset type, number of splits and number of partially shared datasets."""
    return datasets.groupBy("dataset_type").agg(
        F.count(F.lit(1)).alias("n_datasets"),
        F.countDistinct("split_id").alias("n_splits"),
        F.count_if(F.col("pairing_type") == "partially_shared").alias("n_partial"),
    )


def merged_metadata(datasets: DataFrame, column: str) -> DataFrame:
    """Union of a list column over the sources of each derived dataset, first seen first."""
    values = datasets.select(
        F.col("dataset_id").alias("source_id"), F.posexplode(column).alias("pos", "value")
    )
    first = (
        declared_sources(datasets)
        .join(values, "source_id")
        .groupBy("dataset_id", "value")
        .agg(F.min(F.struct("source_ord", "pos")).alias("seen"))
    )
    # A metadata list holds at most the values of its declared sources.
    return first.groupBy("dataset_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seen", "value"))), lambda v: v["value"]).alias(
            "merged"
        )
    ).withColumn("is_scalar", F.size("merged") == 1)


def incompatible_sources(datasets: DataFrame, modalities: DataFrame) -> DataFrame:
    """Derived datasets whose sources disagree on a value type or on the units."""
    declared = declared_sources(datasets).select("dataset_id", "source_id")
    units = (
        declared.join(
            datasets.select(
                F.col("dataset_id").alias("source_id"), "spatial_unit", "coordinate_unit"
            ),
            "source_id",
        )
        .groupBy("dataset_id")
        .agg(
            F.countDistinct("spatial_unit", "coordinate_unit").alias("n_values"),
        )
        .select("dataset_id", F.lit("units").alias("field"), "n_values")
    )
    types = (
        declared.join(
            modalities.select(F.col("dataset_id").alias("source_id"), "name", "value_type"), "source_id"
        )
        .groupBy("dataset_id", "name")
        .agg(F.countDistinct("value_type").alias("n_values"))
        .select("dataset_id", F.concat(F.lit("value_type:"), F.col("name")).alias("field"), "n_values")
    )
    return units.unionByName(types).where("n_values > 1")


def reconcile_ids(catalogue: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids that are only in the catalogue or only in the store."""
    left = catalogue.select("dataset_id", F.lit(1).alias("_c"))
    right = stored.select("dataset_id", F.lit(1).alias("_s"))
    return (
        left.join(right, "dataset_id", "full_outer")
        .where(F.col("_c").isNull() | F.col("_s").isNull())
        .select(
            "dataset_id",
            F.when(F.col("_s").isNull(), "missing").otherwise("unindexed").alias("difference"),
        )
    )


def migration_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old against new checksum, size and observation count of every dataset."""
    names = ("sha256", "file_size", "n_obs")
    left = old.select("dataset_id", *[F.col(n).alias(f"old_{n}") for n in names])
    right = new.select("dataset_id", *[F.col(n).alias(f"new_{n}") for n in names])
    changed = F.lit(False)
    for n in names:
        changed = changed | ~F.col(f"old_{n}").eqNullSafe(F.col(f"new_{n}"))
    return left.join(right, "dataset_id", "full_outer").withColumn("changed", changed)


def pinned_metadata(datasets: DataFrame, pins: DataFrame) -> DataFrame:
    """Pins (``dataset_id, sha256, spatial_unit``) against the catalogue; exactly one row must agree."""
    found = (
        datasets.select("dataset_id", F.col("sha256").alias("_sha"), F.col("spatial_unit").alias("_unit"))
        .groupBy("dataset_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"), F.max("_sha").alias("_sha"), F.max("_unit").alias("_unit")
        )
    )
    return pins.join(found, "dataset_id", "left").select(
        "dataset_id",
        F.when(F.coalesce("n_rows", F.lit(0)) != 1, "absent_or_duplicated")
        .when(F.col("sha256") != F.col("_sha"), "version_changed")
        .when(F.col("spatial_unit") != F.col("_unit"), "collection_changed")
        .otherwise("pinned")
        .alias("state"),
    )


def replacement_identity(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whether a replacement keeps type, construction, sources, split and challenge type."""

    def identity(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "dataset_id",
            F.struct(
                "dataset_type",
                F.col("derivation.construction_type").alias("construction_type"),
                F.col("derivation.source_dataset_ids").alias("source_dataset_ids"),
                F.col("derivation.split_id").alias("split_id"),
                F.col("derivation.challenge_type").alias("challenge_type"),
            ).alias(name),
        )

    return (
        identity(new, "_new")
        .join(identity(old, "_old"), "dataset_id", "left")
        .select(
            "dataset_id",
            F.when(F.col("_old").isNull(), "absent")
            .when(F.col("_old").eqNullSafe(F.col("_new")), "same")
            .otherwise("changed")
            .alias("identity"),
        )
    )


def import_append(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Catalogue after an import: ids already present are refused, the others appended."""
    fresh = incoming.join(existing.select("dataset_id"), "dataset_id", "left_anti")
    return existing.unionByName(fresh)


def import_replace(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Catalogue after replacements: only rows with an unchanged identity are exchanged."""
    allowed = replacement_identity(existing, incoming).where("identity = 'same'")
    accepted = incoming.join(allowed.select("dataset_id"), "dataset_id", "left_semi")
    untouched = existing.join(accepted.select("dataset_id"), "dataset_id", "left_anti")
    return untouched.unionByName(accepted)


def register_auxiliary(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Side-file records after registration: id and name stay unique per dataset."""
    once = incoming
    for key in ("auxiliary_id", "name"):
        counts = once.groupBy("dataset_id", key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
        once = once.join(counts.drop("_n"), ["dataset_id", key], "left_semi")
        once = once.join(existing.select("dataset_id", key), ["dataset_id", key], "left_anti")
    return existing.unionByName(once)
