"""Schema migration: trim two-modality datasets to paired observations, validate, publish, report the change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltomics.operators.ordering import numbered
from quiltomics.session import settled
from quiltomics.sources.publishing import Publication, Tables


def paired_members(memberships: DataFrame) -> DataFrame:
    """Observations of each dataset, flagged if they are in every modality of it."""
    k = memberships.groupBy("dataset_id").agg(F.countDistinct("modality").alias("k"))
    per_obs = memberships.groupBy("dataset_id", "obs_id").agg(F.countDistinct("modality").alias("n"))
    return per_obs.join(k, "dataset_id").select("dataset_id", "obs_id", (F.col("n") == F.col("k")).alias("kept"))


def migration_report(memberships: DataFrame, old_version: str, new_version: str) -> DataFrame:
    """Old and new observation counts of each dataset."""
    return (
        paired_members(memberships)
        .groupBy("dataset_id")
        .agg(
            F.count(F.lit(1)).alias("old_n_obs"),
            F.count_if("kept").alias("new_n_obs"),
            F.count_if(~F.col("kept")).alias("n_removed"),
        )
        .withColumn("old_version", F.lit(old_version))
        .withColumn("new_version", F.lit(new_version))
        .withColumn("status", F.when(F.col("new_n_obs") == 0, "empty").otherwise("migrated"))
    )


def migrated(tables: Tables, new_version: str) -> dict[str, DataFrame]:
    """The tables of all datasets after the migration, and ``removed``: the ids that went.

    ``tables`` holds ``datasets`` (``dataset_id, schema_version, pairing_type, n_obs`` and more),
    ``observations``, ``memberships`` and ``entries``, each with ``dataset_id, obs_id``.  Datasets of one
    modality stay whole.  Kept observations keep their order and are numbered anew without gaps.
    """
    flags = settled(paired_members(tables["memberships"]), "paired")
    kept = flags.where("kept").select("dataset_id", "obs_id")
    keys = ["dataset_id", "obs_id"]
    observations = tables["observations"].join(kept, keys, "left_semi")
    ranked = numbered(observations, [F.col("obs_ord"), F.col("obs_id")], ["dataset_id"], "_ordinal")
    observations = settled(ranked.drop("obs_ord").withColumnRenamed("_ordinal", "obs_ord"), "migrated-observations")
    counts = observations.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    datasets = (
        tables["datasets"]
        .join(counts, "dataset_id", "left")
        .withColumn("n_obs", F.coalesce("_n", F.lit(0)).cast("long"))
        .withColumn("schema_version", F.lit(new_version))
        .withColumn("pairing_type", F.when(F.col("pairing_type") == "partially_shared", "same_unit").otherwise(F.col("pairing_type")))
        .drop("_n")
    )
    places = observations.select(*keys, F.col("obs_ord").alias("_ordinal"))
    members = tables["memberships"].join(places, keys).drop("obs_ord").withColumnRenamed("_ordinal", "obs_ord")
    return {
        "datasets": datasets,
        "observations": observations.select(*tables["observations"].columns),
        "memberships": members.select(*tables["memberships"].columns),
        "entries": tables["entries"].join(kept, keys, "left_semi"),
        "removed": flags.where("NOT kept").select(*keys),
    }


def migration_findings(tables: Tables, new_version: str) -> DataFrame:
    """What is wrong with migrated tables: ``dataset_id, code, severity``; the gate before they are published."""
    keys = ["dataset_id", "obs_id"]

    def finding(rows: DataFrame, code: str, severity: str = "error") -> DataFrame:
        return rows.select("dataset_id").distinct().select("dataset_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"))

    datasets, observations = tables["datasets"], tables["observations"]
    held = observations.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("obs_ord").alias("_low"), F.max("obs_ord").alias("_high"), F.countDistinct("obs_ord").alias("_places")
    )
    counted = datasets.join(held, "dataset_id", "left")
    gaps = (F.col("_low") != 0) | (F.col("_high") != F.col("_n") - 1) | (F.col("_places") != F.col("_n"))
    # Entries of one observation lie together, so few rows of them move.
    rows = tables["entries"].select(*keys, "modality").distinct()
    found = [
        finding(paired_members(tables["memberships"]).where("NOT kept"), "unpaired_modalities"),
        finding(counted.where(F.coalesce("_n", F.lit(0)) == 0), "empty_observations"),
        finding(counted.where(F.coalesce("_n", F.lit(0)) != F.col("n_obs")), "observation_count_mismatch"),
        finding(counted.where(gaps), "observation_order_gap"),
        finding(datasets.where(~F.col("schema_version").eqNullSafe(F.lit(new_version))), "schema_version_mismatch"),
        finding(datasets.where("pairing_type = 'partially_shared'"), "pairing_type_mismatch"),
        finding(rows.join(tables["memberships"].select(*keys, "modality"), [*keys, "modality"], "left_anti"), "unknown_entry"),
        finding(observations.join(tables["removed"], keys, "left_semi"), "removed_observation_present"),
    ]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def publish_migration(spark: SparkSession, root: str, tables: Tables, new_version: str, versions: tuple[str, ...]) -> Publication:
    """Migrate all datasets and publish them as one generation with the report of the change.

    Datasets of a version outside ``versions`` are refused before anything is written.
    """
    strange = tables["datasets"].where(~F.col("schema_version").isin(*versions) | F.col("schema_version").isNull())
    names = [r.dataset_id for r in strange.select("dataset_id").limit(20).collect()]
    if names:
        raise ValueError(f"datasets of another schema version: {', '.join(names)}")
    after = migrated(tables, new_version)
    change = tables["datasets"].select("dataset_id", F.struct("n_obs", "schema_version", "pairing_type").alias("old")).join(
        after["datasets"].select("dataset_id", F.struct("n_obs", "schema_version", "pairing_type").alias("new")), "dataset_id"
    )
    gone = after["removed"].groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_removed"))
    report = change.join(gone, "dataset_id", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    publication = Publication(spark, root)
    publication.publish({**after, "report": report}, lambda staged: migration_findings(staged, new_version), {"entries": ["modality"]})
    return publication
