"""Spatial and whole-source splits, their coordinates, identity and integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltomics.operators.matrix import is_finite
from quiltomics.operators.tiles import grids, inside, tile_table, tiled
from quiltomics.schema import HIERARCHY_COLUMNS
from quiltomics.session import dealt, settled

_CHUNK = 4096


def _joined(observations: DataFrame, regions: DataFrame, how: str) -> DataFrame:
    laid = settled(grids(regions), "grids")
    tiles = settled(tile_table(regions, laid), "tiles")
    return tiled(observations, laid).join(tiles, inside(), how).drop("_px", "_py")


def region_select(observations: DataFrame, regions: DataFrame) -> DataFrame:
    """Observations in any rectangle of their sample, each once; a rectangle's edges belong to it.

    Points and rectangles meet by the tiles of the sample's grid.  A rectangle with a missing edge or one that is
    not a number holds nothing, and a point without a coordinate lies in none.
    """
    return _joined(observations, regions, "left_semi")


def region_complement(observations: DataFrame, regions: DataFrame) -> DataFrame:
    """Everything the regions do not hold, also samples without regions."""
    return _joined(observations, regions, "left_anti")


def spatial_sides(observations: DataFrame, regions: DataFrame) -> DataFrame:
    """``side`` test inside the regions, train elsewhere; one pass over the observations."""
    laid = settled(grids(regions), "grids")
    tiles = settled(tile_table(regions, laid), "tiles")
    outer = {c: F.col(c).outer() for c in ("sample_id", "_px", "_py", "x", "y")}
    held = tiles.where(inside(outer)).exists()
    return (
        tiled(observations, laid)
        .withColumn("side", F.when(held, "test").otherwise("train"))
        .drop("_px", "_py")
    )


def coordinate_ranges(observations: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Size and coordinate range of each sample and of the whole, in one aggregate."""
    sets = [[F.col(g) for g in (*groups, "sample_id")], [F.col(g) for g in groups]]
    return observations.groupingSets(
        sets, *[F.col(g) for g in (*groups, "sample_id")]
    ).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
    )


def sample_bounds(observations: DataFrame) -> DataFrame:
    """Finite coordinate bounds per sample; samples without any get -1 to 1."""
    usable = is_finite("x") & is_finite("y")

    def edge(function, column: str, default: float) -> Column:
        return F.coalesce(function(F.when(usable, F.col(column))), F.lit(default))

    return observations.groupBy("sample_id").agg(
        edge(F.min, "x", -1.0).alias("x_min"),
        edge(F.max, "x", 1.0).alias("x_max"),
        edge(F.min, "y", -1.0).alias("y_min"),
        edge(F.max, "y", 1.0).alias("y_max"),
    )


def apply_coordinate_rule(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Coordinates as float32 by the rule of each source.

    ``rules`` is ``source_dataset_id, kind, x_column, y_column``; kind ``obsm`` keeps
    ``x, y``, kind ``obs_columns`` reads the named columns from ``attrs``.  Rules are one row
    per source and travel to the observations, which are not dealt by their few sources.
    """
    ruled = observations.join(F.broadcast(rules), "source_dataset_id")

    def pick(own: str, column: str) -> Column:
        named = F.try_element_at("attrs", F.col(column)).try_cast("double")
        return F.when(F.col("kind") == "obsm", F.col(own)).otherwise(named).cast("float")

    return ruled.withColumn("new_x", pick("x", "x_column")).withColumn("new_y", pick("y", "y_column"))


def coordinate_problems(placed: DataFrame) -> DataFrame:
    """Per source: non-finite coordinates and coordinates used more than once."""
    finite = is_finite("new_x") & is_finite("new_y")
    keys = ["source_dataset_id", "new_x", "new_y"]
    places = dealt(placed.select(*keys), placed.count(), *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ok = F.coalesce(finite, F.lit(False))
    return places.groupBy("source_dataset_id").agg(
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("n_non_finite"),
        F.coalesce(F.sum(F.when(ok & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("n_shared"),
    )


def compose_sources(observations: DataFrame) -> DataFrame:
    """Stack sources: ids become ``source::id``; labels stay only if every source has them."""
    complete = observations.agg(F.bool_and(F.col("cell_type").isNotNull()).alias("c"))
    return observations.select(
        F.concat_ws("::", "source_dataset_id", "obs_id").alias("obs_id"),
        F.concat_ws("::", "source_dataset_id", "sample_id").alias("sample_id"),
        "source_dataset_id",
        F.col("obs_id").alias("source_obs_id"),
        "x",
        "y",
        F.when(complete.scalar(), F.col("cell_type")).alias("cell_type"),
    )


def source_pairs_missing(derived: DataFrame, source: DataFrame) -> DataFrame:
    """Source pairs of a derived dataset that the source does not have."""
    return derived.select("source_dataset_id", "source_obs_id").join(
        source.select("source_dataset_id", F.col("obs_id").alias("source_obs_id")),
        ["source_dataset_id", "source_obs_id"],
        "left_anti",
    )


def overlapping_pairs(train: DataFrame, test: DataFrame) -> DataFrame:
    """Source pairs on both sides."""
    keys = ["source_dataset_id", "source_obs_id"]
    return train.select(*keys).join(test.select(*keys), keys, "left_semi").distinct()


def uncovered_pairs(train: DataFrame, test: DataFrame, source: DataFrame) -> DataFrame:
    """Pairs that train and test together miss or add."""
    keys = ["source_dataset_id", "source_obs_id"]
    covered = train.select(*keys).unionByName(test.select(*keys)).distinct().withColumn("_c", F.lit(1))
    wanted = source.select(*keys).distinct().withColumn("_w", F.lit(1))
    return (
        covered.join(wanted, keys, "full_outer")
        .where("_c IS NULL OR _w IS NULL")
        .select(*keys, F.when(F.col("_c").isNull(), "missing").otherwise("added").alias("difference"))
    )


def membership_differences(kept: DataFrame, source: DataFrame, derived: DataFrame) -> DataFrame:
    """Per modality, members lost or gained against the source among the kept observations."""
    expected = source.join(kept.select("obs_id"), "obs_id", "left_semi").select(
        "modality", "obs_id", F.lit(1).alias("_e")
    )
    actual = derived.select("modality", "obs_id", F.lit(1).alias("_a"))
    return (
        expected.join(actual, ["modality", "obs_id"], "full_outer")
        .where("_e IS NULL OR _a IS NULL")
        .select(
            "modality", "obs_id", F.when(F.col("_a").isNull(), "lost").otherwise("gained").alias("difference")
        )
    )


def trim_to_paired(memberships: DataFrame) -> DataFrame:
    """Observations in every modality of their dataset."""
    k = memberships.agg(F.countDistinct("modality").alias("k"))
    return (
        memberships.groupBy("obs_id")
        .agg(F.countDistinct("modality").alias("n"))
        .where(F.col("n") == k.scalar())
        .select("obs_id")
    )


def removed_observations(memberships: DataFrame) -> DataFrame:
    """Observations the trimming drops."""
    return memberships.select("obs_id").distinct().join(trim_to_paired(memberships), "obs_id", "left_anti")


def uncovered_observations(observations: DataFrame, memberships: DataFrame) -> DataFrame:
    """Observations in no modality, and members that are no observations."""
    ids = observations.select("obs_id", F.lit(1).alias("_o"))
    members = memberships.select("obs_id").distinct().withColumn("_m", F.lit(1))
    return (
        ids.join(members, "obs_id", "full_outer")
        .where("_o IS NULL OR _m IS NULL")
        .select(
            "obs_id",
            F.when(F.col("_m").isNull(), "unrepresented").otherwise("not_global").alias("problem"),
        )
    )


def sample_bijection(pairs: DataFrame) -> DataFrame:
    """Source samples with several derived ids, and derived ids with several source samples."""
    forward = (
        pairs.groupBy("source_dataset_id", "source_sample_id")
        .agg(F.countDistinct("sample_id").alias("n"))
        .select(
            F.lit("forward").alias("direction"),
            F.concat_ws("::", "source_dataset_id", "source_sample_id").alias("id"),
            "n",
        )
    )
    backward = (
        pairs.groupBy("sample_id")
        .agg(F.countDistinct("source_dataset_id", "source_sample_id").alias("n"))
        .select(F.lit("backward").alias("direction"), F.col("sample_id").alias("id"), "n")
    )
    return forward.unionByName(backward).where("n > 1")


def hierarchy_diagnostics(sides: DataFrame, columns: Sequence[str] = HIERARCHY_COLUMNS) -> DataFrame:
    """Per column: distinct values on each side, shared ones, and whether the sides are disjoint.

    Values are counted as rows, not collected.
    """
    present = [c for c in columns if c in sides.columns]
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in present]
        )
    )
    values = (
        sides.select("side", pairs.alias("p"))
        .groupBy("p.column", "p.value")
        .agg(
            F.max(F.when(F.col("side") == "train", 1).otherwise(0)).alias("a"),
            F.max(F.when(F.col("side") == "test", 1).otherwise(0)).alias("b"),
        )
    )
    return (
        values.groupBy("column")
        .agg(
            F.sum("a").alias("train_unique"),
            F.sum("b").alias("test_unique"),
            F.sum(F.col("a") * F.col("b")).alias("overlap"),
        )
        .withColumn(
            "domain_disjoint",
            (F.col("train_unique") > 0) & (F.col("test_unique") > 0) & (F.col("overlap") == 0),
        )
    )


def bounded_digest(df: DataFrame, groups: Sequence[str], order: Sequence[str], text: Column) -> DataFrame:
    """SHA-256 over the ordered texts of a bounded list (a sample or a feature axis).

    ``text`` is one item's bytes including its separators.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, text.alias("_text"))))
    joined = F.array_join(F.transform(items, lambda i: i["_text"]), "")
    return df.groupBy(*groups).agg(F.sha2(joined, 256).alias("digest"))


def order_digest(df: DataFrame, ordinal: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Digest of an observation order of any length, as a tree of chunk digests.

    A flat SHA-256 is one sequential pass; chunks of 4096 ids are digested in
    parallel, then the chunk digests, so no task sees more than 4096 items.
    """
    level = df.select(
        *groups, F.col(ordinal).alias("_ord"), F.concat(F.col(value), F.lit("\0")).alias("_text")
    )
    levels, rows = 4, df.count()
    while _CHUNK**levels < rows:  # whatever the number of rows, one chunk is left
        levels += 1
    for _ in range(levels):
        chunk = F.floor(F.col("_ord") / _CHUNK).cast("long").alias("_chunk")
        items = F.array_sort(F.collect_list(F.struct("_ord", "_text")))
        level = (
            level.groupBy(*groups, chunk)
            .agg(F.sha2(F.array_join(F.transform(items, lambda i: i["_text"]), ""), 256).alias("_text"))
            .withColumnRenamed("_chunk", "_ord")
        )
    return level.select(*groups, F.col("_text").alias("digest"))


def gather(observations: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows by requested index; duplicates and request order stay, negatives count from the end.

    ``observations`` carries the zero-based ``obs_ord``; ``requests`` is ``pos, index``.
    """
    size = observations.agg(F.count(F.lit(1)).alias("n"))
    wanted = (
        requests.withColumn("_n", size.scalar())
        .withColumn("obs_ord", F.when(F.col("index") < 0, F.col("index") + F.col("_n")).otherwise(F.col("index")))
        .withColumn("in_range", F.col("obs_ord").between(0, F.col("_n") - 1))
        .drop("_n")
    )
    return wanted.join(observations, "obs_ord", "left")


def first_appearance(observations: DataFrame, label: str = "label") -> DataFrame:
    """Category ids in the order in which the categories first appear."""
    # One row per category; a category id fits in 16 bits.
    firsts = observations.groupBy(label).agg(F.min("obs_ord").alias("first_ord"))
    return firsts.withColumn(
        "type_id", (F.row_number().over(Window.orderBy("first_ord")) - 1).cast("long")
    )
