"""Statistics of sparse matrices in long form; absent entries are zeros.

``observations`` lists every row of the matrix, because a row without entries is
still a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltomics.operators.ordering import (
    cumulative_histogram,
    histogram_quantiles,
    numbered,
    values_at_ranks,
)
from quiltomics.session import settled

#: Draws that are placed at a time.
_DRAWS = 1 << 20

# The depth quantiles the summary reports.
DEPTH_QUANTILES = {
    "q01": 0.01,
    "q05": 0.05,
    "q10": 0.10,
    "q25": 0.25,
    "q50": 0.50,
    "q75": 0.75,
    "q90": 0.90,
    "q95": 0.95,
    "q99": 0.99,
}


def is_finite(value: str | Column) -> Column:
    """Neither NaN nor infinite."""
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    return ~F.isnan(number) & (F.abs(number) < float("inf"))


def row_totals(entries: DataFrame, observations: DataFrame) -> DataFrame:
    """Total per observation, zero for empty rows."""
    totals = entries.groupBy("obs_id").agg(F.sum("value").alias("total"))
    return (
        observations.select("obs_id")
        .join(totals, "obs_id", "left")
        .select("obs_id", F.coalesce("total", F.lit(0)).alias("total"))
    )


def row_validity(entries: DataFrame, observations: DataFrame, value_type: str = "counts") -> DataFrame:
    """``reason`` an observation is excluded (null if valid); the first reason wins."""
    finite = is_finite("value")
    facts = entries.groupBy("obs_id").agg(
        F.bool_or(~finite).alias("bad"),
        F.bool_or(F.when(finite, F.col("value") < 0)).alias("negative"),
        F.sum(F.when(finite, F.col("value"))).alias("total"),
    )
    reason = F.when(F.coalesce("bad", F.lit(False)), "non_finite")
    if value_type == "counts":
        reason = reason.when(F.coalesce("negative", F.lit(False)), "negative").when(
            F.coalesce("total", F.lit(0)) <= 0, "zero_total"
        )
    return (
        observations.select("obs_id")
        .join(facts, "obs_id", "left")
        .select("obs_id", reason.alias("reason"))
    )


def exclusion_counts(validity: DataFrame) -> DataFrame:
    """Observations per exclusion reason."""
    return validity.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def library_size_log1p(entries: DataFrame, target_sum: float = 10000.0) -> DataFrame:
    """``log1p(value * target_sum / row total)`` of every entry.

    One aggregate and one join on the observation, which share their partitioning.
    """
    totals = entries.groupBy("obs_id").agg(F.sum("value").alias("_total"))
    return (
        entries.join(totals, "obs_id")
        .withColumn("value", F.log1p(F.col("value") * (F.lit(target_sum) / F.col("_total"))))
        .drop("_total")
    )


def feature_variance(entries: DataFrame, n_obs: Column) -> DataFrame:
    """Population variance per feature over all ``n_obs`` rows, zeros included."""
    value = F.col("value").cast("double")
    return (
        entries.groupBy("feature_id")
        .agg(F.sum(value).alias("_s"), F.sum(value * value).alias("_ss"))
        .withColumn("mean", F.col("_s") / n_obs)
        .withColumn("variance", F.col("_ss") / n_obs - F.col("mean") * F.col("mean"))
        .select("feature_id", "mean", "variance")
    )


def high_variance_features(variances: DataFrame, k: int = 2000) -> DataFrame:
    """The ``k`` most variable features, ties by id; constant ones never qualify."""
    best = (
        variances.where(is_finite("variance") & (F.col("variance") > 0))
        .orderBy(F.desc("variance"), F.asc("feature_id"))
        .limit(k)
    )
    # At most k rows.
    order = Window.orderBy(F.desc("variance"), F.asc("feature_id"))
    return best.withColumn("position", F.row_number().over(order).cast("long"))


def integer_counts(entries: DataFrame, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Rounded non-zero counts, and the number of entries that are no counts."""
    value = F.col("value").cast("double")
    fits = is_finite("value") & (value >= 0) & (value < 2.0**63)
    whole = F.abs(value - F.rint(value)) <= tolerance
    rounded = (
        entries.where(fits & whole)
        .withColumn("value", F.rint(value).cast("long"))
        .where("value <> 0")
    )
    bad = entries.agg(
        F.count_if(~is_finite("value")).alias("n_non_finite"),
        F.count_if(is_finite("value") & (value < 0)).alias("n_negative"),
        F.count_if(fits & ~whole).alias("n_fractional"),
    )
    return rounded, bad


def modality_summary(memberships: DataFrame, features: DataFrame) -> DataFrame:
    """Observations and features per modality."""
    rows = memberships.groupBy("modality").agg(F.countDistinct("obs_id").alias("n_obs"))
    columns = features.groupBy("modality").agg(F.countDistinct("feature_id").alias("n_vars"))
    return rows.join(columns, "modality", "full_outer")


def pairing_type(memberships: DataFrame) -> DataFrame:
    """same_unit, partially_shared or unpaired per dataset."""
    per_obs = memberships.groupBy("dataset_id", "obs_id").agg(
        F.countDistinct("modality").alias("n")
    )
    k = memberships.groupBy("dataset_id").agg(F.countDistinct("modality").alias("k"))
    return (
        per_obs.groupBy("dataset_id")
        .agg(F.min("n").alias("low"), F.max("n").alias("high"))
        .join(k, "dataset_id")
        .select(
            "dataset_id",
            F.when(F.col("low") == F.col("k"), "same_unit")
            .when(F.col("high") >= 2, "partially_shared")
            .otherwise("unpaired")
            .alias("pairing_type"),
        )
    )


def depth_summary(totals: DataFrame, sample_size: int) -> DataFrame:
    """Counts, mean, quantiles and an even sample of the sorted positive depths, long form.

    All of it comes from the histogram of the depths, so the matrix is read once.
    """
    histogram = cumulative_histogram(totals, "total")
    empty = F.coalesce(F.sum(F.when(F.col("total") == 0, F.col("_n"))), F.lit(0))
    sizes = histogram.agg(
        F.sum("_n").alias("observation_count"),
        F.coalesce(F.sum(F.when(F.col("total") > 0, F.col("_n"))), F.lit(0)).alias("nonzero_observation_count"),
        empty.alias("zero_observation_count"),
        (F.sum(F.col("total") * F.col("_n")) / F.sum("_n")).alias("mean"),
    )
    names = ("observation_count", "nonzero_observation_count", "zero_observation_count", "mean")
    summary = sizes.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]
            )
        ).alias("p")
    ).select("p.name", "p.value")
    quantiles = histogram_quantiles(histogram, "total", DEPTH_QUANTILES)
    sample = sample_of_histogram(histogram, "total", sample_size).select(
        F.format_string("sample_%03d", F.col("pos")).alias("name"),
        F.col("depth").cast("double").alias("value"),
    )
    return summary.unionByName(
        quantiles.select("name", F.col("value").cast("double").alias("value"))
    ).unionByName(sample)


def sample_of_histogram(histogram: DataFrame, value: str, size: int) -> DataFrame:
    """``size`` evenly spaced members of the sorted positive values (half-even places)."""
    positive = F.col(value) > 0
    sizes = histogram.agg(
        F.coalesce(F.sum(F.when(positive, F.col("_n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~positive, F.col("_n"))), F.lit(0)).alias("lower"),
    )
    taken = F.least(F.col("n"), F.lit(size))
    step = F.when(taken > 1, (F.col("n") - 1) / (taken - 1)).otherwise(F.lit(0.0))
    ranks = (
        sizes.where("n > 0")
        .select("lower", step.alias("step"), F.explode(F.sequence(F.lit(0), (taken - 1).cast("int"))).alias("pos"))
        .select("pos", (F.col("lower") + F.rint(F.col("pos") * F.col("step")).cast("long")).alias("rank"))
    )
    return values_at_ranks(histogram, value, ranks).select("pos", F.col("value").alias("depth"))


def even_sample(totals: DataFrame, value: str, size: int) -> DataFrame:
    """Even sample of the positive values of a column."""
    return sample_of_histogram(cumulative_histogram(totals, value), value, size)


def cyclic_depths(totals: DataFrame, depths: DataFrame, order: str) -> DataFrame:
    """Depth request of the i-th observation, taken from the list in turn, and the applied depth.

    ``depths`` (``pos, depth``) is the bounded even sample; it travels as one array.
    """
    listed = depths.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "depth"))), lambda d: d["depth"]).alias("d")
    )
    placed = numbered(totals, [F.col(order)], name="ordinal").withColumn("_depths", listed.scalar())
    return (
        placed.withColumn(
            "requested",
            F.element_at("_depths", (F.pmod("ordinal", F.size("_depths")) + 1).cast("int")),
        )
        .withColumn("applied", F.least("total", "requested"))
        .drop("_depths")
    )


def gathered(entries: DataFrame) -> DataFrame:
    """One row per observation, written once: ``obs_id, total, cells`` (its features and counts).

    Whoever needs the totals reads that column alone, and a draw reads the cells; the matrix is shuffled once.
    """
    return settled(
        entries.groupBy("obs_id").agg(
            F.sum("value").alias("total"), F.array_sort(F.collect_list(F.struct("feature_id", F.col("value").cast("long").alias("value")))).alias("cells")
        ),
        "gathered",
    )


def _uniforms(seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each seed and place, by a mixing hash: the same in any batch and on any task."""
    with np.errstate(over="ignore"):
        v = seeds + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((v ^ (v >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def draw_counts(counts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Multinomial draws for many observations at once.

    ``counts`` are the cells of all observations one after the other, ``sizes`` says how many each has.  Every
    draw is a place on the running sum of the counts, so a whole batch is one search; an observation of which as much is
    wanted as it has keeps its counts.
    """
    sums = np.concatenate(([0], np.cumsum(counts)))
    ends = np.cumsum(sizes)
    base = sums[ends - sizes]
    total = sums[ends] - base
    whole = wanted >= total
    result = np.where(np.repeat(whole, sizes), counts, 0)
    draws = np.cumsum(np.where(whole, 0, np.maximum(wanted, 0)))
    for start in range(0, int(draws[-1]) if len(draws) else 0, _DRAWS):
        place = np.arange(start, min(start + _DRAWS, int(draws[-1])))
        row = np.searchsorted(draws, place, side="right")
        first = np.where(row > 0, draws[np.maximum(row - 1, 0)], 0)
        unit = np.minimum((_uniforms(seeds[row], place - first) * total[row]).astype(np.int64), total[row] - 1)
        result += np.bincount(np.searchsorted(sums, base[row] + unit, side="right") - 1, minlength=len(counts))
    return result


def downsample(entries: DataFrame, applied: DataFrame, seed: int) -> DataFrame:
    """Multinomial draw of ``applied`` counts per observation with its own proportions; counts are whole numbers.

    ``entries`` is the matrix, or its rows as ``gathered`` gives them.  Cells cross to Python in Arrow batches and
    come back as entries; draws are hashes of the observation, so a retried task draws the same counts.
    """
    rows = entries if "cells" in entries.columns else gathered(entries)
    asked = rows.join(applied.where("applied > 0").select("obs_id", F.col("applied").cast("long").alias("applied")), "obs_id")
    asked = asked.select("obs_id", "cells", "applied", F.xxhash64(F.lit(seed), "obs_id").alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            obs, cells, wanted, seeds = batch.columns
            sizes, flat = cells.value_lengths().to_numpy(), cells.flatten()
            counts = flat.field("value").to_numpy()
            drawn = draw_counts(counts, sizes, wanted.to_numpy(), seeds.to_numpy().astype(np.uint64))
            kept = drawn > 0
            owner = np.repeat(np.arange(len(sizes)), sizes)[kept]
            columns = [obs.take(pa.array(owner)), flat.field("feature_id").filter(pa.array(kept)), pa.array(drawn[kept])]
            yield pa.RecordBatch.from_arrays(columns, ["obs_id", "feature_id", "value"])

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    feature = rows.schema["cells"].dataType.elementType["feature_id"].dataType.simpleString()
    return asked.mapInArrow(run, f"obs_id {kinds['obs_id']}, feature_id {feature}, value bigint")
