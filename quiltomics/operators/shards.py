"""Training samples as sparse shards on the sources' real feature axes, with random access by row number.

A sample keeps the features it has, as sorted indices and values for each modality; what a source measures
is one row per source and modality, never repeated in its samples.  Samples are stored in shards of
consecutive row numbers: the shard is a partition folder and rows are sorted inside, so a gather of a few
numbers reads the folders and the row groups they lie in.  Whoever needs dense vectors gets them a batch
at a time (``map_dense``); no dense row is stored or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltomics.operators.ordering import numbered
from quiltomics.operators.samples import gather_rows

#: Samples of one shard.
SHARD_ROWS = 100_000
#: Samples of a shard that one task writes together.
STRETCH = 20_000
#: Dense cells that a batch may have at a time.
CELLS = 1 << 22


def sparse_samples(
    observations: DataFrame,
    memberships: DataFrame,
    entries: DataFrame,
    modalities: Sequence[str],
    obs_columns: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """One row per observation: ``position`` (gapless, by ``obs_ord``), ``spatial``, and per modality ``<m>_present``, ``<m>_indices``, ``<m>_values``.

    ``entries`` is ``modality, obs_id, feature_ord, value``.  An observation that is not in a modality has no
    indices there, whatever the entries say.  Zeros are not stored.
    """
    kept = entries.where(F.col("value") != 0)
    # Observations alone are ranged; their rows are gathered by observation, each modality where its entries lie, and
    # never sorted or sampled.
    placed = numbered(observations, [F.col("obs_ord"), F.col("obs_id")], name="position")
    ranked = gather_rows(placed, memberships, list(modalities))
    for m in modalities:
        cell = F.struct(F.col("feature_ord").cast("int").alias("ord"), F.col("value").cast("double").alias("value"))
        cells = kept.where(F.col("modality") == m).groupBy("obs_id").agg(F.array_sort(F.collect_list(cell)).alias(f"_{m}"))
        ranked = ranked.join(cells, "obs_id", "left")

    def part(m: str, name: str, kind: str) -> Column:
        listed = F.when(F.col(f"{m}_present") & F.col(f"_{m}").isNotNull(), F.transform(f"_{m}", lambda c: c[name]))
        return F.coalesce(listed, F.array().cast(f"array<{kind}>"))

    return ranked.select(
        "position", "obs_id", "obs_ord", "source_dataset_id", *obs_columns, F.array("x", "y").alias("spatial"),
        *[
            c
            for m in modalities
            for c in (F.col(f"{m}_present"), part(m, "ord", "int").alias(f"{m}_indices"), part(m, "value", "double").alias(f"{m}_values"))
        ],
    )


def measured_features(mask: DataFrame) -> DataFrame:
    """``modality, source_id, n_features, measured``: per source the sorted ordinals it measures.

    ``mask`` is ``modality, source_id, feature_ord, measured``, of which rows that are not measured may be left
    out.  One axis is the largest group.
    """
    held = F.collect_list(F.when(F.col("measured"), F.col("feature_ord").cast("int")))
    return mask.groupBy("modality", "source_id").agg(F.count_if("measured").alias("n_features"), F.array_sort(held).alias("measured"))


def write_shards(samples: DataFrame, masks: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> None:
    """Store samples by shard, sorted by position, and the sources' measured features beside them."""
    sharded = samples.withColumn("shard", F.floor(F.col("position") / shard_rows).cast("long"))
    # Stretches of a shard are dealt whole; how many there are follows the rows, so nothing is sampled for bounds.
    stretch = F.floor(F.col("position") / min(shard_rows, STRETCH)).cast("long")
    placed = sharded.repartition("shard", stretch).sortWithinPartitions("shard", "position")
    placed.write.mode("errorifexists").partitionBy("shard").option("parquet.block.size", 8 << 20).parquet(f"{path}/samples")
    masks.write.mode("errorifexists").parquet(f"{path}/measured")


class SampleShards:
    """Stored samples with access by row number."""

    def __init__(self, spark: SparkSession, path: str, shard_rows: int = SHARD_ROWS) -> None:
        self.spark, self.path, self.shard_rows = spark, path, shard_rows
        self.samples = spark.read.parquet(f"{path}/samples")
        self.measured = spark.read.parquet(f"{path}/measured")

    def __len__(self) -> int:
        last = self.samples.agg(F.max("position")).first()[0]  # from the files' statistics or one narrow column
        return 0 if last is None else last + 1

    def gather(self, indices: Sequence[int]) -> DataFrame:
        """Samples of the given row numbers with their place ``at`` in the list; repeats and order are kept by ``at``.

        Negative numbers count from the end; others than whole numbers are refused, and so is what lies outside.
        """
        size = len(self)
        places = []
        for at, index in enumerate(indices):
            if isinstance(index, bool) or not isinstance(index, int | np.integer):
                raise TypeError("sample indices must be whole numbers")
            place = int(index) + size if index < 0 else int(index)
            if not 0 <= place < size:
                raise IndexError(f"sample index {index} out of range")
            places.append((at, place // self.shard_rows, place))
        wanted = sorted({p for _, _, p in places})
        # The list itself bounds what is pushed down and broadcast.
        listed = self.spark.createDataFrame(places, "at long, _shard long, _position long")
        near = self.samples.where(F.col("shard").isin(sorted({s for _, s, _ in places})) & F.col("position").isin(wanted))
        return near.join(F.broadcast(listed), F.col("position") == F.col("_position")).drop("_shard", "_position", "shard")

    def take(self, wanted: DataFrame) -> DataFrame:
        """Samples for a table of row numbers ``at, position``, of any size: shards that are not asked for are pruned."""
        asked = wanted.select("at", F.col("position").alias("_position"), F.floor(F.col("position") / self.shard_rows).cast("long").alias("_shard"))
        same = (F.col("shard") == F.col("_shard")) & (F.col("position") == F.col("_position"))
        return self.samples.join(asked, same).drop("_shard", "_position", "shard")


def complete_pairs(samples: DataFrame, measured: DataFrame, left: str, right: str, sizes: Mapping[str, int]) -> DataFrame:
    """Samples in both modalities; none at all if a source of theirs leaves a feature of either axis unmeasured.

    A source without a row in ``measured`` measures everything.
    """
    both = samples.where(F.col(f"{left}_present") & F.col(f"{right}_present"))
    short = F.lit(False)
    for m in (left, right):
        short = short | ((F.col("modality") == m) & (F.col("n_features") < sizes[m]))
    lacking = measured.where(short).select(F.col("source_id").alias("source_dataset_id")).distinct()
    refused = both.join(lacking, "source_dataset_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return both.where(refused.scalar() == 0)


def axis_sum(modality: str, size: int, change: Callable[[Column], Column]) -> Column:
    """Sum of a changed row over its whole axis of ``size`` features, as of its dense vector.

    ``change`` is applied to what is stored, and once to the zero that stands for all other features, so the work
    grows with what a sample has and not with the axis.
    """
    stored = F.aggregate(f"{modality}_values", F.lit(0.0), lambda total, v: total + change(v))
    return stored + change(F.lit(0.0)) * (F.lit(size) - F.size(f"{modality}_indices"))


def _dense(indices: pa.Array, values: pa.Array, size: int) -> np.ndarray:
    out = np.zeros((len(indices), size))
    rows = np.repeat(np.arange(len(indices)), indices.value_lengths().to_numpy())
    out[rows, indices.flatten().to_numpy()] = values.flatten().to_numpy()
    return out


def map_dense(
    samples: DataFrame, sizes: Mapping[str, int], keep: Sequence[str], function: Callable[[dict[str, np.ndarray]], dict[str, pa.Array]], schema: str
) -> DataFrame:
    """Apply a function to dense matrices of whole batches: modality -> rows x features, in; named columns, out.

    ``keep`` columns are passed through before the function's; batches are cut so that no matrix has over ``CELLS`` cells.
    """
    modalities = list(sizes)
    columns = [*keep, *[f"{m}_{part}" for m in modalities for part in ("indices", "values")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, CELLS // max(1, *sizes.values()))
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                found = {m: _dense(part.column(f"{m}_indices"), part.column(f"{m}_values"), sizes[m]) for m in modalities}
                made = function(found)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *made.values()], [*keep, *made])

    return samples.select(*columns).mapInArrow(run, schema)
