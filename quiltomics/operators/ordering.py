"""Exact ranks, ordinals and quantiles that never sort one group in one task.

A window over a whole table (or over a group that holds a third of it) runs in a
single task.  The functions here place rows with a range shuffle instead, so any
group, and any run of equal values, is spread over many tasks; only one row per
task is combined afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltomics.session import settled

_ROW_BITS = 33


def _place(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Range-partition and sort; add the task number and the row number inside it.

    The bounds of a range shuffle come from a sample.  The result is settled so that
    the totals and the rows read the same placement.
    """
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return settled(
        placed.withColumn("_part", F.shiftright("_id", _ROW_BITS))
        .withColumn("_row", F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_id"),
        "placed",
    )


def _same(left: str, names: Sequence[str], right: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def numbered(
    df: DataFrame, order: Sequence[Column], groups: Sequence[str] = (), name: str = "ordinal"
) -> DataFrame:
    """Zero-based position of each row in its group, for a total order."""
    placed = _place(df, [F.col(g) for g in groups] + list(order))
    # One row per task of the range shuffle: at most the number of shuffle partitions.
    tasks = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    result = (
        placed.join(F.broadcast(tasks), "_part")
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_part", "_row", "_before")
    )
    if not groups:
        return result
    starts = result.groupBy(*groups).agg(F.min(name).alias("_start"))
    return (
        result.alias("a")
        .join(starts.alias("b"), _same("a", groups, "b"))
        .select("a.*", (F.col(f"a.{name}") - F.col("_start")).alias("_position"))
        .drop(name)
        .withColumnRenamed("_position", name)
    )


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: Sequence[str], groups: Sequence[str] = ()
) -> DataFrame:
    """Add ``before_<t>``: the sum of integer column ``t`` over earlier rows of the group."""
    placed = _place(df, [F.col(g) for g in groups] + list(order))
    tasks = placed.groupBy("_part").agg(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(
        "_part",
        *[
            F.coalesce(F.sum(f"_sum_{t}").over(before), F.lit(0)).alias(f"_before_{t}")
            for t in totals
        ],
    )
    # One range-shuffle task's rows per window group.
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    result = placed.join(F.broadcast(tasks), "_part")
    for t in totals:
        result = result.withColumn(
            f"before_{t}",
            F.col(f"_before_{t}") + F.coalesce(F.sum(t).over(inside), F.lit(0)),
        )
    result = result.drop("_part", "_row", *[f"_before_{t}" for t in totals])
    if not groups:
        return result
    starts = result.groupBy(*groups).agg(
        *[F.min(f"before_{t}").alias(f"_start_{t}") for t in totals]
    )
    kept = [F.col(f"a.{c}") for c in df.columns]
    return (
        result.alias("a")
        .join(starts.alias("b"), _same("a", groups, "b"))
        .select(
            *kept,
            *[(F.col(f"a.before_{t}") - F.col(f"_start_{t}")).alias(f"before_{t}") for t in totals],
        )
    )


def value_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: count, ``min_rank`` and ``avg_rank`` (one-based, ties averaged)."""
    histogram = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_equal"))
    ranked = running_totals(histogram, [F.col(value)], ["n_equal"], groups)
    return ranked.select(
        *groups,
        value,
        "n_equal",
        (F.col("before_n_equal") + 1).alias("min_rank"),
        (F.col("before_n_equal") + (F.col("n_equal") + 1) / 2).alias("avg_rank"),
    )


def cumulative_histogram(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Per distinct non-null value its count ``_n`` and the count ``before__n`` of smaller ones.

    One pass over the data; everything about ranks and quantiles follows from this table.
    """
    histogram = (
        df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    return running_totals(histogram, [F.col(value)], ["_n"], groups)


def values_at_ranks(
    histogram: DataFrame, value: str, ranks: DataFrame, groups: Sequence[str] = ()
) -> DataFrame:
    """Values at given zero-based ranks of a cumulative histogram.

    ``ranks`` holds ``groups``, any label columns and ``rank``: a few rows per group,
    which travel as one array, so a value looks only at its own group's ranks.
    """
    labels = [c for c in ranks.columns if c not in groups]
    packed = ranks.groupBy(*groups).agg(F.collect_list(F.struct(*labels)).alias("_ranks"))
    if groups:
        joined = histogram.alias("v").join(packed.alias("r"), _same("v", groups, "r")).select("v.*", "_ranks")
    else:
        joined = histogram.withColumn("_ranks", packed.scalar())
    first, last = F.col("before__n"), F.col("before__n") + F.col("_n")
    hits = F.filter("_ranks", lambda r: (r["rank"] >= first) & (r["rank"] < last))
    return joined.select(*groups, F.col(value).alias("value"), F.explode(hits).alias("_hit")).select(
        *groups, *[F.col(f"_hit.{c}").alias(c) for c in labels], "value"
    )


def _targets(histogram: DataFrame, fractions: dict[str, float], groups: Sequence[str]) -> DataFrame:
    wanted = F.explode(
        F.array(*[F.struct(F.lit(k).alias("name"), F.lit(f).alias("f")) for k, f in fractions.items()])
    )
    return (
        histogram.groupBy(*groups)
        .agg(F.sum("_n").alias("n"))
        .where("n > 0")
        .select(*groups, "n", wanted.alias("w"))
        .select(*groups, F.col("w.name").alias("name"), (F.col("w.f") * (F.col("n") - 1)).alias("_place"))
    )


def histogram_quantiles(
    histogram: DataFrame, value: str, fractions: dict[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """Type 7 quantiles of a cumulative histogram: linear between neighbouring ranks."""
    ends = F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))).alias("rank")
    targets = _targets(histogram, fractions, groups).select(*groups, "name", "_place", ends)
    found = values_at_ranks(histogram, value, targets, groups)
    low, high = F.min("value"), F.max("value")
    weight = F.first("_place") - F.floor(F.first("_place"))
    return found.groupBy(*groups, "name").agg((low + (high - low) * weight).alias("value"))


def linear_quantiles(
    df: DataFrame, value: str, fractions: dict[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """Type 7 quantiles of a column."""
    return histogram_quantiles(cumulative_histogram(df, value, groups), value, fractions, groups)


def nearest_quantiles(
    df: DataFrame, value: str, fractions: dict[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """Sorted value at the half-even rounded place ``f * (n - 1)``."""
    histogram = cumulative_histogram(df, value, groups)
    targets = _targets(histogram, fractions, groups).select(
        *groups, "name", F.rint("_place").cast("long").alias("rank")
    )
    return values_at_ranks(histogram, value, targets, groups).select(*groups, "name", "value")


def rank_by_hash(
    df: DataFrame, hash_column: str, groups: Sequence[str], name: str = "rank", limit: Column | None = None
) -> DataFrame:
    """One-based rank by a hex digest inside each group.

    The first four hex digits cut a group of any size into 65 536 even slices; only
    slice counts are accumulated per group.  With ``limit``, slices that begin behind it
    go before anything is ranked.
    """
    sliced = df.withColumn("_slice", F.substring(hash_column, 1, 4))
    counts = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # At most 65 536 slice counts per group.
    earlier = (
        Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    keys = [*groups, "_slice"]
    inside = Window.partitionBy(*keys).orderBy(hash_column)
    joined = (
        sliced.alias("a").join(counts.alias("b"), _same("a", keys, "b")).select("a.*", "_before")
    )
    if limit is not None:
        joined = joined.where(F.col("_before") < limit)
    return joined.withColumn(
        name, (F.col("_before") + F.row_number().over(inside)).cast("long")
    ).drop("_slice", "_before")


def smallest_by_hash(df: DataFrame, hash_column: str, groups: Sequence[str], limit: Column) -> DataFrame:
    """Rows whose digest is among the ``limit`` smallest of their group."""
    return rank_by_hash(df, hash_column, groups, "_rank", limit).where(F.col("_rank") <= limit).drop("_rank")


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group; Spark's group limit cuts every task's rows down before they meet."""
    final = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("position", F.row_number().over(final)).where(F.col("position") <= n)
