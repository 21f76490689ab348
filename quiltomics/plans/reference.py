"""Reference builders by method name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quiltomics.operators import matrix, reference


def normalised_reference(entries: DataFrame, selected: DataFrame) -> DataFrame:
    """Log-normalised counts of the training cells."""
    train = selected.where("partition = 'train'").selectExpr("cast(cell_id as string) as obs_id", "cell_type")
    return matrix.library_size_log1p(entries.join(train, "obs_id"))


def count_reference(entries: DataFrame, selected: DataFrame) -> DataFrame:
    """Raw counts of the training cells."""
    train = selected.where("partition = 'train'").selectExpr("cast(cell_id as string) as obs_id", "cell_type")
    rounded, _bad = matrix.integer_counts(entries)
    return rounded.join(train, "obs_id")


BUILDERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "singler": normalised_reference,
    "rctd": count_reference,
}


def build_reference(method: str, cells: DataFrame, entries: DataFrame, sampling: reference.Sampling) -> DataFrame:
    """Select the cells and build the reference of a registered method."""
    if method not in BUILDERS:
        raise ValueError(f"no reference builder for {method!r}")
    return BUILDERS[method](entries, reference.select_partitions(cells, sampling))
