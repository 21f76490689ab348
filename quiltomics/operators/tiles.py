"""Rectangles of samples as a table of tiles, so that points find them by an equi-join on the tile.

A sample's grid is laid over its rectangles.  Its fineness is the largest of ``FINENESS`` for which all its
rectangles together cover at most ``COVER`` tiles each on average (and ``LEAST`` in all): one rectangle gets
thousands of tiles, so a sample that holds most rows is dealt to many tasks, and ten thousand rectangles
get fine tiles, so a point meets the few whose edges cross its tile.  A tile that lies wholly in a
rectangle is one row without edges, whatever else covers it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINENESS = (16, 32, 64, 128, 256, 512, 1024)
COVER = 16
LEAST = 4096

_EDGES = ("x_min", "x_max", "y_min", "y_max")


def _sound(regions: DataFrame) -> DataFrame:
    """Rectangles that can hold a point: no missing edge, no edge that is not a number, not inside out."""
    ok = F.col("sample_id").isNotNull()
    for edge in _EDGES:
        ok = ok & F.col(edge).isNotNull() & ~F.isnan(edge)
    ok = ok & (F.col("x_min") <= F.col("x_max")) & (F.col("y_min") <= F.col("y_max"))
    return regions.select("sample_id", *[F.col(e).cast("double").alias(e) for e in _EDGES]).where(ok)


def _index(value: Column, low: Column, high: Column, fineness: Column) -> Column:
    """Tile of a coordinate along one axis; -1 and ``fineness`` stand for all that lies outside. Never falls as values rise."""
    size = F.when(high > low, (high - low) / fineness).otherwise(F.lit(1.0))
    place = F.least(fineness.cast("double"), F.greatest(F.lit(-1.0), F.floor((value - low) / size).cast("double")))
    return F.when(~F.isnan(value), place.cast("int"))


def grids(regions: DataFrame) -> DataFrame:
    """One row for each sample with rectangles: bounds of the finite edges and the grid's fineness."""
    finite = {e: F.when(F.abs(e) < F.lit(float("inf")), F.col(e)) for e in _EDGES}
    sample = Window.partitionBy("sample_id")
    low, high = ({a: (F.least if f is F.min else F.greatest)(*[f(finite[f"{a}_{e}"]).over(sample) for e in ("min", "max")]) for a in "xy"} for f in (F.min, F.max))
    # One shuffle by sample: bounds beside every rectangle, then sums over the rectangles.
    bounds = _sound(regions).withColumns(
        {f"g{a}{n}": F.coalesce(edge[a], F.lit(0.0)) for n, edge in enumerate((low, high)) for a in "xy"}
        | {"rectangles": F.count(F.lit(1)).over(sample)}
    )

    bounds = bounds.withColumn("fineness", F.explode(F.array(*[F.lit(g) for g in FINENESS])))
    grid = ["sample_id", "gx0", "gx1", "gy0", "gy1"]

    def across(axis: str) -> Column:
        ends = [_index(F.col(f"{axis}_{end}"), F.col(f"g{axis}0"), F.col(f"g{axis}1"), F.col("fineness")) for end in ("min", "max")]
        return (ends[1] - ends[0] + 1).cast("double")

    covered = bounds.groupBy(*grid, "rectangles", "fineness").agg(F.sum(across("x") * across("y")).alias("tiles"))
    fits = F.col("tiles") <= F.greatest(F.lit(LEAST), F.col("rectangles") * COVER)
    return covered.groupBy(*grid).agg(F.coalesce(F.max(F.when(fits, F.col("fineness"))), F.lit(FINENESS[0])).alias("fineness"))


def _range(low: str, high: str) -> Column:
    return F.explode(F.sequence(F.col(low), F.col(high)))


def tile_table(regions: DataFrame, laid: DataFrame) -> DataFrame:
    """``_tile_sample, _tx, _ty, _x0, _x1, _y0, _y1``: edges of the rectangles that cross a tile, infinite ones where one holds it."""
    g = F.col("fineness")
    placed = _sound(regions).join(laid, "sample_id").select(
        "sample_id", *_EDGES,
        *[_index(F.col(f"{axis}_{end}"), F.col(f"g{axis}0"), F.col(f"g{axis}1"), g).alias(f"_{axis}{end}") for axis in "xy" for end in ("min", "max")],
    )
    tiles = placed.withColumn("_tx", _range("_xmin", "_xmax")).withColumn("_ty", _range("_ymin", "_ymax"))
    # Strictly between the tiles of its edges, a tile has no point outside the rectangle.
    whole = (
        (F.col("_tx") > F.col("_xmin")) & (F.col("_tx") < F.col("_xmax")) & (F.col("_ty") > F.col("_ymin")) & (F.col("_ty") < F.col("_ymax"))
    )
    keys = ["sample_id", "_tx", "_ty"]
    # One shuffle by tile: a tile that is held keeps no edges.
    held = F.bool_or(whole).over(Window.partitionBy(*keys))
    open_edge = {e: F.lit(float("-inf") if e.endswith("min") else float("inf")) for e in _EDGES}
    every = (
        tiles.withColumn("_held", held)
        .select(*keys, *[F.when(F.col("_held"), open_edge[e]).otherwise(F.col(e)).alias(e) for e in _EDGES])
        .distinct()
    )
    names = {"sample_id": "_tile_sample", "x_min": "_x0", "x_max": "_x1", "y_min": "_y0", "y_max": "_y1"}
    return every.withColumnsRenamed(names)


def tiled(points: DataFrame, laid: DataFrame) -> DataFrame:
    """Points with the tile ``_px, _py`` of their sample's grid; null where the sample has no rectangles."""
    grid = laid.withColumnsRenamed({c: f"_grid_{c}" for c in laid.columns})
    g = F.col("_grid_fineness")
    joined = points.join(grid, F.col("sample_id") == F.col("_grid_sample_id"), "left")
    return joined.withColumns(
        {f"_p{axis}": _index(F.col(axis).cast("double"), F.col(f"_grid_g{axis}0"), F.col(f"_grid_g{axis}1"), g) for axis in "xy"}
    ).drop(*grid.columns)


def inside(point: Mapping[str, Column] | None = None) -> Column:
    """Join condition of tiled points (their columns by default) and the tile table."""
    at = point or {c: F.col(c) for c in ("sample_id", "_px", "_py", "x", "y")}
    return (
        (at["sample_id"] == F.col("_tile_sample"))
        & (at["_px"] == F.col("_tx"))
        & (at["_py"] == F.col("_ty"))
        & at["x"].between(F.col("_x0"), F.col("_x1"))
        & at["y"].between(F.col("_y0"), F.col("_y1"))
    )
