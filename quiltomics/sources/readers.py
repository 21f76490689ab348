"""Readers: long tables, sparse exchange folders, prediction tables, metadata documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_SCHEMA = (
    "observation_id string, label string, ontology_id string, status string, confidence double, "
    "best_score double, second_score double, delta double, pruned_label string"
)
METADATA_SCHEMA = (
    "database struct<schema_version:string, dataset_id:string, dataset_type:string, source:string, "
    "organism:string, tissue:string, spatial_unit:string, coordinate_unit:string, pairing_type:string>, "
    "sample_ids array<string>, title string, description string, keywords array<string>"
)


def scan_matrix(observations: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per observation with its coordinates and the size of its matrix row."""
    rows = entries.groupBy("obs_id").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum("value").alias("total")
    )
    return (
        observations.join(rows, "obs_id", "left")
        .withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))
        .withColumn("total", F.coalesce("total", F.lit(0)))
    )


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their place: file, start of the split, line number inside the task.

    Splits are dealt to tasks by size, so a task's number says nothing about the place in the file.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return spark.read.text(path).select("value", place.alias("_at"))


def scan_exchange(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a Matrix Market folder with their observation and gene ids.

    The size line is the first line after the banner that is no comment.  A folder whose size line, axis tables and
    entries disagree is refused: the joins would drop or repeat entries unseen.
    """
    lines = _placed_lines(spark, f"{folder}/matrix.mtx").where(F.trim("value") != "")
    banner = lines.where(F.startswith(F.col("value"), F.lit("%%MatrixMarket"))).agg(F.min("_at").alias("b"))
    plain = lines.where(~F.startswith(F.col("value"), F.lit("%")))
    size_at = plain.withColumn("_b", banner.scalar()).where("_at > _b").agg(F.min("_at").alias("s"))
    parts = F.split("value", " ")
    numbers = (
        plain.withColumn("_s", size_at.scalar())
        .where("_at <> _s")
        .select(
            (parts[0].cast("long") - 1).alias("row_ord"),
            (parts[1].cast("long") - 1).alias("feature_ord"),
            parts[2].cast("double").alias("value"),
        )
    )
    axis = "row_ord long, observation_id string"
    observations = spark.read.schema(axis).option("sep", "\t").csv(f"{folder}/observations.tsv")
    genes = spark.read.schema("feature_ord long, gene_id string").option("sep", "\t").csv(f"{folder}/genes.tsv")
    _require_dimensions(exchange_sizes(spark, folder), numbers, observations, genes)
    return numbers.join(observations, "row_ord").join(genes, "feature_ord").select(
        "row_ord", "feature_ord", F.col("observation_id").alias("obs_id"), F.col("gene_id").alias("feature_id"), "value"
    )


def _require_dimensions(sizes: DataFrame, entries: DataFrame, observations: DataFrame, genes: DataFrame) -> None:
    """Refuse entries that the size line does not count or the axes do not hold, and axes that are not 0 to n - 1."""
    size = sizes.first()
    declared = (size.declared_rows, size.declared_columns, size.declared_entries)
    if None in declared:
        raise ValueError("Matrix Market file has no size line")
    if declared[:2] != (size.n_rows, size.n_columns):
        raise ValueError(f"Matrix Market dimensions {declared[:2]} do not match the axis tables ({size.n_rows}, {size.n_columns})")

    def outside(ordinal: str, n: int) -> Column:
        return ~F.coalesce(F.col(ordinal).between(0, n - 1), F.lit(False))

    lost = outside("row_ord", declared[0]) | outside("feature_ord", declared[1])
    found = entries.agg(F.count(F.lit(1)).alias("n"), F.count_if(lost).alias("lost")).first()
    if found.n != declared[2]:
        raise ValueError(f"Matrix Market file declares {declared[2]} entries and has {found.n}")
    if found.lost:
        raise ValueError(f"{found.lost} Matrix Market entries lie outside the declared dimensions")
    for axis, ordinal, n in ((observations, "row_ord", declared[0]), (genes, "feature_ord", declared[1])):
        held = axis.agg(F.countDistinct(ordinal).alias("n"), F.count_if(outside(ordinal, n)).alias("lost")).first()
        if held.lost or held.n != n:
            raise ValueError(f"ordinals {ordinal} are not each of 0 to {n - 1} once")


def exchange_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Declared matrix size against the two axis files."""
    lines = _placed_lines(spark, f"{folder}/matrix.mtx")
    banner = lines.where(F.startswith(F.col("value"), F.lit("%%MatrixMarket"))).agg(F.min("_at").alias("b"))
    declared = (
        lines.where(~F.startswith(F.col("value"), F.lit("%")))
        .withColumn("_b", banner.scalar())
        .where("_at > _b")
        .agg(F.min_by("value", "_at").alias("size"))
        .withColumn("s", F.split("size", " "))
    )
    rows = spark.read.text(f"{folder}/observations.tsv").agg(F.count(F.lit(1)).alias("n"))
    columns = spark.read.text(f"{folder}/genes.tsv").agg(F.count(F.lit(1)).alias("n"))
    return declared.select(
        F.col("s")[0].cast("long").alias("declared_rows"),
        F.col("s")[1].cast("long").alias("declared_columns"),
        F.col("s")[2].cast("long").alias("declared_entries"),
        rows.scalar().alias("n_rows"),
        columns.scalar().alias("n_columns"),
    )


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction table with its required columns; empty fields are missing values."""
    return (
        spark.read.schema(PREDICTION_SCHEMA)
        .option("sep", "\t")
        .option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", "")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def scan_cells(
    cells: DataFrame, predicate: str, columns: Sequence[str], ids: DataFrame | None = None
) -> DataFrame:
    """Reference cells by predicate, column list and, if given, a set of ids."""
    chosen = cells.where(F.expr(predicate))
    if ids is not None:
        chosen = chosen.join(ids.select("cell_id"), "cell_id", "left_semi")
    return chosen.select(*columns)


def scan_documents(raw: DataFrame, column: str) -> DataFrame:
    """Metadata documents (JSON text) as typed columns; ``broken`` marks unreadable ones."""
    parsed = F.from_json(column, METADATA_SCHEMA, {"mode": "PERMISSIVE"})
    return raw.withColumn("document", parsed).withColumn(
        "broken", F.col("document").isNull() | F.col("document.database").isNull()
    )
