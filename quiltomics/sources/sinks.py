"""Sinks: exports, reports, products and the published-status log."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltomics.operators.events import latest_status
from quiltomics.session import settled
from quiltomics.sources.store import Store

_BLOCK_BYTES = 1 << 20


def export_csv(events: DataFrame, path: str, order: Sequence[str]) -> None:
    """Ordered CSV parts; an existing export is not overwritten."""
    (
        events.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("errorifexists")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )


def export_jsonl(events: DataFrame, path: str, order: Sequence[str]) -> None:
    """Ordered JSON lines; an existing export is not overwritten."""
    events.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").json(path)


def write_report(report: DataFrame, path: str, force: bool = False) -> None:
    """Report as JSON; replaces an older one only if forced."""
    report.write.mode("overwrite" if force else "errorifexists").json(path)


def export_exchange(entries: DataFrame, observations: DataFrame, features: DataFrame, folder: str) -> None:
    """Counts as Matrix Market text with two axis tables.

    ``observations`` is ``obs_id, row_ord``; ``features`` is ``feature_id, feature_ord``;
    both ordinals are dense and start at zero.  Lines are placed by range, so the banner
    and the size line open the first part.
    """
    placed = entries.join(observations, "obs_id").join(features, "feature_id").select("row_ord", "feature_ord", "value")
    placed = settled(placed, "exchange-lines")  # read by the count, the bounds of the ranges and the sort
    sizes = placed.agg(F.count(F.lit(1)).alias("n"))
    rows = observations.agg(F.count(F.lit(1)).alias("n"))
    columns = features.agg(F.count(F.lit(1)).alias("n"))
    head = sizes.select(
        F.explode(
            F.array(
                F.struct(
                    F.lit(-2).cast("long").alias("a"),
                    F.lit(0).cast("long").alias("b"),
                    F.lit("%%MatrixMarket matrix coordinate integer general").alias("value"),
                ),
                F.struct(
                    F.lit(-1).cast("long").alias("a"),
                    F.lit(0).cast("long").alias("b"),
                    F.concat_ws(" ", rows.scalar(), columns.scalar(), F.col("n")).alias("value"),
                ),
            )
        ).alias("l")
    ).select("l.*")
    body = placed.select(
        F.col("row_ord").alias("a"),
        F.col("feature_ord").alias("b"),
        F.concat_ws(" ", F.col("row_ord") + 1, F.col("feature_ord") + 1, F.col("value")).alias("value"),
    )
    lines = head.unionByName(body).repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    lines.select("value").write.mode("errorifexists").text(f"{folder}/matrix.mtx")
    observations.select("row_ord", "obs_id").repartitionByRange("row_ord").sortWithinPartitions(
        "row_ord"
    ).write.mode("errorifexists").option("sep", "\t").csv(f"{folder}/observations.tsv")
    features.select("feature_ord", "feature_id").repartitionByRange("feature_ord").sortWithinPartitions(
        "feature_ord"
    ).write.mode("errorifexists").option("sep", "\t").csv(f"{folder}/genes.tsv")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Prediction table as TSV, missing values empty."""
    predictions.write.mode("errorifexists").option("sep", "\t").option("header", True).option(
        "nullValue", ""
    ).option("emptyValue", "").csv(path)


def write_split(products: DataFrame, problems: DataFrame, path: str) -> None:
    """Train and test in one write, after the checks; nothing is written if any fails."""
    first = problems.limit(1).collect()
    if first:
        raise ValueError(f"split product rejected: {first[0].asDict()}")
    products.write.mode("errorifexists").partitionBy("split_id", "side").parquet(path)


def publish_status(rows: DataFrame, path: str) -> None:
    """Append to the status log; generations are immutable, the log says which is current."""
    rows.write.mode("append").parquet(path)


def current_generation(log: DataFrame) -> DataFrame:
    """Current state per dataset and its generation while it is a success."""
    latest = latest_status(log)
    return latest.select(
        "dataset_id", "state", F.when(F.col("state") == "success", F.col("sequence")).alias("generation_id")
    )


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path as Spark lists it (not URL-encoded), and the place inside it."""
    scheme, authority, place = re.fullmatch(r"(?:([a-zA-Z][\w+.-]*):)?(//[^/]*)?(/.*)", path).groups()
    if scheme in (None, "file"):
        return pafs.LocalFileSystem(), place
    store, root = pafs.FileSystem.from_uri(f"{scheme}:{authority or '//'}/")
    return store, root.rstrip("/") + place


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path below the folder, size and SHA-256 of every file, of any size, empty ones included.

    Files are listed by the store; each task reads its files block by block.  Files whose name or folder begins with
    a dot or an underscore are bookkeeping and left out, as Spark's readers do.
    """
    listed = [(n, place, size) for n, place, size in Store(spark, path).files() if fnmatchcase(n.rsplit("/", 1)[-1], pattern)]
    files = spark.createDataFrame(listed, "name string, path string, length long")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for name, path, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, place = _store(path)
                state = hashlib.sha256()
                with store.open_input_stream(place) as stream:
                    while block := stream.read(_BLOCK_BYTES):
                        state.update(block)
                rows.append((name, size, state.hexdigest()))
            kinds = (pa.string(), pa.int64(), pa.string())
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["name", "size", "sha256"])

    return files.repartition("path").mapInArrow(digest, "name string, size long, sha256 string")


def manifest_differences(manifest: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Stored files whose size or checksum disagrees with the catalogue (``name, size, sha256``)."""
    left = manifest.select("name", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    problem = (
        F.when(F.col("_sha").isNull(), "missing_file")
        .when(F.col("sha256").isNull(), "unindexed_file")
        .when(F.col("size") != F.col("_size"), "size")
        .when(F.col("sha256") != F.col("_sha"), "checksum")
    )
    return left.join(catalogue, "name", "full_outer").select("name", problem.alias("problem")).where(
        "problem IS NOT NULL"
    )
