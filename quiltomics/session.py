"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_BATCH_ROWS = "1000"
#: Rows that a task gets of a dealt table on average, at most.
TASK_ROWS = 1 << 19


def local_session(cores: str = "8", name: str = "quiltomics") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        folder = configured
    elif context.getCheckpointDir():
        folder = context.getCheckpointDir()
    elif context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="quiltomics-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read from there.

    Cuts the lineage like a checkpoint, but columnar: later readers take only the
    columns they need, and a lost executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows placed by keys, over as many tasks as their number asks for.

    Left to itself, adaptive execution gives each core one task until shuffled bytes reach its advisory size, and a
    task holds a row several times (sums, partial sums, sorts): its memory then grows with the table.
    """
    spark = df.sparkSession
    tasks = -(-rows // TASK_ROWS)
    if tasks <= spark.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    # Not below the usual number, so that other tables come to this placement and not it to theirs.
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


@contextmanager
def hash_joins(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, joins hash a side whose partitions are all small, where they would sort both."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors once per application, so that it need not be installed there.

    Also bounds the rows that a task hands to Python at a time, since whole texts travel in them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    # Spark's file server reads the archive while the application lives; it goes when the driver ends.
    folder = tempfile.mkdtemp(prefix="quiltomics-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "quiltomics.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
