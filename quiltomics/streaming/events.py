"""Event counters as Structured Streaming jobs.

Each job reads the event log as a file stream, keeps its state in Spark's store under
the shared checkpoint folder and drains what is there with ``availableNow``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiltomics.operators.events import METRICS, _metric_columns, known_events, observable, truncated
from quiltomics.session import scratch_path
from quiltomics.sources.bindings import shape_events
from quiltomics.streaming.sessions import RETENTION_DAYS, current_sessions, session_rows, write_batch

__all__ = ["append_events", "current_sessions", "drain", "event_stream", "first_visits", "run", "session_upserts", "upsert_daily"]

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """The event log as a stream of files, in the event log's columns."""
    raw = (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", 64)
        .parquet(folder)
    )
    return shape_events(raw).withColumn("event_time", F.col("occurred_at").cast("timestamp"))


def drain(writer) -> StreamingQuery:  # noqa: ANN001
    """Run a stream over everything available and wait for it."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_events(events: DataFrame, out: str, checkpoint: str) -> None:
    """Append-only log, partitioned by day and batch; late events are kept here.

    Only responses below 400 and events of the vocabulary are stored, in columns of bounded length.  A replayed
    batch replaces its own partitions, and whole days can be dropped, since no file list is kept beside the files.
    """
    known, _unknown = known_events(observable(events))

    def store(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "batch")
            .parquet(out)
        )

    drain(
        truncated(known).withColumn("day", F.to_date("occurred_at"))
        .drop("event_time")
        .writeStream.outputMode("append")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
    )


def upsert_daily(events: DataFrame, out: str, checkpoint: str) -> None:
    """Daily counters: changed days replace their partition, so a replayed batch is harmless."""
    known, _unknown = known_events(observable(events))
    daily = (
        known.withWatermark("event_time", "1 day")
        .groupBy(F.window("event_time", "1 day").alias("w"))
        .agg(*_metric_columns())
        .select(F.to_date("w.start").alias("day"), *METRICS[1:])
    )

    def replace_days(batch: DataFrame, _batch_id: int) -> None:
        (
            batch.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(out)
        )

    drain(
        daily.writeStream.outputMode("update")
        .foreachBatch(replace_days)
        .option("checkpointLocation", checkpoint)
    )


def session_upserts(events: DataFrame, out: str, checkpoint: str, retention_days: int = RETENTION_DAYS, lateness: str = "60 days") -> StreamingQuery:
    """Sessions as keyed state that ends at the retention limit; every batch writes the rows it changed."""
    rows = session_rows(events, retention_days, lateness)
    return drain(rows.writeStream.outputMode("update").foreachBatch(write_batch(out)).option("checkpointLocation", checkpoint))


def first_visits(events: DataFrame, out: str, checkpoint: str) -> None:
    """One row per session within the watermark: its first human event."""
    visits = (
        events.where(~F.col("automated"))
        .withWatermark("event_time", "60 days")
        .dropDuplicatesWithinWatermark(["session_id"])
        .select("session_id", "event_time")
    )
    drain(
        visits.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )


def run(spark: SparkSession, folder: str, job, pattern: str = "events*.parquet") -> str:  # noqa: ANN001
    """Run one of the jobs above over a folder; returns the folder it wrote."""
    out = scratch_path(spark, job.__name__)
    job(event_stream(spark, folder, pattern), f"{out}/data", f"{out}/state")
    return f"{out}/data"
