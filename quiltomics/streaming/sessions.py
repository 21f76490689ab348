"""Visitor sessions with an end: keyed state, expiry at the retention limit, compaction, the retention job.

A session's state is a handful of numbers.  Its timer stands at the last sight plus the retention; when the
watermark passes it, the session is written once more as ended and its state is dropped, so the state holds
the sessions of one retention period however long the stream runs.  Every batch writes the rows it changed
into a folder of its own (a replayed batch writes the same folder again).  Compaction folds finished batches
into one base, partitioned by the day of the last sight; ended sessions are left out of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quiltomics.session import settled
from quiltomics.sources.store import Store, finished_folders

RETENTION_DAYS = 90
_DAY_MS = 86_400_000
_FIELDS = ["started_us", "last_seen_us", "counted_us", "first_id", "initial_automated"]
_STATE = "started_us long, last_seen_us long, counted_us long, first_id long, initial_automated boolean"
_ROW = f"session_id string, {_STATE}, ended boolean"

State = tuple[int, int, int | None, int, bool]


def seen(state: State | None, hits: pd.DataFrame) -> State:
    """State after more hits (``us, id, automated``), in whatever order they come; repeats change nothing."""
    first = hits.loc[hits["us"] == hits["us"].min()].nsmallest(1, "id").iloc[0]
    human = hits.loc[~hits["automated"], "us"]
    counted = int(human.min()) if len(human) else None
    new: State = (int(first["us"]), int(hits["us"].max()), counted, int(first["id"]), bool(first["automated"]))
    if state is None:
        return new
    earlier = min(state, new, key=lambda s: (s[0], s[3]))
    counts = [c for c in (state[2], new[2]) if c is not None]
    return earlier[0], max(state[1], new[1]), min(counts, default=None), earlier[3], earlier[4]


def _tracked(retention_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(values: State, ended: bool) -> pd.DataFrame:
            frame = pd.DataFrame([(key[0], *values, ended)], columns=["session_id", *_FIELDS, "ended"])
            return frame.astype({"counted_us": "Int64"})

        if state.hasTimedOut:
            values = state.get
            state.remove()
            yield row(values, True)
            return
        values = state.getOption
        for hits in batches:
            if len(hits):
                values = seen(values, hits)
        limit = values[1] // 1000 + retention_ms
        if limit <= state.getCurrentWatermarkMs():
            # So late that the session has ended already.
            if state.exists:
                state.remove()
            yield row(values, True)
            return
        state.update(values)
        state.setTimeoutTimestamp(limit)
        yield row(values, False)

    return update


def session_rows(events: DataFrame, retention_days: int = RETENTION_DAYS, lateness: str = "60 days") -> DataFrame:
    """Changed and ended sessions of a stream of events with ``event_time``; hits later than ``lateness`` are dropped."""
    hits = events.where(F.col("session_id").isNotNull()).select(
        "session_id", "event_time", F.unix_micros("event_time").alias("us"), "id", "automated"
    )
    return (
        hits.withWatermark("event_time", lateness)
        .groupBy("session_id")
        .applyInPandasWithState(_tracked(retention_days * _DAY_MS), _ROW, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    )


def _shaped(rows: DataFrame) -> DataFrame:
    times = {"started_at": "started_us", "last_seen_at": "last_seen_us", "counted_at": "counted_us"}
    return rows.select(
        "session_id",
        *[F.timestamp_micros(us).alias(name) for name, us in times.items()],
        F.col("counted_us").isNotNull().alias("counted"),
        "initial_automated",
        "ended",
    )


def write_batch(out: str) -> Callable[[DataFrame, int], None]:
    """Sink of one batch: its own folder, overwritten by a replay."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        _shaped(batch).write.mode("overwrite").parquet(f"{out}/parts/batch={batch_id}")

    return keep


_SESSIONS = (
    "session_id string, started_at timestamp, last_seen_at timestamp, counted_at timestamp, counted boolean, "
    "initial_automated boolean, ended boolean"
)


def _state_of(store: Store) -> tuple[list[tuple[int, ...]], list[int], int]:
    """Bases (batch reached, revision), batches, and the batch that the newest base reaches (-1: none)."""
    bases = finished_folders(store, "base", "through")
    batches = [b for b, *_ in finished_folders(store, "parts", "batch")]
    return bases, batches, bases[-1][0] if bases else -1


def _base(key: tuple[int, ...]) -> str:
    return f"base/through={key[0]}.{key[1]}"


def current_sessions(spark: SparkSession, out: str) -> DataFrame:
    """Last written row of each session: the newest base, overlaid with the batches after it."""
    store = Store(spark, out)
    bases, batches, through = _state_of(store)
    reader = spark.read.schema(_SESSIONS)
    frames = [spark.createDataFrame([], f"{_SESSIONS}, _seq long")]
    if bases:
        frames.append(reader.parquet(store.path(_base(bases[-1]))).drop("day").withColumn("_seq", F.lit(through).cast("long")))
    later = [store.path(f"parts/batch={b}") for b in batches if b > through]
    if later:
        parts = spark.read.schema(f"{_SESSIONS}, batch long").option("basePath", store.path("parts")).parquet(*later)
        frames.append(parts.withColumnRenamed("batch", "_seq"))
    rows = reduce(DataFrame.unionByName, frames)
    names = [c for c in rows.columns if c not in ("session_id", "_seq")]
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*names), "_seq").alias("r")).select("session_id", "r.*")


def compact_sessions(spark: SparkSession, out: str, keep: Column | None = None) -> int:
    """Fold all finished batches into a new base by day and remove what it replaces; returns the batch it reaches.

    Ended sessions, and those for which ``keep`` does not hold, are left out.  The new base has a place of its
    own and counts once it is complete, so a job that dies half-way leaves the old one in force.
    """
    store = Store(spark, out)
    bases, batches, through = _state_of(store)
    reached = max([through, *batches])
    if reached < 0:
        return reached
    kept = current_sessions(spark, out).where("NOT ended")
    if keep is not None:
        kept = kept.where(keep)
    revision = bases[-1][1] + 1 if bases else 0
    by_day = kept.withColumn("day", F.to_date("last_seen_at")).repartition("day")
    by_day.write.mode("overwrite").partitionBy("day").parquet(store.path(_base((reached, revision))))
    for old in bases:
        store.delete(_base(old))
    for old in batches:
        store.delete(f"parts/batch={old}")
    return reached


def retention_job(spark: SparkSession, log: str, sessions: str, now: datetime, days: int) -> bool:
    """Once a day: drop what is older than ``days`` from the event log and the sessions; false if it was done that day.

    Whole days before the cutoff are dropped as partitions, the day of the cutoff is rewritten, and sessions
    last seen before it go and take their remaining events along.  Daily counters are not touched.  Every
    step may be repeated; the day's marker is set at the end, so a job that died runs again.
    """
    store = Store(spark, log)
    marker = f"_retention/{now.date().isoformat()}"
    if store.exists(marker):
        return False
    cutoff = now - timedelta(days=days)
    limit = F.lit(cutoff.isoformat(sep=" "))
    partitions = {n.split("=", 1)[1]: n for n in store.names() if n.startswith("day=")}
    for day, name in partitions.items():
        if day < cutoff.date().isoformat():
            store.delete(name)
    schema = spark.read.parquet(log).schema if any(d >= cutoff.date().isoformat() for d in partitions) else None
    if schema is not None:
        today = spark.read.schema(schema).parquet(log).where(F.col("day") == F.lit(cutoff.date()))
        _keep_rows(store, today, F.col("occurred_at") >= limit.cast("timestamp_ntz"))
        idle = current_sessions(spark, sessions).where(F.col("last_seen_at") < limit.cast("timestamp")).select("session_id")
        idle = settled(idle, "idle-sessions")
        events = spark.read.schema(schema).parquet(log)
        touched = [r["day"] for r in events.join(idle, "session_id", "left_semi").select("day").distinct().collect()]
        if touched:
            inside = events.where(F.col("day").isin(touched))
            _keep_rows(store, inside.join(idle.withColumn("_idle", F.lit(True)), "session_id", "left"), F.col("_idle").isNull())
    compact_sessions(spark, sessions, F.col("last_seen_at") >= limit.cast("timestamp"))
    return store.mark(marker)


def _keep_rows(store: Store, rows: DataFrame, keep: Column) -> None:
    """Keep some rows of whole partitions: those left without any are dropped, those that lose some are rewritten."""
    parts = [c for c in ("day", "batch") if c in rows.columns]
    name = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in parts])
    # One row for each partition of the days concerned.
    counts = rows.groupBy(name.alias("name")).agg(F.count_if(keep).alias("kept"), F.count(F.lit(1)).alias("all")).collect()
    changed = [r["name"] for r in counts if 0 < r["kept"] < r["all"]]
    if changed:
        # From a copy, since the partitions are read meanwhile.
        left = settled(rows.where(name.isin(changed) & keep).drop("_idle"), "retained")
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(store.root)
    for row in counts:
        if not row["kept"]:
            store.delete(row["name"])
