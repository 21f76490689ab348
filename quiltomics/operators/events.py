"""Visitor events: recording rules, daily counters, retention, status logs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltomics.schema import AUTOMATION_PATTERN, EVENT_METRICS

COUNTERS = tuple(EVENT_METRICS.values())
METRICS = ("visits", *COUNTERS, "automated_events")


def automated(user_agent: Column) -> Column:
    """No user agent, or one that names an automaton."""
    return user_agent.isNull() | (user_agent == "") | F.rlike(user_agent, F.lit(AUTOMATION_PATTERN))


def observable(events: DataFrame) -> DataFrame:
    """Only responses below 400 are recorded."""
    return events.where(F.col("status_code") < 400)


def known_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of the vocabulary, and the quarantined rest."""
    known = F.coalesce(F.col("event_type").isin(*EVENT_METRICS), F.lit(False))
    return events.where(known), events.where(~known)


def truncated(events: DataFrame) -> DataFrame:
    """Columns cut to their stored length; a negative duration becomes zero."""
    limits = {"route_name": 100, "path": 2048, "ip_address": 45, "user_agent": 1024, "referrer": 2048}
    result = events
    for name, limit in limits.items():
        if name in events.columns:
            result = result.withColumn(name, F.substring(name, 1, limit))
    return result.withColumn("duration_ms", F.greatest(F.lit(0), F.col("duration_ms")))


def bounded_details(details: Column) -> Column:
    """First 20 keys in stored order, keys cut to 100 and values to 500 characters."""
    first = F.slice(F.map_entries(details), 1, 20)
    cut = F.transform(
        first,
        lambda e: F.struct(F.substring(e["key"], 1, 100).alias("key"), F.substring(e["value"], 1, 500).alias("value")),
    )
    return cut


def event_window(events: DataFrame, start: date, end: date) -> DataFrame:
    """Events from the first instant of ``start`` to the last of ``end``."""
    low = F.lit(start.isoformat()).cast("timestamp_ntz")
    high = F.date_add(F.lit(end.isoformat()).cast("date"), 1).cast("timestamp_ntz")
    return events.where((F.col("occurred_at") >= low) & (F.col("occurred_at") < high))


def _metric_columns() -> list[Column]:
    human = ~F.col("automated")
    counters = [
        F.count_if(human & (F.col("event_type") == event)).alias(name)
        for event, name in EVENT_METRICS.items()
    ]
    return [*counters, F.count_if(F.col("automated")).alias("automated_events")]


def sessions(events: DataFrame) -> DataFrame:
    """First and last sight of each session, and when its first human hit was."""
    human = F.when(~F.col("automated"), F.col("occurred_at"))
    return events.groupBy("session_id").agg(
        F.min("occurred_at").alias("started_at"),
        F.max("occurred_at").alias("last_seen_at"),
        F.min(human).alias("counted_at"),
        F.bool_or(~F.col("automated")).alias("counted"),
        F.min_by("automated", F.struct("occurred_at", "id")).alias("initial_automated"),
    )


def visits_per_day(events: DataFrame) -> DataFrame:
    """Every session once, on the day of its first human hit."""
    return (
        sessions(events)
        .where("counted")
        .groupBy(F.to_date("counted_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("visits"))
    )


def daily_metrics(events: DataFrame) -> DataFrame:
    """Visits, event counters and automated events per day; automated rows count only there.

    A hit opens its session even if the response is too bad to be recorded; an event of an unknown type is
    refused before any counter, an automated one too.
    """
    known, _unknown = known_events(observable(events))
    counted = known.groupBy(F.to_date("occurred_at").alias("day")).agg(*_metric_columns())
    return (
        counted.join(visits_per_day(events), "day", "full_outer")
        .select("day", *[F.coalesce(m, F.lit(0)).alias(m) for m in METRICS])
    )


def daily_between(daily: DataFrame, start: date, end: date) -> DataFrame:
    """Inclusive range of days."""
    return daily.where(
        F.col("day").between(F.lit(start.isoformat()).cast("date"), F.lit(end.isoformat()).cast("date"))
    )


def summary(daily: DataFrame, start: date, end: date) -> DataFrame:
    """Daily rows of the range and, under a null day, their totals."""
    return daily_between(daily, start, end).rollup("day").agg(*[F.sum(m).alias(m) for m in METRICS])


def lifetime_visits(daily: DataFrame) -> DataFrame:
    """All visits so far; zero without any day."""
    return daily.agg(F.coalesce(F.sum("visits"), F.lit(0)).alias("lifetime_visits"))


def orphans(events: DataFrame, known_sessions: DataFrame) -> DataFrame:
    """Events of unknown sessions."""
    return events.join(known_sessions.select("session_id"), "session_id", "left_anti")


def cascade(events: DataFrame, kept_sessions: DataFrame) -> DataFrame:
    """Events that survive the removal of sessions."""
    return events.join(kept_sessions.select("session_id"), "session_id", "left_semi")


def retained(events: DataFrame, visit_sessions: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Events and sessions after the retention purge; daily counters are not touched.

    Old events go first, then idle sessions take their remaining events along.
    """
    kept_sessions = visit_sessions.where(F.col("last_seen_at") >= cutoff)
    return cascade(events.where(F.col("occurred_at") >= cutoff), kept_sessions), kept_sessions


def ordered_events(events: DataFrame) -> DataFrame:
    """Export order."""
    return events.orderBy("occurred_at", "id")


def export_columns(events: DataFrame) -> DataFrame:
    """Export fields with the time as ISO text in milliseconds."""
    return events.select(
        "id",
        iso_millis(F.col("occurred_at")).alias("occurred_at"),
        "session_id",
        "event_type",
        "route_name",
        "path",
        "details",
        "ip_address",
        "user_agent",
        "referrer",
        "status_code",
        "duration_ms",
        "automated",
    )


def iso_millis(instant: Column) -> Column:
    """ISO 8601 in milliseconds with a trailing Z."""
    return F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def latest_status(log: DataFrame, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Current record per dataset: the last one; a failure hides an older success."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", "sequence")).alias("_r")
    return log.groupBy(*keys).agg(newest).select(*keys, "_r.*")
