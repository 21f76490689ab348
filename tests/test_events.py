"""Event counters in batch and as streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quiltomics.operators import events as E
from quiltomics.session import scratch_path
from quiltomics.sources import sinks
from quiltomics.streaming import events as S

DAY = dt.datetime(2024, 3, 1, 12)


def log(spark, rows):
    return spark.createDataFrame(
        rows, "id long, session_id string, occurred_at timestamp_ntz, event_type string, automated boolean, status_code int"
    )


def test_bot_then_human_counts_on_the_human_day(spark):
    events = log(
        spark,
        [
            (1, "s", DAY, "page_view", True, 200),
            (2, "s", DAY + dt.timedelta(days=1), "page_view", False, 200),
            (3, "s", DAY + dt.timedelta(days=1), "download", False, 404),
            (4, "bot", DAY, "page_view", True, 200),
        ],
    )
    daily = {r.day: r for r in E.daily_metrics(events).collect()}
    first, second = daily[DAY.date()], daily[DAY.date() + dt.timedelta(days=1)]
    assert (first.visits, first.automated_events, first.page_views) == (0, 2, 0)
    assert (second.visits, second.page_views, second.downloads) == (1, 1, 0)
    totals = E.summary(E.daily_metrics(events), DAY.date(), DAY.date()).where("day IS NULL").first()
    assert totals.automated_events == 2 and totals.visits == 0


def test_retention_keeps_daily_counters(spark):
    events = log(spark, [(1, "s", DAY, "page_view", False, 200)])
    now = F.lit((DAY + dt.timedelta(days=31)).isoformat()).cast("timestamp_ntz")
    kept, sessions = E.retained(events, E.sessions(events), now - F.make_dt_interval(F.lit(30)))
    assert kept.count() == 0 and sessions.count() == 0
    assert E.daily_metrics(events).count() == 1


def test_bot_agents(spark):
    agents = [None, "", "Googlebot", "Mozilla/5.0", "curl/8"]
    rows = spark.createDataFrame([(a,) for a in agents], "ua string")
    assert [r.a for r in rows.select(E.automated(F.col("ua")).alias("a")).collect()] == [True, True, True, False, True]


def test_failure_hides_success(spark):
    rows = spark.createDataFrame(
        [("d", "success", DAY, 1), ("d", "failure", DAY + dt.timedelta(hours=1), 2), ("e", "success", DAY, 3)],
        "dataset_id string, state string, updated_at timestamp_ntz, sequence long",
    )
    current = {r.dataset_id: r for r in sinks.current_generation(rows).collect()}
    assert current["d"].generation_id is None and current["e"].generation_id == 3


@pytest.fixture
def files(spark):
    """Raw events in three files that arrive one after the other."""
    folder = scratch_path(spark, "raw")
    rows = [
        (i, DAY + dt.timedelta(hours=6 * i), i % 3, ["click", "view", "purchase"][i % 3], 1.0, '{"k": %d}' % (5 if i % 4 == 0 else 50))
        for i in range(30)
    ]
    raw = spark.createDataFrame(rows, S.EVENT_SCHEMA)
    for part in range(3):
        raw.where(F.floor(F.col("event_id") / 10) == part).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_streams_agree_with_batch(spark, files):
    from quiltomics.sources.bindings import shape_events

    batch = shape_events(spark.read.schema(S.EVENT_SCHEMA).parquet(files))
    expected = {r.day: tuple(r[m] for m in E.METRICS[1:]) for r in E.daily_metrics(batch).collect()}
    out = scratch_path(spark, "daily")

    def run(job, name):
        stream = S.event_stream(spark, files, "*.parquet")
        job(stream, f"{out}/{name}", f"{out}/{name}-state")
        return f"{out}/{name}"

    daily = spark.read.parquet(run(S.upsert_daily, "d"))
    assert {r.day: tuple(r[m] for m in E.METRICS[1:]) for r in daily.collect()} == {
        d: v for d, v in expected.items() if any(v)
    }
    # A second run over the same state finds nothing new and changes nothing.
    run(S.upsert_daily, "d")
    assert spark.read.parquet(f"{out}/d").count() == daily.count()
    sessions = S.current_sessions(spark, run(S.session_upserts, "s"))
    assert sessions.count() == 3 and sessions.where("counted").count() == 3
    # Two of the thirty are 404 responses.
    assert spark.read.parquet(run(S.append_events, "e")).count() == 28
    assert spark.read.parquet(run(S.first_visits, "v")).count() == 3


def test_export_refuses_to_overwrite(spark):
    path = scratch_path(spark, "export")
    rows = spark.range(3).withColumn("occurred_at", F.lit("x"))
    sinks.export_csv(rows, path, ["id"])
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.export_csv(rows, path, ["id"])
