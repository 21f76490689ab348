"""Sessions as keyed state, their end, compaction, and retention as a job."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quiltomics.operators import events as E
from quiltomics.session import scratch_path
from quiltomics.sources.store import Store
from quiltomics.streaming import events as S
from quiltomics.streaming.sessions import compact_sessions, current_sessions, retention_job

START = dt.datetime(2024, 3, 1, 12)
SCHEMA = "id long, session_id string, occurred_at timestamp_ntz, event_type string, automated boolean, status_code int, path string, duration_ms double"


def hit(i, session, days, automated=False, kind="page_view"):
    return (i, session, START + dt.timedelta(days=days), kind, automated, 200, "/", 1.0)


class Log:
    """A folder of event files and the session stream over it."""

    def __init__(self, spark, retention_days=30, lateness="2 days"):
        self.spark, self.folder = spark, scratch_path(spark, "hits")
        self.out, self.state = scratch_path(spark, "sessions"), scratch_path(spark, "state")
        self.options = {"retention_days": retention_days, "lateness": lateness}
        self.rows = []

    def add(self, *rows):
        self.rows += rows
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        stream = self.spark.readStream.schema(SCHEMA).parquet(self.folder).withColumn("event_time", F.col("occurred_at").cast("timestamp"))
        return S.session_upserts(stream, self.out, self.state, **self.options)

    def sessions(self):
        return {r.session_id: r for r in current_sessions(self.spark, self.out).collect()}


def naive(value):
    return value if value is None else value.replace(tzinfo=None)


def test_late_and_repeated_hits_and_a_restart(spark):
    log = Log(spark, retention_days=60, lateness="20 days")
    rng = random.Random(2)
    rows = [hit(i, f"s{rng.randrange(9)}", rng.randrange(10), rng.random() < 0.6) for i in range(120)]
    log.add(*rows[:50])
    log.add(*rows[30:90])  # repeats, and hits before those of the first batch; each call restarts the stream
    log.add(*rows[90:], hit(500, None, 1))
    got = log.sessions()
    batch = {r.session_id: r for r in E.sessions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == batch.keys()
    for name, want in batch.items():
        row = got[name]
        assert (naive(row.started_at), naive(row.last_seen_at), naive(row.counted_at)) == (want.started_at, want.last_seen_at, want.counted_at)
        assert (row.counted, row.initial_automated, row.ended) == (want.counted, want.initial_automated, False)


def test_a_bot_session_flips_to_counted_once(spark):
    log = Log(spark)
    log.add(hit(1, "s", 0, True))
    assert not log.sessions()["s"].counted
    log.add(hit(2, "s", 1))
    log.add(hit(3, "s", 1.5, True))
    row = log.sessions()["s"]
    assert row.counted and row.initial_automated and naive(row.counted_at) == START + dt.timedelta(days=1)


def test_state_is_dropped_at_the_retention_limit(spark):
    log = Log(spark, retention_days=30)
    log.add(*[hit(i, f"old{i}", 0) for i in range(40)])
    query = log.add(*[hit(100 + i, f"new{i}", 50) for i in range(3)])
    # The batch after the watermark has passed ends the old sessions: three are left in the state.
    log.add(hit(200, "new0", 50.5))
    query = log.add(hit(201, "new1", 50.6))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    got = log.sessions()
    assert {n for n, r in got.items() if r.ended} == {f"old{i}" for i in range(40)}
    # A session that comes back after its end is a new one.
    log.add(hit(300, "old7", 51, True))
    back = log.sessions()["old7"]
    assert not back.ended and naive(back.started_at) == START + dt.timedelta(days=51) and not back.counted


def test_compaction_keeps_the_current_rows_by_day(spark):
    log = Log(spark)
    log.add(hit(1, "a", 0), hit(2, "b", 1))
    log.add(hit(3, "a", 2))
    before = log.sessions()
    reached = compact_sessions(spark, log.out)
    assert log.sessions() == before
    store = Store(spark, log.out)
    assert store.names("parts") == []
    [base] = store.names("base")
    days = [n for n in store.names(f"base/{base}") if n.startswith("day=")]
    assert days == ["day=2024-03-02", "day=2024-03-03"]
    assert compact_sessions(spark, log.out) == reached and log.sessions() == before
    log.add(hit(4, "b", 4))
    after = log.sessions()
    assert naive(after["b"].last_seen_at) == START + dt.timedelta(days=4) and after["a"] == before["a"]
    assert compact_sessions(spark, log.out) > reached and log.sessions() == after


@pytest.fixture
def kept_log(spark):
    log = Log(spark, retention_days=365)
    log.add(*[hit(i, f"s{i % 4}", i % 40) for i in range(80)], hit(900, "idle", 3, True))
    path = scratch_path(spark, "log")
    # An event that its session does not know of yet: the cascade takes it.
    rows = [*log.rows, hit(901, "idle", 39)]
    spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("occurred_at")).write.partitionBy("day").parquet(path)
    return log, path, rows


def test_retention_job_drops_days_and_cascades(spark, kept_log):
    log, path, rows = kept_log
    daily = E.daily_metrics(spark.createDataFrame(rows, SCHEMA)).count()
    now = START + dt.timedelta(days=40, hours=6)
    cutoff = now - dt.timedelta(days=30)
    assert retention_job(spark, path, log.out, now, 30)
    left = {r.id for r in spark.read.parquet(path).collect()}
    assert left == {r[0] for r in rows if r[2] >= cutoff and r[1] != "idle"}
    assert set(log.sessions()) == {"s0", "s1", "s2", "s3"}
    assert daily == E.daily_metrics(spark.createDataFrame(rows, SCHEMA)).count()
    # The second run of the day does nothing, even with a later cutoff; the next day's run does.
    assert not retention_job(spark, path, log.out, now + dt.timedelta(hours=5), 1)
    assert {r.id for r in spark.read.parquet(path).collect()} == left
    assert retention_job(spark, path, log.out, now + dt.timedelta(days=300), 30)
    assert not [n for n in Store(spark, path).names() if n.startswith("day=")] and log.sessions() == {}


def test_retention_job_that_died_runs_again(spark, kept_log, monkeypatch):
    log, path, rows = kept_log
    from quiltomics.streaming import sessions as module

    def dies(*_):
        raise RuntimeError("lost")

    now = START + dt.timedelta(days=40, hours=6)
    with monkeypatch.context() as patch:
        patch.setattr(module, "compact_sessions", dies)
        with pytest.raises(RuntimeError):
            retention_job(spark, path, log.out, now, 30)
    assert retention_job(spark, path, log.out, now, 30)
    assert {r.id for r in spark.read.parquet(path).collect()} == {r[0] for r in rows if r[2] >= now - dt.timedelta(days=30) and r[1] != "idle"}


def test_unknown_types_are_refused_before_any_counter(spark):
    rows = [hit(1, "s", 0), hit(2, "s", 0, True, None), hit(3, "s", 0, True, "other"), hit(4, "s", 0, True)]
    row = E.daily_metrics(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.automated_events, row.page_views) == (1, 1)
