"""Event queries, batch and streaming."""

from datetime import date, datetime

from pyspark.sql import functions as F

from quiltomics.operators import events as E
from quiltomics.registry import query
from quiltomics.registry.views import using
from quiltomics.sources import bindings as B
from quiltomics.streaming import events as S
from quiltomics.streaming.sessions import retention_job

EVT = using("evt")
_DAILY = """vis AS (SELECT day, count(*) AS visits FROM (SELECT session_id, CAST(min(occurred_at) FILTER (NOT automated) AS DATE) AS day
      FROM evt GROUP BY session_id HAVING bool_or(NOT automated)) GROUP BY day),
    cnt AS (SELECT CAST(occurred_at AS DATE) AS day,
      count(*) FILTER (NOT automated AND event_type = 'page_view') AS page_views,
      count(*) FILTER (NOT automated AND event_type = 'catalogue_search') AS searches,
      count(*) FILTER (NOT automated AND event_type = 'database_detail_view') AS database_details,
      count(*) FILTER (NOT automated AND event_type = 'challenge_detail_view') AS challenge_details,
      count(*) FILTER (NOT automated AND event_type = 'download') AS downloads,
      count(*) FILTER (automated) AS automated_events FROM evt WHERE status_code < 400 AND event_type IS NOT NULL GROUP BY 1),
    daily AS (SELECT coalesce(cnt.day, vis.day) AS day, coalesce(visits, 0) AS visits, coalesce(page_views, 0) AS page_views,
      coalesce(searches, 0) AS searches, coalesce(database_details, 0) AS database_details, coalesce(challenge_details, 0) AS challenge_details,
      coalesce(downloads, 0) AS downloads, coalesce(automated_events, 0) AS automated_events
      FROM cnt FULL JOIN vis ON cnt.day = vis.day)"""
DAILY = using("evt", more=_DAILY)
START, END = date(2024, 1, 5), date(2024, 1, 20)
_SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in E.METRICS)


@query(
    "event_window",
    EVT
    + """SELECT id, session_id, event_type FROM evt WHERE occurred_at >= TIMESTAMP '2024-01-05 00:00:00'
      AND occurred_at < TIMESTAMP '2024-01-21 00:00:00'""",
)
def _(spark, d):
    return E.event_window(B.visit_events(spark, d), START, END).select("id", "session_id", "event_type")


@query("daily_between", DAILY + "SELECT * FROM daily WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def _(spark, d):
    return E.daily_between(E.daily_metrics(B.visit_events(spark, d)), START, END)


@query("daily_metrics", DAILY + "SELECT * FROM daily")
def _(spark, d):
    return E.daily_metrics(B.visit_events(spark, d))


@query("visits_per_day", DAILY + "SELECT * FROM vis")
def _(spark, d):
    return E.visits_per_day(B.visit_events(spark, d))


@query("lifetime_visits", DAILY + "SELECT CAST(coalesce(sum(visits), 0) AS BIGINT) AS lifetime_visits FROM daily")
def _(spark, d):
    return E.lifetime_visits(E.daily_metrics(B.visit_events(spark, d)))


@query(
    "summary_totals",
    DAILY
    + f"SELECT day, {_SUMS} FROM daily WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ROLLUP (day)",
)
def _(spark, d):
    return E.summary(E.daily_metrics(B.visit_events(spark, d)), START, END)


_AGENTS = ("Mozilla/5.0 Chrome/120", "Googlebot/2.1", "curl/8.0", "HeadlessChrome", "Safari/17")


def _with_agent(spark, d):
    k = F.col("marker") % 7
    agent = F.when(k == 0, None).when(k == 1, "")
    for i, name in enumerate(_AGENTS):
        agent = agent.when(k == i + 2, name)
    return B.visit_events(spark, d).withColumn("user_agent", agent)


@query(
    "bot_flag",
    EVT + "SELECT id, marker % 7 NOT IN (2, 6) AS automated FROM evt",
)
def _(spark, d):
    return _with_agent(spark, d).select("id", E.automated(F.col("user_agent")).alias("automated"))


@query(
    "event_domain_check",
    """SELECT event_id AS id, event_type IN ('page_view', 'download') AS known, event_type FROM
      (SELECT event_id, CASE event_type WHEN 'click' THEN 'page_view' WHEN 'purchase' THEN 'download' ELSE event_type END AS event_type FROM events)""",
)
def _(spark, d):
    raw = B.table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "click", "page_view")
        .when(F.col("event_type") == "purchase", "download")
        .otherwise(F.col("event_type"))
        .alias("event_type"),
    )
    known, rest = E.known_events(raw)
    return known.withColumn("known", F.lit(True)).unionByName(rest.withColumn("known", F.lit(False)))


@query(
    "event_truncate",
    """SELECT event_id AS id, left(repeat(event_type || '/', 60), 100) AS route_name, length(left(repeat(event_type || '/', 500), 2048)) AS path_length,
      round(greatest(0, value - 50), 6) AS duration_ms FROM events""",
)
def _(spark, d):
    raw = B.table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.repeat(F.concat("event_type", F.lit("/")), 60).alias("route_name"),
        F.repeat(F.concat("event_type", F.lit("/")), 500).alias("path"),
        (F.col("value") - 50).alias("duration_ms"),
    )
    return E.truncated(raw).select(
        "id", "route_name", F.length("path").cast("long").alias("path_length"), F.round("duration_ms", 6).alias("duration_ms")
    )


@query(
    "details_bound",
    """SELECT doc_id, least(20, 10 + doc_id % 25) AS n_keys, 105 > 100 AS long_key,
      CAST(sum(least(500, length(text))) AS BIGINT) AS n_characters FROM documents, (SELECT unnest(range(1, 41)) AS i)
      WHERE i <= least(20, 10 + doc_id % 25) GROUP BY doc_id""",
)
def _(spark, d):
    documents = B.table(spark, d, "documents").select("doc_id", "text")
    keys = F.transform(
        F.sequence(F.lit(1), (10 + F.col("doc_id") % 25).cast("int")),
        lambda i: F.concat(i.cast("string"), F.repeat(F.lit("k"), 110)),
    )
    details = F.map_from_arrays(keys, F.transform(keys, lambda _k: F.col("text")))
    bounded = documents.select("doc_id", E.bounded_details(details).alias("b"))
    lengths = F.transform("b", lambda e: F.length(e["value"]).cast("long"))
    return bounded.select(
        "doc_id",
        F.size("b").cast("long").alias("n_keys"),
        F.forall("b", lambda e: F.length(e["key"]) == 100).alias("long_key"),
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, v: a + v).alias("n_characters"),
    )


@query("observable_status", EVT + "SELECT id, status_code FROM evt WHERE status_code < 400")
def _(spark, d):
    return E.observable(B.visit_events(spark, d)).select("id", "status_code")


@query(
    "session_event_join",
    EVT + "SELECT id, session_id, 'orphan' AS side FROM evt WHERE session_id > 'u40' UNION ALL SELECT id, session_id, 'kept' FROM evt WHERE session_id <= 'u40'",
)
def _(spark, d):
    events = B.visit_events(spark, d)
    known = E.sessions(events).where("session_id <= 'u40'")
    lost = E.orphans(events, known).withColumn("side", F.lit("orphan"))
    kept = E.cascade(events, known).withColumn("side", F.lit("kept"))
    return lost.unionByName(kept).select("id", "session_id", "side")


@query("event_order", EVT + "SELECT id, event_type FROM evt ORDER BY occurred_at, id")
def _(spark, d):
    return E.ordered_events(B.visit_events(spark, d)).select("id", "event_type")


LOG = EVT.rstrip() + """, lg AS (SELECT session_id AS dataset_id, CASE WHEN event_type = 'challenge_detail_view' THEN 'failure' ELSE 'success' END AS state,
    occurred_at AS updated_at, id AS sequence FROM evt)
"""


def _status_log(spark, d):
    return B.visit_events(spark, d).select(
        F.col("session_id").alias("dataset_id"),
        F.when(F.col("event_type") == "challenge_detail_view", "failure").otherwise("success").alias("state"),
        F.col("occurred_at").alias("updated_at"),
        F.col("id").alias("sequence"),
    )


@query(
    "latest_status",
    LOG + "SELECT dataset_id, arg_max(state, (updated_at, sequence)) AS state, arg_max(sequence, (updated_at, sequence)) AS sequence FROM lg GROUP BY 1",
)
def _(spark, d):
    return E.latest_status(_status_log(spark, d)).select("dataset_id", "state", "sequence")


@query(
    "publish_generation",
    LOG
    + """SELECT dataset_id, arg_max(state, (updated_at, sequence)) AS state,
      CASE WHEN arg_max(state, (updated_at, sequence)) = 'success' THEN arg_max(sequence, (updated_at, sequence)) END AS generation_id FROM lg GROUP BY 1""",
)
def _(spark, d):
    from quiltomics.session import scratch_path
    from quiltomics.sources.sinks import current_generation, publish_status

    path = scratch_path(spark, "status")
    log = _status_log(spark, d)
    publish_status(log.where("sequence % 2 = 0"), path)
    publish_status(log.where("sequence % 2 = 1"), path)
    return current_generation(spark.read.parquet(path))


@query(
    "publish_failure",
    LOG
    + """SELECT dataset_id, count(*) FILTER (state = 'success') AS hidden_successes FROM lg GROUP BY 1
      HAVING arg_max(state, (updated_at, sequence)) = 'failure'""",
)
def _(spark, d):
    log = _status_log(spark, d)
    failed = E.latest_status(log).where("state = 'failure'").select("dataset_id")
    return log.join(failed, "dataset_id", "left_semi").groupBy("dataset_id").agg(
        F.count_if(F.col("state") == "success").alias("hidden_successes")
    )


@query(
    "retention_purge",
    EVT
    + """, s AS (SELECT session_id, max(occurred_at) AS last_seen FROM evt WHERE session_id <> 'u1' OR id < 500 GROUP BY 1)
      SELECT id, evt.session_id FROM evt JOIN s USING (session_id)
      WHERE occurred_at >= TIMESTAMP '2024-01-15 12:00:00' AND last_seen >= TIMESTAMP '2024-01-15 12:00:00'""",
)
def _(spark, d):
    events = B.visit_events(spark, d)
    seen = E.sessions(events.where("session_id <> 'u1' OR id < 500"))
    kept, _sessions = E.retained(events, seen, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return kept.select("id", "session_id")


@query(
    "stream_sessions",
    EVT
    + """SELECT session_id, epoch_us(min(occurred_at)) AS started_us, epoch_us(max(occurred_at)) AS seen_us,
      epoch_us(min(occurred_at) FILTER (NOT automated)) AS counted_us, bool_or(NOT automated) AS counted,
      arg_min(automated, (occurred_at, id)) AS initial_automated
      FROM evt GROUP BY session_id""",
)
def _(spark, d):
    rows = S.current_sessions(spark, S.run(spark, d, S.session_upserts))
    return rows.select(
        "session_id",
        F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("last_seen_at").alias("seen_us"),
        F.unix_micros("counted_at").alias("counted_us"),
        "counted",
        "initial_automated",
    )


@query(
    "retention_job",
    EVT
    + """, s AS (SELECT session_id, max(occurred_at) AS last_seen FROM evt GROUP BY 1)
      SELECT 'event' AS kind, CAST(id AS VARCHAR) AS key FROM evt JOIN s USING (session_id)
      WHERE status_code < 400 AND event_type IS NOT NULL
        AND occurred_at >= TIMESTAMP '2024-01-15 12:00:00' AND last_seen >= TIMESTAMP '2024-01-15 12:00:00'
      UNION ALL SELECT 'session', session_id FROM s WHERE last_seen >= TIMESTAMP '2024-01-15 12:00:00'""",
)
def _(spark, d):
    log, sessions = S.run(spark, d, S.append_events), S.run(spark, d, S.session_upserts)
    for _repeat in range(2):  # the second run of a day does nothing
        retention_job(spark, log, sessions, datetime(2024, 2, 14, 12), 30)
    events = spark.read.parquet(log).select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("key"))
    return events.unionByName(S.current_sessions(spark, sessions).select(F.lit("session").alias("kind"), F.col("session_id").alias("key")))


@query("stream_events", EVT + "SELECT id, session_id, event_type, status_code FROM evt WHERE status_code < 400 AND event_type IS NOT NULL")
def _(spark, d):
    return spark.read.parquet(S.run(spark, d, S.append_events)).select("id", "session_id", "event_type", "status_code")


@query("append_event", EVT + "SELECT CAST(occurred_at AS DATE) AS day, event_type, count(*) AS n FROM evt WHERE status_code < 400 AND event_type IS NOT NULL GROUP BY ALL")
def _(spark, d):
    stored = spark.read.parquet(S.run(spark, d, S.append_events))
    return stored.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_daily", DAILY + "SELECT day, page_views, searches, database_details, challenge_details, downloads, automated_events FROM cnt")
def _(spark, d):
    return spark.read.parquet(S.run(spark, d, S.upsert_daily)).select("day", *E.METRICS[1:])


@query(
    "stream_bot_split",
    DAILY
    + """SELECT CAST(sum(automated_events) AS BIGINT) AS automated_events,
      CAST(sum(page_views + searches + database_details + challenge_details + downloads) AS BIGINT) AS human_events FROM cnt""",
)
def _(spark, d):
    daily = spark.read.parquet(S.run(spark, d, S.upsert_daily))
    human = F.lit(0)
    for name in E.COUNTERS:
        human = human + F.col(name)
    return daily.agg(F.sum("automated_events").alias("automated_events"), F.sum(human).alias("human_events"))


@query("stream_total_visits", DAILY + "SELECT CAST(coalesce(sum(visits), 0) AS BIGINT) AS total_visits FROM vis")
def _(spark, d):
    rows = S.current_sessions(spark, S.run(spark, d, S.session_upserts))
    return rows.agg(F.count_if("counted").alias("total_visits"))


@query("stream_session_dedup", EVT + "SELECT DISTINCT session_id FROM evt WHERE NOT automated")
def _(spark, d):
    return spark.read.parquet(S.run(spark, d, S.first_visits)).select("session_id")


def _exported(spark, d):
    return E.export_columns(E.event_window(B.visit_events(spark, d), START, END))


_EXPORT = EVT + """SELECT id, left(strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f'), 23) || 'Z' AS occurred_at,
  session_id, event_type, route_name, path, details, ip_address, user_agent, referrer,
  CAST(status_code AS INTEGER) AS status_code, duration_ms, automated FROM evt
  WHERE occurred_at >= TIMESTAMP '2024-01-05 00:00:00' AND occurred_at < TIMESTAMP '2024-01-21 00:00:00'"""
_EXPORT_SCHEMA = (
    "id long, occurred_at string, session_id string, event_type string, route_name string, path string, details string, "
    "ip_address string, user_agent string, referrer string, status_code int, duration_ms double, automated boolean"
)


@query("sink_event_export_csv", _EXPORT)
def _(spark, d):
    from quiltomics.session import scratch_path
    from quiltomics.sources.sinks import export_csv

    path = scratch_path(spark, "events-csv")
    export_csv(_exported(spark, d), path, ["occurred_at", "id"])
    return spark.read.schema(_EXPORT_SCHEMA).option("header", True).option("escape", '"').csv(path)


@query("sink_event_export_jsonl", _EXPORT)
def _(spark, d):
    from quiltomics.session import scratch_path
    from quiltomics.sources.sinks import export_jsonl

    path = scratch_path(spark, "events-jsonl")
    export_jsonl(_exported(spark, d), path, ["occurred_at", "id"])
    return spark.read.schema(_EXPORT_SCHEMA).json(path)
