"""Challenge score queries."""

from pyspark.sql import functions as F

from quiltomics.operators import catalogue as C
from quiltomics.operators import scoring as K
from quiltomics.registry import query
from quiltomics.registry.views import using
from quiltomics.sources import bindings as B

MEANS = using(
    "scores",
    more="""means AS (SELECT split_id, any_value(challenge_type) AS challenge_type, round(avg(auroc), 2) AS mean_auroc
      FROM scores GROUP BY split_id),
    ranked AS (SELECT *, rank() OVER (ORDER BY mean_auroc) AS difficulty_rank,
      100 * (rank() OVER (ORDER BY mean_auroc) + (count(*) OVER (PARTITION BY mean_auroc) - 1) / 2 - 1) / (count(*) OVER () - 1) AS pct,
      CASE WHEN count(*) OVER (PARTITION BY challenge_type) < 2 THEN 0 ELSE
        100 * (rank() OVER (PARTITION BY challenge_type ORDER BY mean_auroc)
        + (count(*) OVER (PARTITION BY challenge_type, mean_auroc) - 1) / 2 - 1) / (count(*) OVER (PARTITION BY challenge_type) - 1) END AS cpct,
      count(*) OVER (PARTITION BY challenge_type) AS category_size FROM means),
    rr AS (SELECT *, rank() OVER (PARTITION BY repeat ORDER BY auroc)
        + (count(*) OVER (PARTITION BY repeat, auroc) - 1) / 2 AS ar, count(*) OVER (PARTITION BY repeat) AS n FROM scores)""",
)


def _means(spark, d):
    return (
        B.challenge_scores(spark, d)
        .groupBy("split_id")
        .agg(F.max("challenge_type").alias("challenge_type"), F.round(F.avg("auroc"), 2).alias("mean_auroc"))
    )


@query("difficulty_rank", MEANS + "SELECT split_id, mean_auroc, difficulty_rank FROM ranked")
def _(spark, d):
    return K.challenge_rankings(_means(spark, d)).select("split_id", "mean_auroc", "difficulty_rank")


@query("difficulty_percentile", MEANS + "SELECT split_id, round(pct, 6) AS percentile FROM ranked")
def _(spark, d):
    return K.challenge_rankings(_means(spark, d)).select(
        "split_id", F.round("difficulty_percentile", 6).alias("percentile")
    )


@query(
    "category_percentile",
    MEANS
    + """SELECT split_id, challenge_type, round(cpct, 6) AS percentile, category_size, category_size < 5 AS small FROM ranked""",
)
def _(spark, d):
    return K.challenge_rankings(_means(spark, d)).select(
        "split_id",
        "challenge_type",
        F.round("same_category_percentile", 6).alias("percentile"),
        "category_size",
        (F.col("category_size") < 5).alias("small"),
    )


@query(
    "repeat_percentile_std",
    MEANS
    + """SELECT split_id, round(stddev_pop(100 * (ar - 1) / (n - 1)), 6) AS repeat_percentile_std FROM rr GROUP BY split_id""",
)
def _(spark, d):
    return K.repeat_percentile_std(B.challenge_scores(spark, d)).withColumn(
        "repeat_percentile_std", F.round("repeat_percentile_std", 6)
    )


_PAIRS = """SELECT a.repeat AS "left", b.repeat AS "right", corr(a.ar, b.ar) AS spearman FROM rr a JOIN rr b
      ON a.split_id = b.split_id AND a.repeat < b.repeat GROUP BY ALL"""


@query(
    "pairwise_spearman",
    MEANS + 'SELECT "left", "right", round(spearman, 6) AS spearman FROM (' + _PAIRS + ")",
)
def _(spark, d):
    return K.pairwise_spearman(B.challenge_scores(spark, d)).withColumn("spearman", F.round("spearman", 6))


@query(
    "ranking_stability",
    MEANS
    + """SELECT count(*) AS pairwise_spearman_count, round(avg(spearman), 6) AS mean_pairwise_spearman,
      round(min(spearman), 6) AS minimum_pairwise_spearman FROM ("""
    + _PAIRS
    + ")",
)
def _(spark, d):
    stable = K.ranking_stability(K.pairwise_spearman(B.challenge_scores(spark, d)))
    return stable.select(
        "pairwise_spearman_count",
        F.round("mean_pairwise_spearman", 6).alias("mean_pairwise_spearman"),
        F.round("minimum_pairwise_spearman", 6).alias("minimum_pairwise_spearman"),
    )


@query(
    "fold_summary",
    MEANS
    + """SELECT split_id, round(avg(auroc), 6) AS mean_auroc, round(stddev_pop(auroc), 6) AS std_auroc, count(*) AS n_folds
      FROM scores GROUP BY split_id""",
)
def _(spark, d):
    return K.fold_summary(B.challenge_scores(spark, d)).select(
        "split_id", F.round("mean_auroc", 6).alias("mean_auroc"), F.round("std_auroc", 6).alias("std_auroc"), "n_folds"
    )


@query(
    "shift_score",
    MEANS
    + "SELECT split_id, repeat, round(least(1, greatest(0, 2 * (auroc - 0.5))), 6) AS shift FROM scores",
)
def _(spark, d):
    return B.challenge_scores(spark, d).select(
        "split_id", "repeat", F.round(K.shift_score(F.col("auroc")), 6).alias("shift")
    )


REPORT = MEANS.rstrip() + """,
  report AS (SELECT split_id, CASE WHEN difficulty_rank % 7 = 0 THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN difficulty_rank % 7 = 0 THEN NULL ELSE mean_auroc END AS mean_auroc FROM ranked)
"""


def _report(spark, d):
    ranked = K.challenge_rankings(_means(spark, d))
    failed = F.col("difficulty_rank") % 7 == 0
    return ranked.select(
        "split_id",
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(~failed, F.col("mean_auroc")).alias("mean_auroc"),
    )


@query(
    "report_order",
    REPORT + "SELECT split_id, status, mean_auroc FROM report ORDER BY status <> 'success', mean_auroc NULLS LAST, split_id",
)
def _(spark, d):
    return _report(spark, d).orderBy(
        F.asc(F.col("status") != "success"), F.asc_nulls_last("mean_auroc"), F.asc("split_id")
    )


@query(
    "outcome_counts",
    REPORT
    + """SELECT count(*) AS challenge_count, count(*) FILTER (status = 'success') AS success_count,
      count(*) FILTER (status <> 'success') AS failure_count FROM report""",
)
def _(spark, d):
    return K.outcome_counts(_report(spark, d))


@query(
    "difficulty_warnings",
    MEANS
    + """, s AS (SELECT split_id, sum(auroc) AS a, round(stddev_pop(auroc), 6) AS std_auroc, count(*) AS c FROM scores GROUP BY split_id)
      SELECT split_id, concat_ws('|', CASE WHEN difficulty_rank * 60 < 500 THEN 'low_sample_size' END,
        CASE WHEN mean_auroc < 0.8 THEN 'low_feature_overlap' END,
        CASE WHEN difficulty_rank % 2 = 0 THEN 'preprocessed_input' END,
        CASE WHEN std_auroc > 0.05 THEN 'unstable_auroc' END, CASE WHEN mean_auroc < 0.5 THEN 'below_chance_mean_auroc' END,
        CASE WHEN difficulty_rank % 6 < 5 THEN 'small_category_pool' END,
        CASE WHEN difficulty_rank > 10 THEN 'unstable_repeat_percentile' END) AS warnings
      FROM ranked JOIN s USING (split_id)""",
)
def _(spark, d):
    ranked = K.challenge_rankings(_means(spark, d)).drop("category_size")
    spread = K.fold_summary(B.challenge_scores(spark, d)).select(
        "split_id", F.round("std_auroc", 6).alias("std_auroc")
    )
    rank = F.col("difficulty_rank")
    summary = ranked.join(spread, "split_id").select(
        "split_id",
        "mean_auroc",
        "std_auroc",
        (rank * 60).alias("sample_count"),
        F.col("mean_auroc").alias("overlap_fraction"),
        F.when(rank % 2 == 0, "normalized").otherwise("counts").alias("value_type"),
        (rank % 6).alias("category_size"),
        rank.cast("double").alias("repeat_percentile_std"),
    )
    return K.difficulty_warnings(summary).select(
        "split_id", F.array_join("warnings", "|").alias("warnings")
    )


@query(
    "snapshot_reconcile",
    MEANS.replace("WITH ", using("chal").rstrip() + ",\n", 1)
    + """, s AS (SELECT r.split_id, c.challenge_type, CASE WHEN difficulty_rank % 7 = 0 THEN 'failed' ELSE 'success' END AS status,
        CASE WHEN difficulty_rank % 5 = 0 THEN 'ds_x' ELSE c.train_id END AS train_id, c.test_id, mean_auroc, difficulty_rank,
        least(1, greatest(0, 2 * (mean_auroc - 0.5))) + CASE WHEN difficulty_rank % 4 = 0 THEN 0.1 ELSE 0 END AS shift
        FROM ranked r JOIN chal c USING (split_id)),
      e AS (SELECT mean_auroc, 100 * (avg(rk) - 1) / (max(n) - 1) AS expected FROM
        (SELECT mean_auroc, row_number() OVER (ORDER BY mean_auroc) AS rk, count(*) OVER () AS n FROM s WHERE status = 'success') GROUP BY mean_auroc),
      j AS (SELECT coalesce(s.split_id, c.split_id) AS split_id, s.status, s.train_id, c.train_id AS ct, s.mean_auroc, s.shift, s.difficulty_rank,
        e.expected FROM s FULL JOIN chal c ON s.split_id = c.split_id LEFT JOIN e ON s.mean_auroc = e.mean_auroc),
      p AS (SELECT split_id, concat_ws('|', CASE WHEN status IS NULL THEN 'missing_in_report' END,
        CASE WHEN status IS NULL THEN 'challenge_type' END,
        CASE WHEN status = 'success' AND train_id <> ct THEN 'train_id' END,
        CASE WHEN status = 'success' AND difficulty_rank % 4 = 0 THEN 'shift_score' END,
        CASE WHEN status = 'success' AND abs(0 - expected) > 1e-9 THEN 'percentile' END) AS problems FROM j)
      SELECT split_id, problems FROM p WHERE problems <> ''""",
)
def _(spark, d):
    challenges = C.build_challenges(B.datasets(spark, d))
    rank = F.col("difficulty_rank")
    ranked = K.challenge_rankings(_means(spark, d)).drop("challenge_type")
    shift = K.shift_score(F.col("mean_auroc")) + F.when(rank % 4 == 0, 0.1).otherwise(0.0)
    report = ranked.join(challenges.drop("status"), "split_id").select(
        "split_id",
        "challenge_type",
        F.when(rank % 7 == 0, "failed").otherwise("success").alias("status"),
        F.when(rank % 5 == 0, "ds_x").otherwise(F.col("train_id")).alias("train_id"),
        "test_id",
        "mean_auroc",
        shift.alias("domain_shift_score"),
        F.lit(0.0).alias("difficulty_percentile"),
    )
    return K.snapshot_problems(report, challenges).select(
        "split_id", F.array_join("problems", "|").alias("problems")
    )


@query(
    "auroc",
    using("pts")
    + """SELECT sample_id, sum(pos) AS n_positive, sum(neg) AS n_negative,
        round(sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auroc FROM
      (SELECT sample_id, p, pos, neg, coalesce(sum(neg) OVER (PARTITION BY sample_id ORDER BY p
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
        (SELECT sample_id, round(vector[1], 2) AS p, count(*) FILTER (domain = 'test') AS pos,
           count(*) FILTER (domain <> 'test') AS neg FROM pts GROUP BY ALL)) GROUP BY sample_id""".replace(
        "sum(pos) AS n_positive, sum(neg) AS n_negative",
        "CAST(sum(pos) AS BIGINT) AS n_positive, CAST(sum(neg) AS BIGINT) AS n_negative",
    ),
)
def _(spark, d):
    scored = B.points(spark, d).withColumn("p", F.round(F.element_at("vector", 1), 2))
    return K.auroc(scored, "p", F.col("domain") == "test", ["sample_id"]).withColumn(
        "auroc", F.round("auroc", 6)
    )


@query(
    "published_state",
    using("cat", more="""st AS (SELECT dataset_id, p_size, CASE WHEN p_size % 10 = 0 THEN 2 ELSE 1 END AS v,
      CASE p_size % 4 WHEN 0 THEN 'failure' WHEN 1 THEN 'queued' ELSE 'success' END AS state,
      CASE WHEN p_size % 3 = 0 THEN 'technical' ELSE 'scientific_failure' END AS category,
      p_size % 7 <> 0 AND p_size % 9 <> 0 AS same FROM cat WHERE p_size <> 17)""")
    + """SELECT c.dataset_id, CASE WHEN st.v IS NULL OR st.v <> 1 THEN 'missing' WHEN state = 'success' AND same THEN 'success'
      WHEN state = 'success' THEN 'stale' WHEN state = 'failure' AND category = 'scientific_failure' AND same THEN 'scientific_failure'
      WHEN state = 'failure' THEN 'failure' ELSE 'missing' END AS published_state
      FROM cat c LEFT JOIN st USING (dataset_id) WHERE dataset_type = 'full'""",
)
def _(spark, d):
    return _states(spark, d).select("dataset_id", "published_state")


def _states(spark, d):
    from quiltomics.plans.annotation import published_states

    catalogue = B.datasets(spark, d)
    size = F.col("file_size")
    plans = C.full_datasets(catalogue).select(
        "dataset_id",
        F.lit("singler").alias("method"),
        F.lit("{}").alias("parameters"),
        F.lit("g1").alias("gates"),
        (size % 8 == 2).alias("pilot"),
    )
    statuses = catalogue.where("file_size <> 17").select(
        "dataset_id",
        F.when(size % 10 == 0, 2).otherwise(1).alias("status_version"),
        F.when(size % 4 == 0, "failure").when(size % 4 == 1, "queued").otherwise("success").alias("state"),
        F.when(size % 3 == 0, "technical").otherwise("scientific_failure").alias("category"),
        F.when(size % 7 == 0, "old").otherwise(F.col("sha256")).alias("source_sha256"),
        F.lit("singler").alias("method"),
        F.lit("{}").alias("parameters"),
        F.when(size % 9 == 0, "g0").otherwise("g1").alias("gates"),
    )
    return published_states(plans, catalogue, statuses)


@query(
    "annotation_audit",
    using("cat", more="""st AS (SELECT dataset_id, CASE WHEN p_size = 17 OR p_size % 10 = 0 OR p_size % 4 = 1 THEN 'missing'
      WHEN p_size % 4 = 0 THEN CASE WHEN p_size % 3 <> 0 AND p_size % 7 <> 0 AND p_size % 9 <> 0 THEN 'scientific_failure' ELSE 'failure' END
      WHEN p_size % 7 <> 0 AND p_size % 9 <> 0 THEN 'success' ELSE 'stale' END AS s, p_size % 8 = 2 AS pilot
      FROM cat WHERE dataset_type = 'full')""")
    + """SELECT count(*) AS n_datasets, count(*) FILTER (s = 'success') AS success_count,
      count(*) FILTER (s = 'scientific_failure') AS scientific_failure_count,
      count(*) FILTER (s NOT IN ('success', 'scientific_failure')) AS failure_count,
      bool_and(s IN ('success', 'scientific_failure')) AS ok,
      bool_and(s IN ('success', 'scientific_failure')) FILTER (pilot) AS pilot_ready FROM st""",
)
def _(spark, d):
    from quiltomics.plans.annotation import audit

    return audit(_states(spark, d))
