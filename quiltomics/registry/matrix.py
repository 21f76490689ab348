"""Matrix statistics queries."""

from pyspark.sql import functions as F

from quiltomics.operators import matrix as M
from quiltomics.operators.ordering import linear_quantiles
from quiltomics.registry import query
from quiltomics.registry.views import using
from quiltomics.session import settled
from quiltomics.sources import bindings as B

TOTALS = using(
    "rna",
    "obs",
    more="""tot AS (SELECT obs.obs_id, obs.obs_ord, coalesce(CAST(sum(value) AS BIGINT), 0) AS total
      FROM obs LEFT JOIN rna USING (obs_id) GROUP BY ALL)""",
)
# Values spoiled on whole rows, so that every exclusion reason occurs.
SPOILED = using(
    "rna",
    "obs",
    more="""bad AS (SELECT obs_id, feature_id, CASE WHEN obs_ord % 101 = 0 THEN 'nan'::DOUBLE
        WHEN obs_ord % 103 = 0 THEN -CAST(value AS DOUBLE) WHEN obs_ord % 107 = 0 THEN value + 0.25
        ELSE CAST(value AS DOUBLE) END AS value FROM rna)""",
)


def _totals(spark, d):
    return M.row_totals(B.entries(spark, d, "rna"), B.observations(spark, d))


def _spoiled(spark, d):
    row = F.col("obs_id").cast("long")
    value = F.col("value").cast("double")
    return B.entries(spark, d, "rna").withColumn(
        "value",
        F.when(row % 101 == 0, F.lit(float("nan")))
        .when(row % 103 == 0, -value)
        .when(row % 107 == 0, value + 0.25)
        .otherwise(value),
    )


@query(
    "valid_rows",
    SPOILED
    + """SELECT obs.obs_id, CASE WHEN bool_or(isnan(value)) THEN 'non_finite' WHEN min(value) < 0 THEN 'negative'
      WHEN coalesce(sum(value), 0) <= 0 THEN 'zero_total' END AS reason
      FROM obs LEFT JOIN bad USING (obs_id) GROUP BY obs.obs_id""",
)
def _(spark, d):
    return M.row_validity(_spoiled(spark, d), B.observations(spark, d))


@query(
    "excluded_row_counts",
    SPOILED
    + """SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM
      (SELECT obs.obs_id, CASE WHEN bool_or(isnan(value)) THEN 'non_finite' WHEN min(value) < 0 THEN 'negative'
      WHEN coalesce(sum(value), 0) <= 0 THEN 'zero_total' END AS reason
      FROM obs LEFT JOIN bad USING (obs_id) GROUP BY obs.obs_id) GROUP BY 1""",
)
def _(spark, d):
    return M.exclusion_counts(M.row_validity(_spoiled(spark, d), B.observations(spark, d)))


@query("row_totals", TOTALS + "SELECT obs_id, total FROM tot")
def _(spark, d):
    return _totals(spark, d)


@query(
    "library_size_log1p",
    using("rna")
    + """SELECT obs_id, feature_id, round(ln(1 + value * (10000.0::DOUBLE / sum(value) OVER (PARTITION BY obs_id))), 6) AS value
      FROM rna""",
)
def _(spark, d):
    return M.library_size_log1p(B.entries(spark, d, "rna")).select(
        "obs_id", "feature_id", F.round("value", 6).alias("value")
    )


VARIANCE = using(
    "rna",
    more="""n AS (SELECT CAST(count(DISTINCT obs_id) AS DOUBLE) AS n FROM rna),
      v AS (SELECT feature_id, sum(value) / any_value(n) AS mean,
        sum(value * value) / any_value(n) - (sum(value) / any_value(n)) * (sum(value) / any_value(n)) AS variance
        FROM rna, n GROUP BY feature_id)""",
)


def _variances(spark, d):
    count = B.memberships(spark, d).where("modality = 'rna'").agg(F.count(F.lit(1)).alias("n"))
    return M.feature_variance(B.entries(spark, d, "rna"), count.scalar())


@query(
    "feature_variance",
    VARIANCE + "SELECT feature_id, round(mean, 6) AS mean, round(variance, 6) AS variance FROM v",
)
def _(spark, d):
    return _variances(spark, d).select(
        "feature_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance")
    )


@query(
    "high_variance_features",
    VARIANCE
    + """SELECT feature_id, row_number() OVER (ORDER BY variance DESC, feature_id) AS position,
      round(variance, 6) AS variance FROM v WHERE variance > 0 ORDER BY variance DESC, feature_id LIMIT 200""",
)
def _(spark, d):
    return M.high_variance_features(_variances(spark, d), 200).select(
        "feature_id", "position", F.round("variance", 6).alias("variance")
    )


@query(
    "scalar_integer_counts",
    SPOILED
    + """SELECT obs_id, feature_id, CAST(round_even(value, 0) AS BIGINT) AS value FROM bad
      WHERE NOT isnan(value) AND value >= 0 AND abs(value - round_even(value, 0)) <= 1e-6 AND round_even(value, 0) <> 0""",
)
def _(spark, d):
    rounded, _bad = M.integer_counts(_spoiled(spark, d))
    return rounded.select("obs_id", "feature_id", "value")


@query(
    "non_count_entries",
    SPOILED
    + """SELECT count(*) FILTER (isnan(value)) AS n_non_finite, count(*) FILTER (NOT isnan(value) AND value < 0) AS n_negative,
      count(*) FILTER (NOT isnan(value) AND value >= 0 AND abs(value - round_even(value, 0)) > 1e-6) AS n_fractional FROM bad""",
)
def _(spark, d):
    _rounded, bad = M.integer_counts(_spoiled(spark, d))
    return bad


@query(
    "quantiles_linear",
    TOTALS
    + " UNION ALL ".join(
        f"SELECT '{k}' AS name, round(quantile_cont(total, {f}), 6) AS value FROM tot"
        for k, f in M.DEPTH_QUANTILES.items()
    ),
)
def _(spark, d):
    return linear_quantiles(_totals(spark, d), "total", M.DEPTH_QUANTILES).select(
        "name", F.round("value", 6).alias("value")
    )


SAMPLE = """, pos AS (SELECT total, row_number() OVER (ORDER BY total) - 1 AS r, count(*) OVER () AS n FROM tot WHERE total > 0),
    smp AS (SELECT i, (SELECT max(total) FROM pos WHERE r = CAST(round_even(i * ((n - 1) / 19.0::DOUBLE), 0) AS BIGINT)) AS depth
      FROM (SELECT unnest(range(20)) AS i), (SELECT max(n) AS n FROM pos))
"""


@query(
    "depth_summary",
    TOTALS.rstrip()
    + SAMPLE
    + """SELECT 'observation_count' AS name, CAST(count(*) AS DOUBLE) AS value FROM tot
      UNION ALL SELECT 'nonzero_observation_count', count(*) FILTER (total > 0) FROM tot
      UNION ALL SELECT 'zero_observation_count', count(*) FILTER (total = 0) FROM tot
      UNION ALL SELECT 'mean', round(avg(total), 6) FROM tot UNION ALL """
    + " UNION ALL ".join(
        f"SELECT '{k}', round(quantile_cont(total, {f}), 6) FROM tot" for k, f in M.DEPTH_QUANTILES.items()
    )
    + " UNION ALL SELECT 'sample_' || lpad(CAST(i AS VARCHAR), 3, '0'), CAST(depth AS DOUBLE) FROM smp",
)
def _(spark, d):
    return M.depth_summary(_totals(spark, d), 20).withColumn("value", F.round("value", 6))


def _cyclic(spark, d, rows=None):
    totals = _totals(spark, d)
    if rows is not None:
        held = B.observations(spark, d).select("obs_id").join(rows.select("obs_id", "total"), "obs_id", "left")
        totals = held.withColumn("total", F.coalesce("total", F.lit(0)))
    # Read by the histogram and by the numbering.
    totals = settled(totals.withColumn("obs_ord", F.col("obs_id").cast("long")), "totals")
    depths = M.even_sample(totals, "total", 20)
    return M.cyclic_depths(totals, depths, "obs_ord")


@query(
    "cyclic_depth",
    TOTALS.rstrip()
    + SAMPLE
    + """SELECT obs_id, total, CAST(depth AS BIGINT) AS requested, CAST(least(total, depth) AS BIGINT) AS applied
      FROM (SELECT *, (row_number() OVER (ORDER BY obs_ord) - 1) % 20 AS i FROM tot) JOIN smp USING (i)""",
)
def _(spark, d):
    return _cyclic(spark, d).select("obs_id", "total", "requested", "applied")


@query(
    "depth_matched_downsample",
    TOTALS.rstrip()
    + SAMPLE
    + """SELECT obs_id, CAST(least(total, depth) AS BIGINT) AS drawn
      FROM (SELECT *, (row_number() OVER (ORDER BY obs_ord) - 1) % 20 AS i FROM tot) JOIN smp USING (i)
      WHERE total > 0""",
)
def _(spark, d):
    # The draw itself is random; its column sums must equal the applied depths.
    rows = M.gathered(B.entries(spark, d, "rna"))
    drawn = M.downsample(rows, _cyclic(spark, d, rows), 17)
    return drawn.groupBy("obs_id").agg(F.sum("value").alias("drawn"))
