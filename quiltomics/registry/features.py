"""Feature axis queries."""

from pyspark.sql import functions as F

from quiltomics.operators import features as X
from quiltomics.operators import matrix as M
from quiltomics.registry import query
from quiltomics.registry.views import using
from quiltomics.sources import bindings as B

FEAT = using("feat")
MASK = using(
    "feat",
    more="""mask AS (SELECT f.feature_id, s.source_id, EXISTS (SELECT 1 FROM feat g WHERE g.feature_id = f.feature_id
      AND g.source_id = s.source_id) AS measured
      FROM (SELECT DISTINCT feature_id FROM feat) f, (SELECT DISTINCT source_id FROM feat) s)""",
)
SIDES = FEAT.rstrip() + """,
  tr AS (SELECT * FROM feat WHERE source_id = '1-URGENT'), te AS (SELECT * FROM feat WHERE source_id = '5-LOW')
"""


def _side(spark, d, source):
    return B.source_features(spark, d).where(F.col("source_id") == source)


@query("fully_measured_features", MASK + "SELECT feature_id FROM mask GROUP BY feature_id HAVING bool_and(measured)")
def _(spark, d):
    return X.fully_measured(X.measured_mask(B.source_features(spark, d)))


@query("feature_measured_mask", MASK + "SELECT * FROM mask")
def _(spark, d):
    return X.measured_mask(B.source_features(spark, d))


@query(
    "all_measured",
    MASK + "SELECT bool_and(measured) AS all_measured FROM mask WHERE source_id IN ('1-URGENT', '5-LOW')",
)
def _(spark, d):
    features = B.source_features(spark, d)
    used = features.where("source_ord IN (1, 5)")
    return X.all_measured(X.measured_mask(features), used)


@query(
    "common_features",
    SIDES + "SELECT feature_id, tr.feature_ord AS train_ord, te.feature_ord AS test_ord FROM tr JOIN te USING (feature_id)",
)
def _(spark, d):
    return X.common_features(_side(spark, d, "1-URGENT"), _side(spark, d, "5-LOW")).orderBy("feature_id")


@query(
    "feature_overlap_fraction",
    SIDES
    + """SELECT CAST((SELECT count(*) FROM tr) AS BIGINT) AS n_train, CAST((SELECT count(*) FROM te) AS BIGINT) AS n_test,
    count(*) AS n_common, round(count(*) / least((SELECT count(*) FROM tr), (SELECT count(*) FROM te)), 9) AS fraction
    FROM tr JOIN te USING (feature_id)""",
)
def _(spark, d):
    return X.overlap_fraction(_side(spark, d, "1-URGENT"), _side(spark, d, "5-LOW")).withColumn(
        "fraction", F.round("fraction", 9)
    )


@query(
    "shared_genes",
    SIDES + "SELECT count(*) AS shared, count(*) >= 500 AS passes FROM tr JOIN te USING (feature_id)",
)
def _(spark, d):
    return X.shared_genes(_side(spark, d, "1-URGENT"), _side(spark, d, "5-LOW"), 500)


@query(
    "scan_target_panel",
    "SELECT DISTINCT trim(CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE ' g' || l_partkey END) AS feature_id"
    " FROM lineitem WHERE l_partkey % 9 <> 0",
)
def _(spark, d):
    raw = B.table(spark, d, "lineitem").select(
        F.when(F.col("l_partkey") % 9 == 0, " ")
        .otherwise(F.concat(F.lit(" g"), F.col("l_partkey").cast("string")))
        .alias("feature_id")
    )
    return X.target_panel(raw)


MAPPED = using(
    "feat",
    more="""mapped AS (SELECT source_id, source_ord, feature_id, feature_ord,
      CASE WHEN source_ord = 1 THEN feature_id WHEN source_ord = 2 THEN canonical_id
        WHEN feature_ord % 3 > 0 THEN 'm' || (feature_ord % 700) END AS canonical_id FROM feat)""",
)


def _mapped(spark, d):
    features = B.source_features(spark, d).withColumnRenamed("canonical_id", "symbol")
    rules = features.select("source_id", "source_ord").distinct().select(
        "source_id",
        F.when(F.col("source_ord") == 1, "identity")
        .when(F.col("source_ord") == 2, "var_column")
        .otherwise("mapping_file")
        .alias("kind"),
    )
    mapping = features.where("source_ord > 2 AND feature_ord % 3 > 0").select(
        "source_id",
        "feature_id",
        F.concat(F.lit("m"), (F.col("feature_ord") % 700).cast("string")).alias("mapped_id"),
    )
    return features, rules, mapping


@query(
    "map_features",
    MAPPED + "SELECT * FROM mapped WHERE canonical_id IS NOT NULL",
)
def _(spark, d):
    return X.map_features(*_mapped(spark, d))


@query(
    "unknown_mapping_keys",
    FEAT
    + """SELECT m.source_id, m.feature_id FROM (SELECT '1-URGENT' AS source_id, feature_id FROM feat WHERE source_ord = 3) m
      WHERE NOT EXISTS (SELECT 1 FROM feat f WHERE f.source_id = m.source_id AND f.feature_id = m.feature_id)""",
)
def _(spark, d):
    features = B.source_features(spark, d)
    mapping = features.where("source_ord = 3").select(F.lit("1-URGENT").alias("source_id"), "feature_id")
    return X.unknown_mapping_keys(features, mapping)


@query(
    "features_intersection",
    FEAT
    + """SELECT feature_id, row_number() OVER (ORDER BY o, feature_id) - 1 AS target_ord FROM
      (SELECT feature_id, arg_min(feature_ord, source_ord) AS o FROM feat GROUP BY feature_id
       HAVING count(DISTINCT source_id) = (SELECT count(DISTINCT source_id) FROM feat))""",
)
def _(spark, d):
    return X.intersection(B.source_features(spark, d))


@query(
    "features_union",
    FEAT
    + """SELECT feature_id, row_number() OVER (ORDER BY s, o) - 1 AS target_ord FROM
      (SELECT feature_id, min(source_ord) AS s, arg_min(feature_ord, source_ord) AS o FROM feat GROUP BY feature_id)""",
)
def _(spark, d):
    return X.union(B.source_features(spark, d))


@query(
    "features_preserve",
    FEAT
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY feature_ord) AS pos FROM feat),
      n AS (SELECT pos, feature_id, count(DISTINCT source_id) AS n FROM p GROUP BY ALL)
      SELECT source_id, count(*) AS n_features, count(*) FILTER (n.n < 5) AS n_mismatch
      FROM p JOIN n USING (pos, feature_id) GROUP BY source_id""",
)
def _(spark, d):
    return X.preserve_mismatches(B.source_features(spark, d))


@query(
    "features_reference",
    FEAT
    + """SELECT feature_id, row_number() OVER (ORDER BY feature_ord) - 1 AS target_ord FROM feat
      WHERE source_id = '3-MEDIUM'""",
)
def _(spark, d):
    return X.reference_axis(B.source_features(spark, d), "3-MEDIUM")


NAMED = using(
    "feat",
    more="""mapped AS (SELECT source_id, source_ord, feature_id, feature_ord,
      CASE WHEN source_ord <= 2 THEN canonical_id WHEN feature_ord % 3 > 0 THEN 'c' || (feature_ord % 500) END AS canonical_id FROM feat)""",
)


@query(
    "canonical_intersection",
    NAMED
    + """SELECT canonical_id, row_number() OVER (ORDER BY o, canonical_id) - 1 AS target_ord FROM
      (SELECT canonical_id, min(feature_ord) FILTER (source_ord = s0) AS o FROM
         (SELECT *, min(source_ord) OVER (PARTITION BY canonical_id) AS s0 FROM mapped
          WHERE canonical_id IS NOT NULL)
       GROUP BY canonical_id HAVING count(DISTINCT source_id) = 5)""",
)
def _(spark, d):
    features, rules, mapping = _mapped(spark, d)
    # All sources name their features in one vocabulary: by a column or by a mapping file.
    rules = rules.withColumn("kind", F.when(F.col("kind") == "identity", "var_column").otherwise(F.col("kind")))
    named = features.select("source_id", "feature_id", "feature_ord")
    mapping = mapping.join(named, ["source_id", "feature_id"]).select(
        "source_id", "feature_id", F.concat(F.lit("c"), (F.col("feature_ord") % 500).cast("string")).alias("mapped_id")
    )
    return X.intersection(X.map_features(features, rules, mapping), "canonical_id")


@query(
    "feature_provenance",
    MAPPED
    + """SELECT canonical_id, source_id, '["' || string_agg(feature_id, '","' ORDER BY feature_ord) || '"]' AS raw_ids
      FROM mapped WHERE canonical_id IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    return X.provenance(X.map_features(*_mapped(spark, d)))


@query(
    "mapping_digest",
    MAPPED
    + """SELECT source_id, sha256(string_agg(feature_id || chr(0) || canonical_id || chr(0), '' ORDER BY feature_ord)) AS digest
      FROM mapped WHERE canonical_id IS NOT NULL GROUP BY source_id""",
)
def _(spark, d):
    from quiltomics.operators.splits import bounded_digest

    mapped = X.map_features(*_mapped(spark, d))
    text = F.concat("feature_id", F.lit("\0"), "canonical_id", F.lit("\0"))
    return bounded_digest(mapped, ["source_id"], ["feature_ord"], text)


@query(
    "align_to_target_features",
    using("rna", "feat", more="""t AS (SELECT feature_id, row_number() OVER (ORDER BY feature_ord) - 1 AS target_ord
      FROM feat WHERE source_ord = 3)""")
    + "SELECT obs_id, feature_id, target_ord, value FROM rna JOIN t USING (feature_id)",
)
def _(spark, d):
    target = X.reference_axis(B.source_features(spark, d), "3-MEDIUM")
    return X.align_entries(B.entries(spark, d, "rna"), target).select(
        "obs_id", "feature_id", "target_ord", "value"
    )


@query(
    "harmonize_sum",
    using("rna")
    + """SELECT obs_id, 'c' || (feature_ord % 500) AS canonical_id, CAST(sum(value) AS BIGINT) AS value
      FROM rna GROUP BY ALL""",
)
def _(spark, d):
    parts = B.table(spark, d, "part").select(
        F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("feature_id"),
        F.concat(F.lit("c"), (F.col("p_partkey") % 500).cast("string")).alias("canonical_id"),
    )
    return X.harmonize_sum(B.entries(spark, d, "rna"), parts).select("obs_id", "canonical_id", "value")


def _symbols(spark, d):
    return B.table(spark, d, "part").select(
        F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("feature_id"),
        F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.concat(F.col("p_name"), F.lit(" "))).alias("symbol"),
    )


@query(
    "collapse_duplicate_genes",
    using("rna")
    + """SELECT obs_id, trim(p_name) AS canonical_id, CAST(sum(value) AS BIGINT) AS value
      FROM rna JOIN part ON p_partkey = feature_ord WHERE p_partkey % 10 <> 0 GROUP BY ALL""",
)
def _(spark, d):
    merged, _ids = X.collapse_symbols(B.entries(spark, d, "rna"), _symbols(spark, d))
    return merged.select("obs_id", "canonical_id", "value")


@query(
    "collapsed_gene_ids",
    """SELECT trim(p_name) AS canonical_id, string_agg('g' || p_partkey, ',' ORDER BY 'g' || p_partkey) AS source_feature_id
      FROM part WHERE p_partkey % 10 <> 0 GROUP BY ALL""",
)
def _(spark, d):
    _merged, ids = X.collapse_symbols(B.entries(spark, d, "rna"), _symbols(spark, d))
    return ids


@query(
    "modality_summary",
    using("x")
    + "SELECT modality, count(DISTINCT obs_id) AS n_obs, count(DISTINCT feature_id) AS n_vars FROM x GROUP BY modality",
)
def _(spark, d):
    entries = B.entries(spark, d)
    return M.modality_summary(B.memberships(spark, d), entries.select("modality", "feature_id").distinct())


@query(
    "pairing_type",
    using("members", more="""g AS (SELECT 'd' || (obs_ord % 5000) AS dataset_id, modality, obs_id FROM members),
      p AS (SELECT dataset_id, obs_id, count(DISTINCT modality) AS n FROM g GROUP BY ALL),
      k AS (SELECT dataset_id, count(DISTINCT modality) AS k FROM g GROUP BY ALL)""")
    + """SELECT dataset_id, CASE WHEN min(n) = any_value(k) THEN 'same_unit' WHEN max(n) >= 2 THEN 'partially_shared'
      ELSE 'unpaired' END AS pairing_type FROM p JOIN k USING (dataset_id) GROUP BY dataset_id""",
)
def _(spark, d):
    grouped = B.memberships(spark, d).withColumn(
        "dataset_id", F.concat(F.lit("d"), (F.col("obs_ord") % 5000).cast("string"))
    )
    return M.pairing_type(grouped)
