"""Split, coordinate and identity queries."""

from pyspark.sql import functions as F

from quiltomics.operators import splits as S
from quiltomics.registry import query
from quiltomics.registry.views import using
from quiltomics.sources import bindings as B

SIDES = using("sides")


def _side(spark, d, side):
    return S.spatial_sides(B.observations(spark, d), B.regions(spark)).where(F.col("side") == side)


@query("region_select", SIDES + "SELECT obs_id, sample_id FROM sides WHERE side = 'test'")
def _(spark, d):
    return S.region_select(B.observations(spark, d), B.regions(spark)).select("obs_id", "sample_id")


@query("region_complement", SIDES + "SELECT obs_id, sample_id FROM sides WHERE side = 'train'")
def _(spark, d):
    return S.region_complement(B.observations(spark, d), B.regions(spark)).select("obs_id", "sample_id")


@query(
    "coordinate_ranges",
    using("obs")
    + """SELECT sample_id, count(*) AS n_obs, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max
      FROM obs GROUP BY GROUPING SETS ((sample_id), ())""",
)
def _(spark, d):
    return S.coordinate_ranges(B.observations(spark, d))


@query(
    "split_coordinate_ranges",
    SIDES
    + """SELECT side, sample_id, count(*) AS n_obs, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max
      FROM sides GROUP BY GROUPING SETS ((side, sample_id), (side))""",
)
def _(spark, d):
    return S.coordinate_ranges(S.spatial_sides(B.observations(spark, d), B.regions(spark)), ["side"])


@query(
    "sample_bounds",
    using("obs")
    + """SELECT sample_id, coalesce(min(x) FILTER (ok), -1) AS x_min, coalesce(max(x) FILTER (ok), 1) AS x_max,
      coalesce(min(y) FILTER (ok), -1) AS y_min, coalesce(max(y) FILTER (ok), 1) AS y_max
      FROM (SELECT sample_id, x, y, sample_id <> '2-HIGH' AND obs_ord % 13 <> 0 AS ok FROM obs) GROUP BY sample_id""",
)
def _(spark, d):
    spoiled = B.observations(spark, d).withColumn(
        "x",
        F.when((F.col("sample_id") == "2-HIGH") | (F.col("obs_ord") % 13 == 0), F.lit(float("nan"))).otherwise(
            F.col("x")
        ),
    )
    return S.sample_bounds(spoiled)


def _placed(spark, d):
    observed = B.observations(spark, d).withColumn(
        "attrs",
        F.create_map(
            F.lit("array_col"),
            (F.col("obs_ord") % 100).cast("string"),
            F.lit("array_row"),
            F.when(F.col("obs_ord") % 11 == 0, "none").otherwise(
                F.floor(F.col("obs_ord") / 200).cast("string")
            ),
        ),
    )
    rules = spark.createDataFrame(
        [("F", "obsm", None, None), ("O", "obs_columns", "array_col", "array_row"), ("P", "obs_columns", "array_col", "missing")],
        "source_dataset_id string, kind string, x_column string, y_column string",
    )
    return S.apply_coordinate_rule(observed, rules)


COORDS = using(
    "obs",
    more="""placed AS (SELECT *, CAST(CASE source_dataset_id WHEN 'F' THEN x ELSE obs_ord % 100 END AS FLOAT) AS new_x,
      CAST(CASE source_dataset_id WHEN 'F' THEN y WHEN 'O' THEN
        CASE WHEN obs_ord % 11 <> 0 THEN obs_ord // 200 END END AS FLOAT) AS new_y FROM obs)""",
)


@query("coordinate_rule", COORDS + "SELECT obs_id, CAST(new_x AS DOUBLE) AS new_x, CAST(new_y AS DOUBLE) AS new_y FROM placed")
def _(spark, d):
    return _placed(spark, d).select(
        "obs_id", F.col("new_x").cast("double").alias("new_x"), F.col("new_y").cast("double").alias("new_y")
    )


@query(
    "coordinate_problems",
    COORDS
    + """SELECT source_dataset_id, CAST(coalesce(sum(n) FILTER (new_x IS NULL OR new_y IS NULL), 0) AS BIGINT) AS n_non_finite,
      CAST(coalesce(sum(n) FILTER (new_x IS NOT NULL AND new_y IS NOT NULL AND n > 1), 0) AS BIGINT) AS n_shared
      FROM (SELECT source_dataset_id, new_x, new_y, count(*) AS n FROM placed GROUP BY ALL) GROUP BY ALL""",
)
def _(spark, d):
    return S.coordinate_problems(_placed(spark, d))


@query(
    "compose_union_all",
    using("lobs")
    + """SELECT source_dataset_id || '::' || obs_id AS obs_id, source_dataset_id || '::' || sample_id AS sample_id,
      source_dataset_id, obs_id AS source_obs_id, x, y, cell_type FROM lobs""",
)
def _(spark, d):
    return S.compose_sources(B.labelled_observations(spark, d))


@query(
    "compose_without_labels",
    using("lobs")
    + """SELECT source_dataset_id || '::' || obs_id AS obs_id, NULL::VARCHAR AS cell_type FROM lobs""",
)
def _(spark, d):
    partly = B.labelled_observations(spark, d).withColumn(
        "cell_type", F.when(F.col("source_dataset_id") != "P", F.col("cell_type"))
    )
    return S.compose_sources(partly).select("obs_id", "cell_type")


@query(
    "source_obs_exists",
    using("obs")
    + """SELECT source_dataset_id, source_obs_id FROM
      (SELECT CASE WHEN obs_ord % 50 = 0 THEN 'F' ELSE source_dataset_id END AS source_dataset_id, source_obs_id FROM obs) t
      WHERE (source_dataset_id, source_obs_id) NOT IN (SELECT (source_dataset_id, obs_id) FROM obs)""",
)
def _(spark, d):
    source = B.observations(spark, d)
    derived = source.withColumn(
        "source_dataset_id", F.when(F.col("obs_ord") % 50 == 0, "F").otherwise(F.col("source_dataset_id"))
    )
    return S.source_pairs_missing(derived, source)


@query(
    "train_test_overlap",
    SIDES
    + """SELECT DISTINCT source_dataset_id, source_obs_id FROM sides WHERE side = 'test' AND x > 200000""",
)
def _(spark, d):
    sides = S.spatial_sides(B.observations(spark, d), B.regions(spark))
    return S.overlapping_pairs(sides.where("side = 'train' OR x > 200000"), sides.where("side = 'test'"))


@query(
    "split_coverage",
    SIDES
    + """SELECT source_dataset_id, source_obs_id, 'missing' AS difference FROM sides WHERE side = 'train' AND x < 20000
      UNION ALL SELECT source_dataset_id, source_obs_id, 'added' FROM sides WHERE side = 'test' AND y < 300""",
)
def _(spark, d):
    sides = S.spatial_sides(B.observations(spark, d), B.regions(spark))
    return S.uncovered_pairs(
        sides.where("side = 'train' AND x >= 20000"),
        sides.where("side = 'test'"),
        sides.where("side = 'train' OR y >= 300"),
    )


@query(
    "membership_preserved",
    using("members", "sides")
    + """, e AS (SELECT m.modality, m.obs_id, m.obs_ord, s.y FROM members m JOIN sides s USING (obs_id) WHERE side = 'test'),
      g AS (SELECT modality, obs_id, CASE WHEN obs_ord % 7 = 0 THEN 'atac' ELSE modality END AS now FROM e)
      SELECT modality, obs_id, 'lost' AS difference FROM g WHERE now <> modality
      UNION ALL SELECT DISTINCT now, obs_id, 'gained' FROM g WHERE now <> modality""",
)
def _(spark, d):
    members = B.memberships(spark, d)
    kept = _side(spark, d, "test")
    derived = (
        members.join(kept.select("obs_id"), "obs_id", "left_semi")
        .withColumn("modality", F.when(F.col("obs_ord") % 7 == 0, "atac").otherwise(F.col("modality")))
        .select("modality", "obs_id")
        .distinct()
    )
    return S.membership_differences(kept, members, derived)


@query(
    "trim_to_paired",
    using("members") + "SELECT obs_id FROM members GROUP BY obs_id HAVING count(DISTINCT modality) = 2",
)
def _(spark, d):
    return S.trim_to_paired(B.memberships(spark, d))


@query(
    "removed_observations",
    using("members") + "SELECT obs_id FROM members GROUP BY obs_id HAVING count(DISTINCT modality) < 2",
)
def _(spark, d):
    return S.removed_observations(B.memberships(spark, d))


@query(
    "uncovered_observations",
    using("members", "obs")
    + """SELECT obs_id, 'unrepresented' AS problem FROM obs WHERE obs_id NOT IN (SELECT obs_id FROM members) AND sample_id <> '5-LOW'
      UNION ALL SELECT DISTINCT obs_id, 'not_global' FROM members WHERE obs_id IN (SELECT obs_id FROM obs WHERE sample_id = '5-LOW')""",
)
def _(spark, d):
    return S.uncovered_observations(
        B.observations(spark, d).where("sample_id <> '5-LOW'"), B.memberships(spark, d)
    )


@query(
    "sample_id_bijection",
    using("obs")
    + """, p AS (SELECT source_dataset_id, sample_id AS src, CASE WHEN obs_ord % 40 = 0 THEN 'pool' ELSE source_dataset_id || '::' || sample_id END AS sid FROM obs)
      SELECT 'forward' AS direction, source_dataset_id || '::' || src AS id, count(DISTINCT sid) AS n FROM p GROUP BY ALL HAVING count(DISTINCT sid) > 1
      UNION ALL SELECT 'backward', sid, count(DISTINCT source_dataset_id || src) FROM p GROUP BY ALL
        HAVING count(DISTINCT source_dataset_id || src) > 1""",
)
def _(spark, d):
    pairs = B.observations(spark, d).select(
        "source_dataset_id",
        F.col("sample_id").alias("source_sample_id"),
        F.when(F.col("obs_ord") % 40 == 0, "pool")
        .otherwise(F.concat_ws("::", "source_dataset_id", "sample_id"))
        .alias("sample_id"),
    )
    return S.sample_bijection(pairs)


_DIAG = """SELECT '{c}' AS "column", count(DISTINCT {c}) FILTER (side = 'train') AS train_unique,
  count(DISTINCT {c}) FILTER (side = 'test') AS test_unique,
  (SELECT count(*) FROM (SELECT {c} FROM sides WHERE side = 'train' INTERSECT SELECT {c} FROM sides WHERE side = 'test')) AS overlap,
  (SELECT count(*) FROM (SELECT {c} FROM sides WHERE side = 'train' INTERSECT SELECT {c} FROM sides WHERE side = 'test')) = 0 AS domain_disjoint
  FROM sides"""


@query(
    "hierarchy_diagnostics",
    SIDES + " UNION ALL ".join(_DIAG.format(c=c) for c in ("sample_id", "source_dataset_id", "subject")),
)
def _(spark, d):
    return S.hierarchy_diagnostics(S.spatial_sides(B.observations(spark, d), B.regions(spark)))


@query(
    "ordered_digest",
    using("obs")
    + """SELECT source_dataset_id, sha256(string_agg(obs_id || chr(0), '' ORDER BY obs_ord)) AS digest
      FROM (SELECT *, row_number() OVER (PARTITION BY source_dataset_id ORDER BY sha256('42' || chr(0) || obs_id)) AS r FROM obs)
      WHERE r <= 5000 GROUP BY source_dataset_id""",
)
def _(spark, d):
    from quiltomics.operators.ordering import smallest_by_hash
    from quiltomics.plans.difficulty import DifficultyConfig

    hashed = B.observations(spark, d).withColumn(
        "h", F.sha2(F.concat(F.lit("42\0"), F.col("obs_id")), 256)
    )
    # The digest of the difficulty evaluation's domain sample, which its configuration bounds.
    sample = smallest_by_hash(hashed, "h", ["source_dataset_id"], F.lit(DifficultyConfig().max_observations))
    return S.bounded_digest(
        sample, ["source_dataset_id"], ["obs_ord"], F.concat("obs_id", F.lit("\0"))
    )


@query(
    "observation_order_digest",
    using(
        "obs",
        more="""l1 AS (SELECT obs_ord // 4096 AS o, sha256(string_agg(obs_id || chr(0), '' ORDER BY obs_ord)) AS h FROM obs GROUP BY 1),
        l2 AS (SELECT o // 4096 AS o, sha256(string_agg(h, '' ORDER BY o)) AS h FROM l1 GROUP BY 1),
        l3 AS (SELECT o // 4096 AS o, sha256(string_agg(h, '' ORDER BY o)) AS h FROM l2 GROUP BY 1)""",
    )
    + "SELECT sha256(string_agg(h, '' ORDER BY o)) AS digest FROM l3",
)
def _(spark, d):
    return S.order_digest(B.observations(spark, d), "obs_ord", "obs_id")


@query(
    "gather_by_index",
    using("obs")
    + """SELECT pos, index, obs_ord, obs_id, sample_id, in_range FROM (SELECT o_orderkey AS pos, i AS index,
        CASE WHEN i < 0 THEN i + (SELECT count(*) FROM orders) ELSE i END AS obs_ord,
        coalesce(i BETWEEN -(SELECT count(*) FROM orders) AND (SELECT count(*) FROM orders) - 1, false) AS in_range
      FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 3 ELSE -(o_orderkey % 100) - 1 END AS i FROM orders))
      LEFT JOIN obs USING (obs_ord)""",
)
def _(spark, d):
    key = F.col("o_orderkey")
    requests = B.table(spark, d, "orders").select(
        key.alias("pos"), F.when(key % 2 == 0, key * 3).otherwise(-(key % 100) - 1).alias("index")
    )
    return S.gather(B.observations(spark, d), requests).select(
        "pos", "index", "obs_ord", "obs_id", "sample_id", "in_range"
    )


@query(
    "first_appearance_ids",
    using("lobs")
    + """SELECT cell_type, min(obs_ord) AS first_ord, row_number() OVER (ORDER BY min(obs_ord)) - 1 AS type_id
      FROM lobs GROUP BY cell_type""",
)
def _(spark, d):
    return S.first_appearance(B.labelled_observations(spark, d), "cell_type")


@query(
    "row_position",
    using("members", "obs")
    + """SELECT obs_id, coalesce(r, -1) AS row_ord FROM obs LEFT JOIN
      (SELECT obs_id, row_number() OVER (ORDER BY obs_ord) - 1 AS r FROM members WHERE modality = 'protein') USING (obs_id)""",
)
def _(spark, d):
    from quiltomics.operators.ordering import numbered

    rows = numbered(B.memberships(spark, d).where("modality = 'protein'"), [F.col("obs_ord")], name="row_ord")
    return (
        B.observations(spark, d)
        .select("obs_id")
        .join(rows.select("obs_id", "row_ord"), "obs_id", "left")
        .withColumn("row_ord", F.coalesce("row_ord", F.lit(-1)))
    )


@query(
    "unique_ids",
    using("obs")
    + """SELECT i AS obs_id, count(*) AS n FROM (SELECT CAST(obs_ord // 2 * 2 AS VARCHAR) AS i FROM obs WHERE sample_id = '5-LOW'
      UNION ALL SELECT obs_id FROM obs WHERE sample_id <> '5-LOW') GROUP BY i HAVING count(*) > 1""",
)
def _(spark, d):
    low = F.col("sample_id") == "5-LOW"
    folded = B.observations(spark, d).withColumn(
        "obs_id",
        F.when(low, (F.floor(F.col("obs_ord") / 2) * 2).cast("string")).otherwise(F.col("obs_id")),
    )
    return folded.groupBy("obs_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "blank_ids",
    using("obs") + "SELECT obs_ord, sample_id FROM obs WHERE obs_ord % 21 = 0",
)
def _(spark, d):
    blanked = B.observations(spark, d).withColumn(
        "obs_id", F.when(F.col("obs_ord") % 21 == 0, "  ").otherwise(F.col("obs_id"))
    )
    return blanked.where(F.trim("obs_id") == "").select("obs_ord", "sample_id")
