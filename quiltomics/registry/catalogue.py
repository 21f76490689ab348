"""Catalogue queries."""

from pyspark.sql import functions as F

from quiltomics.operators import catalogue as C
from quiltomics.registry import query
from quiltomics.registry.views import using
from quiltomics.sources import bindings as B

CAT = using("cat")
BOTH = using("cat", "mods")
_ANY = (
    "(contains(lower(dataset_id), '{q}') OR contains(lower(title), '{q}') OR contains(lower(description), '{q}')"
    " OR len(list_filter(source, lambda v: contains(lower(v), '{q}'))) > 0"
    " OR len(list_filter(organism, lambda v: contains(lower(v), '{q}'))) > 0"
    " OR len(list_filter(tissue, lambda v: contains(lower(v), '{q}'))) > 0"
    " OR len(list_filter(keywords, lambda v: contains(lower(v), '{q}'))) > 0"
    " OR dataset_id IN (SELECT dataset_id FROM mods WHERE"
    " len(list_filter(technology, lambda v: contains(lower(v), '{q}'))) > 0))"
)


def _both(spark, d):
    return B.datasets(spark, d), B.modalities(spark, d)


@query(
    "scan_catalogue",
    CAT + "SELECT dataset_id, dataset_type, title, split_id, n_obs, imported_at FROM cat",
)
def _(spark, d):
    return B.datasets(spark, d).select(
        "dataset_id", "dataset_type", "title", "split_id", "n_obs", "imported_at"
    )


@query("catalogue_search", BOTH + "SELECT dataset_id, title FROM cat WHERE " + _ANY.format(q="widget"))
def _(spark, d):
    ds, ms = _both(spark, d)
    return C.search(ds, ms, " Widget ").select("dataset_id", "title")


@query(
    "catalogue_search_literal",
    BOTH + "SELECT dataset_id, title FROM cat WHERE " + _ANY.format(q="brand#1") + " OR contains(lower(title), '100%_')",
)
def _(spark, d):
    ds, ms = _both(spark, d)
    return (
        C.search(ds, ms, "BRAND#1")
        .unionByName(C.search(ds, ms, "100%_"))
        .select("dataset_id", "title")
        .distinct()
    )


@query(
    "filter_list_membership",
    CAT + "SELECT dataset_id, title FROM cat WHERE list_contains(organism, 'Brand#7')",
)
def _(spark, d):
    ds, ms = _both(spark, d)
    return C.apply_filter(ds, ms, C.CatalogueFilter(organism="Brand#7")).select("dataset_id", "title")


@query("filter_spatial_unit", CAT + "SELECT dataset_id FROM cat WHERE spatial_unit = 'spot'")
def _(spark, d):
    ds, ms = _both(spark, d)
    return C.apply_filter(ds, ms, C.CatalogueFilter(spatial_unit="spot")).select("dataset_id")


@query(
    "filter_modality_exists",
    BOTH + "SELECT dataset_id FROM cat WHERE EXISTS (SELECT 1 FROM mods m WHERE m.dataset_id = cat.dataset_id AND m.name = 'R')",
)
def _(spark, d):
    return C.having_modality(*_both(spark, d), "R").select("dataset_id")


@query(
    "filter_technology_exists",
    BOTH + "SELECT dataset_id FROM cat WHERE EXISTS (SELECT 1 FROM mods m WHERE m.dataset_id = cat.dataset_id AND list_contains(m.technology, 'F'))",
)
def _(spark, d):
    return C.having_technology(*_both(spark, d), "F").select("dataset_id")


@query(
    "filter_challenge_type",
    CAT + "SELECT dataset_id, challenge_type FROM cat WHERE challenge_type = 'cross_subject'",
)
def _(spark, d):
    ds, ms = _both(spark, d)
    return C.apply_filter(ds, ms, C.CatalogueFilter(challenge_type="cross_subject")).select(
        "dataset_id", F.col("derivation.challenge_type").alias("challenge_type")
    )


@query(
    "filter_conjunction",
    BOTH
    + "SELECT dataset_id FROM cat WHERE "
    + _ANY.format(q="ing")
    + " AND spatial_unit = 'cell' AND list_contains(tissue, 'small') AND dataset_id IN"
    " (SELECT dataset_id FROM mods WHERE name = 'N') AND dataset_id IN"
    " (SELECT dataset_id FROM mods WHERE list_contains(technology, 'O'))",
)
def _(spark, d):
    wanted = C.CatalogueFilter(
        query="ing", spatial_unit="cell", tissue="small", modality="N", technology="O"
    )
    return C.apply_filter(*_both(spark, d), wanted).select("dataset_id")


@query(
    "filter_dataset_type",
    CAT + "SELECT dataset_id, dataset_type FROM cat WHERE dataset_type IN ('train', 'test')",
)
def _(spark, d):
    return C.derived_datasets(B.datasets(spark, d)).select("dataset_id", "dataset_type")


@query("get_database", CAT + "SELECT dataset_id, title FROM cat WHERE dataset_id = 'ds_5' AND dataset_type = 'full'")
def _(spark, d):
    return (
        C.full_datasets(B.datasets(spark, d)).where("dataset_id = 'ds_5'").select("dataset_id", "title")
    )


@query("get_challenge", using("chal") + "SELECT split_id, train_id, test_id, challenge_type FROM chal WHERE split_id = 'split_7'")
def _(spark, d):
    one = B.datasets(spark, d).where("split_id = 'split_7'")
    return C.build_challenges(one).select("split_id", "train_id", "test_id", "challenge_type")


@query(
    "resolve_sample_sources",
    using("cat", more="s AS (SELECT dataset_id, sources, unnest(sample_ids) AS sample_id FROM cat WHERE len(sources) > 1)")
    + """SELECT s.dataset_id, s.sample_id, f.dataset_id AS source_id,
      substr(s.sample_id, length(f.dataset_id) + 3) AS source_sample_id, f.title AS source_title
    FROM s JOIN cat f ON f.dataset_type = 'full' AND list_contains(s.sources, f.dataset_id)
      AND f.dataset_id = split_part(s.sample_id, '::', 1)
      AND list_contains(f.sample_ids, split_part(s.sample_id, '::', 2))""",
)
def _(spark, d):
    return C.resolve_sample_sources(B.datasets(spark, d)).where("problem IS NULL").drop("problem")


@query(
    "challenge_semi_match",
    BOTH
    + """SELECT dataset_id, split_id, dataset_type FROM cat WHERE dataset_type <> 'full' AND split_id IN
      (SELECT split_id FROM cat WHERE dataset_type <> 'full' AND list_contains(organism, 'Brand#3'))""",
)
def _(spark, d):
    ds, ms = _both(spark, d)
    hits = C.matching_splits(ds, ms, C.CatalogueFilter(organism="Brand#3"))
    return (
        C.derived_datasets(ds)
        .join(hits, "split_id", "left_semi")
        .select("dataset_id", "split_id", "dataset_type")
    )


@query(
    "challenge_pivot",
    using("cat")
    + """SELECT split_id, max(dataset_id) FILTER (dataset_type = 'train') AS train_id,
      max(dataset_id) FILTER (dataset_type = 'test') AS test_id,
      CASE WHEN count(*) FILTER (dataset_type = 'train') = 0 THEN 'missing_train'
        WHEN count(*) FILTER (dataset_type = 'test') = 0 THEN 'missing_test' ELSE 'complete' END AS status,
      any_value(challenge_type) AS challenge_type
    FROM cat WHERE split_id IS NOT NULL AND p_size > 5 GROUP BY split_id""",
)
def _(spark, d):
    return C.build_challenges(B.datasets(spark, d).where("file_size > 5"))


@query(
    "modality_facet_join",
    BOTH
    + """SELECT m.dataset_id, m.name, c.dataset_type, m.n_obs, m.n_vars FROM mods m
      JOIN cat c USING (dataset_id) WHERE c.dataset_type = 'full'""",
)
def _(spark, d):
    ds, ms = _both(spark, d)
    return C.modality_values(ds, ms, ("full",)).select(
        "dataset_id", "name", "dataset_type", "n_obs", "n_vars"
    )


@query(
    "missing_sources",
    using("declared")
    + """SELECT dataset_id, source_id FROM declared WHERE source_id NOT IN
      (SELECT dataset_id FROM cat WHERE dataset_type = 'full' AND p_size <> 7)""",
)
def _(spark, d):
    ds = B.datasets(spark, d).where("dataset_type <> 'full' OR file_size <> 7")
    return C.missing_sources(ds).select("dataset_id", "source_id")


@query(
    "opposite_side_lookup",
    CAT
    + """SELECT a.dataset_id, a.split_id, a.dataset_type, b.dataset_id AS peer_id FROM cat a JOIN cat b
      ON a.split_id = b.split_id AND a.dataset_type <> b.dataset_type""",
)
def _(spark, d):
    return C.opposite_sides(B.datasets(spark, d))


@query("count_databases", CAT + "SELECT count(*) AS n FROM cat WHERE dataset_type = 'full'")
def _(spark, d):
    return C.full_datasets(B.datasets(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("count_challenges", CAT + "SELECT count(DISTINCT split_id) AS n FROM cat WHERE dataset_type <> 'full'")
def _(spark, d):
    return C.derived_datasets(B.datasets(spark, d)).agg(F.countDistinct("split_id").alias("n"))


@query(
    "page_total",
    CAT + "SELECT count(*) AS total FROM cat WHERE dataset_type = 'full' AND spatial_unit = 'cell'",
)
def _(spark, d):
    ds, ms = _both(spark, d)
    return C.apply_filter(C.full_datasets(ds), ms, C.CatalogueFilter(spatial_unit="cell")).agg(
        F.count(F.lit(1)).alias("total")
    )


@query(
    "duplicate_sides",
    CAT
    + """SELECT split_id, dataset_type, count(*) AS n FROM
      (SELECT 'split_' || (k // 40) AS split_id, dataset_type FROM cat WHERE dataset_type <> 'full')
      GROUP BY ALL HAVING count(*) > 1""",
)
def _(spark, d):
    # Splits merged ten to one, so that sides repeat.
    merged = B.datasets(spark, d).withColumn(
        "split_id",
        F.concat(
            F.lit("split_"),
            F.floor(F.substring("split_id", 7, 20).cast("long") / 10).cast("string"),
        ),
    )
    return C.duplicate_sides(merged)


@query(
    "inconsistent_types",
    CAT
    + """SELECT split_id, CASE WHEN bad = 1 THEN 'invalid_type' ELSE 'inconsistent_type' END AS problem, n_types FROM
      (SELECT split_id, count(DISTINCT ct) AS n_types, max(CASE WHEN ct IS NULL THEN 1 ELSE 0 END) AS bad FROM
        (SELECT 'split_' || (k // 8) AS split_id, CASE WHEN p_size = 9 THEN NULL ELSE challenge_type END AS ct
         FROM cat WHERE dataset_type <> 'full') GROUP BY split_id)
      WHERE bad = 1 OR n_types > 1""",
)
def _(spark, d):
    merged = B.datasets(spark, d).withColumn(
        "split_id",
        F.concat(
            F.lit("split_"), F.floor(F.substring("split_id", 7, 20).cast("long") / 2).cast("string")
        ),
    )
    spoiled = merged.withColumn(
        "derivation", F.when(F.col("file_size") != 9, F.col("derivation"))
    )
    return C.inconsistent_types(spoiled)


@query(
    "split_recency",
    CAT
    + "SELECT split_id, max(imported_at) AS recency FROM cat WHERE split_id IS NOT NULL AND spatial_unit = 'cell' GROUP BY split_id",
)
def _(spark, d):
    return C.matching_splits(*_both(spark, d), C.CatalogueFilter(spatial_unit="cell"))


@query(
    "facet_values",
    BOTH
    + """SELECT DISTINCT facet, value FROM (
      SELECT 'organisms' AS facet, unnest(organism) AS value FROM cat WHERE dataset_type <> 'full'
      UNION ALL SELECT 'tissues', unnest(tissue) FROM cat WHERE dataset_type <> 'full'
      UNION ALL SELECT 'spatial_units', spatial_unit FROM cat WHERE dataset_type <> 'full'
      UNION ALL SELECT 'challenge_types', challenge_type FROM cat WHERE dataset_type <> 'full'
      UNION ALL SELECT 'modalities', name FROM mods JOIN cat USING (dataset_id) WHERE dataset_type <> 'full'
      UNION ALL SELECT 'technologies', unnest(technology) FROM mods JOIN cat USING (dataset_id)
        WHERE dataset_type <> 'full')""",
)
def _(spark, d):
    return C.facets(*_both(spark, d), ("train", "test")).orderBy("facet", "value")


@query(
    "list_databases_page",
    CAT
    + """SELECT dataset_id, imported_at, (SELECT count(*) FROM cat WHERE dataset_type = 'full'
        AND spatial_unit = 'spot') AS total
      FROM cat WHERE dataset_type = 'full' AND spatial_unit = 'spot'
      ORDER BY imported_at DESC, dataset_id LIMIT 20 OFFSET 40""",
)
def _(spark, d):
    return C.database_page(*_both(spark, d), C.CatalogueFilter(spatial_unit="spot"), 40, 20).select(
        "dataset_id", "imported_at", "total"
    )


@query(
    "list_challenges_newest",
    using("chal", more="m AS (SELECT split_id, max(imported_at) AS recency FROM cat WHERE split_id IS NOT NULL AND spatial_unit = 'cell' GROUP BY split_id)")
    + """SELECT row_number() OVER (ORDER BY recency DESC, split_id) - 1 AS position, split_id, train_id, test_id, recency, (SELECT count(*) FROM m) AS total
      FROM m JOIN chal USING (split_id) ORDER BY recency DESC, split_id LIMIT 20 OFFSET 10""",
)
def _(spark, d):
    return C.challenge_page(*_both(spark, d), C.CatalogueFilter(spatial_unit="cell"), 10, 20).select(
        "position", "split_id", "train_id", "test_id", "recency", "total"
    )


_DIFFICULTY = """SELECT row_number() OVER (ORDER BY auroc IS NULL, auroc {dir}, recency DESC, split_id) - 1 AS position,
      split_id, train_id, test_id, auroc, (SELECT count(*) FROM m) AS total
      FROM m JOIN chal USING (split_id) LEFT JOIN auc USING (split_id)
      ORDER BY auroc IS NULL, auroc {dir}, recency DESC, split_id LIMIT 30 OFFSET 5"""
_DIFFICULTY_WITH = using(
    "chal",
    "scores",
    more="""m AS (SELECT split_id, max(imported_at) AS recency FROM cat WHERE split_id IS NOT NULL GROUP BY split_id),
    auc AS (SELECT split_id, round(avg(auroc), 2) AS auroc FROM (SELECT split_id, round(auroc, 1) AS auroc FROM scores) GROUP BY split_id)""",
)


def _by_difficulty(spark, d, sort):
    ds, ms = _both(spark, d)
    # The mean over all repeats, rounded so that ties occur.
    aurocs = B.challenge_scores(spark, d).groupBy("split_id").agg(F.round(F.avg(F.round("auroc", 1)), 2).alias("auroc"))
    return C.challenge_page(ds, ms, C.CatalogueFilter(), 5, 30, sort, aurocs).select(
        "position", "split_id", "train_id", "test_id", "auroc", "total"
    )


@query("list_challenges_by_difficulty", _DIFFICULTY_WITH + _DIFFICULTY.format(dir="ASC"))
def _(spark, d):
    return _by_difficulty(spark, d, "difficulty_asc")


@query("list_challenges_hardest_first", _DIFFICULTY_WITH + _DIFFICULTY.format(dir="DESC"))
def _(spark, d):
    return _by_difficulty(spark, d, "difficulty_desc")


@query(
    "inventory_counts",
    CAT
    + """SELECT dataset_type, count(*) AS n_datasets, count(DISTINCT split_id) AS n_splits,
      count(*) FILTER (pairing_type = 'partially_shared') AS n_partial FROM cat GROUP BY dataset_type""",
)
def _(spark, d):
    return C.inventory(B.datasets(spark, d))


@query(
    "metadata_dedup",
    using(
        "declared",
        more="""v AS (SELECT dataset_id AS source_id, unnest(tissue) AS value,
        generate_subscripts(tissue, 1) AS pos FROM cat),
      f AS (SELECT d.dataset_id, value, min(source_ord * 1000 + pos) AS seen FROM declared d
        JOIN v USING (source_id) GROUP BY d.dataset_id, value)""",
    )
    + """SELECT dataset_id, string_agg(value, '|' ORDER BY seen) AS merged, count(*) = 1 AS is_scalar
      FROM f GROUP BY dataset_id""",
)
def _(spark, d):
    return C.merged_metadata(B.datasets(spark, d), "tissue").withColumn(
        "merged", F.array_join("merged", "|")
    )


@query(
    "value_type_consistency",
    using(
        "declared",
        "mods",
        more="""u AS (SELECT d.dataset_id, 'units' AS field, count(DISTINCT c.spatial_unit || c.coordinate_unit) AS n_values
        FROM declared d JOIN cat c ON c.dataset_id = d.source_id GROUP BY d.dataset_id
        UNION ALL SELECT d.dataset_id, 'value_type:' || left(name, 1), count(DISTINCT value_type || (n_obs % 2))
        FROM declared d JOIN mods m ON m.dataset_id = d.source_id GROUP BY d.dataset_id, name)""",
    )
    + "SELECT dataset_id, field, n_values FROM u WHERE n_values > 1",
)
def _(spark, d):
    ds, ms = _both(spark, d)
    mixed = ms.withColumn("value_type", F.concat("value_type", (F.col("n_obs") % 2).cast("string")))
    return C.incompatible_sources(ds, mixed)


@query(
    "catalogue_reconcile",
    CAT
    + """SELECT coalesce(a.dataset_id, b.dataset_id) AS dataset_id,
      CASE WHEN b.dataset_id IS NULL THEN 'missing' ELSE 'unindexed' END AS difference
      FROM (SELECT dataset_id FROM cat WHERE p_size <> 3) a
      FULL JOIN (SELECT DISTINCT 'ds_' || l_partkey AS dataset_id FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.08) b
      ON a.dataset_id = b.dataset_id WHERE a.dataset_id IS NULL OR b.dataset_id IS NULL""",
)
def _(spark, d):
    stored = (
        B.table(spark, d, "lineitem")
        .where("l_quantity > 10 AND l_discount > 0.08")
        .select(F.concat(F.lit("ds_"), F.col("l_partkey").cast("string")).alias("dataset_id"))
        .distinct()
    )
    return C.reconcile_ids(B.datasets(spark, d).where("file_size <> 3"), stored)


@query(
    "migration_diff",
    CAT
    + """SELECT coalesce(o.dataset_id, n.dataset_id) AS dataset_id, o.sha256 AS old_sha256, n.sha256 AS new_sha256,
      o.file_size AS old_file_size, n.file_size AS new_file_size, o.n_obs AS old_n_obs, n.n_obs AS new_n_obs,
      o.sha256 IS DISTINCT FROM n.sha256 OR o.file_size IS DISTINCT FROM n.file_size
        OR o.n_obs IS DISTINCT FROM n.n_obs AS changed
      FROM cat o FULL JOIN (SELECT dataset_id, CASE WHEN p_size % 2 = 0 THEN sha256(sha256) ELSE sha256 END AS sha256,
        file_size, n_obs - p_size % 3 AS n_obs FROM cat WHERE p_size <> 11) n ON o.dataset_id = n.dataset_id""",
)
def _(spark, d):
    old = B.datasets(spark, d)
    new = (
        old.where("file_size <> 11")
        .withColumn(
            "sha256",
            F.when(F.col("file_size") % 2 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")),
        )
        .withColumn("n_obs", F.col("n_obs") - F.col("file_size") % 3)
    )
    return C.migration_diff(old, new)


@query(
    "dataset_metadata_pin",
    CAT
    + """SELECT p.dataset_id, CASE WHEN c.dataset_id IS NULL THEN 'absent_or_duplicated'
      WHEN p.sha256 <> c.sha256 THEN 'version_changed'
      WHEN p.spatial_unit <> c.spatial_unit THEN 'collection_changed' ELSE 'pinned' END AS state
      FROM (SELECT dataset_id, CASE WHEN p_size % 4 = 1 THEN 'old' ELSE sha256 END AS sha256,
        CASE WHEN p_size % 6 = 0 THEN 'cell' ELSE spatial_unit END AS spatial_unit FROM cat) p
      LEFT JOIN (SELECT * FROM cat WHERE p_size <> 13) c ON p.dataset_id = c.dataset_id""",
)
def _(spark, d):
    ds = B.datasets(spark, d)
    size = F.col("file_size")
    pins = ds.select(
        "dataset_id",
        F.when(size % 4 == 1, "old").otherwise(F.col("sha256")).alias("sha256"),
        F.when(size % 6 == 0, "cell").otherwise(F.col("spatial_unit")).alias("spatial_unit"),
    )
    return C.pinned_metadata(ds.where("file_size <> 13"), pins)


@query(
    "import_append",
    CAT
    + """SELECT dataset_id, title FROM cat WHERE p_size <= 30
      UNION ALL SELECT dataset_id, 'new ' || title FROM cat WHERE p_size > 30""",
)
def _(spark, d):
    ds = B.datasets(spark, d)
    incoming = ds.withColumn("title", F.concat(F.lit("new "), F.col("title")))
    return C.import_append(ds.where("file_size <= 30"), incoming).select("dataset_id", "title")


@query(
    "import_replace",
    CAT
    + """SELECT dataset_id, CASE WHEN p_size > 20 AND NOT (p_size % 2 = 0 AND dataset_type <> 'full')
      THEN 'new ' || title ELSE title END AS title FROM cat""",
)
def _(spark, d):
    ds = B.datasets(spark, d)
    incoming = (
        ds.where("file_size > 20")
        .withColumn("title", F.concat(F.lit("new "), F.col("title")))
        .withColumn(
            "derivation",
            F.when(
                (F.col("file_size") % 2 == 0) & F.col("derivation").isNotNull(),
                F.col("derivation").withField("split_id", F.lit("moved")),
            ).otherwise(F.col("derivation")),
        )
    )
    return C.import_replace(ds, incoming).select("dataset_id", "title")


@query(
    "register_auxiliary",
    CAT
    + """, old AS (SELECT split_id AS dataset_id, 'aux_' || p_size AS auxiliary_id, 'file_' || dataset_id AS name
        FROM cat WHERE dataset_type = 'train'),
      new AS (SELECT split_id AS dataset_id, 'aux_' || p_size AS auxiliary_id, 'file_' || dataset_id AS name
        FROM cat WHERE dataset_type = 'test')
      SELECT * FROM old UNION ALL SELECT * FROM new WHERE (dataset_id, auxiliary_id) NOT IN
        (SELECT (dataset_id, auxiliary_id) FROM old)""",
)
def _(spark, d):
    aux = B.datasets(spark, d).select(
        "dataset_type",
        F.col("split_id").alias("dataset_id"),
        F.concat(F.lit("aux_"), F.col("file_size").cast("string")).alias("auxiliary_id"),
        F.concat(F.lit("file_"), F.col("dataset_id")).alias("name"),
    )
    return C.register_auxiliary(
        aux.where("dataset_type = 'train'").drop("dataset_type"),
        aux.where("dataset_type = 'test'").drop("dataset_type"),
    )
