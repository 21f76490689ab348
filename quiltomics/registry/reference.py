"""Reference selection and pseudo-spot queries."""

from pyspark.sql import functions as F

from quiltomics.operators import reference as R
from quiltomics.registry import query
from quiltomics.registry.views import using
from quiltomics.sources import bindings as B

SAMPLING = R.Sampling("1-URGENT", 400, 100, 200, 90, 17)
DESIGN = R.SpotDesign(5, 20, 100, 3, 0.6)
CELLS = using("cells")
# Some cells without a specific type, so that the generic filter has work.
_RAW = """raw AS (SELECT cell_id, ' ' || donor_id AS donor_id, CASE WHEN cell_id % 29 = 0 THEN 'Unknown' WHEN cell_id % 31 = 0 THEN ' '
      ELSE cell_type || ' ' END AS cell_type, CASE WHEN cell_id % 37 = 0 THEN 'unknown' ELSE ontology_id END AS ontology_id, dataset_id FROM cells),
    spec AS (SELECT cell_id, trim(donor_id) AS donor_id, trim(cell_type) AS cell_type, trim(ontology_id) AS ontology_id, dataset_id FROM raw
      WHERE trim(cell_type) <> '' AND lower(trim(cell_type)) <> 'unknown' AND ontology_id NOT IN ('unknown', 'CL:0000000'))"""
SPEC = using("cells", more=_RAW)
_PART = (
    _RAW
    + """, sp AS (SELECT *, CASE WHEN donor_id = '1-URGENT' THEN 'holdout' ELSE 'train' END AS partition FROM spec),
    ty AS (SELECT ontology_id, count(*) FILTER (partition = 'train') AS n_train, count(*) FILTER (partition = 'holdout') AS n_holdout
      FROM sp GROUP BY 1 HAVING count(*) FILTER (partition = 'train') >= 400),
    sel AS (SELECT cell_id, donor_id, cell_type, ontology_id, partition FROM (SELECT sp.*, row_number() OVER (PARTITION BY partition, sp.ontology_id
        ORDER BY sha256('17' || chr(0) || partition || chr(0) || cell_id)) AS rn FROM sp JOIN ty ON ty.ontology_id = sp.ontology_id
        WHERE partition = 'train' OR n_holdout >= 100) WHERE rn <= CASE WHEN partition = 'train' THEN 200 ELSE 90 END)"""
)
PART = using("cells", more=_PART)


def _raw(spark, d):
    cells = B.reference_cells(spark, d)
    key = F.col("cell_id")
    return cells.select(
        "cell_id",
        F.concat(F.lit(" "), F.col("donor_id")).alias("donor_id"),
        F.when(key % 29 == 0, "Unknown")
        .when(key % 31 == 0, " ")
        .otherwise(F.concat(F.col("cell_type"), F.lit(" ")))
        .alias("cell_type"),
        F.when(key % 37 == 0, "unknown").otherwise(F.col("ontology_id")).alias("ontology_id"),
        "dataset_id",
    )


@query("drop_generic_terms", SPEC + "SELECT cell_id, cell_type, ontology_id FROM spec")
def _(spark, d):
    return R.drop_generic(_raw(spark, d)).select("cell_id", "cell_type", "ontology_id")


@query(
    "scan_reference_cells",
    CELLS
    + """SELECT cell_id, donor_id, cell_type FROM cells WHERE dataset_id = 'coll_2' AND cell_type NOT IN ('NATION_7')
      AND CAST(cell_id AS VARCHAR) IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)""",
)
def _(spark, d):
    from quiltomics.sources.readers import scan_cells

    ids = B.memberships(spark, d).where("modality = 'rna'").select(F.col("obs_ord").alias("cell_id"))
    return scan_cells(
        B.reference_cells(spark, d),
        "dataset_id = 'coll_2' AND cell_type <> 'NATION_7'",
        ["cell_id", "donor_id", "cell_type"],
        ids,
    )


@query(
    "reference_obs_filter",
    CELLS
    + """SELECT cell_id, donor_id, cell_type FROM cells WHERE (donor_id <> '5-LOW' AND cell_type > 'NATION_3')
      AND dataset_id = 'coll_1'""",
)
def _(spark, d):
    from quiltomics.sources.readers import scan_cells

    recipe = "donor_id <> '5-LOW' AND cell_type > 'NATION_3'"
    return scan_cells(
        B.reference_cells(spark, d), f"({recipe}) AND dataset_id = 'coll_1'", ["cell_id", "donor_id", "cell_type"]
    )


@query(
    "retained_types",
    PART + "SELECT ontology_id, n_train, n_holdout, n_holdout >= 100 AS calibrates FROM ty",
)
def _(spark, d):
    split = R.split_donor(R.drop_generic(_raw(spark, d)), "1-URGENT")
    return R.retained_types(split, 400, 100)


@query(
    "stable_hash_sample",
    CELLS
    + """SELECT cell_id, ontology_id FROM (SELECT *, row_number() OVER (PARTITION BY ontology_id
      ORDER BY sha256('5' || chr(0) || 'train' || chr(0) || cell_id)) AS rn FROM cells) WHERE rn <= 50""",
)
def _(spark, d):
    cells = B.reference_cells(spark, d).withColumn("partition", F.lit("train"))
    return R.stable_sample(cells, "ontology_id", F.lit(50), 5).select("cell_id", "ontology_id")


@query("select_reference_partitions", PART + "SELECT * FROM sel")
def _(spark, d):
    return R.select_partitions(_raw(spark, d), SAMPLING).select(
        "cell_id", "donor_id", "cell_type", "ontology_id", "partition"
    )


@query(
    "train_holdout_union",
    PART + "SELECT partition, ontology_id, count(*) AS n, count(DISTINCT cell_id) AS n_ids FROM sel GROUP BY ALL",
)
def _(spark, d):
    selected = R.select_partitions(_raw(spark, d), SAMPLING)
    both = selected.where("partition = 'train'").unionByName(selected.where("partition = 'holdout'"))
    return both.groupBy("partition", "ontology_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("n_ids")
    )


@query(
    "partition_order",
    PART + "SELECT partition, ontology_id, cell_id FROM sel ORDER BY partition, ontology_id, cell_id",
)
def _(spark, d):
    return R.ordered_partitions(R.select_partitions(_raw(spark, d), SAMPLING)).select(
        "partition", "ontology_id", "cell_id"
    )


@query(
    "ontology_bijection",
    using("cells", more="o AS (SELECT cell_type, CASE WHEN cell_id % 1000 = 0 THEN 'CL:0000099' ELSE ontology_id END AS ontology_id FROM cells)")
    + """SELECT 'name' AS side, cell_type AS id, count(DISTINCT ontology_id) AS n FROM o GROUP BY cell_type HAVING count(DISTINCT ontology_id) > 1
      UNION ALL SELECT 'ontology', ontology_id, count(DISTINCT cell_type) FROM o GROUP BY ontology_id HAVING count(DISTINCT cell_type) > 1""",
)
def _(spark, d):
    cells = B.reference_cells(spark, d).withColumn(
        "ontology_id", F.when(F.col("cell_id") % 1000 == 0, "CL:0000099").otherwise(F.col("ontology_id"))
    )
    return R.ontology_conflicts(cells)


_DISC = """SELECT c.dataset_id, count(*) AS cells, count(DISTINCT donor_id) AS donors, count(DISTINCT ontology_id) AS types,
      (SELECT count(*) FROM (SELECT ontology_id FROM c2 WHERE c2.dataset_id = c.dataset_id GROUP BY 1 HAVING count(DISTINCT donor_id) >= 2)) AS multi_donor_types
      FROM c2 c GROUP BY c.dataset_id"""
DISC = using("cells", more="c2 AS (SELECT * FROM cells)")


@query("reference_discovery", DISC + _DISC)
def _(spark, d):
    return R.discovery(B.reference_cells(spark, d))


@query(
    "discovery_top",
    DISC + "SELECT * FROM (" + _DISC + ") ORDER BY multi_donor_types DESC, donors DESC, cells DESC, dataset_id LIMIT 3",
)
def _(spark, d):
    return R.discovery_order(R.discovery(B.reference_cells(spark, d)), 3)


@query(
    "reference_top_donors",
    """SELECT dataset_id, donor_id, cells, position FROM (SELECT 'coll_' || n_regionkey AS dataset_id, 'd' || c_custkey AS donor_id, count(*) AS cells,
        row_number() OVER (PARTITION BY n_regionkey ORDER BY count(*) DESC, 'd' || c_custkey) AS position
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, c_custkey)
      WHERE position <= 20""",
)
def _(spark, d):
    orders = B.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    cells = B.reference_cells(spark, d).join(orders, F.col("cell_id") == F.col("o_orderkey")).select(
        "dataset_id", F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("donor_id")
    )
    return R.top_donors(cells, 20).withColumn("position", F.col("position").cast("long"))


@query(
    "category_values_contains",
    " UNION ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value FROM part WHERE contains(lower({c}), 'in')"
        for c in ("p_name", "p_brand", "p_type")
    )
    + " UNION SELECT 'c_mktsegment', c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'in')",
)
def _(spark, d):
    parts = R.category_values(B.table(spark, d, "part"), ["p_name", "p_brand", "p_type"], "IN")
    segments = R.category_values(B.table(spark, d, "customer"), ["c_mktsegment"], "IN")
    return parts.unionByName(segments).orderBy("column", "value")


_DRAWS = """ty AS (SELECT cell_type, row_number() OVER (ORDER BY cell_type) - 1 AS o, count(*) OVER () AS t FROM (SELECT DISTINCT cell_type FROM hold)),
    draws AS (SELECT 0 AS phase, o * 20 + i AS spot, 0 AS slot, cell_type, 5 AS n FROM ty, (SELECT unnest(range(20)) AS i)
      UNION ALL SELECT 1, t * 20 + i, s, cell_type, CASE s WHEN 0 THEN 3 ELSE 1 END FROM (SELECT unnest(range(100)) AS i), (SELECT unnest(range(3)) AS s), ty
        WHERE o = (i + s) % t),
    st AS (SELECT *, coalesce(sum(n - 1) OVER (PARTITION BY cell_type ORDER BY phase, spot, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM draws),
    pool AS (SELECT cell_type, cell_id, row_number() OVER (PARTITION BY cell_type ORDER BY cell_id) - 1 AS position, count(*) OVER (PARTITION BY cell_type) AS size FROM hold),
    dr AS (SELECT spot, phase, slot, k, st.cell_type, cell_id FROM st, (SELECT unnest(range(5)) AS k) q, pool p
      WHERE k < n AND p.cell_type = st.cell_type AND p.position = (start + k) % size)"""
DRAWN = using("cells", more="hold AS (SELECT * FROM cells WHERE donor_id = '1-URGENT'),\n" + _DRAWS)


def _drawn(spark, d):
    holdout = B.reference_cells(spark, d).where("donor_id = '1-URGENT'")
    draws = R.spot_draws(holdout.select("cell_type").distinct(), DESIGN)
    return draws, R.cyclic_draw(draws, R.holdout_pool(holdout))


@query(
    "cyclic_draw",
    DRAWN + "SELECT CAST(spot AS BIGINT) AS spot, slot, CAST(k AS INTEGER) AS k, cell_type, cell_id FROM dr",
)
def _(spark, d):
    return _drawn(spark, d)[1].select(
        F.col("spot").cast("long").alias("spot"), F.col("slot").cast("int").alias("slot"), F.col("k").cast("int").alias("k"), "cell_type", "cell_id"
    )


@query(
    "pseudo_spot_sum",
    using("cells", "rna", more="hold AS (SELECT * FROM cells WHERE donor_id = '1-URGENT'),\n" + _DRAWS)
    + """SELECT CAST(spot AS BIGINT) AS spot, feature_id, CAST(sum(value) AS BIGINT) AS value FROM dr JOIN rna ON rna.obs_id = CAST(cell_id AS VARCHAR) GROUP BY ALL""",
)
def _(spark, d):
    return R.spot_sums(_drawn(spark, d)[1], B.entries(spark, d, "rna"))


@query(
    "pseudo_spots",
    DRAWN
    + """SELECT CAST(spot AS BIGINT) AS spot, cell_type AS truth, phase = 1 AS mixed,
      (SELECT count(*) FROM dr WHERE dr.spot = draws.spot) AS n_cells, (SELECT count(DISTINCT cell_type) FROM dr WHERE dr.spot = draws.spot) AS n_types
      FROM draws WHERE slot = 0""",
)
def _(spark, d):
    draws, drawn = _drawn(spark, d)
    sizes = drawn.groupBy("spot").agg(
        F.count(F.lit(1)).alias("n_cells"), F.countDistinct("cell_type").alias("n_types")
    )
    return R.spot_truth(draws).join(sizes, "spot")
