"""Validation rule queries.

Clean tables break no rule, so the tables here are spoiled on whole rows by key
arithmetic; each oracle finds the spoiled rows from the raw tables.
"""

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltomics import schema
from quiltomics.operators import features as X
from quiltomics.operators import rules as V
from quiltomics.operators.splits import bounded_digest
from quiltomics.registry import ORACLES, query
from quiltomics.registry.views import using
from quiltomics.session import dealt, hash_joins, settled
from quiltomics.sources import bindings as B


class Lazy(dict):
    """Tables built when a rule asks for them."""

    def __init__(self, spark: SparkSession, folder: str, builders: dict[str, Callable]):
        super().__init__()
        self._args = (spark, folder)
        self._builders = builders

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._builders[name](*self._args)
        return self[name]


class Report(str):
    """The folder that a report of many rules reads, with the tables that are written for it."""

    def __new__(cls, folder: str) -> "Report":
        report = super().__new__(cls, folder)
        report._written = {}
        return report

    def written(self, spark: SparkSession, build: Callable, name: str) -> DataFrame:
        """What ``build`` makes of the folder, made once."""
        build = getattr(build, "__wrapped__", build)
        if build not in self._written:
            self._written[build] = settled(build(spark, self), name)
        return self._written[build]


def _step(build: Callable) -> Callable:
    """A table that several others rest on: a report writes it once for all of them."""

    @functools.wraps(build)
    def made(spark: SparkSession, d: str) -> DataFrame:
        return d.written(spark, build, build.__name__.strip("_")) if isinstance(d, Report) else build(spark, d)

    return made


class Settled(Lazy):
    """Tables written once, for reports of many rules; contexts that share a builder share its table."""

    def __init__(self, spark: SparkSession, report: Report, builders: dict[str, Callable]):
        super().__init__(spark, report, builders)
        self._steps: dict[str, DataFrame] = {}

    def __missing__(self, name: str) -> DataFrame:
        spark, report = self._args
        self[name] = report.written(spark, self._builders[name], name)
        return self[name]

    def step(self, name: str, build: Callable) -> DataFrame:
        """What ``build`` makes of these tables, for several rules: written once."""
        if name not in self._steps:
            self._steps[name] = settled(build(self), name)
        return self._steps[name]


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- catalogue tables -----------------------------------------------------------------
def _size():
    return F.col("file_size")



def _datasets(spark, d):
    return (
        B.datasets(spark, d)
        .withColumn("has_database", _size() != 1)
        .withColumn("schema_version", F.when(_size() == 2, "1.1").otherwise(F.col("schema_version")))
        .withColumn("organism", F.when(_size() != 7, F.col("organism")))
        .withColumn("tissue", F.when(_size() == 9, F.array(F.lit("a"), F.lit(" "))).when(_size() != 8, F.col("tissue")))
        .withColumn("spatial_unit", F.when(_size() == 3, " ").otherwise(F.col("spatial_unit")))
        .withColumn("dataset_id", F.when(_size() == 10, F.concat(F.lit("-"), F.col("dataset_id"))).otherwise(F.col("dataset_id")))
    )


def _documents(spark, d):
    base = B.datasets(spark, d)
    sources = F.col("derivation.source_dataset_ids")
    full_source = F.array(F.lit("ds_0"), F.lit("ds_1"))
    derivation = F.when(
        (_size() == 18) | (F.col("derivation").isNotNull() & (_size() != 19)),
        F.struct(
            F.when(_size() == 12, "subset").otherwise("composite").alias("construction_type"),
            F.when(_size() == 13, F.slice(sources, 1, 1)).otherwise(F.coalesce(sources, full_source)).alias("source_dataset_ids"),
            F.when(_size() == 14, "reference").when(_size() == 17, "union").otherwise("intersection").alias("feature_merge_policy"),
            F.when(_size() == 14, "ds_x").when(_size() == 15, "ds_0").alias("reference_dataset_id"),
        ),
    )
    return base.select(
        "dataset_id",
        "dataset_type",
        F.when(_size() == 4, F.array(F.lit("other"))).otherwise(F.col("organism")).alias("organism"),
        F.when(_size() != 5, F.col("tissue")).alias("tissue"),
        F.when(_size() == 11, "bin").otherwise(F.col("spatial_unit")).alias("spatial_unit"),
        "coordinate_unit",
        "pairing_type",
        F.when(_size() == 6, F.array(F.lit("s1"))).otherwise(F.col("sample_ids")).alias("sample_ids"),
        derivation.alias("derivation"),
        F.when(_size() == 16, F.slice(sources, 1, 1)).when(_size() == 17, sources).alias("harmonization_sources"),
    )


@_step
def _named(spark, d):
    return B.modalities(spark, d, ("n_obs",)).withColumn(
        "name", F.when(F.col("name") == "R", "rna").when(F.col("name") == "A", "protein").otherwise("image")
    )


def _modalities(spark, d):
    n = F.col("n_obs")
    return (
        _named(spark, d)
        .withColumn("technology", F.when((n % 11 != 0) & (n % 7 != 0), F.col("technology")))
        .withColumn("value_type", F.when(n % 13 == 0, " ").when(n % 11 != 0, F.col("value_type")))
    )


def _document_modalities(spark, d):
    n = F.col("n_obs")
    return (
        _named(spark, d)
        .where(n % 9 != 0)
        .withColumn("technology", F.when(n % 5 == 0, F.array(F.lit("Z"))).otherwise(F.col("technology")))
    )


def _catalogue(spark, d):
    spoiled = B.datasets(spark, d).select(
        "dataset_id",
        "dataset_type",
        "schema_version",
        "file_size",
        "sha256",
        F.when(_size() != 20, F.when(_size() == 21, "split_1").otherwise(F.col("split_id"))).alias("split_id"),
        F.when(_size() == 22, "easy").otherwise(F.col("derivation.challenge_type")).alias("challenge_type"),
    )
    return spoiled


def _artifacts(spark, d):
    return B.datasets(spark, d).where(_size() != 23).select(
        "dataset_id",
        F.when(_size() == 24, _size() + 1).otherwise(_size()).alias("size"),
        F.when(_size() == 25, "bad").otherwise(F.col("sha256")).alias("sha256"),
        F.when(_size() == 26, "1.1").otherwise(F.col("schema_version")).alias("schema_version"),
    )


def _auxiliary(spark, d):
    return B.datasets(spark, d).select(
        F.concat(F.lit("g"), F.floor(F.substring("dataset_id", 4, 20).cast("long") / 4).cast("string")).alias("dataset_id"),
        F.when(_size() == 1, "Bad Id").otherwise(F.concat(F.lit("aux_"), (_size() % 9).cast("string"))).alias("auxiliary_id"),
        F.when(_size() == 2, " ").when(_size() == 3, F.repeat(F.lit("x"), 201)).otherwise(F.col("title")).alias("label"),
        F.when(_size() == 4, "tiff").when(_size() == 5, "").otherwise("image/tiff").alias("media_type"),
        F.when(_size() == 6, F.lit(-1)).otherwise(_size()).alias("size"),
        F.when(_size() == 7, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"),
        F.when(_size() == 8, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+00:00").alias("retrieved_at"),
        F.concat(F.lit("auxiliary/"), (_size() % 11).cast("string")).alias("name"),
    )


def _pairs(spark, d):
    base = B.datasets(spark, d).where("dataset_type <> 'full'")
    number = F.substring("split_id", 7, 20)

    def side(name: str) -> DataFrame:
        test = name == "test"
        return base.where(F.col("dataset_type") == name).select(
            number.alias("_pair"),
            F.struct(
                (_size() != 27).alias("readable"),
                F.when(_size() == 28, "full").otherwise(F.col("dataset_type")).alias("dataset_type"),
                F.when((_size() == 29) & F.lit(test), "other").otherwise(F.col("split_id")).alias("split_id"),
                F.when((_size() == 30) & F.lit(test), "cross").otherwise(F.col("derivation.challenge_type")).alias("challenge_type"),
                F.when(_size() != 31, F.lit("fh")).alias("feature_harmonization"),
                F.when((_size() == 32) & F.lit(test), "d2").otherwise("d1").alias("feature_digest"),
                F.when(_size() == 33, "ch2").otherwise("ch1").alias("coordinate_harmonization"),
                (_size() != 34).alias("has_provenance"),
            ).alias(name),
        )

    return side("train").join(side("test"), "_pair").select(
        F.concat(F.lit("split_"), F.col("_pair")).alias("dataset_id"), "train", "test"
    )


CATALOGUE = {
    "datasets": _datasets,
    "documents": _documents,
    "modalities": _modalities,
    "document_modalities": _document_modalities,
    "catalogue": _catalogue,
    "artifacts": _artifacts,
    "auxiliary": _auxiliary,
    "pairs": _pairs,
    "files": lambda spark, d: B.datasets(spark, d).select("dataset_id", (_size() != 27).alias("readable")),
}

_CAT_SQL = """rd AS (SELECT CASE WHEN p_size = 10 THEN '-' || dataset_id ELSE dataset_id END AS dataset_id, dataset_id AS raw_id, p_size, dataset_type,
      CASE WHEN p_size = 2 THEN '1.1' ELSE schema_version END AS schema_version, CASE WHEN p_size <> 7 THEN organism END AS organism,
      CASE WHEN p_size = 9 THEN ['a', ' '] WHEN p_size <> 8 THEN tissue END AS tissue, CASE WHEN p_size = 3 THEN ' ' ELSE spatial_unit END AS spatial_unit,
      coordinate_unit, pairing_type, sample_ids FROM cat),
    nm AS (SELECT dataset_id, CASE name WHEN 'R' THEN 'rna' WHEN 'A' THEN 'protein' ELSE 'image' END AS name, technology, value_type, n_obs FROM mods),
    rm AS (SELECT dataset_id, name, n_obs, CASE WHEN n_obs % 11 <> 0 AND n_obs % 7 <> 0 THEN technology END AS technology,
      CASE WHEN n_obs % 13 = 0 THEN ' ' WHEN n_obs % 11 <> 0 THEN value_type END AS value_type FROM nm),
    rdm AS (SELECT dataset_id, name, CASE WHEN n_obs % 5 = 0 THEN ['Z'] ELSE technology END AS technology, value_type FROM nm WHERE n_obs % 9 <> 0)"""


#: Codes that read each context's tables, by the context's identity.
CODES: dict[int, list[str]] = {}
CONTEXTS: dict[int, dict[str, Callable]] = {}


def _register(context: dict[str, Callable], view: str, code: str, bad: str) -> None:
    found = V.RULES[code]
    sql = (
        view.rstrip()
        + f""",
    bad AS ({bad})
    SELECT dataset_id, '{code}' AS code, '{found.severity}' AS severity, '{found.path}' AS path, count(*) AS n_bad,
      min(CAST(sample AS VARCHAR)) AS sample FROM bad GROUP BY dataset_id"""
    )

    CODES.setdefault(id(context), []).append(code)
    CONTEXTS[id(context)] = context

    @query(f"rule_{code}", sql)
    def _(spark, d, code=code):
        return V.findings(Lazy(spark, d, context), [code])


def _all(context: dict[str, Callable], view: str, rules: dict[str, str]) -> None:
    for code, bad in rules.items():
        _register(context, view, code, bad)


_LISTED = "len({c}) = 0 OR len(list_filter({c}, lambda v: trim(v) = '')) > 0 OR len(list_distinct({c})) < len({c})"
_FULL = "SELECT dataset_id, dataset_id AS sample FROM cat WHERE "


def _mismatch(test: str) -> str:
    return " UNION ALL ".join(
        f"SELECT r.dataset_id, '{c}' AS sample FROM rd r JOIN dc ON dc.dataset_id = r.dataset_id WHERE "
        + test.format(f=f"r.{c}", d=f"dc.{c}")
        for c in ("organism", "tissue", "spatial_unit", "coordinate_unit", "pairing_type")
    )


_DC_SQL = """, dc AS (SELECT dataset_id, CASE WHEN p_size = 4 THEN ['other'] ELSE organism END AS organism, CASE WHEN p_size <> 5 THEN tissue END AS tissue,
      CASE WHEN p_size = 11 THEN 'bin' ELSE spatial_unit END AS spatial_unit, coordinate_unit, pairing_type FROM cat)"""

_all(
    CATALOGUE,
    using("cat", "mods", more=_CAT_SQL + _DC_SQL),
    {
        "missing_database_metadata": "SELECT dataset_id, dataset_id AS sample FROM rd WHERE p_size = 1",
        "missing_database_field": "SELECT dataset_id, 'organism' AS sample FROM rd WHERE p_size = 7 UNION ALL SELECT dataset_id, 'tissue' FROM rd WHERE p_size = 8",
        "invalid_database_metadata": "SELECT dataset_id, 'schema_version' AS sample FROM rd WHERE p_size = 2 UNION ALL SELECT dataset_id, 'organism' FROM rd WHERE p_size = 7"
        " UNION ALL SELECT dataset_id, 'spatial_unit' FROM rd WHERE p_size = 3 UNION ALL SELECT dataset_id, 'dataset_id' FROM rd WHERE p_size = 10"
        " UNION ALL SELECT dataset_id, 'tissue' FROM rd WHERE p_size <> 1 AND (tissue IS NULL OR " + _LISTED.format(c="tissue") + ")",
        "metadata_field_missing_from_yaml": "SELECT dataset_id, 'tissue' AS sample FROM cat WHERE p_size = 5",
        "database_metadata_mismatch": _mismatch("{f} IS NOT NULL AND {d} IS NOT NULL AND {f} <> {d}"),
        "sample_ids_mismatch": "SELECT dataset_id, dataset_id AS sample FROM cat WHERE p_size = 6",
        "modalities_mismatch": "SELECT dataset_id, name AS sample FROM nm WHERE n_obs % 9 = 0",
        "assay_metadata_mismatch": "SELECT a.dataset_id, a.name AS sample FROM rm a JOIN rdm b USING (dataset_id, name) WHERE a.technology IS DISTINCT FROM b.technology OR a.value_type IS DISTINCT FROM b.value_type",
        "too_few_modalities": "SELECT r.dataset_id, CAST(count(rm.name) AS VARCHAR) AS sample FROM rd r LEFT JOIN rm ON rm.dataset_id = r.dataset_id GROUP BY r.dataset_id HAVING count(rm.name) < 2",
        "missing_assay": "SELECT dataset_id, name AS sample FROM rm WHERE technology IS NULL AND value_type IS NULL",
        "missing_assay_field": "SELECT dataset_id, name AS sample FROM rm WHERE (technology IS NOT NULL OR value_type IS NOT NULL) AND (technology IS NULL OR value_type IS NULL OR trim(value_type) = '')",
        "nonstandard_modality_name": f"SELECT dataset_id, name AS sample FROM rm WHERE name NOT IN ({_list(schema.MODALITY_NAMES)})",
        "nonstandard_value_type": f"SELECT dataset_id, value_type AS sample FROM rm WHERE value_type NOT IN ({_list(schema.VALUE_TYPES)})",
        "unknown_value_type": "SELECT dataset_id, name AS sample FROM rm WHERE value_type = 'unknown'",
        "nonstandard_spatial_unit": "SELECT dataset_id, spatial_unit AS sample FROM rd WHERE spatial_unit NOT IN ('cell', 'nucleus', 'spot', 'bin', 'region')",
        "nonstandard_coordinate_unit": "SELECT dataset_id, coordinate_unit AS sample FROM rd WHERE coordinate_unit = 'furlong'",
        "subset_needs_one_source": _FULL + "dataset_type <> 'full' AND p_size = 12",
        "composite_needs_two_sources": _FULL + "dataset_type <> 'full' AND p_size = 13",
        "reference_not_a_source": _FULL + "dataset_type <> 'full' AND p_size = 14",
        "reference_without_policy": _FULL + "dataset_type <> 'full' AND p_size = 15",
        "harmonization_needs_intersection": _FULL + "dataset_type <> 'full' AND p_size = 17",
        "harmonization_misses_sources": _FULL + "dataset_type <> 'full' AND p_size = 16",
        "full_with_derivation": _FULL + "dataset_type = 'full' AND p_size = 18",
        "derived_without_derivation": _FULL + "dataset_type <> 'full' AND p_size = 19",
        "two_modalities_need_same_unit": "SELECT dataset_id, pairing_type AS sample FROM cat WHERE pairing_type <> 'same_unit' AND dataset_id IN (SELECT dataset_id FROM rdm GROUP BY 1 HAVING count(*) = 2)",
        "missing_split_id": _FULL + "dataset_type <> 'full' AND p_size = 20",
        "invalid_challenge_type": _FULL + "dataset_type <> 'full' AND p_size = 22",
        "inconsistent_challenge_type": "SELECT s AS dataset_id, s AS sample FROM (SELECT CASE WHEN p_size = 21 THEN 'split_1' WHEN p_size <> 20 THEN split_id END AS s,"
        " CASE WHEN p_size = 22 THEN 'easy' ELSE challenge_type END AS c FROM cat WHERE dataset_type <> 'full') WHERE s IS NOT NULL GROUP BY s HAVING count(DISTINCT c) > 1",
        "duplicate_split_side": "SELECT s AS dataset_id, dataset_type AS sample FROM (SELECT CASE WHEN p_size = 21 THEN 'split_1' WHEN p_size <> 20 THEN split_id END AS s, dataset_type"
        " FROM cat WHERE dataset_type <> 'full') GROUP BY s, dataset_type HAVING count(*) > 1",
        "h5mu_read_failed": _FULL + "p_size = 27",
        "artifact_missing": _FULL + "p_size = 23",
        "artifact_size": "SELECT dataset_id, p_size + 1 AS sample FROM cat WHERE p_size = 24",
        "artifact_checksum": "SELECT dataset_id, 'bad' AS sample FROM cat WHERE p_size = 25",
        "artifact_schema_version": "SELECT dataset_id, '1.1' AS sample FROM cat WHERE p_size = 26",
    },
)

_PAIR_SQL = "tt AS (SELECT a.split_id AS dataset_id, a.p_size AS a, b.p_size AS b FROM cat a JOIN cat b ON a.split_id = b.split_id WHERE a.dataset_type = 'train' AND b.dataset_type = 'test')"
_TT = "SELECT dataset_id, dataset_id AS sample FROM tt WHERE "
_all(
    CATALOGUE,
    using("cat", more=_PAIR_SQL),
    {
        "split_file_read_failed": _TT + "a = 27 OR b = 27",
        "invalid_split_dataset_types": _TT + "a = 28 OR b = 28",
        "split_id_mismatch": _TT + "b = 29",
        "challenge_type_mismatch": _TT + "b = 30",
        "feature_harmonization_mismatch": _TT + "(a = 31) <> (b = 31)",
        "harmonized_feature_order_mismatch": _TT + "b = 32 AND a <> 31",
        "coordinate_harmonization_mismatch": _TT + "(a = 33) <> (b = 33)",
        "missing_source_provenance": _TT + "a = 34 OR b = 34",
    },
)

_AUX_SQL = """ax AS (SELECT 'g' || (k // 4) AS dataset_id, CASE WHEN p_size = 1 THEN 'Bad Id' ELSE 'aux_' || (p_size % 9) END AS auxiliary_id,
    'auxiliary/' || (p_size % 11) AS name, p_size, sha256 FROM cat)"""
_AX = "SELECT dataset_id, auxiliary_id AS sample FROM ax WHERE "
_all(
    CATALOGUE,
    using("cat", more=_AUX_SQL),
    {
        "auxiliary_id": _AX + "p_size = 1",
        "auxiliary_label": _AX + "p_size IN (2, 3)",
        "auxiliary_media_type": "SELECT dataset_id, CASE p_size WHEN 4 THEN 'tiff' ELSE '' END AS sample FROM ax WHERE p_size IN (4, 5)",
        "auxiliary_size": _AX + "p_size = 6",
        "auxiliary_sha256": _AX + "p_size = 7 AND regexp_matches(sha256, '[a-f]')",
        "auxiliary_timezone": "SELECT dataset_id, '2024-01-01T00:00:00' AS sample FROM ax WHERE p_size = 8",
        "auxiliary_duplicate": "SELECT dataset_id, auxiliary_id AS sample FROM ax GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT dataset_id, name FROM ax GROUP BY ALL HAVING count(*) > 1",
    },
)

# --- observation tables -------------------------------------------------------------------
def _key():
    return F.col("o_orderkey")

def _low():
    return F.col("o_orderpriority") == "5-LOW"



def _dataset():
    return F.when(_low(), "DX").otherwise(F.concat(F.lit("D"), F.col("o_orderstatus")))


def _obs_id(key):
    return F.when(key % 211 == 0, " ").when(key % 223 == 0, "dup").otherwise(key.cast("string"))


def _source():
    return F.concat(F.lit("S"), F.substring("o_orderpriority", 1, 1))


def _sample(key):
    return F.concat(F.lit("smp"), (key % 5).cast("string"))


def _observations(spark, d):
    x = F.col("o_totalprice")
    y = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    sample = F.concat(_source(), F.lit("::"), _sample(_key()))
    return B.table(spark, d, "orders").select(
        _dataset().alias("dataset_id"),
        _key().alias("obs_ord"),
        _obs_id(_key()).alias("obs_id"),
        F.when(~_low() & (_key() % 227 != 0), F.when(_key() % 229 == 0, " ").when(_key() % 313 == 0, "pool").otherwise(sample)).alias("sample_id"),
        F.when(~_low() & (_key() % 251 != 0), F.when(_key() % 241 == 0, F.lit(float("nan"))).otherwise(x)).alias("x"),
        F.when(~_low() & (_key() % 251 != 0) & (F.col("o_orderstatus") != "P"), y).alias("y"),
        F.when(_key() % 257 == 0, 1.0).alias("z"),
        F.when(_key() % 263 == 0, "n/a").otherwise(x.cast("string")).alias("x_raw"),
        F.when(_key() % 233 != 0, F.when(_key() % 239 == 0, " pad ").when(_key() % 269 == 0, "").otherwise(F.concat(F.lit("T"), (_key() % 7).cast("string")))).alias("cell_type"),
        F.when(~_low(), F.when(_key() % 271 == 0, "").when(_key() % 277 == 0, "DZ").otherwise(_source())).alias("source_dataset_id"),
        F.when(~_low(), F.when(_key() % 281 == 0, "twin").when(_key() % 331 == 0, " ").otherwise(_key().cast("string"))).alias("source_obs_id"),
    )


@_step
def _lines(spark, d):
    """Lines with what their orders say."""
    orders = B.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = B.table(spark, d, "lineitem")
    placed = dealt(lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), lines.count(), "l_orderkey")
    return placed.join(orders, F.col("l_orderkey") == _key())


def _member_id():
    return F.when(_key() % 283 == 0, F.concat(F.lit("ghost"), _key().cast("string"))).otherwise(_obs_id(_key()))


@_step
def _members(spark, d):
    """Orders that have lines, each with the first of them: the one that tells its modalities."""
    orders = B.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    first = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    return first.join(orders, F.col("l_orderkey") == _key())


def _both(lines, *columns):
    # One row for each modality of a line, so that lines meet their orders once.
    modalities = F.when(F.col("l_linenumber") <= 2, F.array(F.lit("rna"), F.lit("protein"))).otherwise(F.array(F.lit("rna")))
    return lines.select(_dataset().alias("dataset_id"), F.explode(modalities).alias("modality"), *columns)


def _member_rows(spark, d):
    """Rows that both modalities have together, at most."""
    return 2 * B.table(spark, d, "lineitem").count()


def _memberships(spark, d):
    once = _both(_members(spark, d), _member_id().alias("obs_id"), _key().alias("obs_ord"))
    # The modalities of one dataset share no observation.
    turn = F.when(F.col("modality") == "rna", 0).otherwise(1)
    own = (F.col("obs_ord") % 2 == turn) & ((turn == 0) | ~F.col("obs_id").isin(" ", "dup"))
    once = once.where((F.col("dataset_id") != "DX") | own)
    return once.unionByName(once.where("obs_ord % 293 = 0"))


def _feature_id():
    part = F.col("l_partkey")
    return F.when(part % 211 == 0, " ").when(part % 223 == 0, "gdup").otherwise(F.concat(F.lit("g"), part.cast("string")))


def _features(spark, d):
    part = F.col("l_partkey")
    rows = _both(_lines(spark, d).where(part % 300 != 5), _feature_id().alias("feature_id"), part.alias("feature_ord"))
    return dealt(rows, _member_rows(spark, d), "dataset_id", "modality", "feature_id").distinct()


def _entries(spark, d):
    lost = F.when(_key() % 307 == 0, F.concat(F.lit("lost"), _key().cast("string"))).otherwise(_member_id())
    rows = _both(
        _lines(spark, d), lost.alias("obs_id"), _feature_id().alias("feature_id"), F.col("l_quantity").cast("long").alias("q")
    )
    # By observation, where memberships lie too.
    placed = dealt(rows, _member_rows(spark, d), "dataset_id", "modality", "obs_id")
    return placed.groupBy("dataset_id", "modality", "obs_id", "feature_id").agg(F.sum("q").alias("value"))


def _categories(spark, d):
    found = _observations(spark, d).where("cell_type IS NOT NULL").select("dataset_id", F.col("cell_type").alias("category")).distinct()
    extra = found.select("dataset_id").distinct().withColumn("category", F.concat(F.lit("unused_"), F.col("dataset_id")))
    return found.unionByName(extra).select(
        "dataset_id",
        "category",
        (F.col("dataset_id") == "DO").alias("ordered"),
        F.when(F.col("category") == "T3", "int").otherwise("string").alias("category_type"),
    )


def _by(column: str, values: dict[str, object], other: object = None) -> Column:
    """The value that belongs to a column's content, else ``other``."""
    chosen: Column = F.lit(other)
    for key, value in values.items():
        chosen = F.when(F.col(column) == key, F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)).otherwise(chosen)
    return chosen


def _links(spark, d):
    """Derived datasets and their sources as the orders have them; DP keeps one source."""
    orders = B.table(spark, d, "orders").where("o_orderpriority <> '5-LOW'")
    links = orders.select(_dataset().alias("dataset_id"), _source().alias("source_id")).distinct()
    return links.where("dataset_id <> 'DP' OR source_id = 'S1'")


def _sources(spark, d):
    return _links(spark, d).select("source_id").distinct()


def _derived(spark, d):
    links = _links(spark, d)
    gone = links.where("dataset_id = 'DO'").select("dataset_id", F.lit("S9").alias("source_id")).distinct()
    known, listed = F.array_remove("_all", "S9"), F.col("_all")
    grouped = links.unionByName(gone).groupBy("dataset_id").agg(F.sort_array(F.collect_set("source_id")).alias("_all"))
    several = F.size("_all") > 1
    return grouped.select(
        "dataset_id",
        listed.alias("source_dataset_ids"),
        F.when(several, "composite").otherwise("subset").alias("construction_type"),
        several.alias("has_context"),
        F.when(F.col("dataset_id") == "DO", F.array(F.lit("S1"), F.lit("S2"))).otherwise(known).alias("feature_source_ids"),
        F.when(F.col("dataset_id") == "DO", F.array(F.lit("S1"), F.lit("S3"))).otherwise(known).alias("coordinate_source_ids"),
        _by("dataset_id", {"DF": "intersection", "DO": "union"}, "preserve").alias("feature_merge_policy"),
        F.lit(None).cast("string").alias("reference_dataset_id"),
        _by("dataset_id", {"DP": "spot"}, "cell").alias("spatial_unit"),
        _by("dataset_id", {"DP": "pixel"}, "micrometer").alias("coordinate_unit"),
    )


def _axis_datasets(spark, d):
    """The datasets that orders belong to, and DE, to which none belongs."""
    found = B.table(spark, d, "orders").select(_dataset().alias("dataset_id")).distinct()
    empty = found.where("dataset_id = 'DX'").select(F.lit("DE").alias("dataset_id"))
    kind = F.when(F.col("dataset_id").isin("DO", "DX"), "partially_shared").otherwise("same_unit")
    return found.unionByName(empty).withColumn("pairing_type", kind)


def _axis_modalities(spark, d):
    found = _axis_datasets(spark, d).where("dataset_id <> 'DE'").select("dataset_id")
    both = found.withColumn("name", F.explode(F.array(F.lit("rna"), F.lit("protein"))))
    return both.unionByName(found.where("dataset_id = 'DP'").withColumn("name", F.lit("atac")))


def _source_datasets(spark, d):
    return _sources(spark, d).select(
        "source_id",
        (F.col("source_id") != "S2").alias("readable"),
        _by("source_id", {"S3": 2}, 0).alias("n_errors"),
        _by("source_id", {"S4": "train"}, "full").alias("dataset_type"),
        F.col("source_id").alias("stored_id"),
    )


def _coordinate_metadata(spark, d):
    given = F.col("dataset_id") != "DO"
    return _links(spark, d).select("dataset_id").distinct().select(
        "dataset_id",
        F.when(given, "1.0").alias("version"),
        F.when(given, "cell").alias("spatial_unit"),
        _by("dataset_id", {"DF": "micrometer", "DP": "pixel"}).cast("string").alias("coordinate_unit"),
    )


def _coordinate_rules(spark, d):
    last = F.col("source_id") == _by("dataset_id", {"DF": "S3", "DO": "S2"})
    columns = last & (F.col("dataset_id") == "DO")
    ruled = _links(spark, d).where("(dataset_id = 'DF' AND source_id <= 'S3') OR (dataset_id = 'DO' AND source_id <= 'S2')")
    return ruled.select(
        "dataset_id",
        "source_id",
        F.when(columns, "obs_columns").when(last, "magic").otherwise("obsm").alias("kind"),
        F.when(columns, "a").alias("x_column"),
        F.lit(None).cast("string").alias("y_column"),
    )


def _source_observations(spark, d):
    y = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return B.table(spark, d, "orders").where(_key() % 311 != 0).select(
        _source().alias("source_dataset_id"),
        _key().cast("string").alias("source_obs_id"),
        _sample(_key()).alias("sample_id"),
        F.col("o_totalprice").alias("x"),
        y.alias("y"),
    )


def _source_memberships(spark, d):
    members = _members(spark, d).where(_key() % 317 != 0)
    return _both(members, _source().alias("source_dataset_id"), _key().cast("string").alias("source_obs_id")).drop("dataset_id")


AXES = {
    "datasets": _axis_datasets,
    "modalities": _axis_modalities,
    "observations": _observations,
    "memberships": _memberships,
    "features": _features,
    "entries": _entries,
    "categories": _categories,
    "derived": _derived,
    "source_datasets": _source_datasets,
    "source_observations": _source_observations,
    "source_memberships": _source_memberships,
    "source_modalities": lambda spark, d: _sources(spark, d).withColumn("name", F.explode(F.array(F.lit("rna"), F.lit("protein")))),
    "coordinate_metadata": _coordinate_metadata,
    "coordinate_rules": _coordinate_rules,
}

_ORD_SQL = """ro AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'DX' ELSE 'D' || o_orderstatus END AS dataset_id, o_orderkey AS k, o_orderpriority = '5-LOW' AS low,
      CASE WHEN o_orderkey % 211 = 0 THEN ' ' WHEN o_orderkey % 223 = 0 THEN 'dup' ELSE CAST(o_orderkey AS VARCHAR) END AS obs_id, 'S' || left(o_orderpriority, 1) AS src,
      'smp' || (o_orderkey % 5) AS smp, o_totalprice AS price, o_orderstatus,
      CASE WHEN o_orderkey % 283 = 0 THEN 'ghost' || o_orderkey WHEN o_orderkey % 211 = 0 THEN ' ' WHEN o_orderkey % 223 = 0 THEN 'dup' ELSE CAST(o_orderkey AS VARCHAR) END AS mid,
      CASE WHEN o_orderkey % 233 = 0 THEN NULL WHEN o_orderkey % 239 = 0 THEN ' pad ' WHEN o_orderkey % 269 = 0 THEN '' ELSE 'T' || (o_orderkey % 7) END AS cell_type,
      CASE WHEN o_orderpriority <> '5-LOW' THEN CASE WHEN o_orderkey % 271 = 0 THEN '' WHEN o_orderkey % 277 = 0 THEN 'DZ' ELSE 'S' || left(o_orderpriority, 1) END END AS sd,
      CASE WHEN o_orderpriority <> '5-LOW' THEN CASE WHEN o_orderkey % 281 = 0 THEN 'twin' WHEN o_orderkey % 331 = 0 THEN ' ' ELSE CAST(o_orderkey AS VARCHAR) END END AS so,
      CASE WHEN o_orderpriority <> '5-LOW' AND o_orderkey % 227 <> 0 THEN CASE WHEN o_orderkey % 229 = 0 THEN ' ' WHEN o_orderkey % 313 = 0 THEN 'pool'
        ELSE 'S' || left(o_orderpriority, 1) || '::smp' || (o_orderkey % 5) END END AS sample_id FROM orders),
    dl AS (SELECT DISTINCT dataset_id, src AS source_id FROM ro WHERE NOT low AND (dataset_id <> 'DP' OR src = 'S1')
      UNION ALL SELECT DISTINCT 'DO', 'S9' FROM ro WHERE dataset_id = 'DO')"""
_MEM_SQL = """, li AS (SELECT ro.*, l_partkey, l_linenumber, l_quantity FROM lineitem JOIN ro ON l_orderkey = k),
    both_m AS (SELECT *, 'rna' AS modality FROM li UNION ALL SELECT *, 'protein' FROM li WHERE l_linenumber <= 2),
    m1 AS (SELECT DISTINCT dataset_id, modality, mid AS obs_id, k FROM both_m WHERE dataset_id <> 'DX' OR CASE modality WHEN 'rna' THEN k % 2 = 0 ELSE k % 2 = 1 AND mid NOT IN (' ', 'dup') END),
    rmem AS (SELECT * FROM m1 UNION ALL SELECT * FROM m1 WHERE k % 293 = 0),
    rx AS (SELECT dataset_id, modality, CASE WHEN k % 307 = 0 THEN 'lost' || k ELSE mid END AS obs_id,
      CASE WHEN l_partkey % 211 = 0 THEN ' ' WHEN l_partkey % 223 = 0 THEN 'gdup' ELSE 'g' || l_partkey END AS feature_id, l_partkey FROM both_m),
    rf AS (SELECT DISTINCT dataset_id, modality, feature_id, l_partkey FROM rx WHERE l_partkey % 300 <> 5)"""
_RO = "SELECT dataset_id, {s} AS sample FROM ro WHERE "
_COLUMN_ABSENT = "SELECT DISTINCT 'DX' AS dataset_id, '{c}' AS sample FROM ro"
_all(
    AXES,
    using("cat", more=_ORD_SQL),
    {
        "empty_observations": "SELECT DISTINCT 'DE' AS dataset_id, 'DE' AS sample FROM ro",
        "duplicate_obs_names": "SELECT dataset_id, obs_id AS sample FROM ro GROUP BY ALL HAVING count(*) > 1",
        "blank_obs_name": _RO.format(s="k") + "k % 211 = 0",
        "missing_sample_id": _COLUMN_ABSENT.format(c="sample_id"),
        "null_sample_id": _RO.format(s="k") + "NOT low AND k % 227 = 0",
        "blank_sample_id": _RO.format(s="k") + "NOT low AND k % 229 = 0 AND k % 227 <> 0",
        "null_cell_type": _RO.format(s="k") + "k % 233 = 0",
        "noncanonical_cell_type_label": _RO.format(s="cell_type") + "cell_type IN ('', ' pad ')",
        "nonrecommended_spatial_dtype": "SELECT DISTINCT dataset_id, 'x' AS sample FROM ro",
        "ordered_cell_type": "SELECT DISTINCT dataset_id, cell_type AS sample FROM ro WHERE dataset_id = 'DO' AND cell_type IS NOT NULL UNION ALL SELECT 'DO', 'unused_DO'",
        "invalid_cell_type_label": "SELECT DISTINCT dataset_id, cell_type AS sample FROM ro WHERE cell_type = 'T3'",
        "unused_cell_type_category": "SELECT DISTINCT dataset_id, 'unused_' || dataset_id AS sample FROM ro",
        "missing_spatial": _COLUMN_ABSENT.format(c="x"),
        "invalid_spatial_rank": "SELECT DISTINCT 'DP' AS dataset_id, 'y' AS sample FROM ro",
        "spatial_row_mismatch": _RO.format(s="k") + "NOT low AND k % 251 = 0",
        "invalid_spatial_dimensions": "SELECT dataset_id, 'z' AS sample FROM ro WHERE NOT low GROUP BY ALL HAVING count(*) FILTER (k % 257 = 0) > 0",
        "nonnumeric_spatial": _RO.format(s="'n/a'") + "k % 263 = 0",
        "nonfinite_spatial": _RO.format(s="k") + "NOT low AND k % 251 <> 0 AND k % 241 = 0",
        "missing_source_dataset_id": _COLUMN_ABSENT.format(c="source_dataset_id"),
        "missing_source_obs_id": _COLUMN_ABSENT.format(c="source_obs_id"),
        "invalid_source_dataset_id": _RO.format(s="k") + "NOT low AND k % 271 = 0",
        "invalid_source_obs_id": _RO.format(s="k") + "NOT low AND k % 331 = 0 AND k % 281 <> 0",
        "duplicate_source_observation": "SELECT dataset_id, so AS sample FROM ro WHERE so IS NOT NULL GROUP BY dataset_id, sd, so HAVING count(*) > 1",
        "undeclared_source_dataset": "SELECT DISTINCT dataset_id, sd AS sample FROM ro WHERE sd IS NOT NULL AND (dataset_id, sd) NOT IN (SELECT (dataset_id, source_id) FROM dl)",
        "unused_declared_source_dataset": "SELECT dataset_id, source_id AS sample FROM dl WHERE (dataset_id, source_id) NOT IN (SELECT (dataset_id, sd) FROM ro WHERE sd IS NOT NULL)",
        "invalid_subset_sources": "SELECT 'DP' AS dataset_id, CAST(count(DISTINCT sd) AS VARCHAR) AS sample FROM ro WHERE dataset_id = 'DP' HAVING count(DISTINCT sd) <> 1",
        "missing_source_context": "SELECT DISTINCT 'DP' AS dataset_id, 'DP' AS sample FROM ro",
        "harmonization_source_mismatch": "SELECT DISTINCT 'DO' AS dataset_id, 'DO' AS sample FROM ro",
        "missing_source_dataset": "SELECT dataset_id, source_id AS sample FROM dl WHERE source_id = 'S9'",
        "source_read_failed": "SELECT dataset_id, source_id AS sample FROM dl WHERE source_id = 'S2'",
        "invalid_source_dataset": "SELECT dataset_id, source_id AS sample FROM dl WHERE source_id = 'S3'",
        "source_not_full": "SELECT dataset_id, source_id AS sample FROM dl WHERE source_id = 'S4'",
        "source_observation_not_found": _RO.format(s="k") + "NOT low AND (k % 271 = 0 OR k % 277 = 0 OR k % 281 = 0 OR k % 311 = 0 OR k % 331 = 0)",
        "ambiguous_derived_sample_id": "SELECT dataset_id, sd || '::' || smp AS sample FROM ro WHERE NOT low AND sd = src AND so = CAST(k AS VARCHAR) AND k % 311 <> 0 GROUP BY dataset_id, sd, smp HAVING count(DISTINCT sample_id) > 1"
        " UNION ALL SELECT dataset_id, sample_id FROM ro WHERE NOT low AND sd = src AND so = CAST(k AS VARCHAR) AND k % 311 <> 0 GROUP BY dataset_id, sample_id HAVING count(DISTINCT sd || smp) > 1",
        "noncanonical_composite_sample_id": _RO.format(s="k") + "NOT low AND dataset_id <> 'DP' AND sd = src AND so = CAST(k AS VARCHAR) AND k % 311 <> 0 AND (k % 227 = 0 OR k % 229 = 0 OR k % 313 = 0)",
        "missing_coordinate_harmonization_metadata": "SELECT DISTINCT 'DO' AS dataset_id, 'DO' AS sample FROM ro",
        "invalid_coordinate_harmonization_metadata": "SELECT DISTINCT 'DP' AS dataset_id, 'DP' AS sample FROM ro",
        "missing_coordinate_source_metadata": "SELECT dataset_id, source_id AS sample FROM dl WHERE NOT (dataset_id = 'DF' AND source_id IN ('S1', 'S2', 'S3')) AND NOT (dataset_id = 'DO' AND source_id IN ('S1', 'S2'))",
        "invalid_coordinate_source_rule": "SELECT DISTINCT 'DF' AS dataset_id, 'S3' AS sample FROM ro UNION ALL SELECT DISTINCT 'DO', 'S2' FROM ro",
        "harmonized_coordinate_mismatch": _RO.format(s="k")
        + "sd = src AND so = CAST(k AS VARCHAR) AND k % 311 <> 0 AND (k % 251 = 0 OR k % 241 = 0) AND ((dataset_id = 'DF' AND sd IN ('S1', 'S2')) OR (dataset_id = 'DO' AND sd = 'S1'))",
        "modality_without_source": "SELECT DISTINCT 'DP' AS dataset_id, 'atac' AS sample FROM ro",
    },
)
_all(
    AXES,
    using("cat", more=_ORD_SQL + _MEM_SQL),
    {
        "unrepresented_global_obs": "SELECT dataset_id, obs_id AS sample FROM ro WHERE (dataset_id, obs_id) NOT IN (SELECT (dataset_id, obs_id) FROM rmem)",
        "modality_obs_not_global": "SELECT dataset_id, obs_id AS sample FROM rmem WHERE (dataset_id, obs_id) NOT IN (SELECT (dataset_id, obs_id) FROM ro)",
        "duplicate_modality_obs_names": "SELECT dataset_id, obs_id AS sample FROM rmem GROUP BY dataset_id, modality, obs_id HAVING count(*) > 1",
        "blank_modality_obs_name": "SELECT dataset_id, k AS sample FROM rmem WHERE trim(obs_id) = ''",
        "empty_modality_obs": "SELECT DISTINCT 'DP' AS dataset_id, 'atac' AS sample FROM ro",
        "empty_modality_vars": "SELECT DISTINCT 'DP' AS dataset_id, 'atac' AS sample FROM ro",
        "missing_x": "SELECT DISTINCT 'DP' AS dataset_id, 'atac' AS sample FROM ro",
        "duplicate_var_names": "SELECT dataset_id, feature_id AS sample FROM rf GROUP BY dataset_id, modality, feature_id HAVING count(*) > 1",
        "blank_var_name": "SELECT dataset_id, l_partkey AS sample FROM rf WHERE trim(feature_id) = ''",
        "x_shape_mismatch": "SELECT dataset_id, obs_id AS sample FROM (SELECT DISTINCT dataset_id, modality, obs_id, feature_id FROM rx) WHERE (dataset_id, modality, obs_id) NOT IN (SELECT (dataset_id, modality, obs_id) FROM rmem)"
        " UNION ALL SELECT dataset_id, feature_id FROM (SELECT DISTINCT dataset_id, modality, obs_id, feature_id FROM rx) WHERE (dataset_id, modality, feature_id) NOT IN (SELECT (dataset_id, modality, feature_id) FROM rf)",
        "two_modality_pairing_required": "SELECT DISTINCT dataset_id, CASE dataset_id WHEN 'DX' THEN 'unpaired' ELSE 'partially_shared' END AS sample FROM rmem",
        "unpaired_modalities": "SELECT dataset_id, 'unpaired' AS sample FROM (SELECT dataset_id, max(n) AS n FROM (SELECT dataset_id, obs_id, count(DISTINCT modality) AS n FROM rmem GROUP BY ALL) GROUP BY dataset_id) WHERE n = 1",
        "same_unit_mismatch": "SELECT DISTINCT dataset_id, 'partially_shared' AS sample FROM rmem WHERE dataset_id IN ('DF', 'DP')",
        "partially_shared_mismatch": "SELECT DISTINCT dataset_id, 'unpaired' AS sample FROM rmem WHERE dataset_id = 'DX'",
        "invalid_modality_source_membership": """SELECT dataset_id, modality || '/' || so AS sample FROM (
          (SELECT DISTINCT r.dataset_id, m.modality, r.sd, r.so FROM rmem m JOIN ro r ON r.dataset_id = m.dataset_id AND r.obs_id = m.obs_id WHERE r.so IS NOT NULL
           EXCEPT SELECT DISTINCT r.dataset_id, s.modality, r.sd, r.so FROM ro r JOIN both_m s ON s.src = r.sd AND CAST(s.k AS VARCHAR) = r.so WHERE s.k % 317 <> 0)
          UNION ALL
          (SELECT DISTINCT r.dataset_id, s.modality, r.sd, r.so FROM ro r JOIN both_m s ON s.src = r.sd AND CAST(s.k AS VARCHAR) = r.so WHERE s.k % 317 <> 0
           EXCEPT SELECT DISTINCT r.dataset_id, m.modality, r.sd, r.so FROM rmem m JOIN ro r ON r.dataset_id = m.dataset_id AND r.obs_id = m.obs_id WHERE r.so IS NOT NULL)
)""",
    },
)

_all(
    {**AXES, "observations": lambda spark, d: _observations(spark, d).withColumn("cell_type", F.length("cell_type"))},
    using("cat", more=_ORD_SQL),
    {"invalid_cell_type_dtype": "SELECT DISTINCT dataset_id, 'cell_type' AS sample FROM ro"},
)

# --- feature tables ---------------------------------------------------------------------------
def _atlas():
    return F.lit("atlas").alias("dataset_id")



@_step
def _axis(spark, d):
    return B.source_features(spark, d)


def _mask(spark, d):
    number = F.substring("feature_id", 2, 20).cast("long")
    return X.measured_mask(_axis(spark, d)).select(
        _atlas(),
        "feature_id",
        "source_id",
        F.when(number % 97 == 0, ~F.col("measured")).otherwise(F.col("measured")).alias("measured"),
    )


@_step
def _masked_entries(spark, d):
    orders = B.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("obs_id"), F.col("o_orderpriority").alias("source_id"))
    return B.entries(spark, d, "rna").join(orders, "obs_id").select("dataset_id", "source_id", "obs_id", "feature_id", "value")


def _named_axis(spark, d):
    blank = (F.col("source_ord") == 2) & (F.col("feature_ord") % 401 == 0)
    return _axis(spark, d).withColumn("symbol", F.when(blank, " ").otherwise(F.col("canonical_id")))


def _clean_axis(spark, d):
    return _axis(spark, d).withColumn("symbol", F.col("canonical_id"))


def _true_mapping(spark, d):
    return _axis(spark, d).select("source_id", "source_ord", "feature_id", "feature_ord", "canonical_id")


@_step
def _stored_provenance(spark, d):
    return X.provenance(_true_mapping(spark, d)).select(_atlas(), "canonical_id", "source_id", "raw_ids")


def _kinds(spark, d):
    text = F.concat("feature_id", F.lit("\0"), "canonical_id", F.lit("\0"))
    digests = bounded_digest(_true_mapping(spark, d), ["source_id"], ["feature_ord"], text)
    order = F.substring("source_id", 1, 1)
    return digests.select(
        _atlas(),
        "source_id",
        F.when(order <= "2", "var_column").otherwise("mapping_file").alias("kind"),
        F.when(order <= "2", "symbol").alias("column"),
        F.when(order == "3", "bad").otherwise(F.col("digest")).alias("mapping_sha256"),
    )


def _harmonization(version: str, scope: str) -> Callable:
    def build(spark, d):
        return _axis(spark, d).agg(F.array_sort(F.collect_set("source_id")).alias("source_ids")).select(
            _atlas(),
            F.lit("rna").alias("modality"),
            F.lit(version).alias("version") if version else F.lit(None).cast("string").alias("version"),
            F.lit(scope).alias("scope"),
            F.lit("sum").alias("aggregation"),
            F.lit("source_feature_ids__").alias("source_feature_column_prefix"),
            "source_ids",
        )

    return build


def _harmonized_features(spark, d):
    axis = X.intersection(_true_mapping(spark, d), "canonical_id")
    return axis.where("target_ord % 50 <> 7").select(_atlas(), "canonical_id", F.col("target_ord").alias("feature_ord"))


def _harmonized_entries(spark, d):
    sums = X.harmonize_sum(_masked_entries(spark, d), _true_mapping(spark, d))
    spoiled = F.when(F.col("obs_id").cast("long") % 500 == 0, F.col("value") + 1).otherwise(F.col("value"))
    return sums.select(_atlas(), "obs_id", "canonical_id", spoiled.alias("value"))


def _wrong_provenance(spark, d):
    number = F.substring("canonical_id", 2, 20).cast("long")
    wrong = (number % 50 == 1) & (F.col("source_id") == "1-URGENT")
    return _stored_provenance(spark, d).withColumn("raw_ids", F.when(wrong, '["zz"]').otherwise(F.col("raw_ids")))


def _bad_provenance(spark, d):
    number = F.substring("canonical_id", 2, 20).cast("long")
    return _stored_provenance(spark, d).where("source_id <> '5-LOW'").withColumn(
        "raw_ids",
        F.when(number % 50 == 1, "[]").when(number % 50 == 2, '["a","a"]').when(number % 50 == 3, "{").when(number % 50 == 4, '["zz"]').otherwise(F.col("raw_ids")),
    )


def _bad_kinds(spark, d):
    known = _axis(spark, d).select("source_id").distinct()
    extra = known.limit(1).select(F.lit("9-GONE").alias("source_id"))
    order = F.substring("source_id", 1, 1)
    return known.where("source_id <> '1-URGENT'").unionByName(extra).select(
        _atlas(),
        "source_id",
        F.when(order == "2", "var_column").when(order == "3", "magic").otherwise("mapping_file").alias("kind"),
        F.when(order == "2", "gene").alias("column"),
    )


def _merged_features(spark, d):
    axis = X.union(_axis(spark, d))
    return axis.where("target_ord % 40 <> 3").select(F.lit("merged").alias("dataset_id"), "feature_id").unionByName(
        axis.where("target_ord % 40 = 5").select(F.lit("merged").alias("dataset_id"), F.concat(F.lit("new_"), F.col("feature_id")).alias("feature_id"))
    )


def _merged_declared(spark, d):
    return _axis(spark, d).agg(F.array_sort(F.collect_set("source_id")).alias("source_dataset_ids")).select(
        F.lit("merged").alias("dataset_id"), F.lit("union").alias("feature_merge_policy"), F.lit(None).cast("string").alias("reference_dataset_id"), "source_dataset_ids"
    )


FEATURES = {
    "source_features": _clean_axis,
    "mask": _mask,
    "masked_entries": _masked_entries,
    "source_entries": _masked_entries,
    "derived": _merged_declared,
    "merged_features": _merged_features,
    "mask_metadata": lambda spark, d: _axis(spark, d).select("source_id").distinct().select(
        F.concat(F.lit("m_"), F.col("source_id")).alias("dataset_id"),
        F.when(F.col("source_id") == "1-URGENT", "other").otherwise("feature_measured_by_source").alias("mask_key"),
        F.when(F.col("source_id") == "2-HIGH", 1).otherwise(0).alias("placeholder_value"),
        F.when(F.col("source_id") == "3-MEDIUM", " ").otherwise("zero means not measured").alias("description"),
    ),
    "provenance": _stored_provenance,
    "harmonization_sources": _kinds,
    "harmonization": _harmonization("1.0", "all_challenge_sources"),
    "harmonized_features": _harmonized_features,
    "harmonized_entries": _harmonized_entries,
}
DIRTY_FEATURES = {
    **FEATURES,
    "source_features": _named_axis,
    "provenance": _bad_provenance,
    "harmonization_sources": _bad_kinds,
    "harmonization": _harmonization("2.0", "all_challenge_sources"),
}
NO_METADATA = {**FEATURES, "harmonization": _harmonization("", "all_challenge_sources")}

_FEAT = using(
    "feat",
    "rna",
    "obs",
    more="""mk AS (SELECT f.feature_id, s.source_id, EXISTS (SELECT 1 FROM feat g WHERE g.feature_id = f.feature_id AND g.source_id = s.source_id) AS measured,
      CAST(substr(f.feature_id, 2) AS BIGINT) % 97 = 0 AS flipped FROM (SELECT DISTINCT feature_id FROM feat) f, (SELECT DISTINCT source_id FROM feat) s),
    un AS (SELECT feature_id, row_number() OVER (ORDER BY s, o) - 1 AS t FROM (SELECT feature_id, min(source_ord) AS s, arg_min(feature_ord, source_ord) AS o FROM feat GROUP BY 1)),
    ci AS (SELECT canonical_id, row_number() OVER (ORDER BY o, canonical_id) - 1 AS t FROM (SELECT canonical_id, min(feature_ord) FILTER (source_ord = 1) AS o FROM feat
      GROUP BY 1 HAVING count(DISTINCT source_id) = 5)),
    pv AS (SELECT DISTINCT canonical_id, source_id, CAST(substr(canonical_id, 2) AS BIGINT) AS n FROM feat)""",
)
_AT = "SELECT 'atlas' AS dataset_id, {s} AS sample FROM "
_ONE = "SELECT DISTINCT 'atlas' AS dataset_id, {s} AS sample FROM "
_all(
    FEATURES,
    _FEAT,
    {
        "missing_feature_measurement_mask": "SELECT DISTINCT 'merged' AS dataset_id, 'feature_measured_by_source' AS sample FROM un",
        "invalid_feature_measurement_mask": _AT.format(s="feature_id || '/' || source_id") + "mk WHERE flipped",
        "missing_feature_measurement_metadata": _ONE.format(s="'atlas'") + "mk",
        "invalid_feature_measurement_metadata": "SELECT DISTINCT 'm_' || source_id AS dataset_id, CASE WHEN source_ord = 1 THEN 'other' ELSE 'feature_measured_by_source' END AS sample FROM feat WHERE source_ord <= 3",
        "nonzero_unmeasured_feature": _AT.format(s="rna.feature_id || '/' || sample_id")
        + "rna JOIN obs USING (obs_id) JOIN mk ON mk.feature_id = rna.feature_id AND mk.source_id = sample_id WHERE measured = flipped",
        "feature_harmonization_hash_mismatch": _ONE.format(s="'3-MEDIUM'") + "un",
        "harmonized_feature_intersection_mismatch": _AT.format(s="canonical_id") + "ci WHERE t % 50 = 7",
        "harmonized_matrix_mismatch": "SELECT DISTINCT 'atlas' AS dataset_id, rna.obs_id || '/' || canonical_id AS sample FROM rna JOIN obs USING (obs_id)"
        " JOIN feat ON feat.feature_id = rna.feature_id AND feat.source_id = sample_id WHERE rna.obs_ord % 500 = 0",
        "feature_merge_policy_mismatch": "SELECT 'merged' AS dataset_id, feature_id AS sample FROM un WHERE t % 40 = 3 UNION ALL SELECT 'merged', 'new_' || feature_id FROM un WHERE t % 40 = 5",
    },
)
_all(NO_METADATA, _FEAT, {"missing_feature_harmonization_metadata": _ONE.format(s="'rna'") + "un"})
_all(
    {**FEATURES, "provenance": _wrong_provenance},
    _FEAT,
    {
        "harmonized_feature_provenance_mismatch": _AT.format(s="canonical_id || '/' || source_id")
        + "pv JOIN ci USING (canonical_id) WHERE n % 50 = 1 AND source_id = '1-URGENT'"
    },
)
_all(
    DIRTY_FEATURES,
    _FEAT,
    {
        "invalid_feature_harmonization_metadata": _ONE.format(s="'rna'") + "un",
        "missing_harmonized_source_features": _AT.format(s="s") + "(SELECT unnest(['5-LOW', '9-GONE']) AS s)",
        "invalid_harmonized_source_features": _AT.format(s="canonical_id") + "pv WHERE source_id <> '5-LOW' AND n % 50 IN (1, 2, 3)",
        "missing_harmonization_source_modality": _ONE.format(s="'9-GONE'") + "un",
        "missing_harmonization_source_metadata": _ONE.format(s="'1-URGENT'") + "un",
        "invalid_harmonization_mapping_kind": _ONE.format(s="'3-MEDIUM'") + "un",
        "invalid_harmonization_var_column": _ONE.format(s="'2-HIGH'") + "un",
        "invalid_harmonization_var_values": _AT.format(s="feature_id") + "feat WHERE source_ord = 2 AND feature_ord % 401 = 0",
        "unknown_harmonized_source_feature": _AT.format(s="'zz'") + "pv WHERE source_id = '4-NOT SPECIFIED' AND n % 50 = 4",
    },
)


# --- splits, points and predictions -------------------------------------------------------------
def _split_rows(spark, d):
    from quiltomics.operators.splits import spatial_sides

    sides = spatial_sides(B.observations(spark, d), B.regions(spark))
    leaked = sides.where("side = 'test' AND obs_ord % 10 = 0").withColumn("side", F.lit("train"))
    return sides.unionByName(leaked).select(_atlas(), "side", "source_dataset_id", "source_obs_id")


def _points(spark, d):
    return B.points(spark, d).select(
        F.concat(F.lit("ds_"), F.col("sample_id")).alias("dataset_id"),
        F.substring("truth", 1, 1).alias("sample_id"),
        F.substring("truth", 2, 9).cast("long").alias("type_id"),
        F.element_at("vector", 11).alias("x"),
        F.element_at("vector", 12).alias("y"),
    )


def _predictions(spark, d):
    k = F.col("obs_ord")
    status = (
        F.when(k % 5 == 0, "Uncertain").when(k % 5 == 1, "Mixed").when(k % 5 == 2, "Source").when(k % 97 == 3, "Maybe").otherwise("Predicted")
    )
    return B.points(spark, d).select(
        F.concat(F.lit("ds_"), F.col("sample_id")).alias("dataset_id"),
        k.alias("obs_ord"),
        F.when(k % 50 == 7, "twin").otherwise(F.col("obs_id")).alias("obs_id"),
        F.when(k % 41 == 0, " pad").when(k % 43 == 0, "").otherwise(F.col("truth")).alias("label"),
        status.alias("status"),
        F.when(k % 37 == 0, F.lit(float("inf"))).otherwise(F.element_at("vector", 11)).alias("x"),
        F.element_at("vector", 12).alias("y"),
        F.when((k % 5 != 2) | (k % 4 == 0), F.when(k % 31 == 0, 1.5).otherwise(F.abs(F.element_at("vector", 1)))).alias("confidence"),
        F.when(k % 29 != 0, F.when((k % 5 > 1) | (k % 7 == 0), F.concat(F.lit("CL:"), F.lpad(F.substring("truth", 2, 9), 7, "0")))).alias("ontology_id"),
    )


def _declared_counts(spark, d):
    counts = _points(spark, d).groupBy("dataset_id", "sample_id", "type_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("n", F.when(F.col("type_id") == 3, F.col("n") + 1).otherwise(F.col("n")))


def _declared_bounds(spark, d):
    return (
        _points(spark, d)
        .groupBy("dataset_id", "sample_id")
        .agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
        .withColumn("x_max", F.when(F.col("dataset_id") == "ds_2", F.col("x_max") + 0.5).otherwise(F.col("x_max")))
    )


def _point_categories(spark, d):
    types = _points(spark, d).select("dataset_id", "type_id").distinct()
    return types.where("type_id <> 9").select(
        "dataset_id",
        "type_id",
        F.when(F.col("type_id") == 1, "CL:12").when(F.col("type_id") == 2, None).otherwise("CL:0000001").alias("ontology_id"),
        F.when(F.col("type_id") == 4, "red").otherwise("#00ff00").alias("colour"),
    )


def _sidecars(spark, d):
    return _points(spark, d).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).select(
        "dataset_id",
        (F.col("n") + F.when(F.col("dataset_id") == "ds_1", 1).otherwise(0)).alias("observation_count"),
        F.when(F.col("dataset_id") == "ds_3", "old").otherwise(F.sha2(F.substring("dataset_id", 4, 9), 256)).alias("source_sha256"),
    )


PUBLISHED = {
    "split_rows": _split_rows,
    "points": _points,
    "predictions": _predictions,
    "declared_counts": _declared_counts,
    "declared_bounds": _declared_bounds,
    "point_categories": _point_categories,
    "sidecars": _sidecars,
    "catalogue": _catalogue,
}
_PUB = using(
    "pts",
    "sides",
    more="""p AS (SELECT 'ds_' || sample_id AS dataset_id, obs_ord AS k, obs_id, truth, CAST(substr(truth, 2) AS BIGINT) AS type_id,
      CASE WHEN obs_ord % 5 = 0 THEN 'Uncertain' WHEN obs_ord % 5 = 1 THEN 'Mixed' WHEN obs_ord % 5 = 2 THEN 'Source' WHEN obs_ord % 97 = 3 THEN 'Maybe' ELSE 'Predicted' END AS status,
      obs_ord % 29 <> 0 AND (obs_ord % 5 > 1 OR obs_ord % 7 = 0) AS has_ontology FROM pts)""",
)
_P = "SELECT dataset_id, {s} AS sample FROM p WHERE "
_all(
    PUBLISHED,
    _PUB,
    {
        "train_test_source_overlap": "SELECT 'atlas' AS dataset_id, source_obs_id AS sample FROM sides WHERE side = 'test' AND obs_ord % 10 = 0",
        "sidecar_category_counts": "SELECT DISTINCT dataset_id, 'L/3' AS sample FROM p WHERE type_id = 3",
        "sidecar_observation_count": "SELECT dataset_id, CAST(count(*) AS VARCHAR) AS sample FROM p WHERE dataset_id = 'ds_1' GROUP BY 1",
        "sidecar_bounds": "SELECT DISTINCT dataset_id, 'L' AS sample FROM p WHERE dataset_id = 'ds_2'",
        "sidecar_unknown_category": "SELECT DISTINCT dataset_id, '9' AS sample FROM p WHERE type_id = 9",
        "sidecar_ontology_format": "SELECT DISTINCT dataset_id, 'CL:12' AS sample FROM p WHERE type_id = 1",
        "sidecar_colour_format": "SELECT DISTINCT dataset_id, 'red' AS sample FROM p WHERE type_id = 4",
        "sidecar_stale_checksum": "SELECT DISTINCT dataset_id, 'old' AS sample FROM p WHERE dataset_id = 'ds_3'",
        "prediction_duplicate_observation": "SELECT dataset_id, 'twin' AS sample FROM p WHERE k % 50 = 7 GROUP BY dataset_id HAVING count(*) > 1",
        "prediction_label": _P.format(s="k") + "k % 41 = 0 OR k % 43 = 0",
        "prediction_status": _P.format(s="status") + "status = 'Maybe'",
        "prediction_coordinates": _P.format(s="k") + "k % 37 = 0",
        "prediction_confidence": _P.format(s="k") + "status <> 'Source' AND k % 31 = 0",
        "prediction_source_confidence": _P.format(s="k") + "status = 'Source' AND k % 4 = 0",
        "prediction_ontology_missing": _P.format(s="k") + "status = 'Predicted' AND NOT has_ontology",
        "prediction_ontology_forbidden": _P.format(s="k") + "status IN ('Mixed', 'Uncertain') AND has_ontology",
    },
)


# The report over every rule of the catalogue's tables.
_REPORT = " UNION ALL ".join(
    f"SELECT dataset_id, severity FROM ({ORACLES[f'rule_{code}']})" for code in CODES[id(CATALOGUE)]
)


@query(
    "validation_counts",
    using("cat", "mods", more=_CAT_SQL + f", found AS ({_REPORT})")
    + """SELECT dataset_id, count(severity) FILTER (severity = 'error') AS n_errors, count(severity) FILTER (severity = 'warning') AS n_warnings,
      count(severity) FILTER (severity = 'error') = 0 AS valid FROM (SELECT DISTINCT dataset_id FROM rd) LEFT JOIN found USING (dataset_id) GROUP BY dataset_id""",
)
def _(spark, d):
    tables = Settled(spark, Report(d), CATALOGUE)
    return V.validation_counts(V.settled_findings(tables, CODES[id(CATALOGUE)]), tables["datasets"])


_EVERY = " UNION ALL ".join(f"SELECT dataset_id, severity FROM ({ORACLES[f'rule_{code}']})" for codes in CODES.values() for code in codes)


@query(
    "validation_counts_all",
    f"""SELECT dataset_id, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings
      FROM ({_EVERY}) GROUP BY dataset_id""",
)
def _(spark, d):
    """Errors and warnings of every dataset over all rules: catalogue, matrices, splits, sidecars, predictions."""
    report = Report(d)

    def part(key: int) -> DataFrame:
        return V.settled_findings(Settled(spark, report, CONTEXTS[key]), CODES[key])

    # One after another: side by side they are faster, but their plans do not fit a small driver.
    with hash_joins(spark):
        parts = [part(key) for key in CONTEXTS]
    return V.severity_counts(functools.reduce(DataFrame.unionByName, parts))
