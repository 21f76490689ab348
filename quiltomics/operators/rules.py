"""Validation rules: each yields the offending items of its dataset.

A rule is a function from the tables of a catalogue to rows ``dataset_id, sample``.
``findings`` turns them into the report rows ``dataset_id, code, severity, path, n_bad,
sample``; a dataset is valid if it has no error row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltomics import schema
from quiltomics.operators import features as X
from quiltomics.operators import matrix as M
from quiltomics.operators.ordering import numbered
from quiltomics.session import settled

Tables = Mapping[str, DataFrame]

#: Rules of one plan, where a report is made of many.
BATCH = 8


@dataclass(frozen=True)
class Rule:
    """One check: what it finds, how bad that is, and where it is in a dataset.

    What it finds is ``dataset_id, sample``, one row each, or with ``n_bad`` where a row stands for several alike.
    """

    severity: str
    path: str
    find: Callable[[Tables], DataFrame]
    #: A rule that looks at one row at a time: its table, and the samples it finds in a row.
    table: str = ""
    samples: Callable[[], Column] | None = None


RULES: dict[str, Rule] = {}


def rule(code: str, path: str, severity: str = "error") -> Callable:
    """Register a rule under its code."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        RULES[code] = Rule(severity, path, function)
        return function

    return register


def _row_rule(code: str, path: str, table: str, samples: Callable[[], Column], severity: str = "error") -> None:
    """Register a rule that finds samples (an array of texts, or null) in one row at a time."""

    def find(t: Tables) -> DataFrame:
        return t[table].select("dataset_id", F.explode(samples()).alias("sample"))

    RULES[code] = Rule(severity, path, find, table, samples)


def _rows(code: str, path: str, table: str, condition: Callable[[], Column], sample: str, severity: str = "error") -> None:
    """Register a rule that a row breaks or not."""
    _row_rule(code, path, table, lambda: F.when(condition(), F.array(F.col(sample).cast("string"))), severity)


def _scanned(table: DataFrame, codes: Iterable[str]) -> DataFrame:
    """All row rules of one table in one scan and one aggregate: ``dataset_id, code, n_bad, sample``."""
    none = F.array().cast("array<struct<code:string,sample:string>>")

    def marks(code: str) -> Column:
        samples = RULES[code].samples()
        return F.coalesce(F.transform(samples, lambda s: F.struct(F.lit(code).alias("code"), s.alias("sample"))), none)

    found = table.select("dataset_id", F.explode(F.concat(none, *[marks(c) for c in codes])).alias("m"))
    return found.groupBy("dataset_id", "m.code").agg(F.count(F.lit(1)).alias("n_bad"), F.min("m.sample").alias("sample"))


def findings(tables: Tables, codes: Iterable[str]) -> DataFrame:
    """Report rows of the given rules; the row rules of a table share one scan."""
    wanted = list(dict.fromkeys(codes))
    scans: dict[str, list[str]] = {}
    parts = []
    for code in wanted:
        found = RULES[code]
        if found.table:
            scans.setdefault(found.table, []).append(code)
        else:
            bad = found.find(tables)
            n_bad = F.sum("n_bad") if "n_bad" in bad.columns else F.count(F.lit(1))
            counts = bad.groupBy("dataset_id", F.lit(code).alias("code"))
            parts.append(counts.agg(n_bad.alias("n_bad"), F.min("sample").alias("sample")))
    parts += [_scanned(tables[name], own) for name, own in scans.items()]
    known = F.create_map(*[
        item
        for code in wanted
        for item in (F.lit(code), F.struct(F.lit(RULES[code].severity).alias("severity"), F.lit(RULES[code].path).alias("path")))
    ])
    return reduce(DataFrame.unionByName, parts).withColumn("_rule", known[F.col("code")]).select(
        "dataset_id", "code", "_rule.severity", "_rule.path", "n_bad", "sample"
    )


def _step(name: str) -> Callable:
    """A step of several rules: tables that keep steps (a report's) are asked for it."""

    def wrap(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        return lambda t: t.step(name, build) if hasattr(t, "step") else build(t)

    return wrap


def settled_findings(tables: Tables, codes: Iterable[str]) -> DataFrame:
    """The same report rows, ``BATCH`` rules that look beyond one row at a time, each batch written before the next is planned.

    One plan over all rules keeps the driver busy with its text at every stage, which grows with the square of the rules.
    """
    wanted = list(dict.fromkeys(codes))
    rest = [c for c in wanted if not RULES[c].table]
    batches = [[c for c in wanted if RULES[c].table], *[rest[i : i + BATCH] for i in range(0, len(rest), BATCH)]]
    parts = [settled(findings(tables, batch), "findings") for batch in batches if batch]
    return reduce(DataFrame.unionByName, parts)


def severity_counts(report: DataFrame) -> DataFrame:
    """Errors and warnings of the datasets that have any."""
    return report.groupBy("dataset_id").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
    )


def validation_counts(report: DataFrame, datasets: DataFrame) -> DataFrame:
    """Errors, warnings and verdict of every dataset."""
    counts = severity_counts(report)
    return (
        datasets.select("dataset_id")
        .distinct()
        .join(counts, "dataset_id", "left")
        .select(
            "dataset_id",
            F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
            F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"),
            (F.coalesce("n_errors", F.lit(0)) == 0).alias("valid"),
        )
    )


def _absent(column: str) -> Column:
    return F.col(column).isNull()


def _blank(column: str) -> Column:
    return F.trim(column) == ""


def _no_list(column: str) -> Column:
    """No list of unique non-blank texts."""
    values = F.col(column)
    return (
        (F.size(values) == 0)
        | F.exists(values, lambda v: F.trim(v) == "")
        | (F.size(F.array_distinct(values)) < F.size(values))
    )


def _different(left: Column, right: Column) -> Column:
    return (F.size(F.array_except(left, right)) > 0) | (F.size(F.array_except(right, left)) > 0)


# --- metadata shape -----------------------------------------------------------------
_rows("missing_database_metadata", "/uns/database", "datasets", lambda: ~F.col("has_database"), "dataset_id")
_REQUIRED = ("schema_version", "dataset_type", "organism", "tissue", "spatial_unit", "coordinate_unit", "pairing_type")


_row_rule(
    "missing_database_field",
    "/uns/database",
    "datasets",
    lambda: F.when(F.col("has_database"), F.array_compact(F.array(*[F.when(_absent(c), F.lit(c)) for c in _REQUIRED]))),
)


def _invalid_metadata() -> Column:
    problems = {
        "schema_version": F.col("schema_version") != schema.SCHEMA_VERSION,
        "dataset_id": ~F.rlike("dataset_id", F.lit(schema.DATASET_ID_PATTERN)),
        "dataset_type": ~F.col("dataset_type").isin("full", *schema.DERIVED_TYPES),
        "organism": _no_list("organism"),
        "tissue": _no_list("tissue"),
        "spatial_unit": _blank("spatial_unit"),
        "coordinate_unit": _blank("coordinate_unit"),
        "pairing_type": ~F.col("pairing_type").isin("same_unit", "partially_shared"),
    }
    names = F.array_compact(
        F.array(*[F.when(F.coalesce(p, F.lit(True)), F.lit(c)) for c, p in problems.items()])
    )
    return F.when(F.col("has_database"), names)


_row_rule("invalid_database_metadata", "/uns/database", "datasets", _invalid_metadata)


# --- file against document -----------------------------------------------------------
_COMPARED = ("organism", "tissue", "spatial_unit", "coordinate_unit", "pairing_type")


def _compared(t: Tables, test: Callable[[Column, Column], Column]) -> DataFrame:
    pairs = t["datasets"].alias("f").join(t["documents"].alias("d"), "dataset_id")
    names = F.array_compact(
        F.array(*[F.when(test(F.col(f"f.{c}"), F.col(f"d.{c}")), F.lit(c)) for c in _COMPARED])
    )
    return pairs.select("dataset_id", F.explode(names).alias("sample"))


@rule("metadata_field_missing_from_yaml", "/metadata/database")
def _(t: Tables) -> DataFrame:
    return _compared(t, lambda f, d: f.isNotNull() & d.isNull())


@rule("database_metadata_mismatch", "/uns/database")
def _(t: Tables) -> DataFrame:
    return _compared(t, lambda f, d: f != d)


@rule("sample_ids_mismatch", "/metadata/sample_ids")
def _(t: Tables) -> DataFrame:
    pairs = t["datasets"].alias("f").join(t["documents"].alias("d"), "dataset_id")
    return pairs.where(_different(F.col("f.sample_ids"), F.col("d.sample_ids"))).select(
        "dataset_id", F.col("dataset_id").alias("sample")
    )


def _assays(t: Tables) -> DataFrame:
    file = t["modalities"].select("dataset_id", "name", F.struct("technology", "value_type").alias("_file"))
    document = t["document_modalities"].select(
        "dataset_id", "name", F.struct("technology", "value_type").alias("_doc")
    )
    return file.join(document, ["dataset_id", "name"], "full_outer")


@rule("modalities_mismatch", "/metadata/modalities")
def _(t: Tables) -> DataFrame:
    return _assays(t).where("_file IS NULL OR _doc IS NULL").select("dataset_id", F.col("name").alias("sample"))


@rule("assay_metadata_mismatch", "/mod/uns/assay")
def _(t: Tables) -> DataFrame:
    return _assays(t).where(F.col("_file") != F.col("_doc")).select("dataset_id", F.col("name").alias("sample"))


# --- observation and feature axes ------------------------------------------------------
def _repeated(df: DataFrame, keys: list[str], sample: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("dataset_id", F.col(sample).alias("sample"))
    )


def _counted_without(left: DataFrame, right: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """Keys that only the left table has, with its rows: both tables are counted in one aggregate, so neither is sorted for a join."""
    either = left.select(*keys, F.lit(1).alias("_n"), F.lit(False).alias("_there")).unionByName(
        right.select(*keys, F.lit(0).alias("_n"), F.lit(True).alias("_there"))
    )
    counted = either.groupBy(*keys).agg(F.sum("_n").alias("n_bad"), F.bool_or("_there").alias("_there"))
    # A missing key is equal to none.
    unlike = reduce(lambda a, k: a | F.col(k).isNull(), keys, ~F.col("_there"))
    return counted.where((F.col("n_bad") > 0) & unlike).select("dataset_id", F.col(sample).alias("sample"), "n_bad")


def _without(t: Tables, left: DataFrame, right: DataFrame, keys: list[str], sample: str) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti").select(
        "dataset_id", F.col(sample).alias("sample")
    )


@rule("empty_observations", "/obs")
def _(t: Tables) -> DataFrame:
    return _without(t, t["datasets"], t["observations"], ["dataset_id"], "dataset_id")


@rule("duplicate_obs_names", "/obs/index")
def _(t: Tables) -> DataFrame:
    return _repeated(t["observations"], ["dataset_id", "obs_id"], "obs_id")


_rows("blank_obs_name", "/obs/index", "observations", lambda: _blank("obs_id"), "obs_ord")


@rule("unrepresented_global_obs", "/obs/index")
def _(t: Tables) -> DataFrame:
    return _counted_without(t["observations"], t["memberships"], ["dataset_id", "obs_id"], "obs_id")


@rule("modality_obs_not_global", "/mod/obs/index")
def _(t: Tables) -> DataFrame:
    return _counted_without(t["memberships"], t["observations"], ["dataset_id", "obs_id"], "obs_id")


@rule("duplicate_modality_obs_names", "/mod/obs/index")
def _(t: Tables) -> DataFrame:
    return _repeated(t["memberships"], ["dataset_id", "modality", "obs_id"], "obs_id")


_rows("blank_modality_obs_name", "/mod/obs/index", "memberships", lambda: _blank("obs_id"), "obs_ord")


@rule("empty_modality_obs", "/mod")
def _(t: Tables) -> DataFrame:
    declared = t["modalities"].withColumnRenamed("name", "modality")
    return _without(t, declared, t["memberships"], ["dataset_id", "modality"], "modality")


@rule("empty_modality_vars", "/mod")
def _(t: Tables) -> DataFrame:
    declared = t["modalities"].withColumnRenamed("name", "modality")
    return _without(t, declared, t["features"], ["dataset_id", "modality"], "modality")


@rule("duplicate_var_names", "/mod/var/index")
def _(t: Tables) -> DataFrame:
    return _repeated(t["features"], ["dataset_id", "modality", "feature_id"], "feature_id")


_rows("blank_var_name", "/mod/var/index", "features", lambda: _blank("feature_id"), "feature_ord")


# --- samples and cell types -------------------------------------------------------------
def _column_state(t: Tables, column: str) -> DataFrame:
    """Datasets whose column exists, that is, holds any value."""
    return t["observations"].groupBy("dataset_id").agg(
        F.count(column).alias("_present"), F.count(F.lit(1)).alias("_rows")
    )


def _column_missing(t: Tables, column: str) -> DataFrame:
    return _column_state(t, column).where("_present = 0").select("dataset_id", F.lit(column).alias("sample"))


def _column_null(t: Tables, column: str) -> DataFrame:
    # The observations of datasets that have the column; nothing is collected per dataset.
    have = _column_state(t, column).where("_present > 0").select("dataset_id")
    return t["observations"].where(_absent(column)).join(have, "dataset_id", "left_semi").select(
        "dataset_id", F.col("obs_ord").cast("string").alias("sample")
    )


RULES["missing_sample_id"] = Rule("error", "/obs/sample_id", lambda t: _column_missing(t, "sample_id"))
RULES["null_sample_id"] = Rule("error", "/obs/sample_id", lambda t: _column_null(t, "sample_id"))
_rows("blank_sample_id", "/obs/sample_id", "observations", lambda: _blank("sample_id"), "obs_ord")
RULES["null_cell_type"] = Rule("error", "/obs/cell_type", lambda t: _column_null(t, "cell_type"))
_rows(
    "noncanonical_cell_type_label",
    "/obs/cell_type",
    "observations",
    lambda: (F.col("cell_type") == "") | (F.col("cell_type") != F.trim("cell_type")),
    "cell_type",
)


def _by_type(t: Tables, column: str, expected: str) -> DataFrame:
    """Every dataset, if the column has another type than expected."""
    wrong = t["observations"].schema[column].dataType.simpleString() != expected
    return t["observations"].select("dataset_id").distinct().where(F.lit(wrong)).select(
        "dataset_id", F.lit(column).alias("sample")
    )


RULES["invalid_cell_type_dtype"] = Rule("error", "/obs/cell_type", lambda t: _by_type(t, "cell_type", "string"))
RULES["nonrecommended_spatial_dtype"] = Rule("warning", "/obsm/spatial", lambda t: _by_type(t, "x", "float"))
_rows("ordered_cell_type", "/obs/cell_type", "categories", lambda: F.col("ordered"), "category")
_rows(
    "invalid_cell_type_label",
    "/obs/cell_type",
    "categories",
    lambda: F.col("category_type") != "string",
    "category",
)


@rule("unused_cell_type_category", "/obs/cell_type")
def _(t: Tables) -> DataFrame:
    used = t["observations"].select("dataset_id", F.col("cell_type").alias("category"))
    return _without(t, t["categories"], used, ["dataset_id", "category"], "category")


# --- coordinates ---------------------------------------------------------------------------
@rule("missing_spatial", "/obsm/spatial")
def _(t: Tables) -> DataFrame:
    return _column_missing(t, "x")


@rule("invalid_spatial_rank", "/obsm/spatial")
def _(t: Tables) -> DataFrame:
    axes = t["observations"].groupBy("dataset_id").agg(F.count("x").alias("nx"), F.count("y").alias("ny"))
    return axes.where("nx > 0 AND ny = 0").select("dataset_id", F.lit("y").alias("sample"))


@rule("spatial_row_mismatch", "/obsm/spatial")
def _(t: Tables) -> DataFrame:
    return _column_null(t, "x")


@rule("invalid_spatial_dimensions", "/obsm/spatial")
def _(t: Tables) -> DataFrame:
    depth = t["observations"].groupBy("dataset_id").agg(F.count("z").alias("nz"), F.count("x").alias("nx"))
    return depth.where("nz > 0 AND nz < nx").select("dataset_id", F.lit("z").alias("sample"))


_rows(
    "nonnumeric_spatial",
    "/obsm/spatial",
    "observations",
    lambda: F.col("x_raw").isNotNull() & F.col("x_raw").try_cast("double").isNull(),
    "x_raw",
)
_rows(
    "nonfinite_spatial",
    "/obsm/spatial",
    "observations",
    lambda: ~M.is_finite("x") | ~M.is_finite("y"),
    "obs_ord",
)


# --- matrix and assay ------------------------------------------------------------------------
@rule("missing_x", "/mod/X")
def _(t: Tables) -> DataFrame:
    declared = t["modalities"].withColumnRenamed("name", "modality")
    return _without(t, declared, t["entries"], ["dataset_id", "modality"], "modality")


@rule("x_shape_mismatch", "/mod/X")
def _(t: Tables) -> DataFrame:
    def outside(axis: DataFrame, name: str) -> DataFrame:
        return _counted_without(t["entries"], axis, ["dataset_id", "modality", name], name)

    return outside(t["memberships"], "obs_id").unionByName(outside(t["features"], "feature_id"))


@rule("too_few_modalities", "/mod")
def _(t: Tables) -> DataFrame:
    counts = t["modalities"].groupBy("dataset_id").agg(F.countDistinct("name").alias("n"))
    return t["datasets"].join(counts, "dataset_id", "left").where(F.coalesce("n", F.lit(0)) < 2).select(
        "dataset_id", F.coalesce("n", F.lit(0)).cast("string").alias("sample")
    )


_rows("missing_assay", "/mod/uns/assay", "modalities", lambda: _absent("technology") & _absent("value_type"), "name")
_rows(
    "missing_assay_field",
    "/mod/uns/assay",
    "modalities",
    lambda: (F.col("technology").isNotNull() | F.col("value_type").isNotNull())
    & (
        _absent("technology")
        | F.coalesce(_no_list("technology"), F.lit(False))
        | F.coalesce(_blank("value_type"), F.lit(True))
    ),
    "name",
)


def _outside(column: str, values: tuple[str, ...]) -> Callable[[], Column]:
    return lambda: ~F.col(column).isin(*values)


_rows("nonstandard_modality_name", "/mod", "modalities", _outside("name", schema.MODALITY_NAMES), "name", "warning")
_rows("nonstandard_value_type", "/mod/uns/assay/value_type", "modalities", _outside("value_type", schema.VALUE_TYPES), "value_type", "warning")
_rows("unknown_value_type", "/mod/uns/assay/value_type", "modalities", lambda: F.col("value_type") == "unknown", "name", "warning")
_rows("nonstandard_spatial_unit", "/uns/database/spatial_unit", "datasets", _outside("spatial_unit", schema.SPATIAL_UNITS), "spatial_unit", "warning")
_rows("nonstandard_coordinate_unit", "/uns/database/coordinate_unit", "datasets", _outside("coordinate_unit", schema.COORDINATE_UNITS), "coordinate_unit", "warning")


# --- pairing -----------------------------------------------------------------------------------
@_step("pairing")
def _pairing(t: Tables) -> DataFrame:
    k = t["memberships"].groupBy("dataset_id").agg(F.countDistinct("modality").alias("k"))
    return M.pairing_type(t["memberships"]).withColumnRenamed("pairing_type", "computed").join(k, "dataset_id")


@rule("two_modality_pairing_required", "/mod")
def _(t: Tables) -> DataFrame:
    return _pairing(t).where("k = 2 AND computed <> 'same_unit'").select("dataset_id", F.col("computed").alias("sample"))


@rule("unpaired_modalities", "/mod")
def _(t: Tables) -> DataFrame:
    return _pairing(t).where("k >= 2 AND computed = 'unpaired'").select("dataset_id", F.col("computed").alias("sample"))


def _pairing_mismatch(declared: str) -> Callable[[Tables], DataFrame]:
    def find(t: Tables) -> DataFrame:
        return (
            _pairing(t)
            .join(t["datasets"].select("dataset_id", "pairing_type"), "dataset_id")
            .where((F.col("pairing_type") == declared) & (F.col("computed") != declared) & (F.col("k") >= 2))
            .select("dataset_id", F.col("computed").alias("sample"))
        )

    return find


for _declared in ("same_unit", "partially_shared"):
    RULES[f"{_declared}_mismatch"] = Rule("error", "/uns/database/pairing_type", _pairing_mismatch(_declared))


# --- measurement mask ------------------------------------------------------------------------------
@rule("missing_feature_measurement_mask", "/mod/varm/feature_measured_by_source")
def _(t: Tables) -> DataFrame:
    required = t["derived"].where("feature_merge_policy = 'union'").select("dataset_id")
    return required.join(t["mask"].select("dataset_id").distinct(), "dataset_id", "left_anti").select(
        "dataset_id", F.lit("feature_measured_by_source").alias("sample")
    )


@rule("invalid_feature_measurement_mask", "/mod/varm/feature_measured_by_source")
def _(t: Tables) -> DataFrame:
    expected = X.measured_mask(t["source_features"]).withColumnRenamed("measured", "_expected")
    return (
        t["mask"]
        .join(expected, ["feature_id", "source_id"], "left")
        .where(~F.col("measured").eqNullSafe(F.coalesce("_expected", F.lit(False))))
        .select("dataset_id", F.concat_ws("/", "feature_id", "source_id").alias("sample"))
    )


@rule("missing_feature_measurement_metadata", "/mod/uns/feature_measurement")
def _(t: Tables) -> DataFrame:
    masked = t["mask"].select("dataset_id").distinct()
    return _without(t, masked, t["mask_metadata"], ["dataset_id"], "dataset_id")


_rows(
    "invalid_feature_measurement_metadata",
    "/mod/uns/feature_measurement",
    "mask_metadata",
    lambda: (F.col("mask_key") != "feature_measured_by_source")
    | (F.col("placeholder_value") != 0)
    | F.coalesce(_blank("description"), F.lit(True)),
    "mask_key",
)


@rule("nonzero_unmeasured_feature", "/mod/X")
def _(t: Tables) -> DataFrame:
    unmeasured = t["mask"].where(~F.col("measured")).select("dataset_id", "source_id", "feature_id")
    keys = ["dataset_id", "source_id", "feature_id"]
    return t["masked_entries"].where("value <> 0").join(unmeasured, keys, "left_semi").select(
        "dataset_id", F.concat_ws("/", "feature_id", "source_id").alias("sample")
    )


# --- feature harmonisation ---------------------------------------------------------------------------
def _json_list_problem(column: str) -> Column:
    values = F.from_json(column, "array<string>")
    return F.coalesce(
        values.isNull()
        | (F.size(values) == 0)
        | F.exists(values, lambda v: v.isNull() | (v == ""))
        | (F.size(F.array_distinct(values)) < F.size(values)),
        F.lit(True),
    )


def _use() -> Column:
    """One dataset's use of one source: datasets may map a source they share in their own ways."""
    return F.concat_ws("\0", "dataset_id", "source_id")


def _uses(t: Tables, rows: DataFrame) -> DataFrame:
    """Rows of sources, once for every dataset that declares the source, with the use as source."""
    declared = t["harmonization_sources"].select("dataset_id", "source_id").distinct()
    return rows.drop("dataset_id").join(declared, "source_id").withColumn("source_id", _use())


@_step("mapping")
def _mapping(t: Tables) -> DataFrame:
    """Raw to canonical mapping of every harmonised source of every dataset by its declared kind."""
    stored = t["provenance"].where(~_json_list_problem("raw_ids")).select(
        _use().alias("source_id"), F.col("canonical_id").alias("mapped_id"), F.explode(F.from_json("raw_ids", "array<string>")).alias("feature_id")
    )
    kinds = t["harmonization_sources"].select(_use().alias("source_id"), "kind")
    features = _uses(t, t["source_features"].drop("canonical_id")).drop("dataset_id")
    parts = F.split("source_id", "\0")
    return X.map_features(features, kinds, stored).withColumns({"dataset_id": parts[0], "source_id": parts[1]})


@_step("common")
def _common(t: Tables) -> DataFrame:
    """Per dataset the canonical features of all its mapped sources, in the order of the first."""
    mapped = _mapping(t)
    sources = mapped.groupBy("dataset_id").agg(F.countDistinct("source_id").alias("_all"))
    shared = mapped.groupBy("dataset_id", "canonical_id").agg(
        F.countDistinct("source_id").alias("_n"), F.min(F.struct("source_ord", "feature_ord")).alias("_first")
    )
    shared = shared.join(sources, "dataset_id").where(F.col("_n") == F.col("_all"))
    order = [F.col("_first.feature_ord"), F.col("canonical_id")]
    placed = numbered(shared.select("dataset_id", "canonical_id", "_first"), order, ["dataset_id"], "target_ord")
    return placed.select("dataset_id", "canonical_id", "target_ord")


@rule("missing_harmonized_source_features", "/mod/var")
def _(t: Tables) -> DataFrame:
    return _without(t, t["harmonization_sources"], t["provenance"], ["dataset_id", "source_id"], "source_id")


_rows("invalid_harmonized_source_features", "/mod/var", "provenance", lambda: _json_list_problem("raw_ids"), "canonical_id")
_rows("missing_feature_harmonization_metadata", "/mod/uns/feature_harmonization", "harmonization", lambda: _absent("version"), "modality")
_rows(
    "invalid_feature_harmonization_metadata",
    "/mod/uns/feature_harmonization",
    "harmonization",
    lambda: (F.col("version") != "1.0")
    | (F.col("scope") != "all_challenge_sources")
    | (F.col("aggregation") != "sum")
    | (F.col("source_feature_column_prefix") != "source_feature_ids__"),
    "modality",
)


@rule("missing_harmonization_source_modality", "/sources/mod")
def _(t: Tables) -> DataFrame:
    return _without(t, t["harmonization_sources"], t["source_features"], ["source_id"], "source_id")


@rule("missing_harmonization_source_metadata", "/mod/uns/feature_harmonization/sources")
def _(t: Tables) -> DataFrame:
    declared = t["harmonization"].select("dataset_id", F.explode("source_ids").alias("source_id"))
    return _without(t, declared, t["harmonization_sources"], ["dataset_id", "source_id"], "source_id")


_KINDS = ("identity", "var_column", "mapping_file")
_rows("invalid_harmonization_mapping_kind", "/mod/uns/feature_harmonization/sources/kind", "harmonization_sources", _outside("kind", _KINDS), "source_id")
_rows(
    "invalid_harmonization_var_column",
    "/sources/mod/var",
    "harmonization_sources",
    lambda: (F.col("kind") == "var_column") & F.coalesce(F.col("column") != "symbol", F.lit(True)),
    "source_id",
)


@rule("invalid_harmonization_var_values", "/sources/mod/var")
def _(t: Tables) -> DataFrame:
    by_column = t["harmonization_sources"].where("kind = 'var_column'").select("dataset_id", "source_id")
    return (
        t["source_features"]
        .where(F.coalesce(_blank("symbol"), F.lit(True)))
        .join(by_column, "source_id")
        .select("dataset_id", F.col("feature_id").alias("sample"))
    )


@rule("unknown_harmonized_source_feature", "/mod/var")
def _(t: Tables) -> DataFrame:
    raw = t["provenance"].where(~_json_list_problem("raw_ids")).select(
        "dataset_id", "source_id", F.explode(F.from_json("raw_ids", "array<string>")).alias("feature_id")
    )
    by_file = t["harmonization_sources"].where("kind = 'mapping_file'").select("source_id")
    return _without(t, raw.join(by_file, "source_id", "left_semi"), t["source_features"], ["source_id", "feature_id"], "feature_id")


@rule("feature_harmonization_hash_mismatch", "/mod/uns/feature_harmonization/sources")
def _(t: Tables) -> DataFrame:
    from quiltomics.operators.splits import bounded_digest

    text = F.concat("feature_id", F.lit("\0"), "canonical_id", F.lit("\0"))
    digests = bounded_digest(_mapping(t), ["dataset_id", "source_id"], ["feature_ord"], text)
    return (
        t["harmonization_sources"]
        .join(digests, ["dataset_id", "source_id"], "left")
        .where(~F.col("mapping_sha256").eqNullSafe(F.col("digest")))
        .select("dataset_id", F.col("source_id").alias("sample"))
    )


@rule("harmonized_feature_intersection_mismatch", "/mod/var/index")
def _(t: Tables) -> DataFrame:
    stored = t["harmonized_features"].select("dataset_id", "canonical_id", F.col("feature_ord").alias("_stored"))
    return (
        _common(t)
        .join(stored, ["dataset_id", "canonical_id"], "full_outer")
        .where(~F.col("target_ord").eqNullSafe(F.col("_stored")))
        .select("dataset_id", F.col("canonical_id").alias("sample"))
    )


@rule("harmonized_feature_provenance_mismatch", "/mod/var")
def _(t: Tables) -> DataFrame:
    mapped = _mapping(t)
    common = _common(t).select("dataset_id", "canonical_id")
    used = mapped.join(common, ["dataset_id", "canonical_id"], "left_semi").withColumn("source_id", _use()).drop("dataset_id")
    parts = F.split("source_id", "\0")
    expected = X.provenance(used).withColumns({"dataset_id": parts[0], "source_id": parts[1]}).withColumnRenamed("raw_ids", "_expected")
    stored = t["provenance"].join(common, ["dataset_id", "canonical_id"], "left_semi")
    return (
        stored.join(expected, ["dataset_id", "canonical_id", "source_id"], "left")
        .where(~F.col("raw_ids").eqNullSafe(F.col("_expected")))
        .select("dataset_id", F.concat_ws("/", "canonical_id", "source_id").alias("sample"))
    )


@rule("harmonized_matrix_mismatch", "/mod/X")
def _(t: Tables) -> DataFrame:
    """Recompute the sums and compare them cell by cell; both sides shuffle on the cell."""
    mapping = _mapping(t).withColumn("source_id", _use()).drop("dataset_id")
    expected = X.harmonize_sum(_uses(t, t["source_entries"]), mapping).withColumnRenamed("value", "_expected")
    stored = t["harmonized_entries"].select("dataset_id", "obs_id", "canonical_id", "value")
    return (
        expected.select("dataset_id", "obs_id", "canonical_id", "_expected")
        .join(stored, ["dataset_id", "obs_id", "canonical_id"], "full_outer")
        .where(~F.coalesce("_expected", F.lit(0)).eqNullSafe(F.coalesce("value", F.lit(0))))
        .select("dataset_id", F.concat_ws("/", "obs_id", "canonical_id").alias("sample"))
    )


# --- coordinate harmonisation --------------------------------------------------------------------------
_rows("missing_coordinate_harmonization_metadata", "/uns/coordinate_harmonization", "coordinate_metadata", lambda: _absent("version"), "dataset_id")


@rule("invalid_coordinate_harmonization_metadata", "/uns/coordinate_harmonization")
def _(t: Tables) -> DataFrame:
    joined = t["coordinate_metadata"].alias("m").join(t["derived"].alias("d"), "dataset_id")
    bad = (
        (F.col("m.version") != "1.0")
        | (F.col("m.spatial_unit") != F.col("d.spatial_unit"))
        | (F.col("m.coordinate_unit") != F.col("d.coordinate_unit"))
    )
    return joined.where(bad).select("dataset_id", F.col("dataset_id").alias("sample"))


@rule("missing_coordinate_source_metadata", "/uns/coordinate_harmonization/sources")
def _(t: Tables) -> DataFrame:
    return _without(t, _declared(t), t["coordinate_rules"], ["dataset_id", "source_id"], "source_id")


_rows(
    "invalid_coordinate_source_rule",
    "/uns/coordinate_harmonization/sources",
    "coordinate_rules",
    lambda: ~F.col("kind").isin("obsm", "obs_columns")
    | ((F.col("kind") == "obs_columns") & (_absent("x_column") | _absent("y_column"))),
    "source_id",
)


@rule("harmonized_coordinate_mismatch", "/obsm/spatial")
def _(t: Tables) -> DataFrame:
    usable = t["coordinate_rules"].where("kind = 'obsm'").select("dataset_id", F.col("source_id").alias("source_dataset_id"))
    source = t["source_observations"].select(
        "source_dataset_id", "source_obs_id", F.col("x").cast("float").alias("_x"), F.col("y").cast("float").alias("_y")
    )
    return (
        t["observations"]
        .join(usable, ["dataset_id", "source_dataset_id"], "left_semi")
        .join(source, ["source_dataset_id", "source_obs_id"])
        .where(~F.col("x").cast("float").eqNullSafe(F.col("_x")) | ~F.col("y").cast("float").eqNullSafe(F.col("_y")))
        .select("dataset_id", F.col("obs_ord").cast("string").alias("sample"))
    )


# --- derivation ------------------------------------------------------------------------------------------
def _declared(t: Tables) -> DataFrame:
    return t["derived"].select("dataset_id", F.explode("source_dataset_ids").alias("source_id"))


def _observed(t: Tables) -> DataFrame:
    return (
        t["observations"]
        .where("source_dataset_id IS NOT NULL")
        .select("dataset_id", F.col("source_dataset_id").alias("source_id"))
        .distinct()
    )


for _column in ("source_dataset_id", "source_obs_id"):
    RULES[f"missing_{_column}"] = Rule(
        "error", f"/obs/{_column}", lambda t, c=_column: _column_missing(t, c)
    )
    RULES[f"invalid_{_column}"] = Rule(
        "error",
        f"/obs/{_column}",
        lambda t, c=_column: _column_null(t, c).unionByName(
            t["observations"].where(_blank(c)).select("dataset_id", F.col("obs_ord").cast("string").alias("sample"))
        ),
    )


@rule("duplicate_source_observation", "/obs")
def _(t: Tables) -> DataFrame:
    keys = ["dataset_id", "source_dataset_id", "source_obs_id"]
    return _repeated(t["observations"].where("source_obs_id IS NOT NULL"), keys, "source_obs_id")


@rule("undeclared_source_dataset", "/obs/source_dataset_id")
def _(t: Tables) -> DataFrame:
    return _without(t, _observed(t), _declared(t), ["dataset_id", "source_id"], "source_id")


@rule("unused_declared_source_dataset", "/uns/database/derivation/source_dataset_ids")
def _(t: Tables) -> DataFrame:
    return _without(t, _declared(t), _observed(t), ["dataset_id", "source_id"], "source_id")


@rule("invalid_subset_sources", "/obs/source_dataset_id")
def _(t: Tables) -> DataFrame:
    counts = _observed(t).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        t["derived"]
        .where("construction_type = 'subset'")
        .join(counts, "dataset_id", "left")
        .where(F.coalesce("n", F.lit(0)) != 1)
        .select("dataset_id", F.coalesce("n", F.lit(0)).cast("string").alias("sample"))
    )


_rows("missing_source_context", "/uns/database/derivation/source_dataset_ids", "derived", lambda: ~F.col("has_context"), "dataset_id")
_rows(
    "harmonization_source_mismatch",
    "/uns/database/derivation",
    "derived",
    lambda: _different(F.col("feature_source_ids"), F.col("coordinate_source_ids")),
    "dataset_id",
)


@rule("missing_source_dataset", "/uns/database/derivation/source_dataset_ids")
def _(t: Tables) -> DataFrame:
    return _without(t, _declared(t), t["source_datasets"], ["source_id"], "source_id")


def _source_flag(code: str, condition: str) -> None:
    def find(t: Tables) -> DataFrame:
        flagged = t["source_datasets"].where(condition).select("source_id")
        return _declared(t).join(flagged, "source_id").select("dataset_id", F.col("source_id").alias("sample"))

    RULES[code] = Rule("error", "/sources", find)


_source_flag("source_read_failed", "NOT readable")
_source_flag("invalid_source_dataset", "readable AND n_errors > 0")
_source_flag("source_not_full", "readable AND (dataset_type <> 'full' OR stored_id <> source_id)")


@rule("source_observation_not_found", "/obs/source_obs_id")
def _(t: Tables) -> DataFrame:
    keys = ["source_dataset_id", "source_obs_id"]
    return (
        t["observations"]
        .where("source_obs_id IS NOT NULL AND source_dataset_id IS NOT NULL")
        .join(t["source_observations"].select(*keys), keys, "left_anti")
        .select("dataset_id", F.col("obs_ord").cast("string").alias("sample"))
    )


def _sample_pairs(t: Tables) -> DataFrame:
    source = t["source_observations"].select(
        "source_dataset_id", "source_obs_id", F.col("sample_id").alias("source_sample_id")
    )
    return t["observations"].join(source, ["source_dataset_id", "source_obs_id"])


@rule("ambiguous_derived_sample_id", "/obs/sample_id")
def _(t: Tables) -> DataFrame:
    pairs = _sample_pairs(t)
    forward = pairs.groupBy("dataset_id", "source_dataset_id", "source_sample_id").agg(
        F.countDistinct("sample_id").alias("n"), F.concat_ws("::", "source_dataset_id", "source_sample_id").alias("sample")
    )
    backward = pairs.groupBy("dataset_id", "sample_id").agg(
        F.countDistinct("source_dataset_id", "source_sample_id").alias("n")
    )
    return (
        forward.where("n > 1")
        .select("dataset_id", "sample")
        .unionByName(backward.where("n > 1").select("dataset_id", F.col("sample_id").alias("sample")))
    )


@rule("noncanonical_composite_sample_id", "/obs/sample_id")
def _(t: Tables) -> DataFrame:
    several = t["derived"].where(F.size("source_dataset_ids") > 1).select("dataset_id")
    canonical = F.concat_ws("::", "source_dataset_id", "source_sample_id")
    return (
        _sample_pairs(t)
        .join(several, "dataset_id", "left_semi")
        .where(~F.col("sample_id").eqNullSafe(canonical))
        .select("dataset_id", F.col("obs_ord").cast("string").alias("sample"))
    )


@rule("invalid_modality_source_membership", "/mod/obs/index")
def _(t: Tables) -> DataFrame:
    pairs = (
        t["observations"]
        .where("source_dataset_id IS NOT NULL AND source_obs_id IS NOT NULL")
        .select("dataset_id", "obs_id", "source_dataset_id", "source_obs_id")
    )
    keys = ["dataset_id", "modality", "source_dataset_id", "source_obs_id"]

    # Only which members there are counts: a repeated id would meet each of its own repetitions.
    def met(members: DataFrame, ids: list[str], side: str) -> DataFrame:
        once = members.select("modality", *ids).repartition(*ids).distinct()  # placed for the join, too
        return pairs.join(once, ids).select(*keys).withColumns({"_a": F.lit(side == "actual"), "_e": F.lit(side == "expected")})

    actual = met(t["memberships"], ["dataset_id", "obs_id"], "actual")
    expected = met(t["source_memberships"], keys[2:], "expected")
    return (
        actual.unionByName(expected)
        .groupBy(*keys)
        .agg(F.bool_or("_a").alias("_a"), F.bool_or("_e").alias("_e"))
        .where("NOT (_a AND _e)")
        .select("dataset_id", F.concat_ws("/", "modality", "source_obs_id").alias("sample"))
    )


@rule("modality_without_source", "/mod")
def _(t: Tables) -> DataFrame:
    have = t["source_modalities"].select("source_id", F.col("name"))
    supplied = _declared(t).join(have, "source_id").select("dataset_id", "name").distinct()
    derived = t["modalities"].join(t["derived"].select("dataset_id"), "dataset_id", "left_semi")
    return _without(t, derived, supplied, ["dataset_id", "name"], "name")


@rule("feature_merge_policy_mismatch", "/mod/var/index")
def _(t: Tables) -> DataFrame:
    """Stored axis against the axis its policy prescribes: members, and order where it is taken over."""
    declared = t["derived"].select("dataset_id", "feature_merge_policy", "reference_dataset_id", F.explode("source_dataset_ids").alias("source_id"))
    supplied = declared.join(t["source_features"].select("source_id", "feature_id", "feature_ord"), "source_id")
    k = supplied.groupBy("dataset_id").agg(F.countDistinct("source_id").alias("k"))
    per_feature = (
        supplied.groupBy("dataset_id", "feature_merge_policy", "feature_id")
        .agg(
            F.countDistinct("source_id").alias("n"),
            F.max(F.when(F.col("source_id") == F.col("reference_dataset_id"), 1).otherwise(0)).alias("in_reference"),
        )
        .join(k, "dataset_id")
        .where(
            F.when(F.col("feature_merge_policy").isin("intersection", "preserve"), F.col("n") == F.col("k"))
            .when(F.col("feature_merge_policy") == "reference", F.col("in_reference") == 1)
            .otherwise(F.lit(True))
        )
        .select("dataset_id", "feature_id", F.lit(1).alias("_e"))
    )
    stored = t["merged_features"].select("dataset_id", "feature_id", F.lit(1).alias("_s"))
    members = (
        stored.join(per_feature, ["dataset_id", "feature_id"], "full_outer")
        .where("_s IS NULL OR _e IS NULL")
        .select("dataset_id", F.col("feature_id").alias("sample"))
    )
    if "feature_ord" not in t["merged_features"].columns:
        return members
    # Order counts where the axis is taken over: neighbours must not swap in any source.
    taken_over = supplied.where(
        (F.col("feature_merge_policy") == "preserve") | (F.col("source_id") == F.col("reference_dataset_id"))
    ).select("dataset_id", "source_id", "feature_id", F.col("feature_ord").alias("_source_ord"))
    both = taken_over.join(
        t["merged_features"].select("dataset_id", "feature_id", F.col("feature_ord").alias("_stored_ord")),
        ["dataset_id", "feature_id"],
    )
    keys = ["dataset_id", "source_id"]
    by_source = numbered(both, [F.col("_source_ord"), F.col("feature_id")], keys, "_p")
    by_store = numbered(both, [F.col("_stored_ord"), F.col("feature_id")], keys, "_q").select(
        *keys, "feature_id", "_q"
    )
    swapped = by_source.join(by_store, [*keys, "feature_id"]).where("_p <> _q")
    return members.unionByName(swapped.select("dataset_id", F.col("feature_id").alias("sample")))


# --- train/test pairs ----------------------------------------------------------------------------------------
def _pair(code: str, path: str, condition: Callable[[], Column]) -> None:
    """Register a rule over rows ``split_id as dataset_id, train.*, test.*``."""
    _rows(code, path, "pairs", condition, "dataset_id")


def _of(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def _unlike(name: str) -> Callable[[], Column]:
    return lambda: ~_of("train", name).eqNullSafe(_of("test", name))


_pair("split_file_read_failed", "/", lambda: ~_of("train", "readable") | ~_of("test", "readable"))
_pair("invalid_split_dataset_types", "/", lambda: (_of("train", "dataset_type") != "train") | (_of("test", "dataset_type") != "test"))
_pair("split_id_mismatch", "/uns/database/derivation/split_id", _unlike("split_id"))
_pair("challenge_type_mismatch", "/uns/database/derivation/challenge_type", _unlike("challenge_type"))
_pair("feature_harmonization_mismatch", "/uns/database/derivation/feature_harmonization", _unlike("feature_harmonization"))
_pair(
    "harmonized_feature_order_mismatch",
    "/mod",
    lambda: _of("train", "feature_harmonization").isNotNull()
    & _of("test", "feature_harmonization").isNotNull()
    & ~_of("train", "feature_digest").eqNullSafe(_of("test", "feature_digest")),
)
_pair("coordinate_harmonization_mismatch", "/uns/database/derivation/coordinate_harmonization", _unlike("coordinate_harmonization"))
_pair("missing_source_provenance", "/obs", lambda: ~_of("train", "has_provenance") | ~_of("test", "has_provenance"))


@rule("train_test_source_overlap", "/obs")
def _(t: Tables) -> DataFrame:
    keys = ["dataset_id", "source_dataset_id", "source_obs_id"]
    train = t["split_rows"].where("side = 'train'").select(*keys)
    test = t["split_rows"].where("side = 'test'").select(*keys)
    return train.join(test, keys, "left_semi").select("dataset_id", F.col("source_obs_id").alias("sample"))


_rows("h5mu_read_failed", "/", "files", lambda: ~F.col("readable"), "dataset_id")


# --- derivation document ---------------------------------------------------------------------------------------
def _document(code: str, condition: Callable[[], Column]) -> None:
    _rows(code, "/metadata/database/derivation", "documents", condition, "dataset_id")


def _sources() -> Column:
    return F.col("derivation.source_dataset_ids")


_document("subset_needs_one_source", lambda: (F.col("derivation.construction_type") == "subset") & (F.size(_sources()) != 1))
_document("composite_needs_two_sources", lambda: (F.col("derivation.construction_type") == "composite") & (F.size(_sources()) < 2))
_document(
    "reference_not_a_source",
    lambda: (F.col("derivation.feature_merge_policy") == "reference")
    & ~F.coalesce(F.array_contains(_sources(), F.col("derivation.reference_dataset_id")), F.lit(False)),
)
_document(
    "reference_without_policy",
    lambda: (F.col("derivation.feature_merge_policy") != "reference") & F.col("derivation.reference_dataset_id").isNotNull(),
)
_document(
    "harmonization_needs_intersection",
    lambda: F.col("harmonization_sources").isNotNull() & (F.col("derivation.feature_merge_policy") != "intersection"),
)
_document(
    "harmonization_misses_sources",
    lambda: F.col("harmonization_sources").isNotNull()
    & (F.size(F.array_except(_sources(), F.col("harmonization_sources"))) > 0),
)
_document("full_with_derivation", lambda: (F.col("dataset_type") == "full") & F.col("derivation").isNotNull())
_document("derived_without_derivation", lambda: (F.col("dataset_type") != "full") & F.col("derivation").isNull())


@rule("two_modalities_need_same_unit", "/metadata")
def _(t: Tables) -> DataFrame:
    two = t["document_modalities"].groupBy("dataset_id").agg(F.countDistinct("name").alias("n")).where("n = 2")
    return (
        t["documents"]
        .where("pairing_type <> 'same_unit'")
        .join(two, "dataset_id", "left_semi")
        .select("dataset_id", F.col("pairing_type").alias("sample"))
    )


# --- catalogue -----------------------------------------------------------------------------------------------------
_rows("missing_split_id", "/catalogue", "catalogue", lambda: (F.col("dataset_type") != "full") & _absent("split_id"), "dataset_id")
_rows(
    "invalid_challenge_type",
    "/catalogue",
    "catalogue",
    lambda: (F.col("dataset_type") != "full")
    & ~F.coalesce(F.col("challenge_type").isin(*schema.CHALLENGE_TYPES), F.lit(False)),
    "dataset_id",
)


@rule("inconsistent_challenge_type", "/catalogue")
def _(t: Tables) -> DataFrame:
    kinds = t["catalogue"].where("dataset_type <> 'full' AND split_id IS NOT NULL").groupBy("split_id").agg(
        F.countDistinct("challenge_type").alias("n")
    )
    return kinds.where("n > 1").select(F.col("split_id").alias("dataset_id"), F.col("split_id").alias("sample"))


@rule("duplicate_split_side", "/catalogue")
def _(t: Tables) -> DataFrame:
    sides = t["catalogue"].where("dataset_type <> 'full'").groupBy("split_id", "dataset_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    return sides.where("n > 1").select(F.col("split_id").alias("dataset_id"), F.col("dataset_type").alias("sample"))


# --- published points ----------------------------------------------------------------------------------------------
@rule("sidecar_category_counts", "/samples/categories")
def _(t: Tables) -> DataFrame:
    """Declared category counts of every sample against the points."""
    keys = ["dataset_id", "sample_id", "type_id"]
    actual = t["points"].groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (
        t["declared_counts"]
        .join(actual, keys, "full_outer")
        .where(F.coalesce("n", F.lit(0)) != F.coalesce("_n", F.lit(0)))
        .select("dataset_id", F.concat_ws("/", "sample_id", F.col("type_id").cast("string")).alias("sample"))
    )


@rule("sidecar_observation_count", "/source/observation_count")
def _(t: Tables) -> DataFrame:
    actual = t["points"].groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    return t["sidecars"].join(actual, "dataset_id", "left").where(
        F.col("observation_count") != F.coalesce("_n", F.lit(0))
    ).select("dataset_id", F.coalesce("_n", F.lit(0)).cast("string").alias("sample"))


@rule("sidecar_bounds", "/samples/bounds")
def _(t: Tables) -> DataFrame:
    actual = t["points"].groupBy("dataset_id", "sample_id").agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    )
    off = F.lit(False)
    for declared, found in (("x_min", "_x0"), ("x_max", "_x1"), ("y_min", "_y0"), ("y_max", "_y1")):
        allowed = F.greatest(F.lit(1e-6), 1e-6 * F.greatest(F.abs(declared), F.abs(found)))
        off = off | (F.abs(F.col(declared) - F.col(found)) > allowed)
    return t["declared_bounds"].join(actual, ["dataset_id", "sample_id"]).where(off).select(
        "dataset_id", F.col("sample_id").alias("sample")
    )


@rule("sidecar_unknown_category", "/points")
def _(t: Tables) -> DataFrame:
    return _without(t, t["points"].select("dataset_id", "type_id").distinct().withColumn("sample_type", F.col("type_id").cast("string")), t["point_categories"], ["dataset_id", "type_id"], "sample_type")


_rows(
    "sidecar_ontology_format",
    "/categories/ontology_id",
    "point_categories",
    lambda: F.col("ontology_id").isNotNull() & ~F.rlike("ontology_id", F.lit(schema.ONTOLOGY_ID_PATTERN)),
    "ontology_id",
)
_rows("sidecar_colour_format", "/categories/colour", "point_categories", lambda: ~F.rlike("colour", F.lit(schema.COLOUR_PATTERN)), "colour")


@rule("sidecar_stale_checksum", "/source/sha256")
def _(t: Tables) -> DataFrame:
    known = t["catalogue"].select("dataset_id", F.col("sha256").alias("_sha"))
    return t["sidecars"].join(known, "dataset_id").where(F.col("source_sha256") != F.col("_sha")).select(
        "dataset_id", F.col("source_sha256").alias("sample")
    )


# --- predictions ------------------------------------------------------------------------------------------------------
@rule("prediction_duplicate_observation", "/predictions")
def _(t: Tables) -> DataFrame:
    return _repeated(t["predictions"], ["dataset_id", "obs_id"], "obs_id")


_rows("prediction_label", "/predictions/label", "predictions", lambda: F.coalesce((F.col("label") == "") | (F.col("label") != F.trim("label")), F.lit(True)), "obs_ord")
_rows("prediction_status", "/predictions/status", "predictions", _outside("status", schema.PREDICTION_STATUSES), "status")
_rows("prediction_coordinates", "/predictions", "predictions", lambda: ~M.is_finite("x") | ~M.is_finite("y"), "obs_ord")
_rows(
    "prediction_confidence",
    "/predictions/confidence",
    "predictions",
    lambda: (F.col("status") != "Source")
    & ~F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False)),
    "obs_ord",
)
_rows("prediction_source_confidence", "/predictions/confidence", "predictions", lambda: (F.col("status") == "Source") & F.col("confidence").isNotNull(), "obs_ord")
_rows(
    "prediction_ontology_missing",
    "/predictions/ontology_id",
    "predictions",
    lambda: (F.col("status") == "Predicted")
    & ~F.coalesce(F.rlike("ontology_id", F.lit(schema.ONTOLOGY_ID_PATTERN)), F.lit(False)),
    "obs_ord",
)
_rows("prediction_ontology_forbidden", "/predictions/ontology_id", "predictions", lambda: F.col("status").isin("Mixed", "Uncertain") & F.col("ontology_id").isNotNull(), "obs_ord")


# --- auxiliary records and stored artifacts ------------------------------------------------------------------------------
_rows("auxiliary_id", "/auxiliary/id", "auxiliary", lambda: ~F.rlike("auxiliary_id", F.lit(schema.AUXILIARY_ID_PATTERN)), "auxiliary_id")
_rows("auxiliary_label", "/auxiliary/label", "auxiliary", lambda: (F.trim("label") == "") | (F.length(F.trim("label")) > 200), "auxiliary_id")
_rows("auxiliary_media_type", "/auxiliary/media_type", "auxiliary", lambda: (F.trim("media_type") == "") | (F.length("media_type") > 200) | ~F.contains("media_type", F.lit("/")), "media_type")
_rows("auxiliary_size", "/auxiliary/size", "auxiliary", lambda: F.col("size") < 0, "auxiliary_id")
_rows("auxiliary_sha256", "/auxiliary/sha256", "auxiliary", lambda: ~F.rlike("sha256", F.lit(schema.SHA256_PATTERN)), "auxiliary_id")
_rows("auxiliary_timezone", "/auxiliary/retrieved_at", "auxiliary", lambda: ~F.rlike("retrieved_at", F.lit(r"(Z|[+-]\d{2}:\d{2})$")), "retrieved_at")


@rule("auxiliary_duplicate", "/auxiliary")
def _(t: Tables) -> DataFrame:
    ids = _repeated(t["auxiliary"], ["dataset_id", "auxiliary_id"], "auxiliary_id")
    return ids.unionByName(_repeated(t["auxiliary"], ["dataset_id", "name"], "name"))


def _artifact(code: str, stored: str, declared: str) -> None:
    def find(t: Tables) -> DataFrame:
        known = t["catalogue"].select("dataset_id", F.col(declared).alias("_declared"))
        return t["artifacts"].join(known, "dataset_id").where(~F.col(stored).eqNullSafe(F.col("_declared"))).select(
            "dataset_id", F.col(stored).cast("string").alias("sample")
        )

    RULES[code] = Rule("error", "/manifest", find)


_artifact("artifact_size", "size", "file_size")
_artifact("artifact_checksum", "sha256", "sha256")
_artifact("artifact_schema_version", "schema_version", "schema_version")


@rule("artifact_missing", "/manifest")
def _(t: Tables) -> DataFrame:
    return _without(t, t["catalogue"], t["artifacts"], ["dataset_id"], "dataset_id")
