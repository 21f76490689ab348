"""Tasks of large tables follow the number of rows, and the results do not."""

import compare
import pytest

from quiltomics import registry, session
from quiltomics.sources import bindings as B

FOLDER = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(FOLDER)


def _check(spark, oracle, name, least=1):
    problem, rows, _ = compare.check(spark, oracle, FOLDER, name, registry.QUERIES[name], registry.ORACLES[name])
    assert problem is None and rows >= least


def test_entries_are_dealt_by_their_number(spark, small_tasks):
    lines = B.table(spark, FOLDER, "lineitem").count()
    assert B.entries(spark, FOLDER, "rna").rdd.getNumPartitions() == -(-lines // 100)


def test_collapsed_genes_on_many_tasks(spark, small_tasks, oracle):
    _check(spark, oracle, "collapse_duplicate_genes")


def test_harmonised_sums_on_many_tasks(spark, small_tasks, oracle):
    _check(spark, oracle, "harmonize_sum")


def test_rows_of_challenges_on_many_tasks(spark, small_tasks, oracle):
    _check(spark, oracle, "challenge_rows")


def test_split_contents_on_many_tasks(spark, small_tasks, oracle):
    _check(spark, oracle, "spatial_split")


def test_coordinates_are_not_dealt_by_source(spark, small_tasks, oracle):
    from quiltomics.registry import splits

    plan = splits._placed(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_dataset_id" not in plan
    _check(spark, oracle, "coordinate_problems")


def test_rule_lines_are_dealt_by_their_number(spark, small_tasks, oracle):
    from quiltomics.registry import rules

    lines = B.table(spark, FOLDER, "lineitem").count()
    assert rules._lines(spark, FOLDER).rdd.getNumPartitions() >= lines // 100
    _check(spark, oracle, "rule_blank_var_name")


def test_repeated_names_on_many_tasks(spark, small_tasks, oracle):
    _check(spark, oracle, "rule_duplicate_var_names", 0)  # this size has none


def test_shapes_on_many_tasks(spark, small_tasks, oracle):
    _check(spark, oracle, "rule_x_shape_mismatch")


def test_entries_are_counted_before_they_meet_the_axes(spark):
    """Every entry breaks both axes; what meets an axis is a row for each of its items, not each entry."""
    from quiltomics.operators import rules

    entries = spark.range(600).selectExpr("'d' AS dataset_id", "'rna' AS modality", "CAST(id % 20 AS STRING) AS obs_id", "CAST(id % 30 AS STRING) AS feature_id", "1L AS value")
    axes = {"entries": entries, "memberships": entries.where("false"), "features": entries.where("false")}
    found = rules.RULES["x_shape_mismatch"].find(axes)
    assert found.count() == 20 + 30
    report = rules.findings(axes, ["x_shape_mismatch"]).collect()
    assert [(r.n_bad, r.sample) for r in report] == [(1200, "0")]


def test_modalities_of_rule_lines_join_once(spark):
    from quiltomics.registry import rules

    plan = rules._entries(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


@pytest.mark.parametrize("name", ["compose_split", "compose_split_union", "compose_split_reference"])
def test_composed_entries_on_many_tasks(spark, small_tasks, oracle, name):
    _check(spark, oracle, name)


def test_composed_entries_move_once(spark):
    from quiltomics.plans import splits

    entries = spark.createDataFrame([("a", "1", "g1", 2), ("b", "2", "g1", 3), ("b", "2", "g2", 4)], "source_id string, obs_id string, feature_id string, value long")
    axes = spark.createDataFrame([("a", 0, "g1", 0), ("b", 1, "g1", 0), ("b", 1, "g1", 0)], "source_id string, source_ord long, feature_id string, feature_ord long")
    target = spark.createDataFrame([("g1", 0)], "feature_id string, target_ord long")
    composed = splits.compose_entries(entries, axes, "union", target=target, rows=3)
    assert sorted((r.obs_id, r.feature_id, r.value) for r in composed.collect()) == [("a::1", "g1", 2), ("b::2", "g1", 3)]
    assert "LeftSemi" not in composed._jdf.queryExecution().optimizedPlan().toString()


def test_samples_on_many_tasks(spark, small_tasks, oracle):
    _check(spark, oracle, "sample_transform")


def test_migration_on_many_tasks(spark, small_tasks, oracle):
    _check(spark, oracle, "schema_migration_publish")
