"""Steps whose plan, shuffles or pairs grew faster than their input."""

import time

import pytest
from pyspark.sql import functions as F

from quiltomics import registry
from quiltomics.operators import rules, scoring, shards
from quiltomics.plans import difficulty as D
from quiltomics.registry import rules as rule_queries
from quiltomics.sources import bindings as B

FOLDER = "/root/testdata/sf0.001"
registry.load()


def _scans(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_repeated_ids_do_not_meet_each_other(spark):
    n = 60_000
    ids = spark.range(n)
    tables = {
        "observations": ids.select(
            F.lit("d").alias("dataset_id"), F.lit(" ").alias("obs_id"), F.lit("s").alias("source_dataset_id"), F.col("id").cast("string").alias("source_obs_id")
        ),
        "memberships": ids.select(F.lit("d").alias("dataset_id"), F.lit("rna").alias("modality"), F.lit(" ").alias("obs_id")),
        "source_memberships": ids.where("id > 0").select(F.lit("rna").alias("modality"), F.lit("s").alias("source_dataset_id"), F.col("id").cast("string").alias("source_obs_id")),
    }
    began = time.time()
    found = rules.RULES["invalid_modality_source_membership"].find(tables).collect()
    assert [tuple(r) for r in found] == [("d", "rna/0")] and time.time() - began < 60


def test_report_is_joined_from_written_parts(spark):
    assert _scans(registry.QUERIES["difficulty_report"](spark, FOLDER)) <= 5


def test_rankings_are_planned_apart(spark):
    means = spark.createDataFrame([("a", "x", 0.6), ("b", "x", 0.8), ("c", "y", 0.8)], "split_id string, challenge_type string, mean_auroc double")
    # Rows in place and the totals of their tasks, for the ranks and for the starts of the groups.
    assert _scans(scoring.percentile_ranks(means, "mean_auroc", ["challenge_type"])) <= 4
    folds = means.selectExpr("split_id", "explode(array(0, 1)) repeat", "0 fold", "mean_auroc auroc", "5L selected_features", "CAST(NULL AS STRING) error")
    report = D.challenge_report(means.select("split_id", "challenge_type"), folds)
    assert _scans(report) <= 3
    found = {r.split_id: (r.difficulty_rank, r.difficulty_percentile, r.same_category_percentile, r.category_size) for r in report.collect()}
    assert found == {"a": (1, 0.0, 0.0, 2), "b": (2, 75.0, 100.0, 2), "c": (2, 75.0, 0.0, 1)}


def test_rule_reports_are_joined_from_written_batches(spark):
    assert _scans(registry.QUERIES["validation_counts"](spark, FOLDER)) <= 8


def test_report_makes_what_tables_share_once(spark, monkeypatch):
    made = []
    for name in ("source_features", "entries"):
        build = getattr(B, name)
        monkeypatch.setattr(B, name, lambda *a, name=name, build=build: made.append(name) or build(*a))
    report = rule_queries.Report(FOLDER)
    for context in (rule_queries.FEATURES, rule_queries.DIRTY_FEATURES):
        tables = rule_queries.Settled(spark, report, context)
        for name in context:
            tables[name]
    assert sorted(made) == ["entries", "source_features"]


def test_steps_of_rules_are_written_once(spark, monkeypatch):
    kept, write = [], rule_queries.settled
    monkeypatch.setattr(rule_queries, "settled", lambda df, name: kept.append(name) or write(df, name))
    tables = rule_queries.Settled(spark, rule_queries.Report(FOLDER), rule_queries.AXES)
    for code in ("two_modality_pairing_required", "unpaired_modalities", "same_unit_mismatch", "partially_shared_mismatch"):
        rules.RULES[code].find(tables)
    assert kept.count("pairing") == 1


def test_counted_axes_need_no_join(spark):
    schema = "dataset_id string, modality string, obs_id string, feature_id string"
    entries = spark.createDataFrame([("d", "m", "o", "f"), ("d", "m", "o", "g"), ("d", "m", "p", "f"), ("d", "m", None, "f")], schema)
    tables = {
        "entries": entries,
        "memberships": spark.createDataFrame([("d", "m", "o"), ("d", "m", "o"), ("d", "m", "q"), ("d", "m", None)], "dataset_id string, modality string, obs_id string"),
        "features": spark.createDataFrame([("d", "m", "f")], "dataset_id string, modality string, feature_id string"),
    }
    found = rules.RULES["x_shape_mismatch"].find(tables)
    assert " Join " not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.sample or "", r.n_bad) for r in found.collect()) == [("", 1), ("g", 1), ("p", 1)]


def test_evaluation_computes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        made.add(1)
        return value

    rows = spark.range(200).select(
        F.lit("s").alias("split_id"),
        seen(F.col("id").cast("string")).alias("obs_id"),
        F.when(F.col("id") < 100, "train").otherwise("test").alias("domain"),
        F.array(*[F.lit(i) for i in range(20)]).alias("indices"),
        F.array(*[((F.col("id") * (i + 3)) % 17).cast("double") for i in range(20)]).alias("values"),
    )
    challenges = spark.createDataFrame([("s", "a")], "split_id string, challenge_type string")
    config = D.DifficultyConfig(repeats=2, folds=2, min_observations=50, max_features=20, components=5)
    assert D.evaluate(challenges, rows, config).collect()[0].status == "success"
    assert made.value == 200


@pytest.mark.parametrize("size", [3, 2_000_000_000])
def test_sums_over_an_axis_of_any_length(spark, size):
    row = spark.createDataFrame([([0, 2], [5.0, 7.0])], "m_indices array<int>, m_values array<double>")
    got = row.select(shards.axis_sum("m", size, lambda v: (v + 1) * 3)).first()[0]
    assert got == 3 * (12 + size)
