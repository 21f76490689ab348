"""Separability: same distribution, shifted distribution, failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltomics.plans import difficulty as D

CONFIG = D.DifficultyConfig(repeats=2, folds=3, min_observations=30, max_features=40, components=10)


@pytest.fixture(scope="module")
def report(spark):
    rng = np.random.default_rng(11)
    rows = []
    for split, shift, n in (("same", 0, 80), ("shifted", 6, 80), ("small", 0, 20)):
        for domain in ("train", "test"):
            counts = rng.poisson(3, size=(n, 60)) + (shift if domain == "test" else 0) * (np.arange(60) < 20)
            for i, row in enumerate(counts):
                kept = np.flatnonzero(row)
                rows.append((split, f"{domain}{i}", domain, kept.tolist(), row[kept].astype(float).tolist()))
    data = spark.createDataFrame(rows, "split_id string, obs_id string, domain string, indices array<int>, values array<double>")
    challenges = spark.createDataFrame(
        [("same", "a", None), ("shifted", "a", None), ("small", "b", None), ("broken", "b", "incomplete: missing_test")],
        "split_id string, challenge_type string, problem string",
    )
    return {r.split_id: r for r in D.evaluate(challenges, data, CONFIG).collect()}


def test_scores(report):
    assert 0.3 <= report["same"].mean_auroc <= 0.7
    assert report["shifted"].mean_auroc > 0.9
    assert report["shifted"].difficulty_rank == 2
    assert report["shifted"].domain_shift_score == pytest.approx(2 * (report["shifted"].mean_auroc - 0.5))


def test_failures_stay_in_the_report(report):
    assert report["small"].status == "failed" and report["small"].mean_auroc is None
    assert report["broken"].error == "incomplete: missing_test"


def test_sample_is_balanced_and_repeatable(spark):
    rows = spark.range(300).select(
        F.lit("s").alias("split_id"),
        F.col("id").cast("string").alias("obs_id"),
        F.when(F.col("id") < 100, "train").otherwise("test").alias("domain"),
    )
    first = D.sample_and_folds(rows, CONFIG)
    counts = first.groupBy("repeat", "domain").count().toPandas()
    assert (counts["count"] == 100).all() and len(counts) == 4
    again = D.sample_and_folds(rows.repartition(9), CONFIG)
    key = ["repeat", "domain", "obs_id", "fold"]
    assert set(map(tuple, first.select(*key).collect())) == set(map(tuple, again.select(*key).collect()))


def test_label_swap_mirrors_nothing_but_the_side():
    rng = np.random.default_rng(2)
    score, label = rng.random(50), rng.random(50) < 0.5
    assert D.rank_auroc(score, label) == pytest.approx(1 - D.rank_auroc(score, ~label))


def test_matrix_query_runs_the_default_job_on_the_gene_axis(spark):
    from quiltomics.registry import products

    assert products.MATRIX_CONFIG == D.DifficultyConfig()
    rows = products._matrix_rows(spark, "/root/testdata/sf0.001")
    assert rows.select(F.max(F.array_max("indices"))).first()[0] >= 60
    sampled = D.sample_and_folds(rows, products.MATRIX_CONFIG)
    assert sampled.select("repeat", "fold").distinct().count() == 25


@pytest.fixture(scope="module")
def whole(spark):
    """Three challenges: the same and shifted counts, and one with too few rows."""
    from quiltomics.plans import difficulty_report as R

    rng = np.random.default_rng(12)
    rows, obs, features = [], [], []
    for split, shift, n in (("same", 0, 60), ("shifted", 6, 60), ("small", 0, 20)):
        for domain in ("train", "test"):
            counts = rng.poisson(3, size=(n, 60)) + (shift if domain == "test" else 0) * (np.arange(60) < 20)
            for i, row in enumerate(counts):
                kept = np.flatnonzero(row)
                name = f"{domain}{i}"
                obs.append((split, domain, name, f"slice{i % 3}" if split == "same" else f"{domain}{i % 2}", None if i % 2 else "donor"))
                if i:  # the first row of a side is not valid
                    rows.append((split, name, domain, kept.tolist(), row[kept].astype(float).tolist()))
            # 'same' leaves 20 of the test side's 60 features unmeasured; train has 5 more of its own.
            features += [(split, domain, f"g{j}", not (split == "same" and domain == "test" and j < 20)) for j in range(60)]
            if domain == "train":
                features += [(split, domain, f"own{j}", True) for j in range(5)]
    report = R.whole_report(
        spark.createDataFrame(
            [("same", "a", "counts", None), ("shifted", "a", "intensity", None), ("small", "b", "counts", None), ("broken", "b", "counts", "incomplete")],
            "split_id string, challenge_type string, value_type string, problem string",
        ),
        spark.createDataFrame(obs, "split_id string, domain string, obs_id string, sample_id string, subject string"),
        spark.createDataFrame(features, "split_id string, domain string, feature_id string, measured boolean"),
        spark.createDataFrame(rows, "split_id string, obs_id string, domain string, indices array<int>, values array<double>"),
        CONFIG,
    )
    return {r.split_id: r for r in report.collect()}


def test_whole_report_counts_and_overlap(whole):
    row = whole["same"]
    assert (row.train_observations_total, row.train_observations_valid) == (60, 59)
    assert (row.train_features_total, row.test_features_total, row.common_fully_measured_features) == (65, 60, 40)
    assert row.feature_overlap_fraction == pytest.approx(40 / 60)
    found = {h.column: h for h in row.hierarchy}["sample_id"]
    assert (found.train_unique, found.test_unique, found.overlap, found.domain_disjoint) == (3, 3, 3, False)
    assert {h.column: h.domain_disjoint for h in whole["shifted"].hierarchy}["sample_id"]


def test_whole_report_repeats(whole):
    import hashlib

    for name in ("same", "shifted"):
        row = whole[name]
        assert [r["repeat"] for r in row.repeat_results] == [0, 1]
        for repeat in row.repeat_results:
            assert len(repeat.fold_aurocs) == CONFIG.folds == len(repeat.selected_feature_counts)
            assert repeat.mean_auroc == pytest.approx(np.mean(repeat.fold_aurocs))
            assert repeat.train_observations_used == repeat.test_observations_used == 59
            # All valid rows are in the sample here, so its digest is known.
            ids = sorted(f"train{i}" for i in range(1, 60))
            assert repeat.train_sample_hash == hashlib.sha256(b"".join(i.encode() + b"\0" for i in ids)).hexdigest()
            assert repeat.test_sample_hash != repeat.train_sample_hash
        assert row.mean_auroc == pytest.approx(np.mean([a for r in row.repeat_results for a in r.fold_aurocs]))


def test_whole_report_warnings_and_failures(whole):
    assert {"low_sample_size", "low_feature_overlap", "small_category_pool"} <= set(whole["same"].warnings)
    assert "preprocessed_input" in whole["shifted"].warnings and "preprocessed_input" not in whole["same"].warnings
    assert "hierarchy_domain_aligned:sample_id" in whole["shifted"].warnings
    assert not [w for w in whole["same"].warnings if w.startswith("hierarchy")]
    for name, error in (("small", "too few"), ("broken", "incomplete")):
        row = whole[name]
        assert row.status == "failed" and error in row.error and row.mean_auroc is None and row.warnings is None and row.repeat_results is None
    assert whole["small"].train_observations_total == 20  # what is known stays
