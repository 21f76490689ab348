"""Composed train and test products on small sources."""

import pytest
from pyspark.sql import functions as F

from quiltomics.plans import composition as C
from quiltomics.session import scratch_path
from quiltomics.sources.publishing import Publication, PublishRefused

A, B, D = ("A", ["g2", "g1"], [[2, 1], [20, 10]]), ("B", ["g1", "g3"], [[3, 30], [4, 40]]), ("D", ["g1", "g2", "g4"], [[5, 6, 50], [7, 8, 70]])


def tables(spark, *sources, labels=None, coordinates=0.0):
    observations, members, features, entries = [], [], [], []
    for order, (name, axis, matrix) in enumerate(sources):
        features += [("rna", name, order, feature, place) for place, feature in enumerate(axis)]
        for i, row in enumerate(matrix):
            obs = f"cell_{i}"
            observations.append((name, obs, "shared", float(i) + coordinates, 1.0, (labels or {}).get(name, ["Astro", "Micro"])[i]))
            members.append((name, "rna", obs))
            entries += [("rna", name, obs, feature, value) for feature, value in zip(axis, row)]
    return {
        "observations": spark.createDataFrame(observations, "source_dataset_id string, obs_id string, sample_id string, x double, y double, cell_type string"),
        "memberships": spark.createDataFrame(members, "source_id string, modality string, obs_id string"),
        "features": spark.createDataFrame(features, "modality string, source_id string, source_ord int, feature_id string, feature_ord int"),
        "entries": spark.createDataFrame(entries, "modality string, source_id string, obs_id string, feature_id string, value int"),
    }


def matrix(side):
    """Rows of a side on its merged axis."""
    axis = [r.feature_id for r in side["features"].orderBy("target_ord").collect()]
    rows = {r.obs_id: [0] * len(axis) for r in side["observations"].collect()}
    for r in side["entries"].collect():
        rows[r.obs_id][r.target_ord] = r.value
    return axis, [rows[k] for k in sorted(rows)]


def mask(side):
    return {(r.source_id, r.feature_id) for r in side["measured"].collect()}


def test_intersection(spark):
    side = C.compose_side(tables(spark, A, B), ["A", "B"], "train", "s", "intersection")
    assert matrix(side) == (["g1"], [[1], [10], [3], [4]])
    assert mask(side) == set() and not side["metadata"].first().has_unmeasured_features
    assert [r.obs_id for r in side["observations"].orderBy("obs_id").collect()] == ["A::cell_0", "A::cell_1", "B::cell_0", "B::cell_1"]
    assert {r.sample_id for r in side["observations"].collect()} == {"A::shared", "B::shared"}


def test_union_and_its_mask(spark):
    side = C.compose_side(tables(spark, A, B), ["A", "B"], "train", "s", "union")
    assert matrix(side) == (["g2", "g1", "g3"], [[2, 1, 0], [20, 10, 0], [0, 3, 30], [0, 4, 40]])
    assert mask(side) == {("A", "g2"), ("A", "g1"), ("B", "g1"), ("B", "g3")}
    row = side["metadata"].first()
    assert row.has_unmeasured_features and (row.construction_type, row.pairing_type, row.n_obs) == ("composite", "same_unit", 4)


def test_reference(spark):
    other, reference = ("other", ["r1"], [[1], [2]]), ("reference", ["r2", "r1"], [[5, 6], [7, 8]])
    side = C.compose_side(tables(spark, other, reference), ["other", "reference"], "train", "s", "reference", "reference")
    axis, rows = matrix(side)
    assert axis == ["r2", "r1"] and rows[0] == [0, 1]
    assert mask(side) == {("other", "r1"), ("reference", "r2"), ("reference", "r1")}
    assert side["metadata"].first().reference_dataset_id == "reference"


def test_refusals(spark):
    t = tables(spark, A, ("E", ["z"], [[1], [2]]))
    with pytest.raises(ValueError, match="in common"):
        C.compose_side(t, ["A", "E"], "train", "s", "intersection")
    with pytest.raises(ValueError, match="equal axes"):
        C.compose_side(t, ["A", "E"], "train", "s", "preserve")
    with pytest.raises(ValueError, match="unknown feature policy"):
        C.compose_side(t, ["A"], "train", "s", "other")


def test_labels_stay_only_where_every_source_has_them(spark):
    t = tables(spark, A, B, D, labels={"B": ["Micro", "Oligo"], "D": [None, None]})
    full = C.compose_side(t, ["A", "B"], "train", "s", "union")["observations"]
    assert {r.cell_type for r in full.collect()} == {"Astro", "Micro", "Oligo"}
    part = C.compose_side(t, ["A", "D"], "test", "s", "union")["observations"]
    assert {r.cell_type for r in part.collect()} == {None}


def test_published_after_the_checks(spark):
    t = tables(spark, A, B, D)
    root = scratch_path(spark, "c")
    product = C.composed(t, {"train": ["A", "B"], "test": ["D"]}, "s", "union", challenge_type="cross")
    held = C.publish_composition(spark, root, product).tables()
    assert {(r.dataset_id, r.construction_type) for r in held["metadata"].collect()} == {("s_train", "composite"), ("s_test", "subset")}
    assert held["observations"].groupBy("side").count().count() == 2
    # A subset that measures its whole axis stores no mask.
    assert {r.side for r in held["measured"].collect()} == {"train"}


@pytest.mark.parametrize(
    "sides, change, code",
    [
        ({"train": ["A", "B"], "test": ["B"]}, {}, "train_test_source_overlap"),
        ({"train": ["A", "gone"], "test": ["B"]}, {}, "empty_source"),
        ({"train": ["A"], "test": ["B"]}, {"observations": lambda df: df.withColumn("x", F.lit(float("nan")))}, "nonfinite_coordinates"),
        ({"train": ["A"], "test": ["B"]}, {"observations": lambda df: df.unionByName(df)}, "duplicate_obs_names"),
        ({"train": ["A"], "test": ["B"]}, {"memberships": lambda df: df.where("obs_id <> 'cell_1'")}, "unknown_entry"),
    ],
)
def test_a_failing_check_writes_nothing(spark, sides, change, code):
    t = tables(spark, A, B)
    for name, function in change.items():
        t[name] = function(t[name])
    root = scratch_path(spark, "c")
    with pytest.raises(PublishRefused, match=code):
        C.publish_composition(spark, root, C.composed(t, sides, "s", "union"))
    assert Publication(spark, root).current() is None
