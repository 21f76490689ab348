"""Large tables are read once where several results rest on them."""

from quiltomics import registry
from quiltomics.operators import shards
from quiltomics.plans import composition
from quiltomics.registry import products
from quiltomics.sources import bindings as B
from quiltomics.sources import sinks

FOLDER = "/root/testdata/sf0.001"
registry.load()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entries_of_both_sides_are_aligned_in_one_join(spark):
    obs = spark.createDataFrame(
        [("A", "a1", "s", 0.0, 0.0, "T"), ("B", "b1", "s", 1.0, 0.0, "T")],
        "source_dataset_id string, obs_id string, sample_id string, x double, y double, cell_type string",
    )
    members = spark.createDataFrame([("A", "rna", "a1"), ("B", "rna", "b1")], "source_id string, modality string, obs_id string")
    features = spark.createDataFrame(
        [("rna", "A", 0, "g1", 0), ("rna", "B", 1, "g1", 0), ("rna", "B", 1, "g2", 1)],
        "modality string, source_id string, source_ord long, feature_id string, feature_ord long",
    )
    entries = spark.createDataFrame(
        [("rna", "A", "a1", "g1", 3), ("rna", "A", "a1", "g2", 4), ("rna", "B", "b1", "g2", 5)],
        "modality string, source_id string, obs_id string, feature_id string, value long",
    )
    tables = {"observations": obs, "memberships": members, "features": features, "entries": entries}
    product = composition.composed(tables, {"train": ["A"], "test": ["B"]}, "s", "union")
    assert _plan(product["entries"]).count("Join ") == 1
    got = sorted((r.side, r.obs_id, r.feature_id, r.target_ord, r.value) for r in product["entries"].collect())
    assert got == [("test", "B::b1", "g2", 1, 5), ("train", "A::a1", "g1", 0, 3)]


def test_observations_are_numbered_without_their_rows(spark):
    observed = B.observations(spark, FOLDER)
    samples = shards.sparse_samples(observed, B.memberships(spark, FOLDER), B.entries(spark, FOLDER), ["rna", "protein"])
    numbered = [f for f in samples.inputFiles() if "/placed-" in f]
    assert numbered
    stored = spark.read.parquet(numbered[0].rsplit("/", 1)[0])
    assert not [f for f in stored.schema.fields if f.dataType.typeName() == "array"]


def test_lines_of_an_exchange_are_made_once(spark, monkeypatch):
    kept, write = [], sinks.settled
    monkeypatch.setattr(sinks, "settled", lambda df, name: kept.append(name) or write(df, name))
    products._exchange(spark, FOLDER)
    assert kept == ["exchange-lines"]
