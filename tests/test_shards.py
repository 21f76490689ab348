"""Sparse sample shards: contents, random access, dense batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiltomics.operators import shards
from quiltomics.session import scratch_path

N = 40


@pytest.fixture(scope="module")
def stored(spark):
    obs = [(f"c{i}", 100 + 3 * i, "a" if i % 2 else "b", "s", float(i), 0.0) for i in range(N)]
    observations = spark.createDataFrame(obs, "obs_id string, obs_ord long, source_dataset_id string, sample_id string, x double, y double")
    members = [(m, f"c{i}") for i in range(N) for m in ("rna", "protein") if m == "rna" or i % 3]
    entries = [("rna", f"c{i}", (i * 7 + j * 13) % 500, i + j) for i in range(N) for j in range(4)]
    entries += [("protein", f"c{i}", i % 5, i) for i in range(N)]
    samples = shards.sparse_samples(
        observations,
        spark.createDataFrame(members, "modality string, obs_id string"),
        spark.createDataFrame(entries, "modality string, obs_id string, feature_ord long, value int"),
        ["rna", "protein"],
    )
    mask = spark.createDataFrame([("rna", s, o, s == "a" or o % 2 == 0) for s in "ab" for o in range(6)], "modality string, source_id string, feature_ord long, measured boolean")
    path = scratch_path(spark, "shards")
    shards.write_shards(samples, shards.measured_features(mask), path, 8)
    return shards.SampleShards(spark, path, 8)


def test_samples_are_sparse_on_the_real_axis(stored):
    rows = {r.position: r for r in stored.samples.collect()}
    assert sorted(rows) == list(range(N)) and len(stored) == N
    for i, row in rows.items():
        want = {}
        for j in range(4):
            want[(i * 7 + j * 13) % 500] = i + j
        assert row.obs_id == f"c{i}" and dict(zip(row.rna_indices, row.rna_values)) == {o: v for o, v in want.items() if v}
        assert row.rna_indices == sorted(row.rna_indices) and row.spatial == [float(i), 0.0]
        # No protein row: nothing there, whatever the entries say. Zeros are not stored.
        assert (row.protein_present, row.protein_indices) == ((True, [i % 5]) if i % 3 else (False, []))
    held = {r.source_id: r.measured for r in stored.measured.collect()}
    assert held == {"a": [0, 1, 2, 3, 4, 5], "b": [0, 2, 4]}


def test_gather_keeps_order_and_repeats_and_reads_few_files(stored):
    wanted = [33, 2, 33, -1, 0]
    got = stored.gather(wanted)
    assert [r.obs_id for r in got.orderBy("at").collect()] == ["c33", "c2", "c33", "c39", "c0"]
    assert len(got.select(F.input_file_name()).distinct().collect()) <= 3
    scans = str(got._jdf.queryExecution().executedPlan())
    assert "PartitionFilters: [shard" in scans.replace("[isnotnull(shard#", "[shard#") and "In(position" in scans
    table = stored.spark.createDataFrame(list(enumerate([5, 5, 39])), "at long, position long")
    assert [r.obs_id for r in stored.take(table).orderBy("at").collect()] == ["c5", "c5", "c39"]
    assert stored.gather([]).count() == 0


@pytest.mark.parametrize("index, error", [(N, IndexError), (-N - 1, IndexError), (True, TypeError), (1.0, TypeError), ("1", TypeError)])
def test_bad_indices_are_refused(stored, index, error):
    with pytest.raises(error):
        stored.gather([0, index])


def test_dense_batches(stored, monkeypatch):
    monkeypatch.setattr(shards, "CELLS", 1200)  # two rows at a time

    def sums(batch):
        assert batch["rna"].shape[1] == 500 and batch["protein"].shape[1] == 5
        return {"x": pa.array((batch["rna"] + 1).sum(axis=1)), "top": pa.array(batch["protein"].argmax(axis=1))}

    got = shards.map_dense(stored.samples, {"rna": 500, "protein": 5}, ["position"], sums, "position long, x double, top long")
    rows = {r.position: r for r in got.collect()}
    assert len(rows) == N and rows[7].x == 500 + 7 * 4 + 6 and rows[7].top == 2


def test_pairs_need_every_feature(stored, spark):
    sizes = {"rna": 6, "protein": 5}
    assert shards.complete_pairs(stored.samples, stored.measured, "rna", "protein", sizes).count() == 0
    only = stored.samples.where("source_dataset_id = 'a'")
    assert shards.complete_pairs(only, stored.measured, "rna", "protein", sizes).count() == sum(1 for i in range(N) if i % 2 and i % 3)
    assert shards.complete_pairs(stored.samples, stored.measured.limit(0), "rna", "protein", sizes).count() == sum(1 for i in range(N) if i % 3)


def test_empty_table(spark, stored):
    assert np.shape(shards._dense(pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.float64())), 3)) == (0, 3)
