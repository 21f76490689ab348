"""Compositions that must be refused, large files, and files whose splits are dealt out of order."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quiltomics.plans.splits import compose_entries
from quiltomics.sources import sinks
from quiltomics.sources.readers import exchange_sizes, scan_exchange


def axes(spark, **sources):
    rows = [(s, i, f, p) for i, (s, names) in enumerate(sources.items()) for p, f in enumerate(names)]
    return spark.createDataFrame(rows, "source_id string, source_ord long, feature_id string, feature_ord long")


def entries(spark):
    rows = [("a", "c1", "g1", 1.0), ("a", "c1", "g2", 2.0), ("b", "c1", "g2", 3.0)]
    return spark.createDataFrame(rows, "source_id string, obs_id string, feature_id string, value double")


def test_preserve_needs_equal_axes(spark):
    with pytest.raises(ValueError, match="equal axes"):
        compose_entries(entries(spark), axes(spark, a=["g1", "g2"], b=["g2", "g1"]), "preserve")
    with pytest.raises(ValueError, match="equal axes"):
        compose_entries(entries(spark), axes(spark, a=["g1", "g2"], b=["g1"]), "preserve")
    same = compose_entries(entries(spark), axes(spark, a=["g1", "g2"], b=["g1", "g2"]), "preserve")
    assert sorted((r.obs_id, r.target_ord, r.value) for r in same.collect()) == [("a::c1", 0, 1.0), ("a::c1", 1, 2.0), ("b::c1", 1, 3.0)]


def test_intersection_and_reference_need_an_axis(spark):
    with pytest.raises(ValueError, match="in common"):
        compose_entries(entries(spark), axes(spark, a=["g1"], b=["g2"]), "intersection")
    with pytest.raises(ValueError, match="no feature axis"):
        compose_entries(entries(spark), axes(spark, a=["g1"], b=["g2"]), "reference", "z")
    with pytest.raises(ValueError, match="needs a reference"):
        compose_entries(entries(spark), axes(spark, a=["g1"]), "reference")
    with pytest.raises(ValueError, match="unknown feature policy"):
        compose_entries(entries(spark), axes(spark, a=["g1"]), "mixed")


def test_manifest_reads_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "_BLOCK_BYTES", 7)
    contents = {"small.bin": b"x", "other.txt": b"abc" * 100, "with space %41.bin": bytes(range(256)) * 40}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    rows = sinks.file_manifest(spark, str(tmp_path)).collect()
    assert {(r.name, r["size"], r.sha256) for r in rows} == {
        (n, len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()
    }


def test_exchange_reader_ignores_split_order(spark, tmp_path):
    lines = ["%%MatrixMarket matrix coordinate real general", "% a comment", "40 3 120"]
    lines += [f"{r} {c} {r * 10 + c}" for r in range(1, 41) for c in range(1, 4)]
    (tmp_path / "matrix.mtx").write_text("\n".join(lines) + "\n")
    (tmp_path / "observations.tsv").write_text("".join(f"{i}\tc{i}\n" for i in range(40)))
    (tmp_path / "genes.tsv").write_text("".join(f"{i}\tg{i}\n" for i in range(3)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        # Splits end within the head of the file, and the last, short one may come anywhere.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = scan_exchange(spark, str(tmp_path))
        assert rows.count() == 120
        assert rows.agg(F.sum("value")).first()[0] == sum(r * 10 + c for r in range(1, 41) for c in range(1, 4))
        assert exchange_sizes(spark, str(tmp_path)).count() == 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize(
    ("size", "extra", "axis", "message"),
    [
        ("3 3 3", "", "0\tc0\n1\tc1\n", "dimensions"),
        ("2 2 3", "", "0\tc0\n1\tc1\n", "dimensions"),
        ("2 3 4", "", "0\tc0\n1\tc1\n", "declares 4 entries and has 3"),
        ("2 3 4", "3 1 5\n", "0\tc0\n1\tc1\n", "outside"),
        ("2 3 3", "", "0\tc0\n0\tc1\n", "row_ord"),
        ("2 3 3", "", "1\tc0\n2\tc1\n", "row_ord"),
    ],
)
def test_exchange_dimensions_must_match(spark, tmp_path, size, extra, axis, message):
    (tmp_path / "matrix.mtx").write_text(f"%%MatrixMarket matrix coordinate integer general\n{size}\n1 1 5\n2 2 7\n2 3 1\n{extra}")
    (tmp_path / "observations.tsv").write_text(axis)
    (tmp_path / "genes.tsv").write_text("0\tg0\n1\tg1\n2\tg2\n")
    with pytest.raises(ValueError, match=message):
        scan_exchange(spark, str(tmp_path))


def test_harmonisation_findings_name_their_own_dataset(spark):
    """Two derived datasets map the sources they share in different ways; only one of them is wrong."""
    from quiltomics.operators import rules as V

    axis = [(s, o, f, p) for o, s in enumerate(["s1", "s2"]) for p, f in enumerate(["g1", "g2"])]
    rows = lambda schema, *data: spark.createDataFrame(list(data), schema)
    kinds = [("d1", "s1", "identity"), ("d1", "s2", "identity"), ("d2", "s1", "var_column"), ("d2", "s2", "var_column")]
    tables = {
        "harmonization": rows("dataset_id string, source_ids array<string>", ("d1", ["s1", "s2"]), ("d2", ["s1", "s2"])),
        "harmonization_sources": rows("dataset_id string, source_id string, kind string", *kinds),
        "provenance": rows("dataset_id string, source_id string, canonical_id string, raw_ids string"),
        "source_features": rows(
            "source_id string, source_ord long, feature_id string, feature_ord long, symbol string",
            *[(*a, a[2].upper()) for a in axis],
        ),
        "source_entries": rows("source_id string, obs_id string, feature_id string, value long", ("s1", "c1", "g1", 2), ("s2", "c2", "g2", 3)),
        "harmonized_features": rows(
            "dataset_id string, canonical_id string, feature_ord long", ("d1", "g1", 0), ("d1", "g2", 1), ("d2", "G1", 0)
        ),
        "harmonized_entries": rows(
            "dataset_id string, obs_id string, canonical_id string, value long",
            ("d1", "c1", "g1", 2), ("d1", "c2", "g2", 3), ("d2", "c1", "G1", 9),
        ),
    }
    found = V.findings(tables, ["harmonized_feature_intersection_mismatch", "harmonized_matrix_mismatch"]).collect()
    assert {(r.dataset_id, r.code, r.n_bad) for r in found} == {
        ("d2", "harmonized_feature_intersection_mismatch", 1),
        ("d2", "harmonized_matrix_mismatch", 2),
    }
