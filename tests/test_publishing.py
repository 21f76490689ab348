"""Generations: gate, pointer, manifest, recheck; the migration and gated imports on top of them."""

import os

import pytest
from pyspark.sql import functions as F

from quiltomics.operators.rules import RULES
from quiltomics.plans import migration
from quiltomics.plans.imports import import_datasets
from quiltomics.session import scratch_path
from quiltomics.sources import sinks
from quiltomics.sources.publishing import Publication, PublishRefused

NONE = "dataset_id string, code string, severity string"


def legacy(spark):
    """Two partially shared datasets (observations 1 to 3 and 2 to 4 of their modalities) and one of one modality."""
    obs, members, entries = [], [], []
    for dataset, rna, protein in (("a", (1, 2, 3), (2, 3, 4)), ("b", (5, 6), (6,)), ("c", (8, 9), ())):
        for place in sorted({*rna, *protein}):
            obs.append((dataset, f"cell_{place}", place, float(place)))
        for modality, held in (("rna", rna), ("protein", protein)):
            members += [(dataset, modality, f"cell_{p}", p) for p in held]
            entries += [(dataset, f"cell_{p}", modality, f"g{j}", p * 10 + j) for p in held for j in range(2)]
    return {
        "datasets": spark.createDataFrame(
            [("a", "1.1", "partially_shared", 4, "A"), ("b", "1.1", "partially_shared", 2, "B"), ("c", "1.1", "single", 2, "C")],
            "dataset_id string, schema_version string, pairing_type string, n_obs long, title string",
        ),
        "observations": spark.createDataFrame(obs, "dataset_id string, obs_id string, obs_ord long, x double"),
        "memberships": spark.createDataFrame(members, "dataset_id string, modality string, obs_id string, obs_ord long"),
        "entries": spark.createDataFrame(entries, "dataset_id string, obs_id string, modality string, feature_id string, value int"),
    }


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_migration_trims_numbers_anew_and_reports(spark):
    publication = migration.publish_migration(spark, scratch_path(spark, "p"), legacy(spark), "1.2", ("1.1",))
    tables = publication.tables()
    assert rows(tables["observations"], "dataset_id", "obs_id", "obs_ord", "x") == [
        ("a", "cell_2", 0, 2.0), ("a", "cell_3", 1, 3.0), ("b", "cell_6", 0, 6.0), ("c", "cell_8", 0, 8.0), ("c", "cell_9", 1, 9.0),
    ]
    assert rows(tables["removed"], "dataset_id", "obs_id") == [("a", "cell_1"), ("a", "cell_4"), ("b", "cell_5")]
    assert {r[1] for r in rows(tables["entries"], "dataset_id", "obs_id")} == {"cell_2", "cell_3", "cell_6", "cell_8", "cell_9"}
    assert tables["entries"].count() == 4 * 2 + 2 * 2 + 2 * 2
    assert rows(tables["memberships"], "dataset_id", "modality", "obs_id", "obs_ord")[0] == ("a", "protein", "cell_2", 0)
    assert rows(tables["datasets"], "dataset_id", "schema_version", "pairing_type", "n_obs", "title") == [
        ("a", "1.2", "same_unit", 2, "A"), ("b", "1.2", "same_unit", 1, "B"), ("c", "1.2", "single", 2, "C"),
    ]
    report = {r.dataset_id: r for r in tables["report"].collect()}
    assert (report["a"].old.n_obs, report["a"].new.n_obs, report["a"].n_removed, report["c"].n_removed) == (4, 2, 2, 0)


def test_a_failing_rule_publishes_nothing(spark):
    tables = legacy(spark)
    # No observation of b is in both modalities: it would be empty.
    tables["memberships"] = tables["memberships"].where("NOT (dataset_id = 'b' AND modality = 'protein' AND obs_id = 'cell_6')").unionByName(
        spark.createDataFrame([("b", "protein", "cell_7", 7)], tables["memberships"].schema)
    )
    root = scratch_path(spark, "p")
    with pytest.raises(PublishRefused, match="empty_observations"):
        migration.publish_migration(spark, root, tables, "1.2", ("1.1",))
    publication = Publication(spark, root)
    assert publication.current() is None and publication.tables() == {}
    assert publication.store.names("generations") == [] and publication.store.names("manifests") == []
    with pytest.raises(ValueError, match="another schema version: a, b, c"):
        migration.publish_migration(spark, root, legacy(spark), "1.2", ("1.0",))


@pytest.mark.parametrize(
    "name, change, code",
    [
        ("observations", lambda t: t.where("obs_id <> 'cell_3'"), "observation_count_mismatch"),
        ("observations", lambda t: t.withColumn("obs_ord", F.col("obs_ord") * 2), "observation_order_gap"),
        ("memberships", lambda t: t.where("NOT (obs_id = 'cell_2' AND modality = 'rna')"), "unpaired_modalities"),
        ("datasets", lambda t: t.withColumn("schema_version", F.lit("1.1")), "schema_version_mismatch"),
        ("datasets", lambda t: t.withColumn("pairing_type", F.lit("partially_shared")), "pairing_type_mismatch"),
        ("entries", lambda t: t.withColumn("modality", F.lit("dna")), "unknown_entry"),
        ("removed", lambda t: t.sparkSession.createDataFrame([("a", "cell_2")], "dataset_id string, obs_id string"), "removed_observation_present"),
    ],
)
def test_each_check_of_the_gate(spark, name, change, code):
    tables = migration.migrated(legacy(spark), "1.2")
    assert migration.migration_findings(tables, "1.2").count() == 0
    tables[name] = change(tables[name])
    assert code in {r.code for r in migration.migration_findings(tables, "1.2").collect()}


def test_generations_pointer_recheck_and_roll_back(spark):
    publication = Publication(spark, scratch_path(spark, "p"))
    clean = lambda _: spark.createDataFrame([("d", "odd", "warning")], NONE)
    with pytest.raises(PublishRefused):
        publication.finalise()
    assert publication.publish({"t": spark.range(3)}, clean) == 1
    assert publication.publish({"t": spark.range(5)}, clean) == 2
    assert publication.tables()["t"].count() == 5 and publication.tables(1)["t"].count() == 3
    assert publication.roll_back() == 1 and publication.tables()["t"].count() == 3
    assert publication.publish({"t": spark.range(7)}, clean) == 2
    files = publication.manifest(2).collect()
    assert all(r.name.startswith("t/") and len(r.sha256) == 64 for r in files)
    assert publication.changed_files(2).count() == 0
    part = next(n for n in publication.store.names("generations/gen=2/t") if n.endswith(".parquet"))
    place = publication.store.path(f"generations/gen=2/t/{part}").removeprefix("file:")
    with open(place, "ab") as out:
        out.write(b"x")
    open(os.path.join(os.path.dirname(place), "extra.parquet"), "w").close()
    problems = {r.problem for r in publication.changed_files(2).collect()}
    assert problems == {"size", "unindexed_file"}
    with pytest.raises(PublishRefused, match="changed"):
        publication.finalise()
    assert publication.tables(1)["t"].count() == 3  # the older generation is still there
    assert publication.publish({"t": spark.range(9)}, clean) == 3 and publication.finalise() == 3
    assert publication.store.names("generations") == ["gen=3"] == publication.store.names("pointer") == publication.store.names("manifests")


def test_a_writer_that_dies_leaves_the_old_generation(spark):
    publication = Publication(spark, scratch_path(spark, "p"))
    publication.publish({"t": spark.range(3)}, lambda _: spark.createDataFrame([], NONE))

    def dies(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        publication.publish({"t": spark.range(4)}, dies)
    assert publication.current() == 1 and publication.store.names("generations") == ["gen=1"]


def test_manifest_has_empty_and_nested_files(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    for name, content in (("a.bin", b"abc"), ("empty.bin", b""), ("sub/deep/b c%20.bin", b"x"), ("_hidden/c.bin", b"y"), (".d", b"z"), ("e.txt", b"")):
        (tmp_path / name).write_bytes(content)
    got = {r.name: (r["size"], r.sha256[:8]) for r in sinks.file_manifest(spark, str(tmp_path), "*.bin").collect()}
    assert got == {"a.bin": (3, "ba7816bf"), "empty.bin": (0, "e3b0c442"), "sub/deep/b c%20.bin": (1, "2d711642")}
    assert sinks.file_manifest(spark, str(tmp_path), "*.none").count() == 0


def test_imports_pass_the_gate(spark):
    def tables(*rows):
        return {
            "datasets": spark.createDataFrame([r[:2] for r in rows], "dataset_id string, title string"),
            "observations": spark.createDataFrame([(r[0], r[2]) for r in rows if r[2]], "dataset_id string, obs_id string"),
        }

    publication = Publication(spark, scratch_path(spark, "p"))
    code = "empty_observations"
    assert code in RULES
    assert import_datasets(publication, tables(("a", "A", "o1"), ("b", "B", "o2")), [code]) == 1
    assert import_datasets(publication, tables(("a", "other", "o9"), ("c", "C", "o3")), [code]) == 2
    held = publication.tables()
    assert rows(held["datasets"], "dataset_id", "title") == [("a", "A"), ("b", "B"), ("c", "C")]
    assert rows(held["observations"], "dataset_id", "obs_id") == [("a", "o1"), ("b", "o2"), ("c", "o3")]
    with pytest.raises(PublishRefused, match=code):
        import_datasets(publication, tables(("d", "D", None)), [code])
    assert publication.current() == 2
    with pytest.raises(ValueError, match="mode"):
        import_datasets(publication, tables(), [code], "merge")
