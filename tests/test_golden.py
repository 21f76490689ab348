"""Golden values of the small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltomics.operators import calibration as P
from quiltomics.operators import catalogue as C
from quiltomics.operators import features as X
from quiltomics.operators import matrix as M
from quiltomics.operators import reference as R
from quiltomics.operators import samples as T
from quiltomics.operators import scoring as K
from quiltomics.operators import splits as S


def axis(spark, sources):
    rows = [(s, i, f, j) for i, (s, fs) in enumerate(sources) for j, f in enumerate(fs)]
    return spark.createDataFrame(rows, "source_id string, source_ord long, feature_id string, feature_ord long")


def cells(spark, matrix, features, prefix="o"):
    rows = [
        (f"{prefix}{i}", features[j], int(v))
        for i, row in enumerate(matrix)
        for j, v in enumerate(row)
        if v != 0
    ]
    return spark.createDataFrame(rows, "obs_id string, feature_id string, value long")


def test_regions(spark):
    obs = spark.createDataFrame(
        [("c1", "s1", 0.0, 0.0), ("c2", "s1", 1.0, 1.0), ("c3", "s1", 2.0, 2.0), ("c4", "s1", 3.0, 3.0), ("c5", "s2", 0.0, 0.0), ("c6", "s2", 1.0, 1.0)],
        "obs_id string, sample_id string, x double, y double",
    )
    regions = spark.createDataFrame(
        [("s1", 1.0, 1.0, 1.0, 1.0), ("s1", 3.0, 3.0, 3.0, 3.0)],
        "sample_id string, x_min double, x_max double, y_min double, y_max double",
    )
    test = {r.obs_id for r in S.region_select(obs, regions).collect()}
    train = {r.obs_id for r in S.region_complement(obs, regions).collect()}
    assert test == {"c2", "c4"} and train == {"c1", "c3", "c5", "c6"}
    sides = {r.obs_id: r.side for r in S.spatial_sides(obs, regions).collect()}
    assert {k for k, v in sides.items() if v == "test"} == test


def test_feature_policies(spark):
    features = axis(spark, [("A", ["g2", "g1"]), ("B", ["g1", "g3"])])
    assert [r.feature_id for r in X.intersection(features).orderBy("target_ord").collect()] == ["g1"]
    assert [r.feature_id for r in X.union(features).orderBy("target_ord").collect()] == ["g2", "g1", "g3"]
    mask = {(r.feature_id, r.source_id): r.measured for r in X.measured_mask(features).collect()}
    assert [[mask[f, s] for s in "AB"] for f in ("g2", "g1", "g3")] == [[True, False], [True, True], [False, True]]
    reference = axis(spark, [("other", ["r1"]), ("ref", ["r2", "r1"])])
    assert [r.feature_id for r in X.reference_axis(reference, "ref").orderBy("target_ord").collect()] == ["r2", "r1"]
    assert sum(r.n_mismatch for r in X.preserve_mismatches(features).collect()) == 4
    same = axis(spark, [("A", ["g1", "g2"]), ("B", ["g1", "g2"])])
    assert sum(r.n_mismatch for r in X.preserve_mismatches(same).collect()) == 0


def test_harmonised_sum(spark):
    entries = cells(spark, [[1, 2, 3], [4, 5, 6]], ["r1", "r2", "r3"])
    mapping = spark.createDataFrame([("r1", "G1"), ("r2", "G2"), ("r3", "G2")], "feature_id string, canonical_id string")
    got = {(r.obs_id, r.canonical_id): r.value for r in X.harmonize_sum(entries, mapping).collect()}
    assert got == {("o0", "G1"): 1, ("o0", "G2"): 5, ("o1", "G1"): 4, ("o1", "G2"): 11}


def test_collapse(spark):
    entries = cells(spark, [[1, 2, 0], [0, 3, 4]], ["ENSMUSG1", "ENSMUSG2", "ENSMUSG3"])
    symbols = spark.createDataFrame([("ENSMUSG1", "A"), ("ENSMUSG2", "A "), ("ENSMUSG3", "B")], "feature_id string, symbol string")
    merged, ids = X.collapse_symbols(entries, symbols)
    assert {(r.obs_id, r.canonical_id): r.value for r in merged.collect()} == {("o0", "A"): 3, ("o1", "A"): 3, ("o1", "B"): 4}
    assert {r.canonical_id: r.source_feature_id for r in ids.collect()}["A"] == "ENSMUSG1,ENSMUSG2"


def test_depths(spark):
    entries = cells(spark, [[1, 0, 2], [0, 0, 0], [4, 5, 0], [0, 2, 0]], ["a", "b", "c"])
    observations = spark.createDataFrame([(f"o{i}",) for i in range(4)], "obs_id string")
    summary = {r.name: r.value for r in M.depth_summary(M.row_totals(entries, observations), 3).collect()}
    assert summary["q50"] == 2.5
    assert [summary[f"sample_{i:03d}"] for i in range(3)] == [2, 3, 9]
    assert (summary["observation_count"], summary["zero_observation_count"]) == (4, 1)


def test_downsample(spark):
    entries = cells(spark, [[10, 0], [0, 10], [3, 7]], ["a", "b"])
    observations = spark.createDataFrame([(f"o{i}", i) for i in range(3)], "obs_id string, obs_ord long")
    totals = M.row_totals(entries, observations).join(observations, "obs_id")
    depths = spark.createDataFrame([(0, 4), (1, 5), (2, 6)], "pos long, depth long")
    drawn = M.downsample(entries, M.cyclic_depths(totals, depths, "obs_ord"), 17)
    first = {r.obs_id: r.n for r in drawn.groupBy("obs_id").agg(F.sum("value").alias("n")).collect()}
    assert first == {"o0": 4, "o1": 5, "o2": 6}
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, drawn.collect()))


def test_draws_have_the_multinomial_mean_and_covariance():
    counts, draws, repeats = np.array([5, 0, 20, 75, 100, 0]), 40, 20_000
    sizes = np.full(repeats, len(counts))
    seeds = np.random.default_rng(1).integers(0, 1 << 64, repeats, np.uint64)
    drawn = M.draw_counts(np.tile(counts, repeats), sizes, np.full(repeats, draws), seeds).reshape(repeats, -1)
    share = counts / counts.sum()
    assert (drawn.sum(axis=1) == draws).all() and (drawn[:, counts == 0] == 0).all()
    assert np.abs(drawn.mean(axis=0) - draws * share).max() < 0.1
    assert np.abs(np.cov(drawn.T) - draws * (np.diag(share) - np.outer(share, share))).max() < 0.3


def test_draws_of_a_mixed_batch(monkeypatch):
    monkeypatch.setattr(M, "_DRAWS", 7)  # draws of one observation are placed in several passes
    counts, sizes = np.array([3, 4, 0, 9, 1, 1, 2**40, 2**41]), np.array([2, 0, 2, 2, 2])
    wanted = np.array([7, 5, 4, 9, 50])
    seeds = np.array([1, 2, 3, 4, 5], np.uint64)
    drawn = M.draw_counts(counts, sizes, wanted, seeds)
    assert drawn[:2].tolist() == [3, 4] and drawn[4:6].tolist() == [1, 1]  # as much as there is
    assert drawn[2:4].tolist() == [0, 4] and drawn[6:].sum() == 50
    monkeypatch.setattr(M, "_DRAWS", 1 << 20)
    assert drawn.tolist() == M.draw_counts(counts, sizes, wanted, seeds).tolist()
    alone = M.draw_counts(counts[6:], sizes[4:], wanted[4:], seeds[4:])
    assert alone.tolist() == drawn[6:].tolist()  # the same in any batch
    assert len(M.draw_counts(counts[:0], sizes[:0], wanted[:0], seeds[:0])) == 0


def test_variance_counts_implicit_zeros(spark):
    dense = np.array([[1, 0, 2], [0, 0, 0], [4, 5, 0], [0, 2, 0]])
    entries = cells(spark, dense, ["a", "b", "c"])
    got = {r.feature_id: r.variance for r in M.feature_variance(entries, F.lit(4)).collect()}
    for j, name in enumerate("abc"):
        assert got[name] == pytest.approx(dense[:, j].var())


def test_classification_metrics(spark):
    rows = spark.createDataFrame(
        [("A", "A", 0.9), ("A", "B", 0.4), ("B", "B", 0.8), ("B", "B", 0.7)], "t string, p string, c double"
    )
    metrics = K.classification_metrics(rows, "t", "p").first()
    assert metrics.balanced_accuracy == 0.75 and 0.73 < metrics.macro_f1 < 0.74
    ece = K.expected_calibration_error(rows, F.col("t") == F.col("p"), "c").first().ece
    assert ece == pytest.approx((0.1 + 0.4 + 0.2 + 0.3) / 4)


def test_score_deltas_and_status(spark):
    scores = spark.createDataFrame(
        [("o1", 0, "x", 0.9), ("o1", 1, "y", 0.2), ("o2", 0, "x", 0.4), ("o2", 1, "y", 0.5), ("o3", 0, "x", 0.3)],
        "obs_id string, label_ord int, label string, score double",
    )
    best = {r.obs_id: r for r in K.top_two(scores).collect()}
    assert best["o1"].delta == pytest.approx(0.7) and best["o2"].delta == pytest.approx(0.1)
    assert best["o3"].second is None and best["o3"].delta is None
    knots = spark.createDataFrame([(0.0, 0.05), (1.0, 0.95)], "x double, y double")
    pruned = spark.createDataFrame([("o1", "x"), ("o2", None), ("o3", "x")], "obs_id string, pruned_label string")
    ontology = spark.createDataFrame([("x", "CL:0000001"), ("y", "CL:0000002")], "label string, ontology_id string")
    judged = {r.obs_id: r for r in P.score_status(scores, pruned, knots, ontology, 0.5, 0.2, 0.1).collect()}
    assert judged["o1"].status == "Predicted" and judged["o1"].ontology_id == "CL:0000001"
    assert judged["o1"].confidence == pytest.approx(0.95)
    assert judged["o2"].status == "Uncertain" and judged["o2"].label == "y" and judged["o2"].ontology_id is None
    # One label only: the delta is unknown, so is the verdict.
    assert judged["o3"].status is None


def test_interpolation_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.sort(rng.random(60)) ** 3
    y = np.sort(rng.random(60))
    raw = np.concatenate([rng.random(500) * 1.4 - 0.2, x[:10]])
    knots = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(raw)], "i int, raw double")
    got = P.interpolate(rows, "raw", knots).orderBy("i").toPandas()["confidence"].to_numpy()
    assert np.allclose(got, np.interp(raw, x, y))


def test_isotonic_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    raw = np.round(rng.random(150), 2)
    hit = (rng.random(150) < raw).astype(int)
    rows = spark.createDataFrame([(i, float(r), int(h)) for i, (r, h) in enumerate(zip(raw, hit))], "i int, raw double, hit int")
    got = {r.x: r.y for r in P.isotonic_fit(rows, "raw", "hit", "i").collect()}
    order = np.lexsort((np.arange(150), raw))
    v = hit[order]
    c = np.concatenate([[0], np.cumsum(v)])
    fit = [max(min((c[b + 1] - c[a]) / (b - a + 1) for b in range(i, 150)) for a in range(i + 1)) for i in range(150)]
    for value in np.unique(raw):
        assert got[value] == pytest.approx(np.mean([f for f, r in zip(fit, raw[order]) if r == value]))


def test_auroc_and_percentiles(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "p double, y int")
    assert K.auroc(rows, "p", F.col("y") == 1).first().auroc == pytest.approx((1 + 2 + 1.5) / 6)
    means = spark.createDataFrame([("a", "t", 0.5), ("b", "t", 0.5), ("c", "t", 0.9)], "split_id string, challenge_type string, mean_auroc double")
    ranked = {r.split_id: r for r in K.challenge_rankings(means).collect()}
    assert [ranked[s].difficulty_rank for s in "abc"] == [1, 1, 3]
    assert [ranked[s].difficulty_percentile for s in "abc"] == [25.0, 25.0, 100.0]
    lone = K.challenge_rankings(means.where("split_id = 'a'")).first()
    assert lone.difficulty_percentile == 0.0


def test_composition(spark):
    weights = spark.createDataFrame(
        [("o1", 0, "x", 0.5), ("o1", 1, "y", 0.5), ("o2", 0, "x", 0.0), ("o2", 1, "y", -1.0), ("o3", 0, "x", 3.0), ("o3", 1, "y", float("nan"))],
        "obs_id string, label_ord int, label string, weight double",
    )
    got = {r.obs_id: r for r in P.composition_features(weights).collect()}
    assert got["o1"].label == "x" and got["o1"].entropy == pytest.approx(1.0) and got["o1"].effective_types == pytest.approx(2.0)
    assert not got["o2"].converged and got["o2"].top_weight == 0 and got["o2"].label == "x"
    assert got["o3"].top_weight == 1.0 and got["o3"].entropy == 0


def test_pseudo_spots(spark):
    pool = spark.createDataFrame([(t, f"{t}{i:02d}") for t in ("A", "B") for i in range(10)], "cell_type string, cell_id string")
    design = R.SpotDesign(4, 3, 4, 2, 0.7)
    draws = R.spot_draws(pool.select("cell_type").distinct(), design)
    drawn = R.cyclic_draw(draws, R.holdout_pool(pool))
    assert drawn.select("spot").distinct().count() == 10
    # The cursor advances by one less than the draw: the next spot starts with the last cell.
    pure = [sorted((r.k, r.cell_id) for r in drawn.where(f"spot = {s}").collect()) for s in (0, 1)]
    assert pure[0][-1][1] == pure[1][0][1] == "A03"
    mixed = drawn.where("phase = 1").groupBy("spot", "cell_type").count().toPandas()
    assert sorted(mixed["count"].unique()) == [1, 3]
    assert R.spot_truth(draws).where("mixed").count() == 4


def test_partition_selection(spark):
    rows = [
        (i, f"donor_{d}", f"type {t} ", f"CL:000000{t}")
        for i, (d, t, _n) in enumerate((d, t, n) for d in range(3) for t in (1, 2) for n in range(4))
    ]
    rows += [(900, "donor_0", "Unknown", "CL:0000009"), (901, "donor_0", "cell", "CL:0000000")]
    cells_ = spark.createDataFrame(rows, "cell_id long, donor_id string, cell_type string, ontology_id string")
    chosen = R.select_partitions(cells_, R.Sampling("donor_2", 2, 2, 2, 2, 17))
    counts = {r.partition: r["count"] for r in chosen.groupBy("partition").count().collect()}
    assert counts == {"train": 4, "holdout": 4}
    again = R.select_partitions(cells_.repartition(5), R.Sampling("donor_2", 2, 2, 2, 2, 17))
    assert {r.cell_id for r in chosen.collect()} == {r.cell_id for r in again.collect()}


def test_gather_and_samples(spark):
    obs = spark.createDataFrame(
        [("c1", 0, "s", 0.0, 0.0, "A"), ("c2", 1, "s", 1.0, 1.0, "A"), ("c3", 2, "s", 2.0, 2.0, "B")],
        "obs_id string, obs_ord long, sample_id string, x double, y double, source_dataset_id string",
    )
    requests = spark.createDataFrame([(0, 2), (1, 0), (2, 2), (3, -1), (4, 7)], "pos long, index long")
    got = [(r.obs_id, r.in_range) for r in S.gather(obs, requests).orderBy("pos").collect()]
    assert got == [("c3", True), ("c1", True), ("c3", True), ("c3", True), (None, False)]
    entries = spark.createDataFrame(
        [("rna", f"c{i}", j, float(v)) for i, row in ((1, (1, 10)), (2, (2, 20)), (3, (3, 30))) for j, v in enumerate(row)]
        + [("protein", "c2", 0, 101.0), ("protein", "c3", 0, 102.0)],
        "modality string, obs_id string, feature_ord long, value double",
    )
    members = entries.select("modality", "obs_id").distinct()
    samples = T.training_samples(obs, members, entries, {"rna": F.lit(2), "protein": F.lit(1)})
    rows = {r.obs_id: r for r in samples.collect()}
    assert rows["c1"].rna == [1.0, 10.0] and rows["c1"].protein == [0.0]
    assert not rows["c1"].protein_present and rows["c1"].protein_mask == [False] and rows["c2"].protein_mask == [True]
    pairs = T.prediction_pairs(samples, "rna", "protein")
    moved = T.map_pairs(pairs, lambda s: s.map(lambda v: (v + 1) * 3), lambda s: s.map(lambda v: v * 2 * 4))
    first = {r.obs_id: r for r in moved.collect()}["c2"]
    assert first.x == [9.0, 63.0] and first.y == [808.0]
    mask = spark.createDataFrame(
        [("rna", "A", 0, True), ("rna", "A", 1, True), ("rna", "B", 0, True), ("rna", "B", 1, False)],
        "modality string, source_id string, feature_ord long, measured boolean",
    )
    masked = T.training_samples(obs, members, entries, {"rna": F.lit(2), "protein": F.lit(1)}, T.source_masks(mask))
    assert {r.obs_id: r.rna_mask for r in masked.collect()}["c3"] == [True, False]
    # A used source lacks a feature, so no pair may be served.
    assert T.prediction_pairs(masked, "rna", "protein").count() == 0


def test_challenges(spark):
    derivation = "named_struct('construction_type', 'subset', 'source_dataset_ids', array('f1'), 'split_id', s, 'challenge_type', 'same_slice')"
    rows = [("web", "train", 3), ("web", "test", 3), ("low", "train", 2), ("low", "test", 2), ("none", "train", 1)]
    datasets = spark.createDataFrame([(f"{s}_{t}", t, s, i) for s, t, i in rows], "dataset_id string, dataset_type string, s string, imported_at int").selectExpr(
        "dataset_id", "dataset_type", "dataset_id as title", "'' as description", "array('x') as source",
        "if(dataset_type = 'test', array('lung'), array('Homo sapiens')) as organism", "array('t') as tissue",
        "'cell' as spatial_unit", "array() as keywords", f"{derivation} as derivation", "s as split_id", "imported_at",
    )
    modalities = spark.createDataFrame([], "dataset_id string, name string, technology array<string>")
    aurocs = spark.createDataFrame([("web", 0.8), ("low", 0.6)], "split_id string, auroc double")

    def page(sort, offset=0, limit=10, **wanted):
        found = C.challenge_page(datasets, modalities, C.CatalogueFilter(**wanted), offset, limit, sort, aurocs)
        order = {"difficulty_asc": [F.asc_nulls_last("auroc")], "difficulty_desc": [F.desc_nulls_last("auroc")], "newest": [F.desc("recency")]}
        return [r.split_id for r in found.orderBy(*order[sort]).collect()]

    assert page("difficulty_asc") == ["low", "web", "none"]
    assert page("difficulty_desc") == ["web", "low", "none"]
    assert page("difficulty_desc", 1, 1) == ["low"]
    assert page("newest") == ["web", "low", "none"]
    # One side matches, both sides come back.
    found = C.challenge_page(datasets, modalities, C.CatalogueFilter(organism="lung"), 0, 10)
    assert {(r.train_id, r.test_id) for r in found.collect()} == {("web_train", "web_test"), ("low_train", "low_test")}
    assert {r.split_id: r.status for r in C.build_challenges(datasets).collect()}["none"] == "missing_test"
    assert C.search(datasets, modalities, "50%").count() == 0


def test_order_digest_depends_on_order(spark):
    rows = spark.range(10000).select(F.col("id").alias("o"), F.col("id").cast("string").alias("v"))
    first = S.order_digest(rows, "o", "v").first().digest
    swapped = rows.withColumn("o", F.when(F.col("o") == 1, 2).when(F.col("o") == 2, 1).otherwise(F.col("o")))
    assert first == S.order_digest(rows.repartition(5), "o", "v").first().digest
    assert first != S.order_digest(swapped, "o", "v").first().digest


def test_validity_precedence(spark):
    entries = spark.createDataFrame(
        [("a", "f", float("nan")), ("a", "g", -1.0), ("b", "f", -1.0), ("c", "f", 2.0)], "obs_id string, feature_id string, value double"
    )
    observations = spark.createDataFrame([(c,) for c in "abcd"], "obs_id string")
    got = {r.obs_id: r.reason for r in M.row_validity(entries, observations).collect()}
    assert got == {"a": "non_finite", "b": "negative", "c": None, "d": "zero_total"}
    loose = {r.obs_id: r.reason for r in M.row_validity(entries, observations, "normalized").collect()}
    assert loose == {"a": "non_finite", "b": None, "c": None, "d": None}
    assert math.isclose(M.library_size_log1p(entries.where("obs_id = 'c'")).first().value, math.log1p(10000))


def test_policy_order_rule(spark):
    from quiltomics.operators import rules as V

    features = axis(spark, [("A", ["g1", "g2", "g3"]), ("B", ["g1", "g2", "g3"])])
    declared = spark.createDataFrame(
        [("d", "preserve", None, ["A", "B"])],
        "dataset_id string, feature_merge_policy string, reference_dataset_id string, source_dataset_ids array<string>",
    )

    def stored(order):
        rows = [("d", f, i) for i, f in enumerate(order)]
        table = spark.createDataFrame(rows, "dataset_id string, feature_id string, feature_ord long")
        tables = {"source_features": features, "derived": declared, "merged_features": table}
        return V.findings(tables, ["feature_merge_policy_mismatch"]).collect()

    assert stored(["g1", "g2", "g3"]) == []
    assert stored(["g1", "g3", "g2"])[0].n_bad == 4
    assert stored(["g1", "g2"])[0].sample == "g3"
