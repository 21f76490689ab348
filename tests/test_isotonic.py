"""Monotone fits merged from many runs, and lookup between knots."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltomics.operators import isotonic
from quiltomics.operators.calibration import alternating_split


def pooled(values):
    stack = []
    for v in values:
        block = [v, 1]
        while stack and stack[-1][0] * block[1] >= block[0] * stack[-1][1]:
            a = stack.pop()
            block = [a[0] + block[0], a[1] + block[1]]
        stack.append(block)
    return np.concatenate([np.full(n, t / n) for t, n in stack])


def brute(raw, outcome):
    order = np.lexsort((np.arange(len(raw)), raw))
    fit = pooled(outcome[order].tolist())
    return {x: min(1.0, max(0.0, float(np.mean(fit[raw[order] == x])))) for x in np.unique(raw)}


def sequences():
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.random(n)
    yield "zero-one", x, (rng.random(n) < x).astype(float)
    yield "distinct blocks", x, np.sort(rng.random(n))[np.argsort(np.argsort(x))]
    yield "saw of real values", x, (np.argsort(np.argsort(x)) % 250) / 250 + rng.random(n) * 1e-3
    yield "falling", x, 1 - x
    yield "ties", np.round(x, 1), (rng.random(n) < x).astype(float)
    yield "half one score", np.where(rng.random(n) < 0.5, 0.25, x), (rng.random(n) < x).astype(float)
    yield "steps", x, np.floor(x * 4) / 4
    yield "falling then rising", x, (x - 0.5) ** 2 * 4
    yield "waves", x, 0.5 + 0.4 * np.sin(x * 40) + 0.1 * x


@pytest.mark.parametrize("name, raw, outcome", list(sequences()), ids=[s[0] for s in sequences()])
@pytest.mark.parametrize("run", [60, 700])
def test_fit_over_many_runs_equals_brute_force(spark, monkeypatch, name, raw, outcome, run):
    monkeypatch.setattr(isotonic, "RUN", run)
    rows = spark.createDataFrame([(i, float(r), float(v)) for i, (r, v) in enumerate(zip(raw, outcome))], "i int, raw double, v double")
    got = {r.x: r.y for r in isotonic.isotonic_fit(rows, "raw", "v", "i").collect()}
    want = brute(raw, outcome)
    assert got.keys() == want.keys()
    assert max(abs(got[x] - want[x]) for x in want) < 1e-9


@pytest.mark.parametrize(
    "rows, message",
    [
        ([], "finite"),
        ([(0, 0.1, 1.0), (1, 0.2, 1.0)], "variation"),
        ([(0, 0.1, 1.0), (1, 0.1, 0.0)], "single raw"),
        ([(0, 0.1, 1.0), (1, None, 0.0)], "finite"),
        ([(0, 0.1, 1.0), (1, math.nan, 0.0)], "finite"),
        ([(0, 0.1, math.inf), (1, 0.2, 0.0)], "finite"),
    ],
)
def test_degenerate_fits_are_refused(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        isotonic.isotonic_fit(spark.createDataFrame(rows, "i int, raw double, v double"), "raw", "v", "i")


def test_small_splits_are_refused(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(30)], "i int, k string")
    assert alternating_split(rows, ["k"], "i", ["one", "two"], least=15).count() == 30
    with pytest.raises(ValueError, match="two"):
        alternating_split(rows.limit(29), ["k"], "i", ["one", "two"], least=15)


def test_lookup_equals_numpy_and_a_hot_score_is_spread(spark):
    rng = np.random.default_rng(1)
    x, y = np.sort(rng.random(400)), np.sort(rng.random(400))
    raw = np.concatenate([rng.random(3000) * 1.4 - 0.2, np.full(4000, x[77]), x, [math.inf, -math.inf]])
    knots = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    rows = spark.createDataFrame([(i, float(v), float(i % 7)) for i, v in enumerate(raw)], "i int, raw double, x double").repartition(6)
    got = isotonic.interpolate(rows, "raw", knots)
    assert got.columns == ["i", "raw", "x", "confidence"]
    values = {r.i: r.confidence for r in got.collect()}
    assert np.allclose([values[i] for i in range(len(raw))], np.interp(raw, x, y))
    # The rows of the one score lie in several tasks of the placement.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = isotonic.last_knots(rows, F.col("raw"), knots).where(F.col("raw") == float(x[77]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.count() == 4001
    tasks = [r["count"] for r in placed.groupBy(F.input_file_name()).count().collect()]
    assert len(tasks) > 1 and max(tasks) < 3000


def test_lookup_of_missing_values_one_knot_and_none(spark):
    rows = spark.createDataFrame([(0, None), (1, math.nan), (2, 0.5), (2, 0.5)], "i int, raw double")
    one = spark.createDataFrame([(0.2, 1.7)], "x double, y double")
    assert sorted((r.i, r.confidence) for r in isotonic.interpolate(rows, "raw", one).where("i = 2").collect()) == [(2, 1.0), (2, 1.0)]
    assert {r.confidence for r in isotonic.interpolate(rows, "raw", one).where("i < 2").collect()} == {None}
    assert {r.confidence for r in isotonic.interpolate(rows, "raw", one.limit(0)).collect()} == {None}
    assert isotonic.interpolate(rows.limit(0), "raw", one).count() == 0
