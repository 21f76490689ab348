import math
import random

import pytest
from pyspark.sql import functions as F

from quiltomics.llm import search as module
from quiltomics.llm.search import search, search_digest

SCHEMA = "vec_id long, embedding array<double>, score string, rank int"


def brute(rows, wanted, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in sound:
        first[i] = min(first.get(i, v), v)
    found = set()
    for q, own in first.items():
        if wanted(q):
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in sound if i != q)[:k]
            found |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)}
    return found


def rows_of(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("seed, shard, block", [(1, 8192, 1024), (2, 40, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, shard, block):
    monkeypatch.setattr(module, "SHARD", shard)
    monkeypatch.setattr(module, "QUERIES", block)
    rng = random.Random(seed)
    data = [(i, [rng.gauss(0, 0.2) for _ in range(24)]) for i in range(300)]
    data += [(i, data[7][1]) for i in range(300, 360)]  # one common vector: ties
    data += [(400, None), (401, [0.1, None]), (402, [float("nan"), 1.0]), (450, [float("inf")]), (500, [0.5] * 3), (510, []), (7, data[7][1])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in data], SCHEMA)
    assert rows_of(search(table, F.col("id") % 10 == 0)) == brute(data, lambda q: q % 10 == 0, 5)


def test_few_candidates_empty_and_digest(spark):
    data = [(0, [1.0, -0.001]), (50, [0.25, 0.5]), (51, [0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in data], SCHEMA)
    assert rows_of(search_digest(table)) == brute(data, lambda q: q % 50 == 0, 5)
    assert search_digest(table.limit(0)).count() == 0


def test_scores_beyond_the_long_range(spark):
    """Terms beyond the long range are the nearest long, ranks go by exact scores, scores are given as the nearest long."""
    data = [(0, [1e300, 1.0]), (1, [2e300, 3.0]), (2, [-1e300, 5.0]), (3, [1e17, 0.0]), (4, [0.0, 2.0]), (50, [1e200, -1.0]), (51, [1e300, 2.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in data], SCHEMA)
    low, high = -(1 << 63), (1 << 63) - 1
    term = {i: [max(low, min(high, math.floor(256 * x))) for x in v] for i, v in data}
    want = set()
    for q in (0, 50):
        scored = sorted((-sum(a * b for a, b in zip(term[q], v)), i) for i, v in term.items() if i != q)[:5]
        want |= {(q, rank + 1, i, max(low, min(high, -s))) for rank, (s, i) in enumerate(scored)}
    assert rows_of(search_digest(table)) == want


def test_large_components_stay_exact(spark):
    data = [(0, [123_456.75, -9e5]), (1, [9e5, 1 / 3]), (2, [9e5, 2 / 3]), (50, [-123_456.0, 9e5])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in data], SCHEMA)
    assert rows_of(search_digest(table)) == brute(data, lambda q: q % 50 == 0, 5)
