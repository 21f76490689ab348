"""Region selection by tiles: edges, odd rectangles, hot samples."""

import math
import random

import pytest

from quiltomics.operators import splits as S
from quiltomics.operators.tiles import grids, tile_table

POINTS = "obs_id int, sample_id string, x double, y double, note string"
REGIONS = "sample_id string, x_min double, x_max double, y_min double, y_max double"


def brute(points, regions):
    return {
        i for i, s, x, y, _ in points if None not in (s, x, y) and any(
            s == r[0] and None not in r and not any(math.isnan(v) for v in r[1:]) and r[1] <= x <= r[2] and r[3] <= y <= r[4] for r in regions)
    }


def scene(seed):
    rng = random.Random(seed)
    points = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([rng.uniform(-5, 105), float(rng.randrange(100))]), rng.uniform(-5, 105), "n") for i in range(3000)]
    points += [(5000, "hot", None, 1.0, "n"), (5001, "hot", math.nan, 50.0, "n"), (5002, "hot", math.inf, 50.0, "n"), (5003, "hot", -math.inf, 3.0, "n"), (5004, "b", 1e300, -1e300, "n")]
    regions = []
    for _ in range(rng.choice([3, 60])):
        x, y, size = rng.randrange(100), rng.uniform(0, 100), rng.choice([0, 0.5, 5, 60])
        regions.append((rng.choice(["hot", "b"]), float(x), x + size * 1.0, y, y + size))
    regions += [("hot", 5.0, 4.0, 0.0, 9.0), ("hot", None, 4.0, 0.0, 9.0), ("hot", math.nan, 4.0, 0.0, 9.0), (None, 0.0, 9.0, 0.0, 9.0), ("z", 0.0, 1.0, 0.0, 1.0), regions[0]]
    if seed % 2:
        regions.append(("hot", -math.inf, 20.0, -math.inf, math.inf))
    return points, regions


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    points, regions = scene(seed)
    obs, rects = spark.createDataFrame(points, POINTS), spark.createDataFrame(regions, REGIONS)
    want, every = brute(points, regions), {p[0] for p in points}
    chosen = [r.obs_id for r in S.region_select(obs, rects).collect()]
    left = [r.obs_id for r in S.region_complement(obs, rects).collect()]
    assert set(chosen) == want and len(chosen) == len(want)
    assert set(left) == every - want and len(left) == len(every - want)
    sides = S.spatial_sides(obs, rects)
    assert sides.columns == [*obs.columns, "side"]
    assert {(r.obs_id, r.side) for r in sides.collect()} == {(i, "test" if i in want else "train") for i in every}


def test_no_regions_and_no_points(spark):
    points, regions = scene(1)
    obs, rects = spark.createDataFrame(points, POINTS), spark.createDataFrame(regions, REGIONS)
    assert S.region_select(obs, rects.limit(0)).count() == 0
    assert {r.side for r in S.spatial_sides(obs, rects.limit(0)).collect()} == {"train"}
    assert S.spatial_sides(obs.limit(0), rects).count() == 0


def test_one_sample_is_dealt_over_many_tiles(spark):
    """A sample with every row and 10,000 rectangles: many tiles, few rectangles in each."""
    rng = random.Random(9)
    regions = []
    for _ in range(10_000):
        x, y, size = rng.uniform(0, 1e4), rng.uniform(0, 1e4), rng.expovariate(1 / 60)
        regions.append(("only", x, x + size, y, y + size))
    rects = spark.createDataFrame(regions, REGIONS)
    laid = grids(rects)
    tiles = tile_table(rects, laid)
    per_tile = [r["count"] for r in tiles.groupBy("_tx", "_ty").count().collect()]
    assert len(per_tile) > 4096 and max(per_tile) < 200 and sum(per_tile) <= 16 * 10_000
    one = spark.createDataFrame([("only", 0.0, 1e4, 0.0, 1e4)], REGIONS)
    assert tile_table(one, grids(one)).count() >= 1024


def test_plan_has_no_array_and_no_nested_loop(spark, capsys):
    points, regions = scene(2)
    S.spatial_sides(spark.createDataFrame(points, POINTS), spark.createDataFrame(regions, REGIONS)).explain()
    plan = capsys.readouterr().out
    assert "ExistenceJoin" in plan and "collect_list" not in plan
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
