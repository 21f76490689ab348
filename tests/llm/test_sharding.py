import random
import zlib
from collections import defaultdict

import pytest

from quiltomics.llm import sharding
from quiltomics.llm.sharding import _Index, assign_shards, minimax_cuts

SCHEMA = "doc_id long, text string, size string, shard int"


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, full = (low + high) // 2, 1, 0
        for size in sizes:
            if full + size > middle:
                used, full = used + 1, 0
            full += size
        if used <= shards:
            high = middle
        else:
            low = middle + 1
    return low


@pytest.mark.parametrize("seed", [1, 2])
def test_capacity_is_the_smallest(spark, monkeypatch, seed):
    # Few first blocks, so that the index is refined over several rounds.
    monkeypatch.setattr(sharding, "_FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "_STEP_BITS", 3)
    rng = random.Random(seed)
    keys = sorted(rng.sample(range(1 << 60), 300))
    sizes = [rng.choice([8, 100, 5000]) + rng.randrange(50) for _ in keys]
    groups = spark.createDataFrame(list(zip(keys, sizes)), "_key long, _bytes long").cache()
    capacity, firsts = minimax_cuts(groups, 7)
    assert capacity == brute_capacity(sizes, 7)
    shard = defaultdict(int)
    for key, size in zip(keys, sizes):
        shard[sum(key >= f for f in firsts)] += size
    assert max(shard.values()) <= capacity and len(shard) == 7


def check(rows, shards):
    slots, texts = defaultdict(list), defaultdict(set)
    for row, text in rows:
        assert 0 <= row.shard < shards
        raw = None if text is None else text.encode()
        assert row.size == len(raw or b"") + 8
        assert row.text_crc32 == (None if raw is None else zlib.crc32(raw))
        slots[row.shard].append(row.slot)
        texts[text].add(row.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in texts.values())


def test_rows_groups_nulls_and_hot_text(spark):
    rng = random.Random(3)
    texts = [None, None, "", "é" * 5000] + ["hot copy"] * 200 + [f"text {rng.randrange(200)} " * rng.randrange(9) for _ in range(400)]
    data = [(i, t, "other", 5) for i, t in enumerate(texts)] + [(7, "hot copy", "again", 5)]
    rows = assign_shards(spark.createDataFrame(data, SCHEMA), 5).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in data)
    by_id = {i: t for i, t, *_ in data}
    check([(r, by_id[r.doc_id]) for r in rows], 5)


def test_empty_table(spark):
    assert assign_shards(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_greedy_cut_keeps_to_the_capacity():
    index = _Index([(k, 0, size, 1) for k, size in enumerate([5, 5, 5, 9, 1, 1])])
    assert index.smallest(3, False) == brute_capacity([5, 5, 5, 9, 1, 1], 3)
