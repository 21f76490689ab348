import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quiltomics.llm import minhash
from quiltomics.llm.components import components
from quiltomics.llm.minhash import deduplicated, least_overlap, near_duplicates, shingle_sets

SCHEMA = "doc_id long, text string, kept string, digest int"


def word_sets(texts):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets = {}
    for key, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(lower))
        width = min(5, len(words))
        sets[key] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
    return sets


def brute(texts):
    sets = word_sets(texts)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def compare(spark, texts, again=()):
    data = [(k, t, "no", 1) for k, t in [*texts.items(), *again]]
    rows = near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(rows) == len(data)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def corpus(seed, groups=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts, key = {}, 0
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 8, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            key += rng.randrange(1, 5)
            texts[key] = (passage + "\n" if rng.random() < 0.4 else "") + " ".join(own)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_all_pairs(spark, seed):
    texts = corpus(seed)
    texts |= {900: None, 901: "", 902: " \n\t", 903: "One", 904: "one", 905: "ONE two", 906: "é É"}
    compare(spark, texts, again=[(903, "One")])


def test_large_near_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for key in range(90):
        own = list(base)
        for place in rng.sample(range(120), rng.choice([2, 3, 4])):
            own[place] = f"x{rng.randrange(10_000)}"
        texts[key] = " ".join(own)
    compare(spark, texts)


def test_chain_is_one_component(spark):
    texts = {i: " ".join(f"c{j}" for j in range(3 * i, 3 * i + 60)) for i in range(40)}
    compare(spark, texts)
    assert {c for _, c in brute(texts).values()} == {0}


def test_dedup_keeps_one_of_each_group(spark):
    texts = corpus(7)
    data = [(k, t, "no", 1) for k, t in texts.items()] + [(min(texts), texts[min(texts)], "no", 1), (None, "nobody else", "no", 1)]
    kept = deduplicated(spark.createDataFrame(data, SCHEMA))
    assert kept.columns == ["doc_id", "text", "kept", "digest"]
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted([(False, c) for c in {c for _, c in brute(texts).values()}] + [(True, 0)])


def test_dedup_of_rows_without_an_id(spark):
    data = [(1, "one two three four five six"), (None, "one two three four five six"), (None, "ONE two three four five six")]
    data += [(None, "another text that nobody else has here")] * 2 + [(None, "Another text  that nobody else has here"), (None, ""), (None, None), (2, "alone")]
    table = spark.createDataFrame([(i, t, "no", 1) for i, t in data], SCHEMA).selectExpr("*", "1 AS _mark", "2 AS _text", "3 AS _kept")
    kept = deduplicated(table)
    assert kept.columns == table.columns
    texts = sorted((r.doc_id or 0, (r.text or "").lower().split()) for r in kept.collect())
    assert texts == [(0, []), (0, []), (0, "another text that nobody else has here".split()), (1, "one two three four five six".split()), (2, ["alone"])]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hashes_tell_words_apart():
    texts = ["a b c d e f", "a b c d e g", "", "A B  C\tD\nE F", "ab c d e f"]
    sets = list(shingle_sets(pa.array([*texts, None]), 5))
    assert [len(s) for s in sets] == [2, 2, 0, 2, 1, 0]
    assert (sets[0] == sets[3]).all() and len(np.intersect1d(sets[0], sets[1])) == 1


def test_overlap_bound_and_stars(spark):
    assert 25 <= least_overlap(64, 75) <= 34
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 31)}, 51: 50}
