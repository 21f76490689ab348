import random
import re
from collections import Counter

import pytest

from quiltomics.llm.decontam import contaminated, decontaminate

DOCS = "doc_id long, text string, item_id string, similarity int"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(own):
    width = min(5, len(own))
    return Counter(tuple(own[i : i + width]) for i in range(len(own) - width + 1))


def brute(docs, items):
    found = {}
    for key, text in docs:
        own = words(text)
        for item, other in items:
            want = words(other)
            if not want or len(own) < len(want):
                continue
            goal, best = grams(want), 0.0
            for start in range(len(own) - len(want) + 1):
                here = grams(own[start : start + len(want)])
                best = max(best, sum((here & goal).values()) / sum((here | goal).values()))
            if best >= 0.75:
                found[key, item] = best
    return found


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([3, 5, 12, 30, 30, 45])))) for i in range(12)]
    items += [(50, "one two"), (51, None), (52, "")]
    docs = []
    for key in range(120):
        own = rng.choices(pool, k=rng.randrange(20, 150))
        for _ in range(rng.choice([0, 0, 1, 2])):
            leak = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 0, 1])):
                leak[rng.choice([0, 1, -1, -2])] = "changed"
            place = rng.randrange(len(own))
            own[place:place] = leak[: rng.choice([len(leak), len(leak), max(1, len(leak) // 2)])]
        text = " ".join(own)
        docs.append((key, text.upper() if rng.random() < 0.2 else text.replace(" ", ", ", 5)))
    return docs + [(500, None), (501, ""), (502, "One, TWO"), (503, items[3][1])], items


@pytest.mark.parametrize("seed, block", [(1, 20_000), (2, 4)])
def test_matches_all_windows(spark, seed, block):
    docs, items = corpus(seed)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = contaminated(table, benchmark, items=block).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == {k: round(v, 9) for k, v in want.items()}
    assert len(rows) == len(want)
    spans = dict(docs)
    for row in rows:
        own = words(spans[row.doc_id])[row.first_word : row.last_word + 1]
        goal = grams(words(dict(items)[row.item_id]))
        assert round(sum((grams(own) & goal).values()) / sum((grams(own) | goal).values()), 9) == round(row.similarity, 9)
    kept = decontaminate(table, benchmark, items=block)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {i for i, _ in want})


def test_empty_tables_and_repeats(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h y", "", 0)] * 2, DOCS)
    assert contaminated(docs, benchmark).count() == 4
    assert contaminated(docs.limit(0), benchmark).count() == 0
    assert contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate(docs, benchmark.limit(0)).count() == 2


def test_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(rng.choices([f"w{i}" for i in range(50)], k=300_000))
    item = " ".join(f"item{i}" for i in range(30))
    docs = spark.createDataFrame([(1, long + " " + item + " " + long, "", 0), (2, long, "", 0)], DOCS)
    rows = contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.first_word, r.similarity) for r in rows] == [(1, 9, 300_000, 1.0)]


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(n))) for i, n in enumerate([6, 9, 15, 24, 40, 56])]
    docs = [(1, items[5][1].rsplit(" ", 2)[0])]
    for key in range(100, 500):
        own = words(rng.choice(items)[1])
        front, back = rng.randrange(0, 6), rng.randrange(0, 8)
        own = own[front : max(front + 1, len(own) - back)]
        if rng.random() < 0.3:
            own[rng.randrange(len(own))] = "changed"
        docs.append((key, " ".join(own)))
    want = {}
    for key, text in docs:
        own = words(text)
        for item, other in items:
            size, goal = len(words(other)), grams(words(other))
            # Every window of the item's length; a shorter text is one window.
            here = [grams(own[a : a + size]) for a in range(max(1, len(own) - size + 1))]
            best = max(sum((h & goal).values()) / sum((h | goal).values()) for h in here)
            if best >= 0.75:
                want[key, item] = round(best, 9)
    assert want[1, 5] == round(50 / 52, 9)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = contaminated(table, benchmark).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == want
    short = [r for r in rows if len(words(dict(docs)[r.doc_id])) < len(words(dict(items)[r.item_id]))]
    assert len(short) > 50
    assert all((r.first_word, r.last_word) == (0, len(words(dict(docs)[r.doc_id])) - 1) for r in short)
    left = {r.doc_id for r in decontaminate(table, benchmark).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}
