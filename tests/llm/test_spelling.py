import random
import re
import zlib
from collections import Counter

import pytest

from quiltomics.llm.spelling import near_pairs, spelling_variants, word_counts

SCHEMA = "doc_id long, text string, word string, n int, key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, shortest=6, least=5):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if crc % 199 == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words, ratio=5):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def vocabulary(seed):
    rng = random.Random(seed)
    stems = ["interna", "nation", "aaaaaa", "aaaaab", "éèêëïü", "×÷×÷×÷", "th", "abcabcabc", "zzzzzzzzzzzz"]
    words = {}
    for _ in range(700):
        word = rng.choice(stems) + "".join(rng.choice("abé") for _ in range(rng.randrange(6)))
        for _ in range(rng.randrange(3)):
            place = rng.randrange(len(word) + 1)
            word = rng.choice([word[:place] + rng.choice("abéz") + word[place:], word[:place] + word[place + 1 :], word[:place] + "a" + word[place + 1 :]])
        if len(word) >= 6:
            words[word] = rng.choice([5, 6, 30, 200, 1000])
    return words


@pytest.mark.parametrize("seed, pairs", [(1, 4096), (2, 6), (3, 0)])
def test_pairs_equal_brute_force(spark, seed, pairs):
    words = vocabulary(seed)
    got = [(r.x, r.y) for r in near_pairs(spark.createDataFrame(list(words.items()), "word string, n long"), pairs).collect()]
    listed = sorted(words)
    want = {frozenset((a, b)) for i, a in enumerate(listed) for b in listed[i + 1 :] if one_edit(a, b)}
    assert len(got) == len(set(map(frozenset, got)))  # once each
    assert set(map(frozenset, got)) == want


def test_whole_operator_equals_brute_force(spark):
    rng = random.Random(7)
    words = list(vocabulary(8).items())
    rows = [(i, rng.choice([" ", "-", "1"]).join(w if rng.random() < 0.7 else w.upper() for w, n in rng.choices(words, [n for _, n in words], k=120))) for i in range(120)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (900, None), (901, ""), (None, "nation nation"), (902, "wordsß ĀĀĀĀĀĀ Ünïcode " * 3000)]
    rows.append((903, "chainaaa " * 6 + "chainaaab " * 40 + "chainaaabb " * 250))  # a form of a form
    table = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], SCHEMA).repartition(4)
    counts = brute_counts(rows)
    assert {r.word: r.n for r in word_counts(table).collect()} == counts
    got = [tuple(r) for r in spelling_variants(table).collect()]
    assert len(got) == len(counts) and set(got) == brute(counts)
    assert any(r[1] for r in got) and any(r[1] and r[2] != r[1] for r in got)


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
