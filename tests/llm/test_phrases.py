import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltomics.llm import phrases as module
from quiltomics.llm.phrases import collocations, score_of, windows

SCHEMA = "doc_id long, lang string, text string, prefix string, n int, next array<string>"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, keep, size=4):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, size + 1):
                for i in range(len(words) - m + 1):
                    count[lang or "und"][tuple(words[i : i + m])] += 1
    out = set()
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in longer):
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:keep], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "tion", "Éa", "éa", "x\u00a0y", "und", "日本", "a", "b\x00"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".\n", "\r\n", "?"]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "fr", None, "und"]), text))
    rows += [("en", "red Herring pie.")] * 50 + [("en", "the the the the the")] * 9 + [("fr", None), (None, ""), ("en", " \t "), ("zz", "...")]
    rows.append(("fr", "long of tale " * 4000 + "."))
    return rows


def tuples(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed, window, bits", [(1, 6 << 20, 1 << 28), (2, 300, 1 << 28), (3, 5000, 1 << 10)])
def test_matches_brute_force(spark, monkeypatch, seed, window, bits):
    monkeypatch.setattr(module, "WINDOW", window)
    monkeypatch.setattr(module, "FILTER_BITS", bits)  # a full table lets more through and loses nothing
    rows = corpus(seed)
    table = spark.createDataFrame([(i, lang, text, "x", 1, None) for i, (lang, text) in enumerate(rows)], SCHEMA).repartition(5)
    assert tuples(collocations(table, least=12, keep=40)) == brute(rows, 12, 40)


def test_empty_table_and_short_texts(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    table = spark.createDataFrame([(1, "en", "one", "", 1, None)] * 40 + [(2, None, None, "", 1, None)], SCHEMA)
    assert collocations(table).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    rng = random.Random(4)
    cases = [(a, a + rng.randrange(a) + a) for a in [30, 10**13, 4_611_686_018_427_387_904 // 2] + [rng.randrange(1, 1 << 60) for _ in range(200)]]
    got = spark.createDataFrame(cases, "a long, p long").select("a", "p", score_of(F.col("a"), F.col("p")).alias("s")).collect()
    assert all(r.s == 2_000_000 * r.a // r.p for r in got)


@pytest.mark.parametrize("size", [1, 2, 4])
def test_windows_keep_every_phrase_once(size):
    data = b"aa bb cc. dd ee ff gg hh, ii jj kk " * 20
    seen = []
    for part, own in windows(data, size, 13):
        words = [m for m in re.finditer(rb"[^ .,]+", part)]
        seen += [m.group() for m in words if m.start() < own]
    assert seen == re.findall(rb"[^ .,]+", data)
    counter = module.StripeCounter(2, np.full(1 << 4, ~np.uint64(0)))
    total = Counter()
    for part, own in windows(data, 2, 13):
        rows = counter.stripes(part, own, "en")
        for row in rows.to_pylist() if rows else []:
            for word, n in zip(row["nexts"].split(" "), row["counts"].split(" ")):
                total[row["prefix"], word] += int(n)
    want = Counter()
    for piece in re.split(r"[.,]", data.decode()):
        words = piece.split()
        want.update(zip(words, words[1:]))
    assert total == want
