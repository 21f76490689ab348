"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are runs of letters and digits in lower case.  For every item length, the document's windows of
that many words are fingerprinted from rolling sums of +1 and -1 per bit over their five-word shingles.
A document with fewer words than the item is one window, its whole text, where it has enough shingles to
reach the similarity at all.
An item is filed under its fingerprint's eight bytes and, per byte, under every byte within
``RADIUS // 8`` bits of it: by the pigeonhole principle a window within ``RADIUS`` bits of an item meets it in at least
one block.  Candidates within the radius are verified by the weighted-shingle similarity (sum of the
smaller counts over sum of the larger counts), 0.75 or more.

A window with a similarity above zero to an item holds one of its shingles, so windows without a shingle
of an item of their length are not fingerprinted; this screen loses nothing.  Items are taken ``ITEMS`` at a time, so what a task holds is bounded
however large the benchmark is.

Defined cases: null and empty texts and items match nothing; an item with fewer words than a shingle is
one shingle; repeated rows are reported each, equal items each; ties between windows go to the
first; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltomics.llm.common import WordHasher, passes, shingles, tidy, utf8

RADIUS = 23
#: Items that one pass over the documents looks for.
ITEMS = 20_000
_HASHERS: list[WordHasher] = []


def _hasher() -> WordHasher:
    if not _HASHERS:
        _HASHERS.append(WordHasher())
    return _HASHERS[0]


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), r"[^\p{L}\p{N}]+", " ")
    data, bounds = utf8(plain)
    for first, end in passes(bounds):
        words, places = _hasher().words(data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first])
        for a, b in zip(places[:-1], places[1:]):
            yield words[a:b]


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit of each 64-bit hash."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash bytes (rows of eight) of bit sums."""
    return np.packbits(sums > 0, axis=1)


def weighted_similarity(one: np.ndarray, two: Counter) -> float:
    """Sum of the smaller shingle counts over sum of the larger ones."""
    values, counts = np.unique(one, return_counts=True)
    both = sum(min(int(n), two.get(int(v), 0)) for v, n in zip(values, counts))
    return both / (len(one) + sum(two.values()) - both)


class ItemIndex:
    """Fingerprints of items, their eight-byte blocks and their shingle counts."""

    def __init__(self, items: list[tuple[int, np.ndarray]], radius: int, least: float, size: int) -> None:
        self.radius, self.least, self.size = radius, least, size
        self.ids = [i for i, _ in items]
        sets = [shingles(w, size) for _, w in items]
        self.lengths = np.array([len(w) for _, w in items])
        self.counts = [Counter(s.tolist()) for s in sets]
        self.known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.prints = np.concatenate([fingerprints(_signs(s).sum(axis=0)[None]) for s in sets]) if sets else np.zeros((0, 8), np.uint8)
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= radius // 8
        # Per item length and block: which items each byte value leads to.
        self.blocks = {}
        for length in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == length)
            shared = np.unique(np.concatenate([sets[i] for i in own]))
            self.blocks[int(length)] = (own, [near[:, self.prints[own, b]] for b in range(8)], shared)

    def hits(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Item, first word, last word and similarity of the best window for each item found."""
        best: dict[int, tuple[float, int, int]] = {}
        if not len(self.known):
            return []
        grams = {}
        for length in self.blocks:
            width = min(self.size, length)
            if len(words) >= width and width not in grams:
                found = shingles(words, width)
                at = np.minimum(np.searchsorted(self.known, found), max(0, len(self.known) - 1))
                grams[width] = found, np.flatnonzero(self.known[at] == found)
        for length, (own, blocks, shared) in self.blocks.items():
            width = min(self.size, length)
            # A text shorter than the items is one window; its similarity is at most the ratio of the shingle counts.
            span = min(length, len(words)) - width + 1
            if span < 1 or span / (length - width + 1) < self.least or not len(grams[width][1]):
                continue
            found, seen = grams[width]
            # Only items of this length are compared with these windows.
            seen = seen[shared[np.minimum(np.searchsorted(shared, found[seen]), len(shared) - 1)] == found[seen]]
            if not len(seen):
                continue
            last = len(found) - span
            marks = np.zeros(last + 2, np.int64)
            np.add.at(marks, np.maximum(0, seen - span + 1).clip(max=last + 1), 1)
            np.add.at(marks, np.minimum(seen, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
                for part in np.array_split(group, max(1, len(group) // 65536)):
                    self._windows(found, part, span, width, own, blocks, best)
        return [(self.ids[item], a, b, s) for item, (s, a, b) in sorted(best.items())]

    def _windows(self, found, starts, span, width, own, blocks, best) -> None:
        """Compare the windows that begin at ``starts`` (near each other) with the items ``own``."""
        if not len(starts):
            return
        low = int(starts[0])
        sums = np.zeros((int(starts[-1]) + span - low + 1, 64), np.int32)
        np.cumsum(_signs(found[low : int(starts[-1]) + span]), axis=0, out=sums[1:])
        prints = fingerprints(sums[starts - low + span] - sums[starts - low])
        meet = blocks[0][prints[:, 0]]
        for b in range(1, 8):
            meet = meet | blocks[b][prints[:, b]]
        rows, columns = np.nonzero(meet)
        apart = np.bitwise_count(prints[rows] ^ self.prints[own[columns]]).sum(axis=1)
        for row, column in zip(rows[apart <= self.radius], own[columns[apart <= self.radius]]):
            start, item = int(starts[row]), int(column)
            similarity = weighted_similarity(found[start : start + span], self.counts[item])
            if similarity >= self.least and similarity > best.get(item, (0.0,))[0]:
                best[item] = similarity, start, start + span + width - 2


def _indexes(benchmark: DataFrame, least: float, size: int, radius: int, items: int) -> Iterator[ItemIndex]:
    """Indexes over about ``items`` benchmark items each."""
    ranked = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-ranked.count() // items))
    for block in range(blocks):
        # About ``items`` items of the benchmark, never documents.
        rows = ranked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        words = list(_words(pa.array([r.text for r in rows], pa.string())))
        yield ItemIndex([(r.item_id, w) for r, w in zip(rows, words) if len(w)], radius, least, size)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.75, size: int = 5, radius: int = RADIUS, items: int = ITEMS
) -> DataFrame:
    """One row per document and benchmark item found in it: the best window's words and similarity."""
    schema = "doc_id long, item_id long, first_word long, last_word long, similarity double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = None
    for index in _indexes(benchmark, least, size, radius, items):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 512):
                    part = batch.slice(first, 512)
                    rows = [
                        (key, *hit)
                        for key, words in zip(part.column(0).to_pylist(), _words(part.column(1)))
                        for hit in index.hits(words)
                    ]
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                            ["doc_id", "item_id", "first_word", "last_word", "similarity"],
                        )

        found = texts.mapInArrow(tidy(run), schema)
        result = found if result is None else result.union(found)
    return result


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.75, size: int = 5, radius: int = RADIUS, items: int = ITEMS
) -> DataFrame:
    """The documents in which no benchmark item is found; a filter in place, without a shuffle."""
    place = docs.columns.index("text")
    schema = docs.schema
    for index in _indexes(benchmark, least, size, radius, items):

        def clean(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 512):
                    part = batch.slice(first, 512)
                    yield part.filter(pa.array([not index.hits(w) for w in _words(part.column(place))], pa.bool_()))

        docs = docs.mapInArrow(tidy(clean), schema)
    return docs
