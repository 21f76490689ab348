"""Near-duplicate groups from bottom-k sketches of word shingles.

One hash function orders all shingles; a sketch is the k least of a document's set, so a set of at most
k shingles is its own sketch.  A retained value's frequency over all sets ranks a sketch from rare to
common.  Two sets with the wanted similarity share at least ``need`` retained values (exactly for sets
within k; else up to a chance below 1e-6, see ``least_overlap``), so they share one among the
k - need + 1 rarest: only those are posted in inverted lists, which keeps common passages out of them.

1. Equal sets form a class; only its representative goes on.
2. Each list ties its members to its least member; the union sketch estimates the similarity, the
   full sets confirm it, and the links form components.
3. A list that still spans several components is worked through in blocks: retained values count the
   overlaps inside the block, pairs of different components are confirmed on full sets, and a spanning
   forest of the links found is returned.  No pair that could join two components is left out, each is
   compared in the list of its least common posted value only, and pairs are never listed.

Defined cases: null and blank texts have no shingles and link with nothing; a text with fewer words than
a shingle is one shingle; repeated rows are members of their class; rows of one id are one document; a
row without an id is never a representative and meets others by an equal set only: ``near_duplicates`` marks it
as kept where no document with an id has its set, and ``deduplicated`` keeps one such row of each set; an empty
table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltomics.llm.common import WordHasher, free_name, passes, shingles, tidy, utf8
from quiltomics.llm.components import components
from quiltomics.session import settled

#: Members of a list that one task compares; a longer list is compared block by block.
BLOCK = 4096
_HASHERS: list[WordHasher] = []


def _hasher() -> WordHasher:
    if not _HASHERS:
        _HASHERS.append(WordHasher())
    return _HASHERS[0]


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, bounds = utf8(column)
    for first, end in passes(bounds):
        words, places = _hasher().words(data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first])
        for a, b in zip(places[:-1], places[1:]):
            yield np.unique(shingles(words[a:b], size))


def least_overlap(k: int, percent: int, chance: float = 1e-6) -> int:
    """Least number of values that two k-sketches of sets with the similarity share, but for ``chance``."""
    p, below = percent / 100, 0.0
    for shared in range(k + 1):
        below += comb(k, shared) * p**shared * (1 - p) ** (k - shared)
        if below > chance:
            return max(1, shared)
    return k


def sketches(docs: DataFrame, k: int, size: int, id_type: str = "long") -> DataFrame:
    """Per row ``doc_id, text``: number of shingles, digest of the set, and the k least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, parts = [], [], []
            for found in shingle_sets(batch.column(1), size):
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                parts.append(found[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(parts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {id_type}, n_shingles long, digest binary, sketch array<long>")


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if min(len(left), len(right)) * 100 < percent * max(len(left), len(right)):
        return False
    small, large = (left, right) if len(left) <= len(right) else (right, left)
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(left) + len(right) - shared)


def inverted_lists(sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Postings ``value, id`` of the retained values that any similar pair must share one of."""
    need = least_overlap(k, percent)
    posted = sets.select("id", F.size("sketch").alias("_held"), "n_shingles", F.explode("sketch").alias("value"))
    frequency = posted.groupBy("value").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") > 1)
    exact = F.ceil(F.col("n_shingles") * percent / 100)
    rarest = F.col("_held") - F.least(F.lit(need), exact) + 1
    shared = posted.join(frequency, "value").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("_df", "value"))).alias("_values"),  # at most k
        F.first("_held").alias("_held"),
        F.first("n_shingles").alias("n_shingles"),
    )
    # Values that nobody else holds are the rarest; they fill the first places.
    places = (rarest - (F.col("_held") - F.size("_values"))).cast("int")
    kept = shared.where(places > 0).select("id", F.explode(F.slice("_values", 1, places)).alias("_v"))
    return kept.select(F.col("_v.value").alias("value"), "id")


def _estimated(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose union sketch allows the similarity."""
    need = least_overlap(k, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (2, 3))
            keep = []
            for x, y, a, b in zip(left, right, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if min(x, y) * 100 < percent * max(x, y):
                    keep.append(False)
                    continue
                one, two = np.array(a, np.int64).view(np.uint64), np.array(b, np.int64).view(np.uint64)
                union = np.union1d(one, two)[:k]
                shared = np.intersect1d(np.intersect1d(one, two, True), union, True)
                keep.append(len(shared) >= min(need, -(-percent * len(union) // 100)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(tidy(run), "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs that are similar on their full sets."""
    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("t_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("t_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similar(x, y, percent)
                for x, y in zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size))
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "t_a", "t_b").mapInArrow(tidy(run), "a long, b long")


class _Forest:
    """Union-find over the members of a block."""

    def __init__(self, labels: list[int]) -> None:
        self.parent = {label: label for label in labels}

    def root(self, label: int) -> int:
        while self.parent[label] != label:
            self.parent[label] = self.parent[self.parent[label]]
            label = self.parent[label]
        return label

    def tie(self, one: int, two: int) -> bool:
        one, two = self.root(one), self.root(two)
        if one == two:
            return False
        self.parent[max(one, two)] = min(one, two)
        return True


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Intersection size of one full set with each of the others (none of them empty)."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    starts = np.cumsum([0] + [len(o) for o in others[:-1]])
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def _meetings(values: list[np.ndarray]) -> np.ndarray:
    """How many values each two members share, counted through the values' member lists."""
    count = len(values)
    owners, flat = np.repeat(np.arange(count), [len(v) for v in values]), np.concatenate(values)
    order = np.argsort(flat, kind="stable")
    owners, flat = owners[order], flat[order]
    met, wide = np.zeros((count, count), np.float32), []
    for members in np.split(owners, np.flatnonzero(np.diff(flat)) + 1):
        if len(members) > 32:
            wide.append(members)
        elif len(members) > 1:
            met[np.ix_(members, members)] += 1
    for first in range(0, len(wide), 512):
        # Values that many members hold: one matrix product for all of them.
        holds = np.zeros((count, len(wide[first : first + 512])), np.float32)
        for column, members in enumerate(wide[first : first + 512]):
            holds[members, column] = 1
        met += holds @ holds.T
    return met


def block_links(
    labels: list[int],
    sets: list[np.ndarray],
    earlier: list[np.ndarray],
    sides: np.ndarray | None,
    k: int,
    percent: int,
) -> list[tuple[int, int]]:
    """A spanning forest, over component labels, of the links inside a block of one list.

    ``earlier`` has each member's posted values below this list's: two members that share one of them
    meet in that value's list.  With ``sides`` only pairs of different sides count (the others belong
    to another block).
    """
    need = least_overlap(k, percent)
    forest, links = _Forest(labels), []
    overlaps, before = _meetings([s[:k] for s in sets]), _meetings(earlier)
    lengths = np.array([len(s) for s in sets])
    least = np.minimum(need, -(-percent * lengths // 100))
    roots = np.array(labels)
    for one in range(len(sets)):
        fit = (overlaps[one] >= np.maximum(least[one], least)) & (before[one] == 0) & (roots != roots[one])
        fit &= 100 * np.minimum(lengths, lengths[one]) >= percent * np.maximum(lengths, lengths[one])
        fit[: one + 1] = False
        if sides is not None:
            fit &= sides != sides[one]
        rivals = np.flatnonzero(fit)
        if not len(rivals):
            continue
        shared = _shared(sets[one], [sets[r] for r in rivals])
        linked = rivals[100 * shared >= percent * (lengths[one] + lengths[rivals] - shared)]
        for two in linked:
            a, b = forest.root(labels[one]), forest.root(labels[two])
            if forest.tie(a, b):
                links.append((a, b))
        if len(linked):
            merged = np.isin(roots, roots[linked]) | (roots == roots[one])
            roots[merged] = roots[merged].min()
    return links


def _spanning(lists: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int, size: int) -> DataFrame | None:
    """Links between components inside lists that span several of them."""
    labelled = lists.join(labels, lists.id == labels.node, "left").select(
        "value", "id", F.coalesce("component", "id").alias("label")
    )
    spans = labelled.groupBy("value").agg(
        F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_n")
    )
    # A list of two is one pair, and its least member has been compared with the other.
    spans = spans.where((F.col("_low") < F.col("_high")) & (F.col("_n") > 2))
    members = labelled.join(spans.select("value", "_n", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")), "value")
    # Block pairs (i, j) with i <= j; a list within one block is the pair (0, 0).
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    members = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    members = members.select(
        "value", "_n", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "id", "label"
    )
    members = settled(members, "block-members")
    count = members.count()
    if not count:
        return None
    posted = lists.groupBy("id").agg(F.collect_list("value").alias("_posted"))  # at most k
    # Short lists share tasks; a long one is a group of its own.
    together = F.pmod(F.xxhash64("value"), F.lit(1 + count // 4096))
    group = F.when(F.col("_n") > 64, F.xxhash64("value", "i", "j")).otherwise(together)
    rows = members.withColumn("_group", group).join(posted, "id").join(texts, "id")

    def run(block: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        block = block.combine_chunks()
        lists_of = [block.column(n).to_numpy() for n in ("value", "i", "j")]
        order = np.lexsort(lists_of)
        turns = np.zeros(len(order), bool)
        for column in lists_of:
            turns[1:] |= np.diff(column[order]) != 0
        for part in np.split(order, np.flatnonzero(turns)):
            rows = block.take(pa.array(part))
            value, one_side = rows.column("value")[0].as_py(), rows.column("i")[0] == rows.column("j")[0]
            sets = list(shingle_sets(rows.column("text"), size))
            earlier = [np.array([v for v in posts if v < value], np.int64) for posts in rows.column("_posted").to_pylist()]
            sides = None if one_side else rows.column("_own").to_numpy()
            links += block_links(rows.column("label").to_pylist(), sets, earlier, sides, k, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("_group").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 64, percent: int = 75, size: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least linked doc_id), kept."""
    rows = settled(sketches(docs, k, size), "sketches")
    sets = settled(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
        ),
        "sets",
    )
    lists = settled(inverted_lists(sets, k, percent), "lists")
    pivots = lists.groupBy("value").agg(F.min("id").alias("a"))
    pairs = lists.join(pivots, "value").where(F.col("a") != F.col("id")).select("a", F.col("id").alias("b")).distinct()
    held = sets.select("id", "n_shingles", "sketch")
    pairs = pairs.join(held.toDF("a", "n_a", "s_a"), "a").join(held.toDF("b", "n_b", "s_b"), "b")
    likely = settled(_estimated(pairs, k, percent), "likely")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(lists.select("id").distinct(), "id", "left_semi")
    texts = texts.dropDuplicates(["id"])
    links = settled(_confirmed(likely, texts, percent, size), "links")
    labels = components(links)
    more = _spanning(lists, labels, texts, k, percent, size)
    if more is not None:
        # Links of components, followed by each member's link to its component.
        labels = components(more.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    classes = sets.join(labels, sets.id == labels.node, "left").select("digest", F.coalesce("component", "id").alias("_component"))
    joined = rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.coalesce("_component", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), component.isNull())
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, k: int = 64, percent: int = 75, size: int = 5) -> DataFrame:
    """One document of every near-duplicate group, all columns; of repeated rows of one id, one."""
    mark = free_name(docs, "_mark")
    kept = near_duplicates(docs, k, percent, size).where("kept and doc_id is not null").select(F.col("doc_id").alias(mark)).distinct()
    once = docs.join(kept, F.col("doc_id") == F.col(mark), "left_semi")
    counts = docs.select("doc_id").groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    repeated = settled(counts.select(F.col("doc_id").alias(mark)), "repeated-ids")
    if not repeated.isEmpty():
        # An id whose rows repeat keeps one of them.
        single = once.join(repeated, F.col("doc_id") == F.col(mark), "left_anti")
        again = once.join(repeated, F.col("doc_id") == F.col(mark), "left_semi").dropDuplicates(["doc_id"])
        once = single.unionByName(again)
    nameless = docs.where("doc_id is null")
    return once if nameless.isEmpty() else once.unionByName(_unheld(nameless, docs.where("doc_id is not null"), k, size))


def _unheld(nameless: DataFrame, named: DataFrame, k: int, size: int) -> DataFrame:
    """Rows without an id, one of each set that no document with an id has; those without words stay."""
    mark = free_name(nameless, "_mark")
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    digests = settled(sketches(nameless.select(text.alias("doc_id"), "text").distinct(), k, size, "string"), "nameless-sets")
    held = sketches(named, k, size).select("digest").where("digest is not null").distinct()
    fresh = digests.where("digest is not null").join(held, "digest", "left_anti").groupBy("digest").agg(F.min("doc_id").alias(mark))
    blank = digests.where("digest is null").select(F.col("doc_id").alias(mark))
    tagged = nameless.withColumn(free_name(nameless, "_text"), text)
    tag = tagged.columns[-1]
    one = tagged.join(fresh, F.col(tag) == F.col(mark), "left_semi").dropDuplicates([tag])
    every = tagged.join(blank, F.col(tag) == F.col(mark), "left_semi")
    return one.unionByName(every).drop(tag)
