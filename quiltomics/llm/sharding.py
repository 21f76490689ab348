"""Minimax contiguous partition: the smallest shard capacity that holds ordered atomic groups.

Groups are equal texts, ordered by a hash of the text.  The smallest feasible capacity is found by
binary search with a greedy check, and the order is cut there.  The driver never holds the groups: it
holds an index of key blocks (65,536 at first), and splits only those blocks in which a cut of a
still possible capacity may fall, until every cut falls between single groups.  The capacity is exact.
Among the partitions that keep to it, cuts next to even shares are taken, so no shard is left nearly empty.

Defined cases: a null text is a group of its own apart from the empty text; repeated rows are members
of their text's group; an empty table gives an empty result; columns other than the id and the text
are ignored.  A group larger than an even share gets a shard to itself, and the others share the rest.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltomics.llm.common import gapless
from quiltomics.session import settled

_KEY_BITS = 60
_FIRST_BITS = 16
_STEP_BITS = 8
#: Blocks that one query splits; more are split by more queries.
_PARENTS = 4096


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its size, CRC and the key of its group (60 bits of the text's MD5; 0 for null)."""
    text = F.col(text_column)
    digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select(
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(digest, F.lit(0)).cast("long").alias("_key"),
    )


class _Index:
    """Ordered blocks of groups: (first key, shift, bytes, number of groups)."""

    def __init__(self, blocks: list[tuple[int, int, int, int]]) -> None:
        self.blocks = sorted(blocks)
        self.prefix = [0]
        for block in self.blocks:
            self.prefix.append(self.prefix[-1] + block[2])

    @property
    def total(self) -> int:
        return self.prefix[-1]

    def cut(self, start: int, capacity: int, inside: bool) -> int:
        """Furthest end of a shard that begins at ``start``; ``inside`` lets it end within a block of many groups."""
        reach = start + capacity
        if reach >= self.total:
            return self.total
        block = bisect_right(self.prefix, reach) - 1
        if inside and self.blocks[block][3] > 1:
            return reach
        return max(start, self.prefix[block])

    def fits(self, capacity: int, shards: int, inside: bool, end: int = 0) -> bool:
        """Whether ``shards`` shards of this capacity hold what follows ``end``: greedily, each as full as it gets."""
        for _ in range(shards):
            end = self.cut(end, capacity, inside)
        return end >= self.total

    def smallest(self, shards: int, inside: bool) -> int:
        """Smallest capacity with which ``shards`` shards hold everything."""
        low, high = 0, self.total
        while low < high:
            middle = (low + high) // 2
            if self.fits(middle, shards, inside):
                high = middle
            else:
                low = middle + 1
        return low

    def even_cut(self, start: int, capacity: int, left: int) -> int:
        """End of the shard at ``start``: the boundary nearest an even share of the rest from which the
        other shards still keep to the capacity, else as far as the capacity goes."""
        even = start + (self.total - start) // left
        place = bisect_right(self.prefix, even) - 1
        near = sorted({self.prefix[place], self.prefix[min(place + 1, len(self.prefix) - 1)]}, key=lambda x: abs(x - even))
        for end in near:
            if start < end <= start + capacity and self.fits(capacity, left - 1, False, end):
                return end
        return self.cut(start, capacity, False)

    def doubtful(self, shards: int, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """Blocks of many groups in which a cut may fall for a capacity from ``low`` to ``high``."""
        found, least, most = set(), 0, 0
        for _ in range(shards):
            first = max(0, bisect_right(self.prefix, least + low) - 2)
            reach = min(most + high, self.total)
            for block in range(first, len(self.blocks)):
                if self.prefix[block] >= reach:
                    break
                if self.blocks[block][3] > 1 and self.prefix[block + 1] > least + low:
                    found.add(block)
            least, most = self.cut(least, low, False), self.cut(most, high, True)
        return [self.blocks[b] for b in sorted(found)]


def _measure(groups: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
    rows = (
        groups.groupBy(F.shiftright("_key", shift).alias("_block"))
        .agg(F.sum("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_groups"))
        .collect()  # at most 2^16 blocks at first, then 2^8 for each of the few split ones
    )
    return [(r._block << shift, shift, int(r._bytes), r._groups) for r in rows]


def _split(groups: DataFrame, blocks: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    spark, parts = groups.sparkSession, []
    for shift in sorted({b[1] for b in blocks}):
        keys = [b[0] >> shift for b in blocks if b[1] == shift]
        for i in range(0, len(keys), _PARENTS):
            wanted = spark.createDataFrame([(k,) for k in keys[i : i + _PARENTS]], "_parent long")
            chosen = groups.withColumn("_parent", F.shiftright("_key", shift)).join(F.broadcast(wanted), "_parent")
            parts += _measure(chosen, max(0, shift - _STEP_BITS))
    return parts


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity of ``shards`` shards and the first key of every shard after the first."""
    index = _Index(_measure(groups, _KEY_BITS - _FIRST_BITS))
    while True:
        low, high = index.smallest(shards, True), index.smallest(shards, False)
        doubtful = index.doubtful(shards, low, high)
        if not doubtful:
            break
        kept = set(index.blocks) - set(doubtful)
        index = _Index([*kept, *_split(groups, doubtful)])
    firsts, end = [], 0
    for left in range(shards, 1, -1):
        end = index.even_cut(end, high, left)
        if end >= index.total:
            break
        firsts.append(index.blocks[bisect_right(index.prefix, end) - 1][0])
    return high, firsts


def heavy_groups(groups: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Groups above an even share of what is left: fewer than ``shards`` of them."""
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    # More than total / shards^2 each, so fewer than shards^2 rows.
    rows = groups.where(F.col("_bytes") > F.lit(total // shards**2)).orderBy(F.desc("_bytes"), "_key").limit(shards).collect()
    chosen: list[tuple[int, int]] = []
    for row in rows:
        if len(chosen) == shards - 1 or row._bytes * (shards - len(chosen)) <= total:
            break
        chosen.append((row._key, row._bytes))
        total -= row._bytes
    return chosen


def assign_shards(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with its size, CRC, shard and gapless slot."""
    rows = settled(sizes(docs, id_column, text_column), "shard-rows")
    groups = settled(rows.groupBy("_key").agg(F.sum("size").alias("_bytes")), "shard-groups")
    heavy = heavy_groups(groups, shards)
    rest = groups.where(~F.col("_key").isin([k for k, _ in heavy])) if heavy else groups
    _, firsts = minimax_cuts(rest, shards - len(heavy))
    shard: Column = F.lit(len(heavy))
    for key in firsts:
        shard = shard + (F.col("_key") >= F.lit(key)).cast("int")
    for place, (key, _) in enumerate(heavy):
        shard = F.when(F.col("_key") == F.lit(key), F.lit(place)).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    order = [F.col("_key"), F.col("doc_id")]
    return gapless(placed, ["shard"], order, F.struct("doc_id", "_key"), "slot", rows.count()).drop("_key")


def shard_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The sharding query's columns."""
    return assign_shards(docs, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
