"""Helpers shared by the corpus operators: tables, folds, gapless numbers, byte-level word hashes."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised pass takes at a time; a longer text is a pass of its own.
PASS_BYTES = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key: str = "doc_id") -> Column:
    """True for the fifth of the rows whose labels are never learned from; null without a key, and such rows teach nothing."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def gapless(df: DataFrame, groups: Sequence[str], order: Sequence[Column], salt: Column, name: str, rows: int) -> DataFrame:
    """Zero-based gapless number of each row inside its group.

    A group may hold any share of the rows: it is cut into slices by ``salt`` (about 4,096 rows of the
    whole table each), slices are numbered apart, and only slice counts are accumulated.
    ``rows`` is the table's row count, which sets the number of slices.
    """
    slices = max(1, rows // 4096)
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(salt), F.lit(slices)))
    counts = cut.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*groups, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_slice").orderBy(*order)
    return (
        cut.join(counts, [*groups, "_slice"])
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_slice", "_before")
    )


#: What this worker keeps from task to task, by name.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """This worker's object of that name, made once; tasks that do not name it in ``tidy`` let it go."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def _let_go(keeps: str) -> None:
    """Drop what earlier tasks kept, but for ``keeps``; by a function of the module, since a closure brings its own copy of ``_KEPT``."""
    for name in _KEPT.keys() - {keeps}:
        del _KEPT[name]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow`` that leaves little memory in its worker.

    Workers outlive their tasks, and what they hold counts beside the executor's heap.  So what earlier tasks
    kept goes, but for ``keeps``, and Arrow memory that is free goes back to the system after every batch.
    """

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            pa.default_memory_pool().release_unused()

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go(keeps)
        try:
            yield from run(given(batches))
        finally:
            pa.default_memory_pool().release_unused()

    return tidied


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array and its row bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def passes(bounds: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    start, rows = 0, len(bounds) - 1
    while start < rows:
        end = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        end = min(rows, max(end, start + 1))
        yield start, end
        start = end


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    v = values.copy()
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


class WordHasher:
    """64-bit hashes of the words of many texts at once, from prefix sums of a polynomial over their bytes.

    Words are runs of bytes other than space and 0x09 to 0x0D; A-Z count as a-z.
    """

    def __init__(self) -> None:
        self._table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self._grow(PASS_BYTES)

    def _grow(self, size: int) -> None:
        self._powers = np.full(size, _MULTIPLIER & _MASK, np.uint64).cumprod(dtype=np.uint64)
        self._inverse = np.full(size, pow(_MULTIPLIER, -1, 1 << 64), np.uint64).cumprod(dtype=np.uint64)

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and per text the number of its first word (one more at the end)."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        if len(data) > len(self._powers):
            self._grow(len(data))
        low = data | (((data >= 65) & (data <= 90)).view(np.uint8) << 5)
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        sums = self._table[low] * self._powers[: len(low)]
        np.cumsum(sums, out=sums)
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        hashes = (sums[ends] - before) * self._inverse[starts]
        return mixed(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


#: Odd multipliers of the places of a shingle.
_PLACES = mixed(np.arange(11, 43, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; a shorter text is one run; no words, none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for place in range(width):
        total += words[place : len(words) - width + 1 + place] * _PLACES[place]
    return mixed(total)
