"""Cutting-stock packing: column generation over the histogram of piece lengths.

A document's ids are cut into full sequences and one remainder.  Lengths are counted in classes of
``grain`` tokens (rounded up), so the linear program has at most capacity / grain rows whatever the
corpus size: patterns of classes are its columns, a knapsack dynamic program prices new ones until the
bound proves the value within ``GAP`` of the optimum.  Whole parts of the solution are used as they
are, the remaining few pieces are filled first-fit by decreasing size, and documents ranked inside
their class take the patterns' places.

Defined cases: a null text counts as empty and gives the end id alone; repeated rows are packed each;
an empty table gives no rows; very long texts become full sequences and a remainder; other columns
are ignored.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quiltomics.llm.common import gapless, tidy
from quiltomics.llm.tokenizing import chunk_encoder
from quiltomics.session import settled

GAP = 1e-3
_ROUNDS = 20_000


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document: place, length, CRC and, if wanted, the ids."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if ids else "")
    tail = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                keys = part.column(0).to_pylist()
                rows: list[tuple] = []
                values: list[np.ndarray] = []
                for key, raw in zip(keys, encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    raw += tail
                    total = len(raw) // 4
                    for start in range(0, total, capacity):
                        piece = raw[4 * start : 4 * (start + capacity)]
                        rows.append((key, start, len(piece) // 4, zlib.crc32(piece), total))
                        if ids:
                            values.append(np.frombuffer(piece, dtype="<i4"))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if ids:
                    columns.append(pa.array(values, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(tidy(cut, path), schema)


def _knapsack(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best multiset of sizes 1..len(values) within ``room``, and how often it takes each size."""
    best, choice = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for space in range(1, room + 1):
        sizes = min(space, len(values))
        gains = values[:sizes] + best[space - sizes : space][::-1]
        top = int(gains.argmax())
        if gains[top] > best[space - 1] + 1e-12:
            best[space], choice[space] = gains[top], top + 1
        else:
            best[space], choice[space] = best[space - 1], 0
    counts, space = np.zeros(len(values), np.int64), room
    while space > 0:
        if choice[space]:
            counts[choice[space] - 1] += 1
            space -= int(choice[space])
        else:
            space -= 1
    return float(best[room]), counts


def cutting_patterns(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each size 1..room) and their copies, which cover ``demand`` exactly."""
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    need = demand[sizes - 1].astype(float)
    count = len(sizes)
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ need
    for _ in range(_ROUNDS):
        prices = inverse.sum(axis=0)
        values = np.full(room, -1.0)
        values[sizes - 1] = prices
        best, counts = _knapsack(values, room)
        if best <= 1 + GAP:  # total / best bounds the optimum from below
            break
        column = counts[sizes - 1].astype(float)
        step = inverse @ column
        ratios = np.full(count, np.inf)
        positive = step > 1e-9
        ratios[positive] = amount[positive] / step[positive]
        leaving = int(ratios.argmin())
        move = ratios[leaving]
        amount = np.maximum(amount - move * step, 0)
        amount[leaving] = move
        columns[:, leaving] = column
        pivot = inverse[leaving] / step[leaving]
        inverse -= np.outer(step, pivot)
        inverse[leaving] = pivot
    else:
        warnings.warn(f"column generation ended after {_ROUNDS} rounds within {best - 1:.2%} of the optimum", stacklevel=2)
    whole = np.floor(amount + 1e-7).astype(np.int64)
    left = demand[sizes - 1].astype(np.int64) - columns.astype(np.int64) @ whole
    while (left < 0).any():  # a rounded-up amount took too many: give one pattern back
        short = int(np.flatnonzero(left < 0)[0])
        user = int(np.flatnonzero((columns[short] > 0) & (whole > 0))[0])
        whole[user] -= 1
        left = demand[sizes - 1].astype(np.int64) - columns.astype(np.int64) @ whole
    patterns: Counter[tuple[tuple[int, int], ...]] = Counter()
    for place in np.flatnonzero(whole):
        used = np.flatnonzero(columns[:, place])
        patterns[tuple((int(sizes[u]), int(columns[u, place])) for u in used)] += int(whole[place])
    patterns.update(_first_fit({int(s): int(n) for s, n in zip(sizes, left) if n}, room))
    result = []
    for pattern, copies in sorted(patterns.items()):
        counts = np.zeros(room, np.int64)
        for size, times in pattern:
            counts[size - 1] = times
        result.append((counts, copies))
    return result


def _first_fit(left: dict[int, int], room: int) -> Counter[tuple[tuple[int, int], ...]]:
    """Sequences of the pieces that the whole part leaves over: largest first, each filled greedily."""
    found: Counter[tuple[tuple[int, int], ...]] = Counter()
    while left:
        space, taken = room, []
        for size in sorted(left, reverse=True):
            times = min(left[size], space // size)
            if times:
                taken.append((size, times))
                space -= size * times
        copies = min(left[size] // times for size, times in taken)
        found[tuple(sorted(taken))] += copies
        for size, times in taken:
            left[size] -= times * copies
            if not left[size]:
                del left[size]
    return found


def pack(pieces: DataFrame, capacity: int = 4096, grain: int = 8) -> DataFrame:
    """Give every piece (``doc_id, start, length``, other columns kept) its sequence and offset."""
    room = capacity // grain
    pieces = settled(pieces, "pieces").withColumn("_class", F.ceil(F.col("length") / grain).cast("long"))
    # One row per class: at most capacity / grain.
    histogram = pieces.groupBy("_class").count().collect()
    demand = np.zeros(room, np.int64)
    for row in histogram:
        demand[row._class - 1] = row["count"]
    keys, first, times, base, slot = [], [], [], [], []
    used, sequences = np.zeros(room, np.int64), 0
    for counts, copies in cutting_patterns(demand, room):
        place = 0
        for index in np.flatnonzero(counts)[::-1]:
            keys.append((int(index) + 1 << 40) + int(used[index]))
            first.append(int(used[index]))
            times.append(int(counts[index]))
            base.append(sequences)
            slot.append(place)
            used[index] += counts[index] * copies
            place += int(counts[index])
        sequences += copies
    order = np.argsort(np.array(keys, np.int64))
    keys, first, times, base, slot = (np.array(x, np.int64)[order] for x in (keys, first, times, base, slot))

    # Every column takes part, so that pieces of repeated ids keep their ranks when a task is run again.
    told = [F.col(c) for c in pieces.columns if c not in ("length", "doc_id", "start", "_class") and not isinstance(pieces.schema[c].dataType, MapType)]
    order = [F.desc("length"), F.col("doc_id"), F.col("start"), *told]
    ranked = gapless(
        pieces,
        ["_class"],
        order,
        F.struct("doc_id", "start"),
        "_rank",
        int(demand.sum()),
    )

    def place_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(batch.schema.get_field_index("_class")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (kind << 40) + rank, side="right") - 1
            inside = rank - first[at]
            arrays = [batch.column(i) for i in kept]
            arrays += [pa.array(base[at] + inside // times[at]), pa.array(slot[at] + inside % times[at])]
            yield pa.RecordBatch.from_arrays(arrays, names)

    columns = [f for f in ranked.schema.fields if f.name not in ("_class", "_rank")]
    kept = [ranked.columns.index(f.name) for f in columns]
    names = [f.name for f in columns] + ["sequence_id", "_slot"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", sequence_id long, _slot long"
    placed = ranked.mapInArrow(tidy(place_pieces), schema)
    # A sequence has at most ``capacity`` pieces.
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_slot")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed id sequences themselves, from pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def packing_digest(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """The packing query's columns."""
    return pack(token_pieces(docs, path, capacity), capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset")
    )
