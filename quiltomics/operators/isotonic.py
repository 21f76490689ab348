"""Monotone fits by mergeable convex minorants, and lookup between their knots by co-sorted placement.

The isotonic fit of a sequence is the slope of the greatest convex minorant of its running sums.  Every run
of rows finds its own minorant (its pooled blocks) apart from the others.  Minorants of neighbouring runs
merge by common tangents, and what lies between two tangents stays as it is: so blocks never move.  The
driver holds candidate vertices only (a few for each run), and the line between two candidates of different
runs is a tangent once no vertex of the runs it touches lies below it.  One aggregate over the blocks
finds, for each run, the vertex furthest below its lines; these become candidates, until there are none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltomics.operators.ordering import numbered
from quiltomics.session import settled

#: Rows of a run at least, and runs of a sequence at most.
RUN = 4096
RUNS = 1 << 16
_CELLS = "run long, first long, end long, before double, total double, x double, n long"


def _blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and sums of the pooled blocks of a sequence: neighbours merge until their means increase."""
    ends: list[int] = []
    sums: list[float] = []
    sizes: list[int] = []
    for end, value in enumerate(values.tolist(), 1):
        total, size = value, 1
        while sums and sums[-1] * size >= total * sizes[-1]:
            total, size = total + sums.pop(), size + sizes.pop()
            ends.pop()
        ends.append(end)
        sums.append(total)
        sizes.append(size)
    return np.array(ends, np.int64), np.array(sums)


def _pool(group: pa.Table) -> pa.Table:
    """Per block of a run and raw value in it: the block, and how many of its rows have the value."""
    order = np.argsort(group.column("ordinal").to_numpy(), kind="stable")
    ordinal, x, v = (group.column(c).to_numpy()[order] for c in ("ordinal", "x", "v"))
    ends, sums = _blocks(v)
    firsts = np.concatenate(([0], ends[:-1]))
    block = np.repeat(np.arange(len(ends)), ends - firsts)
    fresh = np.ones(len(x), bool)  # rows are in order of x, so a cell is a stretch of rows
    fresh[1:] = (x[1:] != x[:-1]) | (block[1:] != block[:-1])
    cell = np.flatnonzero(fresh)
    mine = block[cell]
    before = np.concatenate(([0.0], np.cumsum(sums)[:-1]))
    return pa.table({
        "run": pa.array(np.full(len(cell), group.column("run")[0].as_py()), pa.int64()),
        "first": ordinal[0] + firsts[mine],
        "end": ordinal[0] + ends[mine],
        "before": before[mine],
        "total": sums[mine],
        "x": x[cell],
        "n": np.diff(np.append(cell, len(x))),
    })


class _Minorant:
    """Candidate vertices (rows before, sum before) of the whole sequence and the runs they lie in."""

    def __init__(self, runs: list[tuple[int, int, float, float, float]]) -> None:
        """``runs``: number, rows, sum, first slope, last slope; in order."""
        self.numbers = [r[0] for r in runs]
        self.bounds = np.concatenate(([0], np.cumsum([r[1] for r in runs])))
        self.offsets = np.concatenate(([0.0], np.cumsum([r[2] for r in runs])))
        self.slack = 1e-12 * (1 + sum(abs(r[2]) for r in runs))
        self.points = {0: 0.0, int(self.bounds[-1]): float(self.offsets[-1])}
        self.never: list[int | None] = [None] * len(runs)
        for k in range(1, len(runs)):
            # A boundary whose slopes fall lies above the line between its neighbours: never a vertex.
            if runs[k - 1][4] <= runs[k][3]:
                self.points[int(self.bounds[k])] = float(self.offsets[k])
            else:
                self.never[k - 1] = int(self.bounds[k])

    def tangents(self) -> list[tuple[int, int, float, float]]:
        """Lines (from, to, sum at ``from``, slope) of the candidates' minorant that span a boundary of runs."""
        hull: list[tuple[int, float]] = []
        for t, s in sorted(self.points.items()):
            while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (t - hull[-1][0]) >= (s - hull[-1][1]) * (hull[-1][0] - hull[-2][0]):
                hull.pop()
            hull.append((t, s))
        lines = []
        for (t0, s0), (t1, s1) in zip(hull, hull[1:]):
            first = int(np.searchsorted(self.bounds, t0, side="right"))
            if self.bounds[first] < t1:
                lines.append((t0, t1, s0, (s1 - s0) / (t1 - t0)))
        return lines

    def touched(self, line: tuple[int, int, float, float]) -> range:
        """Places of the runs that a line meets, its ends included."""
        low = int(np.searchsorted(self.bounds, line[0], side="left")) - 1
        high = int(np.searchsorted(self.bounds, line[1], side="right")) - 1
        return range(max(0, low), min(len(self.numbers) - 1, high) + 1)


def _merged(cells: DataFrame) -> tuple[_Minorant, list[tuple[int, int, float, float]]]:
    """Tangents between the runs' minorants."""
    slope = F.col("total") / (F.col("end") - F.col("first"))
    summary = (
        cells.groupBy("run")
        .agg(
            (F.max("end") - F.min("first")).alias("rows"),
            F.max_by(F.col("before") + F.col("total"), "end").alias("total"),
            F.min_by(slope, "first").alias("head"),
            F.max_by(slope, "first").alias("tail"),
        )
        .orderBy("run")
        .collect()  # at most RUNS rows
    )
    state = _Minorant([tuple(r) for r in summary])
    spark = cells.sparkSession
    while True:
        lines = state.tangents()
        if not lines:
            return state, lines
        asked = [
            (state.numbers[k], float(state.offsets[k]), state.never[k], t0, s0, slope)
            for line in lines
            for t0, _, s0, slope in [line]
            for k in state.touched(line)
        ]
        # At most three lines for each run.
        tests = spark.createDataFrame(asked, "run long, _offset double, _never long, _t long, _s double, _slope double")
        height = F.col("_offset") + F.col("before") + F.col("total")
        gap = height - F.col("_s") - F.col("_slope") * (F.col("end") - F.col("_t"))
        lowest = (
            cells.join(F.broadcast(tests), "run")
            .where(~F.col("end").eqNullSafe(F.col("_never")))
            .groupBy("run", "_t")
            .agg(F.min(F.struct(gap.alias("gap"), F.col("end"), height.alias("height"))).alias("v"))
            .where(F.col("v.gap") < -state.slack)
            .collect()
        )
        fresh = {r.v.end: r.v.height for r in lowest if r.v.end not in state.points}
        if not fresh:
            return state, lines
        state.points.update(fresh)


def isotonic_fit(rows: DataFrame, raw: str, outcome: str, tie_break: str) -> DataFrame:
    """Knots ``x, y`` of the monotone fit of an outcome on a raw score.

    The sequence is ordered by (raw, tie_break); the knot of a raw value is the mean fit of its rows, clipped
    to [0, 1].  Fits that cannot be calibrated are refused: no rows, values that are null or not finite, a
    constant outcome, a single raw value.
    """
    wanted = rows.select(F.col(raw).cast("double").alias("x"), F.col(outcome).cast("double").alias("v"), F.col(tie_break).alias("_tie"))
    sound = F.lit(True)
    for c in ("x", "v"):
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    count, bad, low, high, least, most = wanted.agg(
        F.count(F.lit(1)), F.count_if(~sound), F.min("x"), F.max("x"), F.min("v"), F.max("v")
    ).first()
    if not count or bad:
        raise ValueError("isotonic fit needs finite scores and outcomes")
    if least == most:
        raise ValueError("no variation of the outcome to calibrate on")
    if low == high:
        raise ValueError("a single raw score cannot be calibrated")
    size = max(RUN, -(-count // RUNS))
    placed = numbered(wanted, [F.col("x"), F.col("_tie")])
    runs = placed.select(F.floor(F.col("ordinal") / size).cast("long").alias("run"), "ordinal", "x", "v")
    cells = settled(runs.groupBy("run").applyInArrow(_pool, _CELLS), "minorants")
    state, lines = _merged(cells)
    spans: dict[int, list] = {}
    for line in lines:
        t0, t1, _, slope = line
        for k in state.touched(line):
            start, end = int(state.bounds[k]), int(state.bounds[k + 1])
            span = spans.setdefault(state.numbers[k], [state.numbers[k], start, 0.0, end, 0.0])
            if t0 <= start < t1:
                span[1:3] = [min(t1, end), slope]  # rows before this place lie under a tangent from the left
            elif start < t0 < end:
                span[3:] = [t0, slope]
    known = cells.sparkSession.createDataFrame(
        [tuple(s) for s in spans.values()], "run long, _left long, _left_fit double, _right long, _right_fit double"
    )
    fit = (
        F.when(F.col("first") < F.col("_left"), F.col("_left_fit"))
        .when(F.col("first") >= F.col("_right"), F.col("_right_fit"))
        .otherwise(F.col("total") / (F.col("end") - F.col("first")))
    )
    # One row for each run that a tangent meets.
    fitted = cells.join(F.broadcast(known), "run", "left").withColumn("_fit", fit)
    mean = F.sum(F.col("_fit") * F.col("n")) / F.sum("n")
    return fitted.groupBy("x").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)).alias("y"))


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give every row of a sorted task the last knot at or before it; rows before the first one get none."""
    last: list = [None] * 4
    for batch in batches:
        if not batch.num_rows:
            continue
        knots = np.flatnonzero(batch.column("_kind").to_numpy() == 0)
        place = np.searchsorted(knots, np.arange(batch.num_rows), side="right") - 1
        columns = []
        for name, column in zip(batch.schema.names, batch.columns):
            if name in _KNOT:
                carry = last[_KNOT.index(name)]
                known = pa.concat_arrays([pa.array([carry], pa.float64()), column.take(pa.array(knots))])
                columns.append(known.take(pa.array(place + 1)))
            else:
                columns.append(column)
        last = [columns[batch.schema.names.index(n)][-1].as_py() for n in _KNOT]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


_KNOT = ["_kx", "_ky", "_kx1", "_ky1"]


def last_knots(rows: DataFrame, value: Column, knots: DataFrame) -> DataFrame:
    """Each row with the last knot ``x`` at or below its value, and the knot after that one.

    Adds ``_kx, _ky, _kx1, _ky1``; rows below the first knot and rows without a value get nulls.  Knots
    and rows are sorted together by one range shuffle, spread inside one value by a hash of the row; a task
    carries knots along its rows, and what it ends with goes to the tasks after it.
    """
    ordered = numbered(knots.select(F.col("x").cast("double"), F.col("y").cast("double")), [F.col("x"), F.col("y")], name="_i")
    after = ordered.select((F.col("_i") - 1).alias("_i"), F.col("x").alias("_kx1"), F.col("y").alias("_ky1"))
    posts = ordered.join(after, "_i", "left").select(
        F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_salt"), F.col("x").alias("_v"),
        F.col("x").alias("_kx"), F.col("y").alias("_ky"), "_kx1", "_ky1",
    )
    asked = rows.withColumns({"_kind": F.lit(1), "_salt": F.xxhash64(*rows.columns), "_v": value.cast("double")})
    both = asked.unionByName(posts, allowMissingColumns=True)
    keys = [F.col("_v"), F.col("_kind"), F.col("_salt")]
    placed = both.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    placed = settled(placed.mapInArrow(_carried, placed.schema), "knots-placed")
    # One row for each task of the range shuffle.
    ends = placed.groupBy("_part").agg(F.max(F.when(F.col("_kind") == 0, F.struct(*_KNOT))).alias("_end"))
    tasks = sorted(((r["_part"], r["_end"]) for r in ends.collect()), key=lambda r: r[0])
    carried, known = [], None
    for part, end in tasks:
        carried.append((part, *(known or (None,) * 4)))
        known = tuple(end) if end is not None else known
    earlier = rows.sparkSession.createDataFrame(carried, "_part int, " + ", ".join(f"_c{k} double" for k in _KNOT))
    joined = placed.where("_kind = 1").join(F.broadcast(earlier), "_part", "left")
    own = F.col("_kx").isNotNull()
    filled = {k: F.when(own, F.col(k)).otherwise(F.col(f"_c{k}")) for k in _KNOT}
    missing = F.col("_v").isNull()
    return joined.select(*rows.columns, *[F.when(~missing, c).alias(k) for k, c in filled.items()])


def interpolate(rows: DataFrame, raw: str, knots: DataFrame, name: str = "confidence") -> DataFrame:
    """Piecewise linear value of ``raw`` over the knots, level beyond the ends, in [0, 1].

    A value that is null or not a number, and any value where there are no knots, gets null.
    """
    value = F.when(~F.isnan(raw), F.col(raw))
    found = last_knots(rows, value, knots)
    first = knots.agg(F.min(F.struct("x", "y"))["y"].cast("double").alias("y")).scalar()
    share = (F.col(raw) - F.col("_kx")) / (F.col("_kx1") - F.col("_kx"))
    inside = F.when(F.col("_kx1").isNull(), F.col("_ky")).otherwise(F.col("_ky") + (F.col("_ky1") - F.col("_ky")) * share)
    level = F.when(value.isNull(), F.lit(None).cast("double")).when(F.col("_kx").isNull(), first).otherwise(inside)
    # least and greatest would pass over a null.
    clipped = F.when(level.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), level)))
    return found.select(*rows.columns, clipped.alias(name))
