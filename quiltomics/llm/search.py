"""Exact top-k inner-product search by MaxScore over shards.

Vectors are turned into integer terms: floor(256 * component).  A shard keeps one posting column per
component.  For a query every component's contribution lies between a lower and an upper bound in the
shard; measured from the lower bound, components are split by bound: the non-essential ones together
cannot lift a vector to the current k-th score.  Essential columns are traversed, the others are probed one group
after the other while the partial score plus the bounds of what is left stays competitive.
Shard results are merged.

Queries meet shards in blocks: every block of queries is sent to every shard once, rows of pairs are never
made.  Scores are exact (floats while all sums of a shard and block stay below 2^53, Python integers beyond that).

Defined cases: a vector that is null or holds a null or non-finite component takes no part, as query or
candidate; a shorter vector counts 0 where it has no component; ties go to the smaller id; a term beyond the long range
is the nearest long; ranks go by the exact score, and a score beyond the long range is given as the nearest long;
a query with fewer candidates gets all; repeated rows are candidates each, and a query id that repeats is one query
(its first vector); a query never gets rows of its own id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a shard and queries of a block, on average.
SHARD = 8192
QUERIES = 1024
_PROBE = 8
_LEAST, _MOST, _SHIFT = -(1 << 63), (1 << 63) - 1, 10**59


def terms(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id, terms``: integer components of the vectors that take part."""
    parts = F.transform(F.col(vector_column).cast("array<double>"), lambda x: F.floor(x * 256).cast("long"))
    sound = F.forall(
        F.col(vector_column).cast("array<double>"),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return vectors.where(F.col(vector_column).isNotNull() & sound).select(F.col(id_column).alias("id"), parts.alias("terms"))


def _largest(rows: list[list[int]]) -> int:
    return max((max(map(abs, r), default=0) for r in rows), default=0)


def _matrix(rows: list[list[int]], width: int, exact: bool) -> np.ndarray:
    """Rows of equal width; float64 where every inner product is ``exact`` in it, else Python integers."""
    out = np.zeros((len(rows), width), np.float64 if exact else object)
    for place, row in enumerate(rows):
        out[place, : len(row)] = row
    return out


class Shard:
    """Posting columns of a shard and their bounds."""

    def __init__(self, ids: np.ndarray, rows: list[list[int]], width: int, exact: bool) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.rows = _matrix([rows[i] for i in order], width, exact)
        self.columns = np.asfortranarray(self.rows)
        self.low, self.high = self.rows.min(axis=0), self.rows.max(axis=0)

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of the shard, ties to the smaller id."""
        one, two = query * self.low, query * self.high
        least, most = np.minimum(one, two), np.maximum(one, two)
        start = min(len(self.ids), 16 * k)
        known = self.rows[:start] @ query
        known = np.sort(known[self.ids[:start] != own])
        bar = known[-k] if len(known) >= k else None
        order = np.argsort(most - least, kind="stable")[::-1]  # widest bounds first
        if bar is None:
            essential = len(order)
        else:
            # Essential: the fewest widest columns such that a vector at their lower bounds cannot reach the bar.
            reach = np.cumsum(least[order]) + (most.sum() - np.cumsum(most[order]))
            below = np.flatnonzero(reach < bar)
            essential = int(below[0]) + 1 if len(below) else len(order)
        first = order[:essential]
        alive = np.arange(len(self.ids))
        partial = self.columns[:, first] @ query[first]
        rest = order[essential:]
        left = most[rest].sum()
        while True:
            if bar is not None:
                keep = partial + left >= bar
                alive, partial = alive[keep], partial[keep]
            if not len(rest):
                break
            probe, rest = rest[:_PROBE], rest[_PROBE:]
            partial = partial + self.rows[np.ix_(alive, probe)] @ query[probe]
            left = most[rest].sum()
        keep = self.ids[alive] != own
        alive, partial = alive[keep], partial[keep]
        best = np.lexsort((self.ids[alive], -partial))[:k] if partial.dtype != object else sorted(
            range(len(alive)), key=lambda i: (-partial[i], self.ids[alive[i]])
        )[:k]
        return [(int(partial[i]), int(self.ids[alive[i]])) for i in best]


def search(vectors: DataFrame, wanted: Column, k: int = 5, **columns: str) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every row for which ``wanted`` holds.

    ``wanted`` is a condition on the column ``id``.
    """
    every = terms(vectors, **columns)
    count, asked = every.agg(F.count(F.lit(1)), F.count(F.when(wanted, 1))).first()
    shards, blocks = max(1, -(-count // SHARD)), max(1, -(-asked // QUERIES))
    kinds = every.withColumn("_salt", F.xxhash64("id", "terms"))
    candidates = kinds.select(
        F.pmod("_salt", F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(False).alias("asks"), "id", "terms",
    )
    # Both kinds of rows are copied a fixed number of times: candidates once per query block, queries once per shard.
    questions = (
        kinds.where(wanted)
        .groupBy("id")
        .agg(F.min("terms").alias("terms"))
        .select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
            F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
            F.lit(True).alias("asks"), "id", "terms",
        )
    )

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids, parts = group.column("id").to_numpy(), group.column("terms").to_pylist()
        width = max(map(len, parts), default=0)
        found: list[tuple[int, int, int]] = []
        rows, wanting = np.flatnonzero(~asks), np.flatnonzero(asks)
        if len(rows) and len(wanting):
            held, asked = [parts[i] for i in rows], [parts[i] for i in wanting]
            exact = width * _largest(held) * _largest(asked) < 1 << 53
            shard = Shard(ids[rows], held, width, exact)
            for place, query in zip(wanting, _matrix(asked, width, exact)):
                found += [(int(ids[place]), i, s) for s, i in shard.top(query, int(ids[place]), k)]
        query_ids, row_ids, scores = zip(*found) if found else ((), (), ())
        return pa.table({
            "query_id": pa.array(query_ids, pa.int64()),
            "vec_id": pa.array(row_ids, pa.int64()),
            "score": pa.array([max(_LEAST, min(_MOST, s)) for s in scores], pa.int64()),
            # Sorts as the exact score does, whatever its size.
            "_order": pa.array([f"{s + _SHIFT:060d}" for s in scores], pa.string()),
        })

    each = candidates.union(questions.select(*candidates.columns)).groupBy("shard", "block").applyInArrow(
        run, "query_id long, vec_id long, score long, _order string"
    )
    # At most k rows per shard for one query.
    order = Window.partitionBy("query_id").orderBy(F.desc("_order"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_digest(vectors: DataFrame) -> DataFrame:
    """The search query's columns: every row whose id is divisible by 50, against all rows."""
    return search(vectors.select("vec_id", "embedding"), F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS (
  SELECT vec_id, unnest(t) AS x, generate_subscripts(t, 1) AS d FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.d = c.d
  WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
  GROUP BY q.vec_id, c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
