"""Connected components of a link table, distributed, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltomics.session import settled


def _undirected(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbourhood."""
    both = _undirected(links)
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them; links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("_m"))
    tied = links.join(least, "a").where(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return tied.union(least.select("a", F.col("_m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Per linked node the least node of its component: columns ``node, component``.

    ``links`` has columns ``a, b`` (longs); self-links and repeats do no harm.  Each round is written to
    the shared folder; the number of rounds is logarithmic in the longest chain.
    """
    links = settled(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    while True:
        links = settled(_small_star(_large_star(links)), "stars")
        # Done when no node has two neighbours above and no parent has a parent: the sums stand still then.
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
        ).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
