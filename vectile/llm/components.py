"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectile.session import materialise


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.inline(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Links of each node's neighbours to the smallest node around it.

    ``larger`` moves the neighbours above the node, otherwise the ones below it (and itself) move. The minimum is an
    aggregate with map-side combine and comes back by a join whose hot side AQE can split, so no neighbourhood
    is gathered anywhere.
    """
    around = _both_ways(links) if larger else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    joined = around.join(least, F.col("a") == F.col("node"))
    low = F.least("low", "a")
    if larger:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), low.alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), low.alias("b")).union(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): ``root`` is the smallest node reachable.

    Self links, repeated links and links with a null end are ignored; no links give an empty table. Every round
    writes its links to the shared folder, which also cuts the lineage, and compares an order-free
    digest of them with the one before. The number of rounds grows with the logarithm of the longest path.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now, before = materialise(links.distinct()), None
    for _ in range(rounds):
        after = digest(now)
        if after == before or not after[0]:
            break
        before = after
        now = materialise(_stars(_stars(now, True), False))
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
