"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.session import checkpointed


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest of a node's neighbourhood.

    The large step moves a node's larger neighbours, the small step the node itself and its
    smaller ones. The smallest is an aggregate that is stored before it meets the pairs, so
    a node that owns most of the links is split by the adaptive join.
    """
    if large:
        near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b"), F.col("a")))
    else:
        near = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = checkpointed(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    met = near.join(least, "u")
    if large:
        moved = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): the smallest node that it reaches.

    Loops until a round changes nothing, which takes about as many rounds as the logarithm of
    the longest path. Self links and repeated links are allowed; no links give no rows.
    """
    state = lambda p: p.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    pairs = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = state(pairs)
    while seen[0]:
        pairs = checkpointed(_star(checkpointed(_star(pairs, True)), False))
        now = state(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return checkpointed(pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots))
