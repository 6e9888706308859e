"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = links.union(links.select("v", "u")).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    return (
        both.filter("other > node")
        .join(least, "node")
        .select(F.col("other").alias("u"), F.col("least").alias("v"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    moved = links.join(least, "u").filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.toDF("u", "v")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node it reaches.

    ``links`` has two long columns and no nulls; order, repeats and self-links do not matter.
    Each round writes its links to the shared folder, so a lost executor repeats one round at
    most. The number of links never grows; the number of rounds is logarithmic in the longest
    path. A hub is only ever met by a partial minimum and by a join that Spark can split. Only a
    count and a checksum come to the driver. No links give no rows.
    """
    u, v = (F.col(c) for c in links.columns)
    now = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v").distinct()
    now = scratch.stored(now)
    before = _state(now)
    while before[0]:
        now = scratch.stored(_small_star(_large_star(now)))
        state = _state(now)
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
