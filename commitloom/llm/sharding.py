"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

SHARDS = 24
BLOCKS = 4096  # most rows of the matrix: input partitions beyond it are read together
SLICE = 50_000  # rows of a shard that are ranked in one window, about
_LOCAL = (1 << 33) - 1  # row bits of monotonically_increasing_id


def hypergeometric(good: int, bad: int, draws: int, random: np.random.Generator) -> int:
    """How many of ``draws`` without replacement are good; exact to double precision at any size.

    Inverts the distribution function over the range that holds all but about 1e-30 of it.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mean = draws * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - draws) / max(1, total - 1)))
    first = max(low, int(mean - 12 * spread) - 30)
    last = min(high, int(mean + 12 * spread) + 30)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(weights - weights.max()))
    return first + int(np.searchsorted(chances, random.random() * chances[-1], side="right").clip(0, len(chances) - 1))


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each block that go to each shard, as a uniform permutation of all rows deals them.

    Row sums are ``counts``; column sums differ by one at most.
    """
    random = np.random.default_rng(seed)
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for count in counts:
        row, draws, rest = [], count, sum(left)
        for s in range(shards):
            rest -= left[s]
            taken = hypergeometric(left[s], rest, draws, random)
            row.append(taken)
            draws -= taken
        left = [have - taken for have, taken in zip(left, row)]
        out.append(row)
    return out


def shuffle(rows: DataFrame, by: list[str], shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    A uniform shuffle: each partition's rows are permuted where they lie, an exactly drawn number of them
    goes to each shard, and each shard is permuted again. Shards differ by one row at most, whatever
    the data: equal rows, null keys and hot groups are ordinary rows. ``by`` names the columns that
    seed the permutations; reruns over the same files agree. Columns named shard or slot are
    replaced. An empty table gives no rows.

    One exchange. Rows lie in the shared folder after the first permutation, so that the
    counts and the rows agree when an executor is lost. The driver sees one number per partition, of
    at most ``BLOCKS``, and makes blocks x shards numbers. A shard is ranked in slices of its hash
    range whose number grows with it, so no task holds a shard.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    key = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in by)).alias("first")
    local = rows.coalesce(BLOCKS).select(row, key).sortWithinPartitions("first", *(f"row.`{c}`" for c in by))
    rank = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))
    local = scratch.stored(local.select("row", "first", F.spark_partition_id().alias("block"), rank.alias("rank")))

    sizes = sorted(tuple(r) for r in local.groupBy("block").count().collect())
    dealt = matrix([n for _, n in sizes], shards, seed)
    limits = [{"block": b, "limits": np.cumsum(r).tolist()} for (b, _), r in zip(sizes, dealt)]
    deal = F.explode(F.from_json(F.lit(json.dumps(limits)), "array<struct<block int, limits array<long>>>"))
    plan = rows.sparkSession.range(1).select(deal.alias("deal")).select("deal.*")
    shard = F.size(F.filter("limits", lambda x: x <= F.col("rank"))).alias("shard")
    again = F.xxhash64(F.lit(seed + 1), "first", "block", "rank").alias("again")
    moved = local.join(plan, "block").select("row", "block", "rank", shard, again)

    total = sum(n for _, n in sizes)
    bits = max(0, math.ceil(math.log2(max(1, total / shards / SLICE))))
    part = F.shiftrightunsigned("again", 64 - bits) if bits else F.lit(0).cast("long")
    moved = moved.withColumn("part", part)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = moved.groupBy("shard", "part").count()
    offsets = offsets.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("again", "block", "rank")
    ranked = moved.withColumn("inside", F.row_number().over(inside) - 1)
    slot = (F.col("offset") + F.col("inside")).cast("long").alias("slot")
    placed = ranked.join(offsets, ["shard", "part"])
    return placed.select(*(F.col("row").getField(c).alias(c) for c in names), F.col("shard").cast("int").alias("shard"), slot)
