"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3  # copies of a document
_STEPS = 80  # Newton steps at most; it takes about ten
_CLOSE = 1e-7  # of a target
_BINS = 4096  # of the rounding scores of a source
_ROUNDS = 3  # of filling up what a source lacks


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, target): all sizes shared by weight, no target above ``most`` sizes.

    Sources in code point order, null last, take the weights in turn. The excess over a stop
    goes to the others by weight until none is above: target = min(stop, weight x level), with the level
    found by raising it until the sum is right. Only that number is at the driver.
    """
    order = scratch.stored(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("n", F.monotonically_increasing_id())
    )
    part = F.shiftright("n", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = order.groupBy(part.alias("part")).count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
    place = F.col("offset") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = order.withColumn("part", part).join(parts, "part")
    weighed = ranked.select("source", "source_size", "docs", turn.alias("weight"), (F.col("source_size") * most).alias("stop"))
    weighed = scratch.stored(weighed)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        free = F.col("stop") > F.col("weight") * F.lit(level)
        full, rest = weighed.agg(F.sum(F.when(~free, F.col("stop"))), F.sum(F.when(free, F.col("weight")))).first()
        higher = (total - (full or 0)) / rest if rest else level
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    target = F.least(F.col("stop").cast("double"), F.col("weight") * F.lit(level)).alias("target")
    return weighed.select("source", "source_size", "docs", target)


def _rate(tilt: Column, size: Column, mean: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), tilt * size / mean)))


def tilts(sources: DataFrame, sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` with ``mean`` size and the ``tilt`` that makes the rates meet the target.

    Among all rates of 0 to ``most`` copies that take the target's words, the ones nearest to one copy of
    each document in relative entropy are min(most, exp(tilt x size / mean)). The tilt is the
    root of the dual's gradient. Newton steps, kept inside a shrinking bracket, run for all sources at once
    over ``sizes`` (source, size, docs); the sums are made by Spark, and the driver sees the largest error.
    """
    done = (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * most * (1 - 1e-12))
    state = sources.select(
        "*",
        (F.col("source_size") / F.col("docs")).alias("mean"),
        F.when(F.col("target") <= 0, F.lit(0.0)).when(done, F.lit(1e9)).otherwise(F.log(F.col("target") / F.col("source_size")) / 4).alias("tilt"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
        done.alias("done"),
    )
    state = scratch.stored(state)
    for _ in range(_STEPS):
        met = sizes.alias("d").join(state.filter("not done").alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
        mass = F.col("size") * F.col("d.docs")
        free = F.when(rate < most, rate * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = met.groupBy(F.col("s.source").alias("of")).agg(F.sum(mass * rate).alias("taken"), F.sum(mass * free).alias("slope"))
        both = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        off = F.col("taken") - F.col("target")
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        both = both.withColumns({"off": off, "low": low, "high": high, "newton": F.col("tilt") - off / F.col("slope")})
        inside = (F.coalesce(F.col("newton") > F.col("low"), F.lit(True))) & (F.coalesce(F.col("newton") < F.col("high"), F.lit(True)))
        bounded = F.col("low").isNotNull() & F.col("high").isNotNull()
        wider = F.when(off < 0, F.greatest(F.col("tilt") * 2, F.col("tilt") + 1)).otherwise(F.least(F.col("tilt") * 2, F.col("tilt") - 1))
        step = F.when(F.col("newton").isNotNull() & inside & (F.abs(F.col("newton") - F.col("tilt")) < 64), F.col("newton"))
        step = step.when(bounded, (F.col("low") + F.col("high")) / 2).otherwise(wider)
        met_it = F.col("done") | (F.abs("off") <= _CLOSE * F.col("target"))
        new = both.select(
            "source", "source_size", "docs", "target", "mean", F.when(met_it, F.col("tilt")).otherwise(step).alias("tilt"), "low", "high", met_it.alias("done")
        )
        state = scratch.stored(new)
        if not state.filter("not done").limit(1).count():
            break
    return state.select("source", "source_size", "docs", "target", "mean", "tilt")


def mix(
    docs: DataFrame, source: str = "source", size: str = "size", by: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 42,
) -> DataFrame:
    """``docs`` with source_size, target (double) and copies (0 to ``most``); no row is left out.

    ``size`` is a long column, not null; ``by`` seeds the rounding, reruns agree. A rate is rounded down,
    and the documents of a source with the best fraction less a hash get one more copy, as many as its target holds:
    first by a histogram of fixed bins, then by rank in the bin where it is met. Two more rounds give
    what is lacking to documents that fit in. So a source misses its target by less than one document. A null source is a source of its own. Documents
    without words take part with rate one and add nothing; a source without words has target zero.
    Repeated rows are rounded each for itself. An empty table gives no rows. Columns with the names
    of results are replaced.

    Sources are only ever met as sums made before a shuffle; the documents join them in a join that
    Spark broadcasts or splits. Nothing but sums over all sources comes to the driver.
    """
    names = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    draw = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in by)).alias("draw")
    numbered = docs.select(row, F.col(source).alias("source"), F.col(size).alias("size"), draw, F.monotonically_increasing_id().alias("n"))
    rows = scratch.stored(numbered)
    sizes = scratch.stored(rows.groupBy("source", "size").agg(F.count("*").alias("docs")))
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("docs"))
    known = scratch.stored(tilts(source_targets(sources, weights, most), sizes, most).withColumn("id", F.monotonically_increasing_id()))

    joined = rows.drop("row").join(known.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), most))
    uniform = F.shiftrightunsigned("draw", 11).cast("double") / float(1 << 53)
    scored = joined.select("n", "size", "draw", "id", rate.alias("rate")).select(
        "n", "size", "draw", "id", F.floor("rate").cast("long").alias("copies"), (F.col("rate") - F.floor("rate") - uniform).alias("score"), (F.col("rate") < most).alias("open")
    )
    scored = scratch.stored(scored.withColumn("bin", F.floor((1 - F.col("score")) / 2 * _BINS).cast("int")))
    for _ in range(_ROUNDS):
        scored = scratch.stored(_one_more(scored, known))
    given = scored.select("n", "id", "copies").join(known.select("id", "source_size", "target"), "id").drop("id")
    whole = rows.select("row", "n").join(given, "n")
    return whole.select(*(F.col("row").getField(c).alias(c) for c in names), "source_size", "target", "copies")


def _one_more(scored: DataFrame, known: DataFrame) -> DataFrame:
    """One more copy for the best open documents of each source, without going over its target."""
    taken = scored.groupBy("id").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    lack = taken.join(known.select("id", "target"), "id").select("id", (F.col("target") - F.col("taken")).alias("lack"))
    lack = scratch.stored(lack)
    rows = scored.join(lack, "id").withColumn("fits", F.col("open") & F.col("size").between(1, F.col("lack")))
    bins = rows.filter("fits").groupBy("id", "bin").agg(F.sum("size").alias("more"), F.max("lack").alias("lack"))
    upto = Window.partitionBy("id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.sum("more").over(upto))
    over = F.col("upto") > F.col("lack")
    edges = bins.groupBy("id").agg(
        F.coalesce(F.min(F.when(over, F.col("bin"))), F.lit(_BINS + 1)).alias("edge"),
        F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("given"),
    )
    # a stored table has a known size: a few sources are broadcast, many are a join that can be split
    rows = rows.join(scratch.stored(edges), "id", "left")
    best = Window.partitionBy("id", "bin").orderBy(F.desc("score"), "draw", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # dealt anew, so that a source's other documents do not come along and the joins can be split
    at_edge = rows.filter(F.col("fits") & (F.col("bin") == F.col("edge"))).repartition("id", "bin")
    at_edge = at_edge.withColumn("sum", F.col("given") + F.sum("size").over(best))
    won = scratch.stored(at_edge.filter("sum <= lack").select("n", F.lit(True).alias("won")))
    more = F.coalesce(F.col("fits") & (F.col("bin") < F.col("edge")), F.lit(False)) | F.coalesce("won", F.lit(False))
    rows = rows.join(won, "n", "left").withColumn("more", more)
    copies = (F.col("copies") + F.col("more").cast("int")).alias("copies")
    return rows.select("n", "size", "draw", "id", copies, "score", (F.col("open") & ~F.col("more")).alias("open"), "bin")
