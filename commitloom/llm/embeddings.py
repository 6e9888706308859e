"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from .components import connected_components

THRESHOLD = 0.93  # cosine
AXES = 6  # leading principal dimensions of the grid
AXES_SAMPLE = 4096  # vectors that the dimensions are fitted on; links do not depend on them
BLOCK = 1024  # vectors in a leaf interval
FAN = 8  # intervals in the next larger interval
_LOW = [f"low{i}" for i in range(AXES)]
_HIGH = [f"high{i}" for i in range(AXES)]
_GROUP = ["label", "width"]  # vectors of one label and length are compared


def usable(vector: Column, label: Column) -> Column:
    """A label, and a vector of finite components that are not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal_axes(classes: DataFrame, size: int = AXES_SAMPLE) -> np.ndarray:
    """Leading principal dimensions of ``size`` unit vectors, taken by a hash, as columns.

    Vectors of another length than the most frequent one in the sample get no projection.
    """
    drawn = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(size).collect()
    if not drawn:
        return np.zeros((0, AXES))
    widths = [len(r.vector) for r in drawn]
    width = max(set(widths), key=lambda w: (widths.count(w), -w))
    sample = _units([r.vector for r in drawn if len(r.vector) == width])
    _, _, rows = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)
    axes = np.zeros((width, AXES))
    axes[:, : min(AXES, len(rows))] = rows[:AXES].T
    return axes


def _units(vectors) -> np.ndarray:
    rows = np.array(list(vectors), np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # keeps squares in range
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _project(axes: np.ndarray, cell: float):
    """Adds the grid cells of a vector and its place on the leading dimensions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = np.zeros((len(batch), AXES))
            known = (batch["width"] == len(axes)).to_numpy()
            if known.any():
                places[known] = _units(batch["vector"][known]) @ axes
            out = batch[["label", "width", "class_id", "copies"]].copy()
            out["cells"] = list(np.floor(places / cell).astype(np.int64))
            out["places"] = list(places)
            out["vector"] = [np.asarray(v, np.float64) for v in batch["vector"]]
            yield out

    return run


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Intervals of at most BLOCK neighbours in grid order, each one row with its bounds."""

    def block(part: pd.DataFrame) -> dict:
        places = np.array(list(part["places"]))
        return {
            "label": part["label"].iat[0],
            "width": part["width"].iat[0],
            "class_ids": part["class_id"].to_numpy(np.int64).tobytes(),
            "copies": part["copies"].to_numpy(np.int64).tobytes(),
            "units": _units(part["vector"]).tobytes(),
            **dict(zip(_LOW, places.min(axis=0))),
            **dict(zip(_HIGH, places.max(axis=0))),
        }

    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        done = []
        for _, part in rest.groupby(["label", "width"], sort=False):
            done += [part.iloc[i : i + BLOCK] for i in range(0, len(part), BLOCK)]
        if len(done) > 1:
            yield pd.DataFrame([block(part) for part in done[:-1]])
        rest = done[-1] if done else None
    if rest is not None and len(rest):
        yield pd.DataFrame([block(rest)])


def _near(eps: float) -> Column:
    """Bounds of intervals ``a`` and ``b`` that do not prove them farther apart than eps."""
    gaps = [F.greatest(F.col(f"a.{lo}") - F.col(f"b.{hi}"), F.col(f"b.{lo}") - F.col(f"a.{hi}"), F.lit(0.0)) for lo, hi in zip(_LOW, _HIGH)]
    return reduce(lambda x, y: x + y, [g * g for g in gaps]) <= eps * eps


def interval_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(label, width, a, b) positions, a <= b, of blocks that may hold links.

    The sequence of blocks is a tree of intervals. From the roots down, the children of each pair
    that is left are paired, and the pairs that their bounds prove distant are left out.
    """
    bounds = [*(F.min(c).alias(c) for c in _LOW), *(F.max(c).alias(c) for c in _HIGH)]
    levels = [blocks.select(*_GROUP, "at", *_LOW, *_HIGH)]
    count = levels[0].agg(F.max("at")).first()[0]
    while count:
        up = levels[-1].groupBy(*_GROUP, F.floor(F.col("at") / FAN).alias("at")).agg(*bounds)
        levels.append(up)
        count //= FAN
    pairs = levels[-1].select(*_GROUP, F.col("at").alias("a"), F.col("at").alias("b"))
    for level in reversed(levels[:-1]):
        level = level.withColumn("up", F.floor(F.col("at") / FAN))
        on = lambda side, up: [*(F.col(f"p.{c}") == F.col(f"{side}.{c}") for c in _GROUP), F.col(f"p.{side}") == F.col(f"{side}.{up}")]
        joined = pairs.alias("p").join(level.alias("a"), on("a", "up")).join(level.alias("b"), on("b", "up"))
        kept = joined.filter((F.col("a.at") <= F.col("b.at")) & _near(eps))
        pairs = scratch.stored(kept.select(*(f"p.{c}" for c in _GROUP), F.col("a.at").alias("a"), F.col("b.at").alias("b")))
    return pairs


def _roots(rows: np.ndarray, cols: np.ndarray, size: int) -> np.ndarray:
    """The smallest index each of ``size`` nodes reaches over the given links."""
    root = np.arange(size)
    while True:
        least = np.minimum(root[rows], root[cols])
        new = root.copy()
        np.minimum.at(new, rows, least)
        np.minimum.at(new, cols, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _join(threshold: float):
    """Links of a pair of blocks, summed: a row per vector that has any, and not per link."""

    def pair(row) -> pd.DataFrame:
        ids, copies = (np.frombuffer(row[c], np.int64) for c in ("a_ids", "a_copies"))
        left = np.frombuffer(row["a_units"]).reshape(len(ids), -1)
        if row["a"] == row["b"]:
            linked = left @ left.T >= threshold
            np.fill_diagonal(linked, False)
            counts = linked @ copies
        else:
            other_ids, other_copies = (np.frombuffer(row[c], np.int64) for c in ("b_ids", "b_copies"))
            right = np.frombuffer(row["b_units"]).reshape(len(other_ids), -1)
            found = left @ right.T >= threshold
            counts = np.concatenate([found @ other_copies, copies @ found])
            ids = np.concatenate([ids, other_ids])
            linked = found
        rows, cols = np.nonzero(linked)
        cols = cols if row["a"] == row["b"] else cols + len(left)
        some = np.flatnonzero(counts)
        return pd.DataFrame({"class_id": ids[some], "links": counts[some], "to": ids[_roots(rows, cols, len(ids))[some]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield pair(row)

    return run


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row; links are pairs of equal label and cosine >= threshold.

    Vectors that are null, zero or hold null or non-finite components, and vectors without a label or
    of different lengths, link with nothing: n_links 0, component_id their own key. Equal vectors
    of a label are one class with a count, so thousands of copies are compared once; n_links
    counts copies, repeated rows included. Rows with a null key link, but a component_id is the smallest key
    that is not null. kept is ``key = component_id``, null keys are not kept. Other columns are
    not read; an empty table gives no rows.

    Classes are sorted by grid cells of side eps on the leading principal dimensions, where eps is
    the distance of unit vectors at the threshold; distances there are never larger than the full
    ones, so skipped intervals hold no link. Any two blocks are compared by one matrix product in
    double precision, which gives sums and a spanning set of links, never all pairs.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold lies between 0 and 1")
    eps = math.sqrt(2 - 2 * threshold) * (1 + 1e-9)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    same = rows.filter(usable(F.col("vector"), F.col("label"))).groupBy("label", "vector")
    classes = same.agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = scratch.stored(classes.withColumn("class_id", F.monotonically_increasing_id()))

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = f"label {kinds['label']}, width int, class_id long, copies long, cells array<long>, places array<double>, vector array<double>"
    sized = classes.select("label", F.size("vector").alias("width"), "class_id", "copies", "vector")
    placed = sized.mapInPandas(_project(principal_axes(classes), eps), schema)
    order = [*_GROUP, "cells", "class_id"]
    placed = scratch.stored(placed).repartitionByRange(*order).sortWithinPartitions(*order)
    bounds = ", ".join(f"{c} double" for c in [*_LOW, *_HIGH])
    cut = placed.mapInPandas(_cut, f"label {kinds['label']}, width int, class_ids binary, copies binary, units binary, {bounds}")
    blocks = scratch.stored(cut.withColumn("n", F.monotonically_increasing_id()))
    places = F.row_number().over(_window()).cast("long") - 1
    at = scratch.stored(blocks.select(*_GROUP, "n", *_LOW, *_HIGH).withColumn("at", places))

    pairs = interval_pairs(at, eps)
    held = at.select(*_GROUP, "at", "n").join(blocks.select("n", "class_ids", "copies", "units"), "n").drop("n")

    def side(name: str) -> DataFrame:
        held_as = {"at": name, "class_ids": f"{name}_ids", "copies": f"{name}_copies", "units": f"{name}_units"}
        return held.withColumnsRenamed(held_as)

    both = pairs.join(side("a"), [*_GROUP, "a"]).join(side("b"), [*_GROUP, "b"]).drop(*_GROUP)
    found = scratch.stored(both.mapInPandas(_join(threshold), "class_id long, links long, to long"))

    grouped = connected_components(found.select("class_id", "to")).toDF("class_id", "component")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    linked = classes.join(links, "class_id", "left").join(grouped, "class_id", "left")
    linked = linked.withColumn("component", F.coalesce("component", "class_id"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    total = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    result = scratch.stored(linked.join(least, "component").select("label", "vector", total, "component_id"))
    joined = rows.join(result.withColumn("known", F.lit(True)), ["label", "vector"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    return joined.select(F.col("id").alias(key), links, component, F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy(*_GROUP).orderBy("n")
