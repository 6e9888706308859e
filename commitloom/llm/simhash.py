"""Near-duplicate documents by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from ..sources import scratch
from .components import connected_components

SHINGLE = 3  # words
SEED = 42
DISTANCE = 3  # differing bits of linked fingerprints
_CHUNK = 1 << 16  # shingles whose bits are counted at once
#: Distinct fingerprints with one half in common, from which a byte of the other half joins the key.
CROWD = 64


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; 0 without words (null, empty or white space only).

    A-Z are lower-cased, words are runs of anything but space and \\t \\n \\v \\f \\r. A text of fewer words
    than a shingle has one shingle. A bit is set if more than half of the shingle hashes, repeats
    included, have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not words:
        return 0
    width = min(shingle, len(words))
    total = len(words) - width + 1
    votes = np.zeros(64, np.int64)
    for start in range(0, total, _CHUNK):
        part = words[start : start + _CHUNK + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width))))
        hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        values = np.fromiter(map(fingerprint_of, batch), np.uint64, len(batch))
        yield pd.Series(values.view(np.int64))


def hex_digits(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _half(fingerprint: Column, segment: int) -> Column:
    low = F.lit(0xFFFFFFFF).cast("long")
    return fingerprint.bitwiseAND(low) if segment == 0 else F.shiftrightunsigned(fingerprint, 32)


def _ball(value: Column) -> Column:
    """The value, and the value without each of its set bits.

    Of two values that differ in one bit, one has it set; it finds the other.
    """
    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(32)))
    cleared = F.transform(F.filter(bits, lambda b: value.bitwiseAND(b) != 0), value.bitwiseXOR)
    return F.concat(F.array(value), cleared)


def _indexed(prints: DataFrame, keys) -> DataFrame:
    """(fp, segment, key) rows: for each half of a fingerprint the keys that ``keys`` makes of it."""
    halves = F.array(
        *(F.struct(F.lit(i).cast("byte").alias("segment"), keys(_half(F.col("fp"), i)).alias("keys")) for i in (0, 1))
    )
    rows = prints.select("fp", F.explode(halves).alias("half"))
    return rows.select("fp", "half.segment", F.explode("half.keys").alias("key"))


def _rest_bytes(rows: DataFrame) -> DataFrame:
    """Four rows for one: with each byte of the half that is not the segment."""
    rest = F.when(F.col("segment") == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    parts = F.array(
        *(F.struct(F.lit(i).cast("byte").alias("at"), F.shiftright(rest, 8 * i).bitwiseAND(F.lit(255)).alias("byte")) for i in range(4))
    )
    return rows.select("fp", "segment", "key", F.explode(parts).alias("part")).select("fp", "segment", "key", "part.*")


def _matches(probes: DataFrame, table: DataFrame, on: list[str], distance: int) -> DataFrame:
    # a broadcast would be chosen by the size before the rows were exploded, up to 34 times too small
    p, t = probes.hint("merge").alias("p"), table.hint("merge").alias("t")
    same = [F.col(f"p.{c}") == F.col(f"t.{c}") for c in on]
    apart = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp")))
    return p.join(t, [*same, apart.between(1, distance)]).select(F.col("p.fp").alias("u"), F.col("t.fp").alias("v"))


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) pairs of distinct fingerprints ``fp`` that differ in 1 to ``distance`` (at most 3) bits.

    Two fingerprints at distance 3 or less differ in at most one bit of one 32-bit half. So each is
    looked up in a table of halves by its halves and their neighbours one bit away, and the whole
    distance is verified in the join. Where more than ``CROWD`` fingerprints share a half, the other
    half differs in at most 3 bits and so has one of its four bytes in common: there the byte joins
    the key. Both ways find every pair.
    """
    if not 1 <= distance <= 3:
        raise ValueError("two segments with balls of one bit cover distances 1 to 3")
    table = _indexed(prints, lambda half: F.array(half))
    crowded = table.groupBy("segment", "key").count().filter(F.col("count") > CROWD).select("segment", "key")
    crowded = scratch.stored(crowded)
    on = ["segment", "key"]
    marked = table.join(crowded.withColumn("crowded", F.lit(True)), on, "left")
    marked = scratch.stored(marked.withColumn("crowded", F.coalesce("crowded", F.lit(False))))
    probes = _indexed(prints, _ball)
    plain = _matches(probes, marked.filter("not crowded"), on, distance)
    dense = probes.join(crowded, on, "left_semi")
    by_byte = _matches(_rest_bytes(dense), _rest_bytes(marked.filter("crowded")), [*on, "at", "byte"], distance)
    return plain.union(by_byte)


def _placed(docs: DataFrame, key: str, text: str, distance: int) -> DataFrame:
    """(id, digest, fp, component, component_id) for every row; component is a fingerprint, digest a hash of the text."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("digest"), _fingerprints(F.col(text)).alias("fp"))
    rows = scratch.stored(rows)
    nodes = scratch.stored(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = connected_components(links(nodes.select("fp"), distance)).toDF("fp", "component")
    placed = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = scratch.stored(placed.join(least, "component").select("fp", "component", "component_id"))
    return rows.join(classes, "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest key reachable over links of at most ``distance`` differing bits,
    itself included. Equal fingerprints are one node, however many rows have them, so copies cost a
    partial minimum; only distinct fingerprints are looked up. Null, empty and blank texts have
    fingerprint zero and are linked like any other; rows with a null key keep it and link, but are
    never a component_id unless nothing else is in the component (then it is null). Repeated rows
    stay. Other columns are not read. An empty table gives no rows.
    """
    rows = _placed(docs, key, text, distance)
    return rows.select(F.col("id").alias(key), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, placed: DataFrame, key: str, text: str) -> DataFrame:
    """Of each component of ``placed`` (id, digest, component, component_id) the row of ``docs`` with the least key, then text.

    A row is met again by its key and its text's hash, so neither a key that repeats in several components
    nor a null one brings them together.
    """
    chosen = placed.filter(F.col("id").eqNullSafe(F.col("component_id"))).select("id", "digest", "component").distinct()
    same = F.col(f"d.{key}").eqNullSafe(F.col("c.id")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("c.digest"))
    row = F.struct(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
    kept = docs.alias("d").join(chosen.alias("c"), same).select(F.col("c.component").alias("component"), row.alias("row"))
    # rows with the same text are told apart by their JSON form: not every type can be ordered
    order = F.struct(F.col("row").getField(text), F.to_json("row"))
    first = kept.groupBy("component").agg(F.min_by("row", order).alias("row"))
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each component, that with the smallest key; all columns of ``docs``.

    Rows that repeat the smallest key of their component are one document: one of them stays, the first by text, then by
    its JSON form. Other columns may be of any type. A component without any key is kept as its first text. A key that repeats in several components is kept once in each.
    """
    return first_rows(docs, _placed(docs, key, text, distance), key, text)
