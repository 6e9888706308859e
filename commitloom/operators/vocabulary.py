"""Vocabulary table and encoding of whole texts to ids."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import UNKNOWN
from ..functions.text import words

# The first ids, in order.
SPECIALS = ("<s>", "<pad>", "</s>", "<unk>", "<mask>")
MARKERS = ("<ide>", "<add>", "<del>", "<msg>", "<path>")
RESERVED = SPECIALS + MARKERS
#: Tokens of a vocabulary that are looked up inside the row, at most.
INLINE = 65_536
LONGEST = 128  # bytes of such a token, at most
#: One row in so many is sketched for heavy tokens.
SAMPLED = 16
_SLOTS = 1 << 13
_MARKER_PATTERN = "(<(?:" + "|".join(token[1:-1] for token in RESERVED) + ")>)"


def tokens(text: Column) -> Column:
    """Whitespace tokens, with each special token or marker a token of its own."""
    return words(F.regexp_replace(text, _MARKER_PATTERN, " $1 "))


def count_tokens(df: DataFrame, columns: list[str]) -> DataFrame:
    """(token, n) over the columns, reserved tokens left out.

    Tokens are counted before the shuffle, so a frequent token is one row per task.
    """
    every = F.concat(*[tokens(F.coalesce(c, F.lit(""))) for c in columns])
    counted = df.select(F.explode(every).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counted.where(~F.col("token").isin(*RESERVED))


def build_vocab(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """(token, id): the reserved tokens, then the ``size`` most frequent ones.

    The ranking window runs over the ``size`` rows left by the top-n only.
    """
    top = count_tokens(df, columns).orderBy(F.desc("n"), "token").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    ranked = top.select("token", (rank + (len(RESERVED) - 1)).cast("int").alias("id"))
    reserved = df.sparkSession.createDataFrame(
        [(token, i) for i, token in enumerate(RESERVED)], "token string, id int"
    )
    return reserved.unionByName(ranked)


def _slot(token: Column) -> Column:
    return F.pmod(F.hash(token), F.lit(_SLOTS))


def _index(entries: list[tuple[str, int]], spark: SparkSession) -> Column:
    """Some tokens and their ids as a constant: an array of hash slots, each a short map.

    A map lookup is a linear scan; spread over slots it sees a handful of entries.
    """
    table = spark.createDataFrame(entries, "token string, id int")
    slots: list[dict[str, int]] = [{} for _ in range(_SLOTS)]
    for row in table.select("token", "id", _slot(F.col("token")).alias("slot")).collect():
        slots[row["slot"]][row["token"]] = row["id"]
    return F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,int>>")


def _heavy(df: DataFrame, every: Column, count: int, columns: list[str] | None = None) -> list[str]:
    """About the most frequent tokens, by a sketch over one row in ``SAMPLED``; they decide how a token is looked up, not its id.

    Rows are drawn by their ``columns`` if given, so that those not drawn are not split into tokens.
    """
    some = df.where(F.pmod(F.xxhash64(*(columns or [every])), F.lit(SAMPLED)) == 0).select(F.explode(every).alias("token"))
    sketch = F.call_function("approx_top_k", F.col("token"), F.lit(count), F.lit(min(8 * count, 1_000_000)))
    found = some.agg(sketch.alias("top")).first()["top"]
    return [row["item"] for row in found or []]


def _row_id(df: DataFrame, keys: list[str], columns: list[str]) -> list[Column]:
    """128 bits that stand for a row's keys and texts, null or not."""
    values = [x for c in dict.fromkeys([*keys, *columns]) for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*values).alias("__a"), F.xxhash64(F.lit(1), *reversed(values)).alias("__b")]


def _looked_up(df: DataFrame, keys: list[str], columns: list[str], every: Column, small: list[str], vocab: DataFrame) -> DataFrame:
    """``df`` with ``__found``: slots of token -> id maps of a row's tokens that are in ``vocab``, those of ``small`` left out.

    A row's distinct tokens meet the vocabulary in an equi-join. Tokens found in many rows are in ``small``, so that no
    task of the join gets the rows of a hot one. The slots keep the look-up short in long texts.
    """
    spark = df.sparkSession
    rows = df.withColumns({"__a": _row_id(df, keys, columns)[0], "__b": _row_id(df, keys, columns)[1]})
    known = F.get(_index([(t, 0) for t in small], spark), _slot(F.col("token")))
    long = rows.select("__a", "__b", F.explode(F.array_distinct(every)).alias("token"))
    rest = long.where(F.element_at(known, F.col("token")).isNull())
    pairs = rest.join(vocab.select("token", "id"), "token").groupBy("__a", "__b").agg(F.collect_set(F.struct("token", "id")).alias("pairs"))
    slots = F.ceil(F.sqrt(F.size("pairs"))).cast("int")

    def slot(number: Column) -> Column:
        return F.map_from_entries(F.filter("pairs", lambda p: F.pmod(F.hash(p["token"]), slots) == number))

    found = pairs.select("__a", "__b", F.transform(F.sequence(F.lit(0), slots - 1), slot).alias("__found"))
    return rows.join(found, ["__a", "__b"], "left").drop("__a", "__b")


def encode(df: DataFrame, columns: list[str], vocab: DataFrame, keys: str | list[str], inline: int = INLINE) -> DataFrame:
    """Add ``<column>_ids`` for each text column, unknown tokens as the unknown id.

    A vocabulary of up to ``inline`` tokens is looked up inside the row, as a constant: no row is shuffled. Of a larger one that
    many tokens are, those that a sketch finds to be the heaviest in the texts; a row's other tokens look it up in an
    equi-join and come back to the row. The bound is on the constant, not on the vocabulary, and both ways give the same
    ids. ``keys`` identify a row together with its texts; any of them may be null. Repeated rows stay. ``vocab``
    should be a stored table, since its size is counted.
    """
    spark = df.sparkSession
    keys = [keys] if isinstance(keys, str) else keys
    every = F.concat(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in columns])
    table = vocab.select("token", "id")
    table = table.where(~F.col("token").isin(*RESERVED))  # their ids are fixed
    short = F.octet_length("token") <= LONGEST
    head = table.where(short).limit(inline + 1).collect()  # inline + 1 rows at most
    joined = len(head) > inline or not table.where(~short).isEmpty()
    if joined:
        heavy = [t for t in _heavy(df, every, inline, columns) if len(t.encode()) <= LONGEST and t not in RESERVED]
        names = spark.createDataFrame([(t,) for t in heavy], "token string")
        head = names.join(table, "token", "left").collect()  # inline rows at most; without an id where unknown
        df = _looked_up(df, keys, columns, every, [*RESERVED, *heavy], table)
    ids = {r["token"]: UNKNOWN if r["id"] is None else r["id"] for r in head} | {t: i for i, t in enumerate(RESERVED)}
    index = _index(list(ids.items()), spark)

    def token_id(token: Column) -> Column:
        found = F.element_at(F.get(index, _slot(token)), token)
        if joined:
            slots = F.col("__found")
            found = F.coalesce(found, F.element_at(F.get(slots, F.pmod(F.hash(token), F.size(slots))), token))
        return F.coalesce(found, F.lit(UNKNOWN))

    return df.withColumns({f"{c}_ids": F.transform(tokens(F.col(c)), token_id) for c in columns}).drop("__found")
