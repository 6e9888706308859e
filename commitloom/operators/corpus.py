"""Corpus-level operators: file rows, funnel, union, order, split, samples."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patch as P
from ..functions.hashing import hash_bucket, hex_number, key_hash
from .annotate import MAX_SUBJECT_LENGTH, MIN_SUBJECT_WORDS, either_verb_object

# 80/10/10 borders on the first four hex digits of the key hash.
TRAIN_BELOW, TEST_BELOW = "cccd", "e666"
SPLITS = ("train", "test", "valid")


def explode_files(commits: DataFrame, compat: bool = False) -> DataFrame:
    """One row per changed file of (owner, repo, sha, message, files) commits.

    ``compat`` keeps the file ending on the hash and the failing language lookup.
    """
    sha = F.concat("sha", F.lit(".json")) if compat else F.col("sha")
    return commits.select(
        "owner",
        "repo",
        sha.alias("sha"),
        "message",
        (F.size("files") > 1).alias("is_multipart"),
        F.explode("files").alias("file"),
    ).select(
        P.language_raw(F.col("file.filename"), compat).alias("language"),
        "owner",
        "repo",
        "sha",
        "message",
        F.col("file.filename").alias("path"),
        F.col("file.patch").alias("patch"),
        "is_multipart",
    )


def gather_files(
    file_rows: DataFrame, keys: tuple[str, ...] = ("repo_key", "sha"), order: str = "file_idx"
) -> DataFrame:
    """Long file rows back to one ordered ``files`` array per commit.

    The group is one commit's files, never a repository's; forks that share a commit hash
    stay apart by the repository in ``keys``.
    """
    fields = [c for c in file_rows.columns if c not in keys]
    ordered = [order] + [c for c in fields if c != order]
    return file_rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*ordered))).alias("files")
    )


FUNNEL_STEPS = (
    "scraped",
    "annotated",
    "not_bot",
    "not_chore",
    "short_enough",
    "enough_words",
    "verb_object",
    "fitting",
    "landed",
    "processed",
)


def funnel_rules() -> dict[str, Column]:
    """The steps that an annotated row alone decides."""
    return {
        "not_bot": ~F.col("is_bot"),
        "not_chore": ~F.col("is_chore"),
        "short_enough": F.col("subject_length") <= MAX_SUBJECT_LENGTH,
        "enough_words": F.col("subject_word_count") >= MIN_SUBJECT_WORDS,
        "verb_object": either_verb_object(),
        "fitting": F.col("fits_requirements"),
    }


def funnel_flags(
    scraped: DataFrame, annotated: DataFrame, landed: DataFrame, processed: DataFrame
) -> DataFrame:
    """One row per scraped commit with a flag for each step it reached.

    All inputs are keyed by (owner, repo, sha), so no repository is a hot join key.
    The stages are tagged, stacked and merged by one aggregation instead of three joins.
    A landed or processed commit that no longer fits the requirements is not counted there; that
    follows from the merged flags, so the later stages need no join with the annotated one.
    """
    keys = ["owner", "repo", "sha"]
    rules = {"annotated": F.lit(True), **funnel_rules()}
    parts = [
        scraped.select(*keys, F.lit(True).alias("scraped")),
        annotated.select(*keys, *[rule.alias(step) for step, rule in rules.items()]),
        landed.select(*keys, F.lit(True).alias("landed")),
        processed.select(*keys, F.lit(True).alias("processed")),
    ]
    still = {step: F.col(step) & F.col("fitting") for step in ("landed", "processed")}
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = stacked.groupBy(*keys).agg(
        *[F.coalesce(F.bool_or(step), F.lit(False)).alias(step) for step in FUNNEL_STEPS]
    )
    return merged.where("scraped").withColumns(still)


def funnel(flags: DataFrame) -> DataFrame:
    """Commits per step for each repository, each owner and in total (null keys).

    Counts come per repository first, so the rollup runs over few rows.
    """
    per_repo = flags.groupBy("owner", "repo").agg(
        *[F.count_if(F.col(step)).alias(step) for step in FUNNEL_STEPS]
    )
    return per_repo.rollup("owner", "repo").agg(
        *[F.sum(step).alias(step) for step in FUNNEL_STEPS]
    )


def union_repos(parts: list[DataFrame]) -> DataFrame:
    """Stack annotated tables that carry owner and repo; the subject length becomes a number."""
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    return stacked.withColumn("subject_length", F.col("subject_length").cast("int"))


def shuffle(df: DataFrame, key: str = "sha", seed: str = "0") -> DataFrame:
    """Reproducible random row order, global over the partitions: by the key's hash, then the key."""
    return spread_by_hash(df, key, seed).sortWithinPartitions(key_hash(F.col(key), seed), key)


def spread_by_hash(df: DataFrame, key: str = "sha", seed: str = "0") -> DataFrame:
    """Rows in as many partitions as the session shuffles to, each an interval of the key's hash.

    The hash is uniform, so its first digits name the partition: unlike a range exchange, which
    samples its bounds, this runs the input once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(parts, hash_bucket(key_hash(F.col(key), seed), parts))


def split_of(key: Column, seed: str = "0") -> Column:
    """Split name by key; a row keeps its split when the table grows."""
    digits = F.substring(key_hash(key, seed), 1, 4)
    return (
        F.when(digits < TRAIN_BELOW, F.lit("train"))
        .when(digits < TEST_BELOW, F.lit("test"))
        .otherwise(F.lit("valid"))
    )


def split(df: DataFrame, key: str = "sha", seed: str = "0") -> DataFrame:
    return df.withColumn("split", split_of(F.col(key), seed))


def debug_head(df: DataFrame, key: str = "sha", n: int = 2) -> DataFrame:
    """First n rows of each split by key.

    One pass for all splits: the planner limits each partition to n rows a split before it
    shuffles them, so no split is gathered.
    """
    place = F.row_number().over(Window.partitionBy("split").orderBy(key))
    known = df.where(F.col("split").isin(*SPLITS))
    return known.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def sample_rows(df: DataFrame, n: int, key: str = "sha", seed: str = "0") -> DataFrame:
    """n random rows, the same for the same seed; a top-n over the key hash."""
    return df.orderBy(key_hash(F.col(key), seed), F.col(key)).limit(n)


def sample_with_replacement(df: DataFrame, n: int, key: str = "sha", seed: str = "0") -> DataFrame:
    """Exactly n random rows with ``draw``, 0 to n - 1; a row may be drawn several times, the same for the same seed.

    Each draw picks a place in the order of the key's hash. The hash cuts the rows into intervals; their sizes,
    one number a shuffle partition, say which interval a place is in and where, so the intervals get multinomial shares. Rows
    are ranked inside their interval only. ``key`` names a row; a table without rows gives none.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digits = key_hash(F.col(key), seed)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), digits.alias("digits"), F.col(key).alias("key"))
    rows = rows.withColumn("interval", hash_bucket(F.col("digits"), parts))
    sizes = {r["interval"]: r["count"] for r in rows.groupBy("interval").count().collect()}
    ends = list(accumulate(sizes.get(i, 0) for i in range(parts)))
    total = ends[-1]
    number = hex_number(key_hash(F.concat(F.lit("draw:"), F.col("id").cast("string")), seed), 1, 15)
    wide = number.cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    draws = spark.range(n if total else 0).select(F.col("id").alias("draw"), wide.alias("wide"))
    place = F.expr("wide div cast(1152921504606846976 as decimal(19,0))")  # 2 to the 60th: 15 digits
    limits = F.array(*(F.lit(e).cast("long") for e in ends))
    draws = draws.withColumn("place", place).withColumn("interval", F.size(F.filter(limits, lambda e: e <= F.col("place"))))
    start = F.get(F.array(*(F.lit(e).cast("long") for e in [0, *ends])), F.col("interval"))
    draws = draws.select("draw", "interval", (F.col("place") - start).alias("rank"))
    rank = F.row_number().over(Window.partitionBy("interval").orderBy("digits", "key")) - 1
    ranked = rows.select("row", "interval", rank.cast("long").alias("rank"))
    return ranked.join(draws, ["interval", "rank"]).select("row.*", "draw")
