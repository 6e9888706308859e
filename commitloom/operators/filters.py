"""Row and column filters; all are plain predicates or semi/anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patch as P


def all_files_supported(commits: DataFrame, flavor: str = "v1") -> DataFrame:
    return commits.where(P.all_files_supported(F.col("files"), flavor))


def complete_patches(commits: DataFrame) -> DataFrame:
    return commits.where(P.complete_patches(F.col("files")))


def drop_incomplete_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def drop_incomplete_columns(df: DataFrame) -> DataFrame:
    """Drop every column that holds a null; one aggregation pass, one row to the driver."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if not nulls[c]])


def single_file(df: DataFrame, allow_multi: bool = False) -> DataFrame:
    return df if allow_multi else df.where(F.col("file_count") == 1)


def unmixed(df: DataFrame, allow_mixed: bool = False) -> DataFrame:
    return df if allow_mixed else df.where(F.col("content_type") != "Mixed")


def for_language(df: DataFrame, lang: str | None) -> DataFrame:
    return df if lang is None else df.where(F.col("main_lang") == lang)


def drop_null_messages(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["message"])


def no_merges(commits: DataFrame) -> DataFrame:
    """Keep commits with at most one parent, and those whose parents are not known."""
    return commits.where(F.col("parents").isNull() | (F.size("parents") <= 1))


def passing_only(diffs: DataFrame, annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Diffs whose commit fits the requirements now.

    ``keys`` hold the commit hash, so a large repository spreads over all partitions;
    the planner broadcasts the hashes only if they are measured to be small.
    """
    fitting = annotated.where("fits_requirements").select(*keys)
    return diffs.join(fitting, keys, "left_semi")
