"""Incremental work: pending units, page and fetch lists, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: commits per API page.
COMMITS_PER_PAGE = 90


def pending_units(
    units: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False
) -> DataFrame:
    """Units without output yet; all of them when overwriting."""
    return units if overwrite else units.join(done.select(*keys), keys, "left_anti")


def page_plan(
    repos: DataFrame, per_page: int = COMMITS_PER_PAGE, mode: str = "compat"
) -> DataFrame:
    """One row per page to fetch of (owner, repo, commit_count).

    ``compat`` loses the last partial page of repositories over one page; ``full``
    covers every commit. A failed count (-1) gives no page.
    """
    count = F.col("commit_count")
    if mode == "compat":
        pages = F.greatest(F.floor(count / per_page), F.lit(1))
    elif mode == "full":
        pages = F.ceil(count / per_page)
    else:
        raise ValueError(f"mode must be 'compat' or 'full', not {mode!r}")
    counted = repos.where(count >= 0).withColumn("pages", pages.cast("int")).where("pages > 0")
    return counted.select("owner", "repo", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))


def last_page(link_header: Column) -> Column:
    """Page number in the second link of a ``Link`` header; null without one."""
    last = F.get(F.split(link_header, ","), F.lit(1))
    number = F.substring_index(F.get(F.split(last, "&page="), F.lit(1)), ">;", 1)
    return number.try_cast("int")


def diff_fetch_plan(annotated: DataFrame, raw_diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of fitting commits whose diff has not landed; overwriting never applies here."""
    return annotated.where("fits_requirements").select(*keys).join(
        raw_diffs.select(*keys), keys, "left_anti"
    )


def with_reason(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reason``: the name of the first rule a row breaks, null for a good row.

    A rule is a condition that good rows fulfil; unknown counts as broken.
    """
    broken = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]
    return df.withColumn("reason", F.coalesce(*broken, F.lit(None).cast("string")))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reason``); one bad row never stops the others."""
    flagged = with_reason(df, rules)
    return flagged.where("reason IS NULL").drop("reason"), flagged.where("reason IS NOT NULL")


def store_checked(
    df: DataFrame, rules: dict[str, Column], path: str
) -> tuple[DataFrame, DataFrame]:
    """``quarantine`` through a table: the rows are computed once, checked and written under
    ``is_bad=false`` and ``is_bad=true``; runs a job."""
    flagged = with_reason(df, rules).withColumn("is_bad", F.col("reason").isNotNull())
    flagged.write.mode("overwrite").partitionBy("is_bad").parquet(path)
    schema = flagged.schema
    table = df.sparkSession.read.schema(schema).parquet(path)
    good, bad = table.where(~F.col("is_bad")), table.where("is_bad")
    return good.drop("reason", "is_bad"), bad.drop("is_bad")
