"""Readers. Every schema is declared.

The JSON readers keep a row for a file that cannot be parsed, with its text in ``_corrupt_record``
and null elsewhere, so that a job can put it into quarantine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import patch as P
from . import files

CORRUPT = "_corrupt_record"


def parse_repo_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(url, owner, repo) of repository lines; '#' lines go, a line without '/' has no owner."""
    line = F.col(column)
    parts = F.split(line, "/")
    return lines.where(~line.startswith("#")).select(
        line.alias("url"),
        F.when(F.size(parts) >= 2, F.element_at(parts, -2)).alias("owner"),
        F.element_at(parts, -1).alias("repo"),
    )


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """Repository list, one URL per line; rows with a null owner are for quarantine."""
    return parse_repo_lines(spark.read.text(path))


def read_top_repos(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 CSV of popular repositories, with a path-safe id and a language partition."""
    raw = spark.read.csv(path, header=True, encoding="ISO-8859-1")
    return raw.select(
        F.col("name").alias("repo"),
        F.col("defaultBranch").alias("main_branch"),
        F.col("mainLanguage").alias("language"),
    ).withColumns(
        {"repo_id": P.repo_id(F.col("repo")), "language_dir": F.lower("language")}
    )


def flatten_api_commits(raw: DataFrame) -> DataFrame:
    return raw.select(
        "sha",
        F.col("commit.author.name").alias("author"),
        F.col("commit.committer.name").alias("committer"),
        F.col("commit.message").alias("message"),
        *([CORRUPT] if CORRUPT in raw.columns else []),
    )


def read_api_commits(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """Commits as the API answers them, an object or a page (an array of them) in a file of these ``names``, one flat row per commit."""
    return flatten_api_commits(_json(spark, schemas.API_COMMIT, path, names))


def read_repo_metadata(spark: SparkSession, path: str | list[str] | DataFrame, file: str | None = None) -> DataFrame:
    """One JSON object per repository to one row per commit with owner and repo; ``path`` may be a listing of files.

    A repository without commits keeps one row, without a commit, so that it can count as done. ``file``
    names a column for the file a row comes from.
    """
    repos = _json(spark, schemas.REPO_METADATA, path)
    more = _file(file)
    return repos.select(
        "owner", F.col("name").alias("repo"), F.explode_outer("commits_metadata").alias("c"), CORRUPT, *more
    ).select("owner", "repo", "c.*", CORRUPT, *([file] if file else []))


def unescaped(name: Column) -> Column:
    """A path component with its percent escapes decoded; a plus is a plus."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _folders(spark: SparkSession, path: str, pattern: str = "/*") -> list[tuple[str, str]]:
    """(name, path) of the folders in a folder."""
    jvm = spark._jvm
    every = jvm.org.apache.hadoop.fs.Path(f"{path}{pattern}")
    listed = every.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(every) or []
    return [(s.getPath().getName(), s.getPath().toString()) for s in listed if s.isDirectory()]


def unit_folders(spark: SparkSession, path: str) -> DataFrame:
    """(repo_key, folder) of the repositories in a raw-diff folder, from a listing; opens no file."""
    return spark.createDataFrame(_folders(spark, path), "repo_key string, folder string")


def folders_of(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """The folders in which the files of a source lie."""
    return [folder for _, folder in _folders(spark, path, "/*" if "/" in pattern else "")]


def source_paths(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """What to load, with the end of ``pattern`` as a filter of names, for the files of a source: its folders where the files lie in folders.

    Spark lists a folder at once, but each file of a pattern by itself.
    """
    found = _folders(spark, path) if pattern.startswith("*/") else []
    return [literal_path(folder) for _, folder in found] or [f"{path}/{pattern}"]


@contextmanager
def _few_listings(spark: SparkSession) -> Iterator[None]:
    """While a reader is made, paths are listed by a few tasks for each core; Spark would start up to 10 000, for a handful of paths each."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def read_raw_diffs(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """One JSON per commit in a folder per repository; hash and repository come from the path.

    ``folders`` are the repositories' folders to read, else all below ``path``. Unreadable files keep a
    row, with the text in ``_corrupt_record``. On a disk of the machines the tasks list and open the files; elsewhere Spark's reader
    does, which keeps the names of all files in the driver.
    """
    if files.on_disk(spark, path):
        found = folders_of(spark, path, "*/*.json") if folders is None else folders
        if found:
            return diff_rows(files.parsed(files.listed(spark, found), schemas.RAW_DIFF, CORRUPT))
    reader = spark.read.schema(with_corrupt(schemas.RAW_DIFF)).option("columnNameOfCorruptRecord", CORRUPT)
    paths = source_paths(spark, path, "*/*.json") if folders is None else [literal_path(f) for f in folders]
    with _few_listings(spark):
        diffs = reader.option("pathGlobFilter", "*.json").json(paths, multiLine=True)
    return diff_rows(diffs)


def read_diff_files(spark: SparkSession, paths: list[str] | DataFrame, file: str | None = None) -> DataFrame:
    """As ``read_raw_diffs``, of these files (names, patterns, or a listing); ``file`` names a column for the file."""
    return diff_rows(_json(spark, schemas.RAW_DIFF, paths), file)


def diff_rows(diffs: DataFrame, file: str | None = None) -> DataFrame:
    """Files of diffs with the hash and the repository that their paths name."""
    name, folder = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    return diffs.select(
        unescaped(F.element_at(F.split(folder, "/"), -2)).alias("repo_key"),
        F.regexp_replace(name, r"\.json\z", "").alias("sha"),
        "message",
        "files",
        CORRUPT,
        *_file(file),
    )


def literal_path(path: str) -> str:
    """A path in which nothing is a pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def read_drilled(spark: SparkSession, path: str | list[str] | DataFrame, file: str | None = None) -> DataFrame:
    """One JSON object per repository to one row per drilled commit; file contents are not parsed. ``path`` may be a listing of files.

    ``file`` names a column for the file a row comes from.
    """
    dumps = _json(spark, schemas.DRILLED, path)
    return dumps.select(F.explode_outer("commits").alias("c"), CORRUPT, *_file(file)).where(
        F.col("c").isNotNull() | F.col(CORRUPT).isNotNull()
    ).select("c.*", CORRUPT, *([file] if file else []))


def read_drilled_ranges(spark: SparkSession, path: str | list[str], first: str = '{"repository":') -> DataFrame:
    """As ``read_drilled``, with as many tasks a dump as its size asks for: one for each range of bytes that Spark cuts it into.

    ``first`` are the bytes that every commit begins with, and that nothing else can: inside a text a quote is escaped, and files
    begin with another name. They separate the records of a text source, which Spark splits by itself, so a commit over the border of two
    ranges is read whole, by one of them. Of a dump that is cut off the commits before the cut are read, and the rest is a
    row with its text in ``_corrupt_record``; so is all of a file without any commit that is not an empty dump.
    """
    lines = spark.read.option("lineSep", first).option("pathGlobFilter", "*.json").text(path)
    text = F.rtrim(F.col("value"), F.lit(" \t\r\n"))
    head = text.rlike(r"^\s*\{")  # what comes before the first commit of a file
    empty = text.rlike(r'^\s*\{\s*"commits"\s*:\s*\[\s*(\]\s*\})?$')
    commit = F.when(F.endswith(text, F.lit(",")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(F.regexp_replace(text, r"\]\s*\}$", ""))
    whole = F.concat(F.lit(first), commit)
    kind = with_corrupt(schemas.DRILLED_COMMIT)
    parsed = F.from_json(F.when(~head, whole), kind, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})
    rows = lines.where(~empty & (text != "")).select(parsed.alias("c"), F.when(head, F.col("value")).alias("lost"))
    names = schemas.DRILLED_COMMIT.fieldNames()
    return rows.select(*[F.col(f"c.{n}").alias(n) for n in names], F.coalesce("lost", f"c.{CORRUPT}").alias(CORRUPT))


#: Columns that name the folders of a stage.
UNITS = ("owner", "repo", "repo_key", "unit")


def read_stage_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stage CSV files as one table; quoted fields may hold line breaks and doubled quotes.

    An empty field reads as null, as in the files' own round trip. One task per file:
    land large tables to Parquet first.
    """
    return spark.read.csv(
        path, schema=schema, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False
    )


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet stage output; its folder columns are text, also where all names are numbers."""
    found = spark.read.parquet(path).schema
    kinds = [T.StructField(f.name, T.StringType() if f.name in UNITS else f.dataType) for f in found]
    return spark.read.schema(T.StructType(kinds)).parquet(path)


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Published rows; one split reads its own partition only."""
    table = spark.read.parquet(path)
    return table if split is None else table.where(F.col("split") == split)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage output can be read."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def is_readable(corrupt: str = CORRUPT) -> Column:
    """Quarantine rule: the record could be parsed."""
    return F.col(corrupt).isNull()


def with_corrupt(schema: T.StructType) -> T.StructType:
    """The schema and a column for the text of a record that does not fit it."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def _file(name: str | None) -> list[Column]:
    return [F.col("_metadata.file_path").alias(name)] if name else []


def _json(spark: SparkSession, schema: T.StructType, path: str | list[str] | DataFrame, names: str = "*.json") -> DataFrame:
    if isinstance(path, DataFrame):
        return files.parsed(path, schema, CORRUPT)
    reader = spark.read.schema(with_corrupt(schema)).option("pathGlobFilter", names)
    with _few_listings(spark):
        return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path, multiLine=True)
