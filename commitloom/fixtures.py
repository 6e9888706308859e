"""Commit-shaped tables made of the given ``documents`` table.

Each document is one commit: its message and every patch carry the whole text. The
tables are row-local functions of the documents and are landed as Parquet once per
application, as collected commits would be; queries then read the columns they need.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import message as M
from .functions import patch as P
from .functions import verb_object as V
from .functions.text import words
from .sources import scratch
from .sources.files import local, on_disk

# (application, sf_dir, table) -> folder of the landed table
_LANDED: dict[tuple[str, str, str], str] = {}
_FILES = 512  # texts of files that a worker gets at once
# Fixed values of Spark: a partition without a name, and what is escaped in names (the percent sign first).
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"
_SPECIAL = "%" + "".join(map(chr, range(1, 32))) + "\"#'*/:=?\\\x7f{[]^"


def landed(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """The named table, written to the shared folder when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LANDED:
        path = scratch.new_folder(spark)
        build(spark, sf_dir).write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select("doc_id", "text", "lang", "source")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents spread over the tasks, whatever files they came in.

    Tables are built of them after this exchange, since a row of commits holds its text two to four times. It goes by hash: dealing
    rows out in turn would sort the texts before.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return documents(spark, sf_dir).repartition(tasks, "doc_id", "text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as landed, spread."""
    return landed(spark, sf_dir, "texts", spread_documents)


def _case(number: Column, *values: str, default: str = "") -> Column:
    result = None
    for i, value in enumerate(values):
        result = (F if result is None else result).when(number == i, F.lit(value))
    return result.otherwise(F.lit(default))


def _text(number: Column) -> Column:
    return number.cast("string")


def _commit_columns() -> dict[str, Column]:
    n, text = F.col("doc_id"), F.col("text")
    developer = F.concat(F.lit("dev"), _text(n % 13))
    author = (
        F.when(n % 7 == 0, F.concat("source", F.lit("[bot]")))
        .when(n % 11 == 0, F.concat("source", F.lit("[BOT]")))
        .otherwise(developer)
    )
    head = F.split(F.substring_index(F.replace(text, F.lit("\n"), F.lit(" ")), " ", 4), " ")

    def word(i: int) -> Column:
        return F.coalesce(F.get(head, F.lit(i)), F.lit(""))

    more = F.concat(F.lit(" "), word(2), F.lit(" "), word(3))
    message = F.concat(
        _case(n % 6, "fix: ", "Merge ", "feat(core): x: ", "Bump "),
        word(0),
        F.lit(" "),
        word(1),
        F.when(n % 5 == 0, F.lit("")).otherwise(more),
        _case(n % 8, " (#1234)", " #98765", ".", ". ", " (#123456)"),
        F.lit("\n\n"),
        text,
    )
    return {
        "sha": F.md5(_text(n)),
        "owner": F.col("lang"),
        "repo": F.col("source"),
        "author": author,
        "committer": developer,
        "message": message,
    }


def _files(n: Column, text: Column) -> Column:
    """1 to 3 files per commit, the whole text as the lines of each patch."""

    def line(i: Column):
        def build(content: Column, j: Column) -> Column:
            hunk = F.concat(
                F.lit("@@ -"), _text(j), F.lit(" +"), _text(j), F.lit(" @@"),
                F.when(j % 2 == 0, F.lit(" scope")).otherwise(F.lit("")), F.lit("\n"),
            )
            return F.concat(
                F.when(j % 7 == 6, hunk).otherwise(F.lit("")),
                _case((i + j) % 3, "+", "-", default=" "),
                content,
            )

        return build

    def file(i: Column) -> Column:
        extension = _case(
            (n + i * (n % 4)) % 9, ".py", ".java", ".js", ".php", ".rb", ".go", ".md", ".PY"
        )
        patch = F.concat(
            F.lit("@@ -1,3 +1,4 @@"),
            F.when(n % 2 == 0, F.lit(" def f():")).otherwise(F.lit("")),
            F.lit("\n"),
            F.array_join(F.transform(F.split(text, "\n"), line(i)), "\n"),
            F.lit("\n+\r\n"),
        )
        renamed = n % 10 == 3
        return F.struct(
            F.concat(F.lit("src/f"), _text(i), extension).alias("filename"),
            F.when(renamed, F.concat(F.lit("old/f"), _text(i), F.lit(".py"))).alias(
                "previous_filename"
            ),
            F.when(renamed, F.lit("renamed")).otherwise(F.lit("modified")).alias("status"),
            F.when(n % 17 != 5, patch).alias("patch"),
        )

    return F.transform(F.sequence(F.lit(0), (n % 3).cast("int")), file)


def _parse_row(i: Column, word: Column, n: Column) -> dict[str, Column]:
    """Synthetic dependency of the i-th word: a verb, words governed by an object, the object."""
    object_at = 1 + n % 3
    is_first, is_object = i == 0, i == object_at
    return {
        "text": word,
        "root": is_first & (n % 5 != 0),
        "object": ~is_first & is_object & (n % 9 != 0),
        "tag": F.when(~is_first, F.lit("NN"))
        .when(n % 7 == 0, F.lit("VBD"))
        .otherwise(F.lit("VB")),
        "head": F.when(is_first | is_object | (n % 8 == 0), F.lit(0)).otherwise(object_at),
    }


def _tokens(subject: Column, n: Column) -> Column:
    def token(word: Column, i: Column) -> Column:
        row = _parse_row(i, word, n)
        dep = F.when(row["root"], F.lit("ROOT")).when(row["object"], F.lit("dobj"))
        return F.struct(
            word.alias("text"),
            dep.otherwise(F.lit("det")).alias("dep"),
            row["tag"].alias("tag"),
            row["head"].cast("int").alias("head"),
        )

    return F.transform(words(subject), token)


def _sentences(subject: Column, n: Column) -> Column:
    def word_row(word: Column, i: Column) -> Column:
        row = _parse_row(i, word, n)
        deprel = F.when(row["root"], F.lit("root")).when(row["object"], F.lit("obj"))
        return F.struct(
            (i + 1).alias("id"),
            deprel.otherwise(F.lit("det")).alias("deprel"),
            row["tag"].alias("xpos"),
            (row["head"] + 1).cast("int").alias("head"),
        )

    return F.array(F.transform(words(subject), word_row))


COMMIT = ["doc_id", "sha", "owner", "repo", "author", "committer", "message"]


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_files(spark, sf_dir).select(*COMMIT)


def parsed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with v1 subject and the two given parses of it."""
    table = landed(spark, sf_dir, "commit_files", _build_commit_files)
    subject = M.extract_subject_v1(F.col("message"))
    return table.select(*COMMIT, subject.alias("subject"), "tokens", "sentences")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with their ``files`` array, as landed by the API."""
    return landed(spark, sf_dir, "commit_files", _build_commit_files).select(*COMMIT, "files")


def write_metadata(rows: DataFrame, path: str, small: bool = False) -> None:
    """(owner, repo, sha, author, committer, message, part, broken) commits as metadata files.

    One object and file per repository and part; where ``broken``, the list of commits is a text, which
    no reader of the schema can parse. Many ``small`` files are opened by the tasks on a disk of the machines, as diff files are.
    """
    commit = F.struct("sha", "author", "committer", "message")
    files = rows.groupBy("owner", F.col("repo").alias("name"), "part", "broken").agg(F.collect_list(commit).alias("commits_metadata"))
    files = files.drop("part")
    if small and on_disk(rows.sparkSession, path):
        names, commits = ("owner", "name"), "commits_metadata"
        text = F.when(F.col("broken"), F.to_json(F.struct(*names, F.to_json(commits).alias(commits))))
        value = text.otherwise(F.to_json(F.struct(*names, commits)))
        _write_each(files.where("broken IS NOT NULL").select(F.lit("").alias("folder"), value.alias("value")), local(path))
        return
    one = {"maxRecordsPerFile": 1}
    files.where("NOT broken").drop("broken").write.options(**one).mode("append").json(path)
    text = files.where("broken").withColumn("commits_metadata", F.to_json("commits_metadata"))
    text.drop("broken").write.options(**one).mode("append").json(path)


def write_pages(commits: DataFrame, page: Column, path: str) -> None:
    """Commits as the pages of an API: text files with an array each, of the commits with the same ``page``."""
    pages = commits.groupBy(page.alias("page")).agg(F.to_json(F.collect_list(F.struct("sha", "commit"))).alias("value"))
    pages.select("value").write.options(maxRecordsPerFile=1).text(path)


def _escaped(name: Column) -> Column:
    """A text as Spark names a partition's folder: what is special in a path as percent escapes."""
    for mark in _SPECIAL:
        name = F.replace(name, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    return name


def write_diffs(rows: DataFrame, path: str) -> None:
    """(repo_key, message, files, broken) commits as diff files, one each, in a folder per repository.

    Where ``broken``, the list of files is a text, which no reader of the schema can parse. On a disk of the machine Spark's
    writer starts a process or two for each file, to set its mode; there the tasks open the files by themselves.
    """
    rows = rows.where("broken IS NOT NULL")
    scheme, _, local = path.rpartition(":")
    if scheme in ("", "file"):
        files = F.when(F.col("broken"), F.to_json(F.struct("message", F.to_json("files").alias("files"))))
        value = files.otherwise(F.to_json(F.struct("message", "files")))
        name = F.coalesce(_escaped(F.when(F.col("repo_key") != "", F.col("repo_key"))), F.lit(_NO_NAME))
        _write_each(rows.select(F.concat(F.lit("repo_key="), name).alias("folder"), value.alias("value")), "/" + local.lstrip("/"))
        return
    one = {"maxRecordsPerFile": 1}
    good = rows.where("NOT broken").select("repo_key", "message", "files")
    good.write.options(**one).mode("append").partitionBy("repo_key").json(path)
    text = rows.where("broken").select("repo_key", "message", F.to_json("files").alias("files"))
    text.write.options(**one).mode("append").partitionBy("repo_key").json(path)


def _write_each(rows: DataFrame, path: str) -> None:
    """(folder, value) rows as a JSON file each, in their folder below ``path`` on a disk that all tasks share.

    A file is named by call, partition and place in it, so a task that runs again writes over its files.
    """
    call = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for folder in batch.column(0).unique().to_pylist():
                os.makedirs(f"{path}/{folder}", exist_ok=True)
            for folder, value in zip(batch.column(0), batch.column(1)):
                with open(f"{path}/{folder}/{call}-{part:05d}-{n:07d}.json", "wb") as file:
                    file.write(value.as_buffer())
                    file.write(b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"files": [n]})

    os.makedirs(path, exist_ok=True)
    spark, setting = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, _FILES)
    try:
        rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    finally:
        spark.conf.set(setting, before)


def write_dumps(rows: DataFrame, path: str) -> None:
    """(part, broken) drilled commits as history dumps, one object and file per repository and part."""
    commit = F.struct("repository", "author", "committer", "message", "hash", "mixed_content", "files")
    files = rows.groupBy("repository", "part", "broken").agg(F.collect_list(commit).alias("commits")).drop("repository", "part")
    one = {"maxRecordsPerFile": 1}
    files.where("NOT broken").drop("broken").write.options(**one).mode("append").json(path)
    files.where("broken").select(F.to_json("commits").alias("commits")).write.options(**one).mode("append").json(path)


def move_files(spark: SparkSession, source: str, target: str, names: list[str] | None = None) -> list[str]:
    """Moves the JSON files with content of a folder into another, under their own names or in place of those named; the names used."""
    if on_disk(spark, source) and on_disk(spark, target):
        return _move_on_disk(local(source), local(target), names)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    full = [s.getPath() for s in fs.listStatus(at) if s.getLen() and s.getPath().getName().endswith(".json")]
    files = sorted(full, key=lambda p: p.getName())
    names = names if names is not None else [p.getName() for p in files]
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(target))
    for file, name in zip(files, names, strict=True):
        into = jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
        fs.delete(into, False)
        fs.rename(file, into)
    return names


def _move_on_disk(source: str, target: str, names: list[str] | None) -> list[str]:
    with os.scandir(source) as entries:
        full = sorted(e.name for e in entries if e.name.endswith(".json") and e.is_file() and e.stat().st_size)
    names = names if names is not None else full
    os.makedirs(target, exist_ok=True)
    for file, name in zip(full, names, strict=True):
        # Spark's writers keep the sums of a file beside it, which Spark's readers look at
        for mark in (name, f".{name}.crc"):
            if os.path.exists(f"{target}/{mark}"):
                os.remove(f"{target}/{mark}")
        os.rename(f"{source}/{file}", f"{target}/{name}")
        if os.path.exists(f"{source}/.{file}.crc"):
            os.rename(f"{source}/.{file}.crc", f"{target}/.{name}.crc")
    return names


def _parses(subject: Column) -> dict[str, Column]:
    n = F.col("doc_id")
    return {"tokens": _tokens(subject, n), "sentences": _sentences(subject, n + 1)}


def _build_commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(F.col("doc_id"), F.col("text"))
    rows = spread_documents(spark, sf_dir).withColumns({**_commit_columns(), "files": files})
    parsed = rows.withColumns(_parses(M.extract_subject_v1(F.col("message"))))
    return parsed.select(*COMMIT, "files", "tokens", "sentences")


def drilled_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as the history dump holds them: before and after paths, content class.

    A commit with an unsupported file never enters the dump.
    """
    table = landed(spark, sf_dir, "drilled_commits", _build_drilled_commits)
    return table.drop("tokens", "sentences")


def _build_drilled_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commit_files(spark, sf_dir)
    added = F.col("doc_id") % 10 == 4
    files = F.transform(
        "files",
        lambda f: F.struct(
            F.upper(f["status"]).alias("status"),
            P.language_v2(f["filename"]).alias("content_type"),
            F.coalesce(f["patch"], F.lit("")).alias("patch"),
            F.when(~added, F.coalesce(f["previous_filename"], f["filename"])).alias("path_before"),
            f["filename"].alias("path_after"),
        ),
    )
    return (
        rows.where(P.all_files_supported(F.col("files"), "v2"))
        .withColumn("files", files)
        .select(
            "doc_id",
            F.col("repo").alias("repository"),
            "author",
            "committer",
            "message",
            F.col("sha").alias("hash"),
            P.mixed_content(F.col("files")["content_type"]).alias("mixed_content"),
            "files",
        )
        .withColumns(_parses(M.extract_subject_v2(F.col("message"))))
    )


def parsed_drilled_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drilled commits with the verb-object flags of the two given parses of their subject."""
    table = landed(spark, sf_dir, "drilled_commits", _build_drilled_commits)
    flags = {
        "verb_object_spacy": V.verb_object_spacy(F.col("tokens")),
        "verb_object_stanza": V.verb_object_stanza(F.col("sentences")),
    }
    return table.withColumns(flags).drop("tokens", "sentences")


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, main_lang, file_count, prediction, reference) pairs of whole texts."""
    return landed(spark, sf_dir, "eval_pairs", _build_eval_pairs)


def _build_eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("doc_id"), F.col("text")
    without_first = text.substr(F.instr(text, " ") + 1, F.length(text))
    shortened = F.when(n % 4 == 0, without_first).otherwise(text)
    changed = F.when(n % 2 == 1, F.replace(shortened, F.lit(" the "), F.lit(" a ")))
    prediction = F.concat(
        changed.otherwise(shortened), F.when(n % 3 == 0, F.lit(" extra")).otherwise(F.lit(""))
    )
    return spread_documents(spark, sf_dir).select(
        n.alias("example_id"),
        F.when(n % 11 == 0, F.lit("baseline")).otherwise(F.lit("tuned")).alias("model"),
        _case(n % 7, "Java", "Go", "PHP", "Javascript", "Ruby", "Python", default="Text").alias(
            "main_lang"
        ),
        (1 + n % 3).alias("file_count"),
        text.alias("reference"),
        prediction.alias("prediction"),
    )
