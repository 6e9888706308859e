"""JSON files on a disk that all machines share, listed and opened by the tasks.

A reader of Spark keeps the name and state of each file of a source in the driver, a kilobyte or more a file, which a source with a
file for each commit soon fills. Here names are rows: tasks look through the folders, and tasks open the files.
"""

from __future__ import annotations

import json
import os
import re
import urllib.parse
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import FILE

# Fixed value: signs that a URI of Java leaves as they are.
_PLAIN = "/_-!.~'()*,;:$&+=@"
_NAMES, _TEXTS = 10_000, 4 << 20  # a batch between a task and its worker, at most


def on_disk(spark: SparkSession, path: str) -> bool:
    """Whether the path is on a disk of the machines, where every task can open it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def local(path: str) -> str:
    """The path on the disk, without a scheme."""
    return re.sub(r"\A(file:)?/+", "/", path)


def listed(spark: SparkSession, folders: list[str], deeper: bool = False) -> DataFrame:
    """(source_file, path, size, modified) of the JSON files with content that lie in these folders; ``deeper`` also in folders there that are named like one. Opens none.

    Lazy: each run of it looks anew.
    """
    names = spark.createDataFrame([(local(f),) for f in folders], "folder string")
    found = names.mapInArrow(_looking(deeper), f"{FILE} string, path string, size long, modified long")
    return found.withColumn("modified", F.timestamp_millis("modified"))


# What follows is closed functions, which workers take whole: they need not import the library.


def _looking(deeper: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of folders the files in them."""

    def as_uri(path: str) -> str:
        """A path on the disk as Spark names the file in ``_metadata.file_path``."""
        kept = lambda c: c.isascii() and (c.isalnum() or c in _PLAIN) or not c.isascii() and c.isprintable()
        return "".join(c if kept(c) else urllib.parse.quote(c, safe="") for c in path)

    def scan(folder: str, deeper: bool) -> Iterator[tuple[str, str, int, int]]:
        start = f"file:{as_uri(folder)}"
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.name[0] in "._" or not entry.name.endswith(".json"):  # as Spark's readers
                    continue
                if entry.is_file():
                    state = entry.stat()
                    if state.st_size:
                        yield f"{start}/{as_uri(entry.name)}", f"file:{folder}/{entry.name}", state.st_size, state.st_mtime_ns // 1_000_000
                elif deeper and entry.is_dir():
                    yield from scan(f"{folder}/{entry.name}", False)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [FILE, "path", "size", "modified"]
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for row in scan(folder, deeper):
                    rows.append(row)
                    if len(rows) == _NAMES:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return look


def _opening() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of files their text, whether its root is an array, and the bytes where they are not those of the text."""

    def content(name: str, path: str) -> tuple | None:
        with open(re.sub(r"\A(file:)?/+", "/", path), "rb") as file:
            data = file.read()
        if not data.strip(b" \t\r\n"):
            return None  # no record, as for Spark's readers
        code = json.detect_encoding(data)
        try:
            text = data.decode(code)
        except UnicodeDecodeError:
            return name, None, False, data
        return name, text, re.match(r"[ \t\r\n]*\[", text) is not None, None if code == "utf-8" else data

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.binary()]
        names = [FILE, "text", "many", "raw"]
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = content(name, path)
                if row is None:
                    continue
                rows.append(row)
                size += len(row[1] or row[3])
                if size >= _TEXTS or len(rows) == _NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return opened


def parsed(files: DataFrame, schema: T.StructType, corrupt: str) -> DataFrame:
    """Rows of the files of a listing, as Spark's JSON reader gives them with ``multiLine``, and ``_metadata`` with the file's path and name.

    A file holds an object, or an array of them. An object or a number where the schema has a text becomes the JSON of it, without the blanks that
    the reader keeps. ``corrupt`` names the column for the text of a file that does not fit the schema. Files are
    dealt out by their names, to as many tasks as a shuffle has, and four for each core at least.
    """
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    names = files.select(FILE, "path").repartition(tasks, "path")
    texts = names.mapInArrow(_opening(), f"{FILE} string, text string, many boolean, raw binary")
    kind = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])

    def record(text: Column) -> Column:
        return F.from_json(text, kind, {"columnNameOfCorruptRecord": corrupt, "mode": "PERMISSIVE"})

    each = F.from_json("text", T.ArrayType(T.StringType()))
    objects = F.forall(each, lambda t: F.coalesce(t.startswith("{"), F.lit(False)))
    several = F.when(objects, F.transform(each, record)).otherwise(F.array(F.lit(None).cast(kind)))
    records = F.when(F.col("many"), several).otherwise(F.array(record(F.col("text"))))
    whole = F.coalesce(F.col("raw").cast("string"), "text")
    # one broken record makes its file unreadable
    broken = F.exists("records", lambda r: r.isNull() | r[corrupt].isNotNull())
    held = texts.select(FILE, whole.alias("whole"), records.alias("records"))
    rows = held.select(FILE, F.when(broken, F.col("whole")).alias("lost"), F.explode("records").alias("c"))
    about = F.struct(F.col(FILE).alias("file_path"), F.element_at(F.split(FILE, "/"), -1).alias("file_name"))
    return rows.select(*[F.col(f"c.{n}").alias(n) for n in schema.fieldNames()], F.col("lost").alias(corrupt), about.alias("_metadata"))
