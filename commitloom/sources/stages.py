"""Stage tables whose state switches at once.

A stage is a folder of parts (rows, rejected rows, a ledger of files), each with a subfolder per run. A run writes all
of its parts, and then one small manifest appears under its final name by one rename. Readers take the
runs that the last manifest names, so a run that ended early is never seen, nor is half of one; ``vacuum`` removes what
it left. Rows of files that a later run went through again are named by that run and left out when read;
``compact`` writes what is left as one run. A stage has one writer at a time: a second one fails on its manifest.

Parts written by keys are bucketed and sorted by them, so that stages with the same keys and number of buckets
join, and group by the keys, without an exchange, however many runs they have.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS = "manifests"
ROWS, REJECTED, LEDGER, REPLACED = "rows", "rejected", "ledger", "replaced"
#: The column that names the file a row came from.
FILE = "source_file"
#: The run a row was written by.
RUN = "run"


@dataclass(frozen=True)
class Manifest:
    """The state of a stage: its number, 0 for a stage without one, and the records of its runs."""

    number: int = 0
    runs: tuple[dict, ...] = ()

    def names(self) -> list[str]:
        return [r["run"] for r in self.runs]

    def consumed(self) -> set[str]:
        """The runs of other stages that this stage's runs went through."""
        return {name for r in self.runs for name in r["consumed"]}


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The last manifest of a stage."""
    fs, folder = _at(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(folder):
        return Manifest()
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
    if not numbers:
        return Manifest()
    number = max(numbers)
    fs, file = _at(spark, f"{path}/{MANIFESTS}/{number:010d}.json")
    stream = fs.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(number, tuple(json.loads(text)["runs"]))


def _publish(spark: SparkSession, path: str, state: Manifest) -> None:
    name = f"{state.number:010d}.json"
    fs, draft = _at(spark, f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    _, final = _at(spark, f"{path}/{MANIFESTS}/{name}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps({"runs": state.runs}).encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another run of {path} has written {name}")


@dataclass
class Run:
    """One run of a stage: ``write`` its parts, then ``commit`` them all at once."""

    spark: SparkSession
    path: str
    buckets: int | None = None
    before: Manifest = field(init=False)
    name: str = field(init=False)

    def __post_init__(self) -> None:
        self.before = manifest(self.spark, self.path)
        self.name = f"r{self.before.number + 1:010d}-{uuid.uuid4().hex[:8]}"
        if self.buckets is None:
            known = [p["buckets"] for r in self.before.runs for p in r["parts"].values() if p["buckets"]]
            self.buckets = known[-1] if known else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._parts: dict[str, dict] = {}

    def write(self, part: str, rows: DataFrame, keys: list[str] | None = None) -> None:
        """The rows of a part; with ``keys`` bucketed and sorted by them, one file a bucket."""
        folder = f"{self.path}/{part}/{RUN}={self.name}"
        if keys:
            table = f"commitloom_{uuid.uuid4().hex}"
            writer = rows.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys)
            writer.format("parquet").option("path", folder).saveAsTable(table)
            self.spark.sql(f"DROP TABLE {table}")  # external: the files stay
        else:
            rows.write.parquet(folder)
        self._parts[part] = {"schema": rows.schema.jsonValue(), "keys": keys, "buckets": self.buckets if keys else None}

    def is_empty(self, part: str) -> bool:
        """Whether the part, written before, has no rows."""
        schema = T.StructType.fromJson(self._parts[part]["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}/{RUN}={self.name}").isEmpty()

    def commit(self, consumed: list[str] = (), counts: dict | None = None, alone: bool = False) -> None:
        """Names the run in a new manifest; ``alone`` instead of all earlier ones."""
        record = {"run": self.name, "parts": self._parts, "consumed": sorted(consumed), "counts": counts or {}}
        earlier = () if alone else self.before.runs
        _publish(self.spark, self.path, Manifest(self.before.number + 1, (*earlier, record)))


def _table(spark: SparkSession, path: str, part: str, number: int, schema: T.StructType, info: dict, every: list[str], names: list[str]) -> DataFrame:
    """The named runs of a bucketed part, as an external table of the session's catalog: one a state, as its runs stay as they are."""
    table = f"commitloom_{hashlib.md5(f'{path}/{part}'.encode()).hexdigest()}_{number}"
    full = T.StructType([*schema, T.StructField(RUN, T.StringType())])
    columns = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(full.json()).toDDL()
    keys = ", ".join(f"`{k}`" for k in info["keys"])
    location = f"{path}/{part}".replace("\\", "\\\\").replace("'", "\\'")
    if not spark.catalog.tableExists(table):
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY ({RUN}) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {info['buckets']} BUCKETS LOCATION '{location}'"
        )
        spark.sql(f"ALTER TABLE {table} ADD " + " ".join(f"PARTITION ({RUN}='{n}')" for n in every))
    return spark.table(table).where(F.col(RUN).isin(names))


def read(spark: SparkSession, path: str, part: str = ROWS, runs: set[str] | None = None, live: bool = True) -> DataFrame | None:
    """The rows of a part with the ``run`` that wrote them; None where no run has the part.

    ``runs``: of these only. Rows of files that a later run replaced are left out unless ``live`` is false. Bucketed
    parts keep their buckets; no schema is inferred.
    """
    state = manifest(spark, path)
    having = [r for r in state.runs if part in r["parts"]]
    if not having:
        return None
    info = having[-1]["parts"][part]
    schema = T.StructType.fromJson(info["schema"])
    wanted = [r["run"] for r in having if runs is None or r["run"] in runs]
    same = all(r["parts"][part]["keys"] == info["keys"] and r["parts"][part]["buckets"] == info["buckets"] for r in having)
    if info["keys"] and same:
        rows = _table(spark, path, part, state.number, schema, info, [r["run"] for r in having], wanted)
    else:
        full = T.StructType([*schema, T.StructField(RUN, T.StringType())])
        folders = [f"{path}/{part}/{RUN}={name}" for name in wanted]
        rows = spark.read.schema(full).option("basePath", f"{path}/{part}").parquet(*folders) if folders else spark.createDataFrame([], full)
    if live and part != REPLACED and FILE in rows.columns and any(REPLACED in r["parts"] for r in state.runs):
        gone = read(spark, path, REPLACED).select(FILE, F.col("replaced_run").alias(RUN))
        rows = rows.join(gone.distinct(), [FILE, RUN], "left_anti")
    return rows


def compact(spark: SparkSession, path: str) -> None:
    """All live rows of every part as one run, which then stands alone; what was replaced is forgotten."""
    run = Run(spark, path)
    parts = dict.fromkeys(p for r in run.before.runs for p in r["parts"] if p != REPLACED)
    for part in parts:
        keys = [r["parts"][part]["keys"] for r in run.before.runs if part in r["parts"]][-1]
        run.write(part, read(spark, path, part).drop(RUN), keys)
    run.commit(sorted(run.before.consumed()), total_counts(run.before), alone=True)


def total_counts(state: Manifest) -> dict[str, int]:
    """The counts that the runs of a stage took on their way, summed."""
    return reduce(lambda a, r: {k: a.get(k, 0) + r["counts"].get(k, 0) for k in {**a, **r["counts"]}}, state.runs, {})


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes the folders of runs that the last manifest does not name, and earlier manifests; the names of those runs.

    Only while no job writes to the stage or still reads an earlier state of it.
    """
    state = manifest(spark, path)
    named, gone = set(state.names()), set()
    fs, top = _at(spark, path)
    for part in fs.listStatus(top):
        if part.getPath().getName() == MANIFESTS:
            for file in fs.listStatus(part.getPath()):
                if file.getPath().getName() != f"{state.number:010d}.json":
                    fs.delete(file.getPath(), False)
            continue
        for folder in fs.listStatus(part.getPath()):
            name = folder.getPath().getName().removeprefix(f"{RUN}=")
            if name not in named:
                fs.delete(folder.getPath(), True)
                gone.add(name)
    return sorted(gone)
