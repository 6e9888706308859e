"""Stage jobs: annotate, preprocess, drill and publish, each one lazy DataFrame.

A job that reads landed JSON lands it once as Parquet, checked: rows that break a rule are kept under
``<out>-rejected`` with the reason, and the others go on. The units a job has gone through are listed
under ``<out>-done``, also those without any output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import StageConfig, StagePaths
from ..functions import message as M
from ..functions import patch as P
from ..operators import annotate as ann
from ..operators import corpus, filters
from ..operators.parsing import ParserFactory, with_verb_object
from ..sources import readers, scratch, writers
from .work import pending_units, store_checked

#: What a landed commit must have; one that breaks a rule is rejected with the rule's name.
METADATA_RULES = {
    "unreadable": readers.is_readable,
    "incomplete": lambda: F.concat("sha", "author", "committer", "message").isNotNull(),
}
DIFF_RULES = {
    "unreadable": readers.is_readable,
    "no message": lambda: F.col("message").isNotNull(),
    "no files": lambda: F.col("files").isNotNull(),
}
DRILL_RULES = {
    "unreadable": readers.is_readable,
    "no message": lambda: F.col("message").isNotNull(),
}
ANNOTATION_FLAGS = ("verb_object_spacy", "verb_object_stanza")


def annotate(
    commits: DataFrame,
    spacy_factory: ParserFactory,
    stanza_factory: ParserFactory,
    full_parse: bool = False,
    vo: str = "either",
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Commit metadata to annotated commits: subject, rules, verb-object flags, mask.

    Rows with a missing value go; a flag left null because no parser was needed stays. ``profile``: resources
    that the parsers ask for.
    """
    base = filters.drop_incomplete_rows(commits, subset=["sha", "author", "committer", "message"])
    ruled = ann.annotate_rules(ann.with_subject(base))
    parsed = with_verb_object(ruled, spacy_factory, stanza_factory, ann.cheap_rules(), full_parse, profile)
    return parsed.withColumn("fits_requirements", ann.requirements_mask(vo))


def preprocess(diffs: DataFrame, annotated: DataFrame | None, keys: list[str], also: str | None = None) -> DataFrame:
    """Landed diffs to processed rows, for commits that fit the requirements now.

    ``diffs`` holds the ``keys``, message and files, and ``also`` a column to keep. Without ``annotated`` every diff is
    taken. The only shuffle is the semi join's, and it precedes the text work; there is none where both
    tables are bucketed by the keys.
    """
    if annotated is not None:
        diffs = filters.passing_only(diffs, annotated, keys)
    files = F.col("files")
    kept = diffs.where(P.all_files_supported(files) & P.complete_patches(files))
    others = [k for k in keys if k != "sha"]
    return kept.withColumn("content", P.content_type(files)).select(
        *others,
        "content.content_type",
        "content.main_lang",
        M.extract_subject_v1(F.col("message")).alias("message"),
        "sha",
        P.serialize_commit(files, "v1").alias("patch"),
        P.file_count(files).cast("int").alias("file_count"),
        *([also] if also else []),
    )


def drill(
    commits: DataFrame,
    spacy_factory: ParserFactory | None = None,
    stanza_factory: ParserFactory | None = None,
    spread: bool = False,
    also: str | None = None,
) -> DataFrame:
    """Drilled commits to rows, map-only. Without parsers the verb-object flags must be given.

    Merges go where ``parents`` are given. ``spread`` re-spreads the commits left by the cheap
    rules before the costly work, for sources that put a whole repository into one read task. ``also`` is
    a column to keep.
    """
    if "parents" in commits.columns:
        commits = filters.no_merges(commits).drop("parents")
    subject = M.extract_subject_v2(F.col("message"))
    ruled = commits.where(ann.drill_cheap_rules(F.col("author"), subject)).withColumn(
        "subject", subject
    )
    if spread:
        ruled = ruled.repartition("hash")
    if spacy_factory is not None:
        ruled = with_verb_object(ruled, spacy_factory, stanza_factory, F.lit(True))
    return ruled.where(ann.either_verb_object()).select(
        "repository",
        "mixed_content",
        "message",
        "hash",
        P.serialize_commit(F.col("files"), "v2").alias("patch"),
        *([also] if also else []),
    )


def raw_rows(diffs: DataFrame, annotated: DataFrame) -> DataFrame:
    """File rows of the landed diffs whose commit fits the requirements, once each.

    Owner and repository come from the metadata, since the folder name alone is ambiguous; a hash
    that the metadata lists twice counts once.
    """
    keyed = annotated
    if "repo_key" not in annotated.columns:
        keyed = annotated.withColumn("repo_key", P.repo_key(F.col("owner"), F.col("repo")))
    fitting = keyed.where("fits_requirements").select("repo_key", "sha", "owner", "repo").distinct()
    return corpus.explode_files(diffs.join(fitting, ["repo_key", "sha"]))


def published(processed: DataFrame, seed: str = "0") -> DataFrame:
    """Processed rows in random order with their split."""
    return corpus.shuffle(corpus.split(processed, "sha", seed), "sha", seed)


@scratch.cleared
def annotate_job(
    spark,
    metadata_path: str,
    out: str,
    spacy_factory: ParserFactory,
    stanza_factory: ParserFactory,
    config: StageConfig = StageConfig(),
) -> None:
    """Annotate the repositories of a metadata folder that have no output yet.

    A metadata file is one read task, and one repository may be a third of all commits:
    the rows are spread by hash before the parsers run.
    """
    commits = readers.read_repo_metadata(spark, metadata_path)
    keys = ["owner", "repo"]
    todo = _todo(spark, commits, out, keys, config)
    good, units, finish = _checked(todo, METADATA_RULES, out, keys)
    rows = annotate(good.repartition("sha"), spacy_factory, stanza_factory, config.full_parse)
    writers.write_stage(rows, out, keys, units=units if config.overwrite_existing else None)
    finish()


@scratch.cleared
def rerun_rules_job(spark, path: str, out: str | None = None) -> None:
    """Re-apply the rules to a stored annotated table, in place unless ``out`` is given.

    Replaced repositories are staged and swapped in when all of them are written.
    """
    annotated = readers.read_stage(spark, path)
    writers.write_stage(ann.reapply_rules(annotated), out or path, ["owner", "repo"])


@scratch.cleared
def preprocess_job(
    spark, diffs_path: str, annotated_path: str, out: str, config: StageConfig = StageConfig()
) -> None:
    """Preprocess the repositories of a raw-diff folder that have no output yet.

    The folder listing is compared with the units done, so the files of finished repositories are not opened.
    """
    annotated = readers.read_stage(spark, annotated_path).withColumn(
        "repo_key", P.repo_key(F.col("owner"), F.col("repo"))
    )
    folders = None
    if not config.overwrite_existing:
        # names of repositories only: far fewer than the files that the reader lists
        pending = _todo(spark, readers.unit_folders(spark, diffs_path), out, ["repo_key"], config)
        folders = [row["folder"] for row in pending.select("folder").collect()]
        if not folders:
            return
    diffs = readers.read_raw_diffs(spark, diffs_path, folders)
    good, units, finish = _checked(diffs, DIFF_RULES, out, ["repo_key"])
    rows = preprocess(good, annotated, ["repo_key", "sha"])
    writers.write_stage(rows, out, ["repo_key"], units=units if config.overwrite_existing else None)
    finish()


@scratch.cleared
def drill_job(
    spark, source: str, out: str, spacy_factory: ParserFactory, stanza_factory: ParserFactory
) -> None:
    """One output table of a folder of drilled repositories.

    A dump is one read task; only the commits passing the cheap rules are spread.
    """
    good, _, finish = _checked(readers.read_drilled(spark, source), DRILL_RULES, out, [])
    rows = drill(good, spacy_factory, stanza_factory, spread=True)
    rows.write.mode("overwrite").parquet(out)
    finish()


@scratch.cleared
def publish_job(
    spark, config: StageConfig, annotated: str, raw_diffs: str, processed: str, out: str
) -> None:
    """Publish the tables switched on: metadata, raw file rows, and the split dataset."""
    if config.publish_metadata:
        table = corpus.union_repos([readers.read_stage(spark, annotated)])
        table.write.mode("overwrite").parquet(f"{out}/analysed-metadata")
    if config.publish_raw_diffs:
        diffs = readers.read_raw_diffs(spark, raw_diffs).where(readers.is_readable())
        rows = raw_rows(diffs, readers.read_stage(spark, annotated))
        rows.write.mode("overwrite").parquet(f"{out}/raw-diffs")
    if config.publish_dataset:
        rows = readers.read_stage(spark, processed).select(*schemas.PROCESSED.fieldNames())
        split = corpus.split(rows, "sha", config.seed)
        writers.export_splits(split, f"{out}/processed-diffs", "sha", config.seed)


def run_stages(
    spark,
    config: StageConfig,
    paths: StagePaths,
    spacy_factory: ParserFactory | None = None,
    stanza_factory: ParserFactory | None = None,
) -> None:
    """Run the stages switched on, in order; all repositories of a stage at once."""
    if config.annotate_metadata:
        annotate_job(spark, paths.metadata, paths.annotated, spacy_factory, stanza_factory, config)
    if config.rerun_rule_filters:
        rerun_rules_job(spark, paths.annotated)
    if config.preprocess_diffs:
        preprocess_job(spark, paths.raw_diffs, paths.annotated, paths.processed, config)
    publish_job(spark, config, paths.annotated, paths.raw_diffs, paths.processed, paths.published)


def _todo(spark, rows: DataFrame, out: str, keys: list[str], config: StageConfig) -> DataFrame:
    """Rows of the units that still need output."""
    if config.overwrite_existing:
        return rows
    for path in (out, f"{out}-done"):
        if readers.exists(spark, path):
            rows = pending_units(rows, readers.read_stage(spark, path).select(*keys).distinct(), keys)
    return rows


def _checked(
    rows: DataFrame, rules: dict, out: str, keys: list[str]
) -> tuple[DataFrame, DataFrame, Callable[[], None]]:
    """The rows that keep the rules, landed; all units; and what a job calls after its output is written.

    Rejected rows are stored before any output, so a job that dies loses none; they replace those that earlier
    runs stored of the same units, so none is stored twice. Units gone through are listed at the end: a job that dies
    before leaves them pending. A unit is null where its file could not be read; it stays pending.
    """
    checks = {name: rule() for name, rule in rules.items()}
    good, bad = store_checked(rows, checks, scratch.new_folder(rows.sparkSession))

    units = good.select(*keys).union(bad.select(*keys)).distinct().na.drop()
    _store_rejected(bad, units, f"{out}-rejected", keys)

    def finish() -> None:
        if keys:
            units.write.mode("append").parquet(f"{out}-done")

    return good.drop(readers.CORRUPT), units, finish


def _store_rejected(bad: DataFrame, units: DataFrame, path: str, keys: list[str]) -> None:
    """Rejected rows in a folder per unit, one for all files that could not be read; all of them anew without keys."""
    if not keys:
        bad.write.mode("overwrite").parquet(path)
        return
    lost = F.lit("unreadable")
    name = F.concat_ws("/", *keys)
    bad = bad.withColumn("unit", F.when(F.concat(*keys).isNull(), lost).otherwise(name))
    gone_through = units.select(name.alias("unit")).union(units.sparkSession.range(1).select(lost)).distinct()
    # a table without rows can be read too
    bad.limit(0).drop("unit").write.mode("ignore").parquet(f"{path}/unit=-")
    writers.write_stage(bad, path, ["unit"], units=gone_through)
