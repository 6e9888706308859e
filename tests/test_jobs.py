import json
import os

import pytest

from commitloom.catalog import sentence_parser, token_parser
from commitloom.config import StageConfig, StagePaths
from commitloom.operators import annotate as ann
from commitloom.operators import parsing
from commitloom.plans import jobs
from commitloom.sources import readers
from commitloom.streaming import ingest
from commitloom.streaming.ingest import ingest_stream


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value), encoding="utf-8")


def file(name, patch="@@ -1 +1 @@\n+x", previous=None):
    return {"filename": name, "previous_filename": previous, "status": "modified", "patch": patch}


COMMITS = {
    "aa": ("feat: Add the parser now", [file("a.py")]),
    "bb": ("Move the parser away", [file("new.py", "-y", "old.py"), file("b.md")]),
    "cc": ("Give the binary back", [file("a.py", None)]),
    "dd": ("Make the text better", [file("a.txt")]),
    "ee": ("Drop the empty commit", []),
    "ff": ("Merge the other branch", [file("a.py")]),
    "gg": ("Only two", [file("a.py")]),
}


@pytest.fixture
def landed(tmp_path):
    """Metadata and raw diffs of one repository, as collected."""
    rows = [{"sha": s, "author": "dev", "committer": "dev", "message": m} for s, (m, _) in COMMITS.items()]
    rows.append({"sha": "hh", "author": None, "committer": "dev", "message": "No the author here"})
    dump(tmp_path / "meta" / "o-r.json", {"owner": "o", "name": "r", "commits_metadata": rows})
    for sha, (message, files) in COMMITS.items():
        dump(tmp_path / "diffs" / "o-r" / f"{sha}.json", {"message": message, "files": files})
    return tmp_path


def calling(log):
    """Parsers that record the texts they see and take the third word as the object."""

    def tokens():
        def parse(subject):
            with open(f"{log}.a", "a") as seen:
                seen.write(subject + "\n")
            return token_parser()(subject)

        return parse

    def sentences():
        def parse(subject):
            with open(f"{log}.b", "a") as seen:
                seen.write(subject + "\n")
            return sentence_parser()(subject)

        return parse

    return tokens, sentences


def seen(path):
    return sorted(path.read_text().splitlines()) if path.exists() else []


def test_parsers_see_only_what_they_must(spark, tmp_path):
    subjects = ["add the parser", "merge the parser", "fixes the parser", "two words", None]
    df = ann.annotate_rules(
        spark.createDataFrame([("dev", s) for s in subjects], "author string, subject string")
    ).coalesce(1)
    log = tmp_path / "seen"
    rows = parsing.with_verb_object(df, *calling(log), ann.cheap_rules()).collect()
    flags = {r["subject"]: (r["verb_object_spacy"], r["verb_object_stanza"]) for r in rows}
    assert flags == {
        "add the parser": (True, None),
        "merge the parser": (None, None),
        "fixes the parser": (False, False),
        "two words": (None, None),
        None: (None, None),
    }
    assert seen(tmp_path / "seen.a") == ["add the parser", "fixes the parser"]
    assert seen(tmp_path / "seen.b") == ["fixes the parser"]


def test_full_parse(spark, tmp_path):
    df = ann.annotate_rules(
        spark.createDataFrame([("dev", "add the parser"), ("dev", "merge it")], "author string, subject string")
    )
    log = tmp_path / "seen"
    rows = parsing.with_verb_object(df, *calling(log), ann.cheap_rules(), full=True).collect()
    assert all(r["verb_object_spacy"] is not None and r["verb_object_stanza"] is not None for r in rows)
    assert seen(tmp_path / "seen.a") == seen(tmp_path / "seen.b") == ["add the parser", "merge it"]


def test_stages(spark, landed):
    annotated, processed = str(landed / "b"), str(landed / "d")
    jobs.annotate_job(spark, str(landed / "meta"), annotated, token_parser, sentence_parser)
    rows = {r["sha"]: r for r in readers.read_stage(spark, annotated).collect()}
    assert set(rows) == set(COMMITS)  # the one without author is dropped
    fitting = {sha for sha, r in rows.items() if r["fits_requirements"]}
    assert fitting == {"aa", "bb", "cc", "dd", "ee"}

    jobs.preprocess_job(spark, str(landed / "diffs"), annotated, processed)
    out = {r["sha"]: r for r in readers.read_stage(spark, processed).collect()}
    assert set(out) == {"aa", "bb"}
    assert out["aa"]["message"] == "add the parser now" and out["aa"]["content_type"] == "Python"
    assert out["aa"]["patch"] == "<ide><path>a.py\n<add>x"
    assert (out["bb"]["content_type"], out["bb"]["main_lang"], out["bb"]["file_count"]) == ("Mixed", "Python", 2)
    assert out["bb"]["patch"].startswith("<add><path>new.py\n<del><path>old.py\n<del>y\n<ide><path>b.md")

    config = StageConfig(publish_metadata=True, publish_raw_diffs=True, publish_dataset=True)
    jobs.publish_job(spark, config, annotated, str(landed / "diffs"), processed, str(landed / "e"))
    assert readers.read_dataset(spark, str(landed / "e" / "processed-diffs")).count() == 2
    assert spark.read.parquet(str(landed / "e" / "analysed-metadata")).count() == 7
    raw = spark.read.parquet(str(landed / "e" / "raw-diffs"))
    assert raw.count() == 5 and raw.select("owner", "repo").distinct().count() == 1

    jobs.rerun_rules_job(spark, annotated, str(landed / "b2"))
    again = {r["sha"] for r in readers.read_stage(spark, str(landed / "b2")).where("fits_requirements").collect()}
    assert again == fitting


def test_run_stages(spark, landed):
    paths = StagePaths(*(str(landed / d) for d in ("meta", "b", "diffs", "d", "e")))
    first = StageConfig(annotate_metadata=True, preprocess_diffs=True)
    jobs.run_stages(spark, first, paths, token_parser, sentence_parser)
    before = stored(spark, paths.annotated)
    again = StageConfig(rerun_rule_filters=True, overwrite_existing=True, publish_dataset=True, seed="1")
    jobs.run_stages(spark, again, paths)
    assert stored(spark, paths.annotated) == before  # the rules are re-applied in place
    got = spark.read.parquet(f"{paths.published}/processed-diffs")
    assert {r["sha"] for r in got.collect()} == {"aa", "bb"}


def test_stages_never_give_diff_files_to_a_reader_that_lists_them_in_the_driver(spark, landed, monkeypatch):
    from pyspark.sql import DataFrameReader

    paths = StagePaths(*(str(landed / d) for d in ("meta", "b", "diffs", "d", "e")))
    read, given = DataFrameReader.json, []
    monkeypatch.setattr(DataFrameReader, "json", lambda self, path, *a, **kw: given.append(str(path)) or read(self, path, *a, **kw))
    config = StageConfig(annotate_metadata=True, preprocess_diffs=True, publish_raw_diffs=True, publish_dataset=True)
    jobs.run_stages(spark, config, paths, token_parser, sentence_parser)
    assert spark.read.parquet(f"{paths.published}/processed-diffs").count() == 2
    assert spark.read.parquet(f"{paths.published}/raw-diffs").count() == 5
    assert given == [paths.metadata]


def test_done_units_are_skipped(spark, landed):
    out = str(landed / "b")
    args = (spark, str(landed / "meta"), out)
    jobs.annotate_job(*args, token_parser, sentence_parser)

    def broken():
        raise RuntimeError("a finished repository must not be parsed again")

    jobs.annotate_job(*args, broken, broken)
    assert readers.read_stage(spark, out).count() == 7
    jobs.annotate_job(*args, token_parser, sentence_parser, StageConfig(overwrite_existing=True))
    assert readers.read_stage(spark, out).count() == 7


def test_overwriting_leaves_nothing_stale(spark, landed):
    meta, out = landed / "meta", str(landed / "b")
    row = {"sha": "s1", "author": "dev", "committer": "dev", "message": "Add the parser"}
    for name in ("007", "a b+%"):
        dump(meta / f"{name}.json", {"owner": "42", "name": name, "commits_metadata": [row]})
    jobs.annotate_job(spark, str(meta), out, token_parser, sentence_parser)
    assert {(r["owner"], r["repo"]) for r in readers.read_stage(spark, out).collect()} == {("o", "r"), ("42", "007"), ("42", "a b+%")}
    dump(meta / "a b+%.json", {"owner": "42", "name": "a b+%", "commits_metadata": []})
    dump(meta / "o-r.json", {"owner": "o", "name": "r", "commits_metadata": [{**row, "author": None}]})
    overwrite = StageConfig(overwrite_existing=True)
    jobs.annotate_job(spark, str(meta), out, token_parser, sentence_parser, overwrite)
    assert [(r["owner"], r["repo"], r["sha"]) for r in readers.read_stage(spark, out).collect()] == [("42", "007", "s1")]


def test_a_second_run_opens_pending_folders_only(spark, landed):
    annotated, processed = str(landed / "b"), str(landed / "d")
    for name in ("s{1}+%", "007"):
        dump(landed / "diffs" / f"o-{name}" / "aa.json", {"message": "Add it", "files": [file("a.py")]})
    rows = [("o", n, "aa", True) for n in ("r", "s{1}+%", "007", "t[x]", "none")]
    meta = spark.createDataFrame(rows, "owner string, repo string, sha string, fits_requirements boolean")
    meta.write.partitionBy("owner", "repo").parquet(annotated)
    args = (spark, str(landed / "diffs"), annotated, processed)
    jobs.preprocess_job(*args)
    done = {"o-r", "o-s{1}+%", "o-007"}
    assert {r["repo_key"] for r in readers.read_stage(spark, processed).collect()} == done
    for broken in (landed / "diffs").glob("*/*.json"):
        broken.write_text("{")  # opening one of them would reject it
    jobs.preprocess_job(*args)
    assert spark.read.parquet(f"{processed}-rejected").count() == 0
    dump(landed / "diffs" / "o-t[x]" / "aa.json", {"message": "Add it", "files": [file("a.py")]})
    (landed / "diffs" / "o-none").mkdir()
    jobs.preprocess_job(*args)
    assert spark.read.parquet(f"{processed}-rejected").count() == 0
    assert {r["repo_key"] for r in readers.read_stage(spark, processed).collect()} == done | {"o-t[x]"}


def test_stream_keeps_rejected_rows(spark, landed):
    (landed / "diffs" / "o-r" / "cut.json").write_text('{"message": ')
    dump(landed / "diffs" / "o-r" / "ii.json", {"message": None, "files": [file("a.py")]})
    out = str(landed / "stream")
    for checkpoint in ("cp", "cp2"):  # a replay sets nothing aside twice
        ingest_stream(spark, str(landed / "diffs"), out, str(landed / checkpoint)).awaitTermination(120)
    bad = spark.read.parquet(f"{out}-rejected").collect()
    assert sorted((r["sha"], r["reason"]) for r in bad) == [("cut", "unreadable"), ("ii", "no message")]


def test_rejected_rows_are_stored_and_empty_units_are_done(spark, landed):
    (landed / "meta" / "cut.json").write_text('{"owner": "x"')
    (landed / "diffs" / "o-r" / "cut.json").write_text('{"message": ')
    dump(landed / "meta" / "o-s.json", {"owner": "o", "name": "s", "commits_metadata": []})
    dump(landed / "diffs" / "o-r" / "ii.json", {"message": None, "files": [file("a.py")]})
    annotated, processed = str(landed / "b"), str(landed / "d")
    jobs.annotate_job(spark, str(landed / "meta"), annotated, token_parser, sentence_parser)
    bad = spark.read.parquet(f"{annotated}-rejected").collect()
    assert sorted((r["reason"], r["sha"]) for r in bad if r["sha"]) == [("incomplete", "hh")]
    assert sorted(r["reason"] for r in bad if not r["sha"]) == ["incomplete", "unreadable"]
    assert {r["repo"] for r in spark.read.parquet(f"{annotated}-done").collect()} == {"r", "s"}

    jobs.preprocess_job(spark, str(landed / "diffs"), annotated, processed)
    bad = {r["sha"]: r["reason"] for r in spark.read.parquet(f"{processed}-rejected").collect()}
    assert bad == {"cut": "unreadable", "ii": "no message"}
    assert {r["sha"] for r in readers.read_stage(spark, processed).collect()} == {"aa", "bb"}


def test_drill_job(spark, tmp_path):
    def commit(hash, message, **kw):
        f = {"status": "ADD", "content_type": "Go", "patch": "+x", "path_before": None, "path_after": "a.go"}
        return {"repository": "r", "author": "dev", "committer": "d", "message": message, "hash": hash,
                "mixed_content": "NO", "files": [f], **kw}

    commits = [
        commit("a", "Add the parser\n\nbody"),
        commit("b", "fixes the parser"),
        commit("c", "Add the parser", author="x[bot]"),
        commit("d", "Add the parser", files=[]),
    ]
    dump(tmp_path / "in" / "r.json", {"commits": commits})
    jobs.drill_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), token_parser, sentence_parser)
    rows = {r["hash"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(rows) == {"a", "d"}
    assert rows["a"]["message"] == "Add the parser\n\nbody"  # not its subject
    assert rows["a"]["patch"] == "<add><path>a.go\n<del><path>None\n<add>x"
    assert rows["d"]["patch"] == ""


def stored(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(path).collect()), key=repr)


def test_stream_equals_batch(spark, landed):
    landing, out = landed / "diffs", str(landed / "stream")
    ingest_stream(spark, str(landing), out, str(landed / "cp"), max_files=2).awaitTermination(120)
    batch = jobs.preprocess(readers.read_raw_diffs(spark, str(landing)), None, ["repo_key", "sha"])
    want = sorted((tuple(r) for r in batch.collect()), key=repr)
    assert stored(spark, out) == want and len(want) == 4

    # nothing new: nothing added; one new and one repeated commit: one added
    ingest_stream(spark, str(landing), out, str(landed / "cp")).awaitTermination(120)
    assert stored(spark, out) == want
    dump(landing / "o-r" / "zz.json", {"message": "New", "files": [file("z.go")]})
    ingest_stream(spark, str(landing), out, str(landed / "cp")).awaitTermination(120)
    assert len(stored(spark, out)) == 5

    # a lost checkpoint replays every file and stores none of them twice
    ingest_stream(spark, str(landing), out, str(landed / "cp2")).awaitTermination(120)
    assert len(stored(spark, out)) == 5


def seen_by_spark(checkpoint):
    """The files that the file stream of a checkpoint has in its log."""
    logs = [f for f in (checkpoint / "sources" / "0").iterdir() if not f.name.startswith(".")]
    return {json.loads(line)["path"].replace("file:///", "/") for f in logs for line in f.read_text().splitlines()[1:]}


def test_the_stream_keeps_no_names_of_diff_files_in_the_driver(spark, landed):
    landing, out, checkpoint = landed / "diffs", str(landed / "stream"), landed / "cp"
    many = {f"n{i:02d}" for i in range(23)}
    for i, name in enumerate(sorted(many)):
        dump(landing / "o-n" / f"{name}.json", {"message": name, "files": [file("z.go")]})
        os.utime(landing / "o-n" / f"{name}.json", (10**9 - i, 10**9 - i))  # the last name is the oldest
    (landing / "o-n" / "none.json").write_text("")
    dump(landing / "beside.json", {"message": "no repository", "files": [file("z.go")]})
    ingest_stream(spark, str(landing), out, str(checkpoint), max_files=5).awaitTermination(120)
    assert many <= {r["sha"] for r in spark.read.parquet(out).collect()} and "beside" not in {r["sha"] for r in spark.read.parquet(out).collect()}
    parts = sorted((checkpoint / "listed").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert {str(f) for f in parts} == seen_by_spark(checkpoint)
    names = [[r["path"].rpartition("/")[2] for r in spark.read.parquet(str(f)).collect()] for f in parts]
    assert max(map(len, names)) <= 5 and [n for part in names for n in part][:23] == sorted((f"{n}.json" for n in many), reverse=True)
    # a file that had no content counts as not there until it has some, and a listed one is not taken again
    dump(landing / "o-n" / "none.json", {"message": "Filled", "files": [file("z.go")]})
    before = len(stored(spark, out))
    ingest_stream(spark, str(landing), out, str(checkpoint)).awaitTermination(120)
    assert len(stored(spark, out)) == before + 1 and len(list((checkpoint / "listed").glob("*.parquet"))) == len(parts) + 1


def test_a_checkpoint_without_a_list_is_gone_on_with(spark, landed, monkeypatch):
    landing, out, checkpoint = landed / "diffs", str(landed / "stream"), landed / "cp"
    (landing / "o-r" / "cut.json").write_text("{")
    with monkeypatch.context() as patch:  # as on another file system, and as earlier versions did
        patch.setattr(ingest.disk, "on_disk", lambda *_: False)
        ingest_stream(spark, str(landing), out, str(checkpoint), max_files=2).awaitTermination(120)
    want = stored(spark, out)
    assert len(want) == 4
    dump(landing / "o-r" / "zz.json", {"message": "New", "files": [file("z.go")]})
    ingest_stream(spark, str(landing), out, str(checkpoint)).awaitTermination(120)
    assert len(stored(spark, out)) == 5 and not (checkpoint / "listed").exists()
    assert [r["sha"] for r in spark.read.parquet(f"{out}-rejected").collect()] == ["cut"]
    ingest_stream(spark, str(landing), str(landed / "other"), str(landed / "cp2")).awaitTermination(120)
    assert stored(spark, str(landed / "other")) == stored(spark, out)


def test_stream_takes_fitting_commits_only(spark, landed):
    annotated = spark.createDataFrame(
        [("o-r", "aa", True), ("o-r", "bb", False)], "repo_key string, sha string, fits_requirements boolean"
    )
    out = str(landed / "stream")
    ingest_stream(spark, str(landed / "diffs"), out, str(landed / "cp"), annotated).awaitTermination(120)
    assert [r["sha"] for r in spark.read.parquet(out).collect()] == ["aa"]


def test_stream_looks_at_its_output_only_for_a_batch_begun_before(spark, landed, monkeypatch):
    landing, out, checkpoint = landed / "diffs", str(landed / "stream"), landed / "cp"
    looked = []
    look = ingest.new_rows
    monkeypatch.setattr(ingest, "new_rows", lambda *a: looked.append(1) or look(*a))
    ingest_stream(spark, str(landing), out, str(checkpoint), max_files=3).awaitTermination(120)
    dump(landing / "o-s" / "aa.json", {"message": "Another", "files": [file("z.go")]})
    ingest_stream(spark, str(landing), out, str(checkpoint)).awaitTermination(120)
    want = stored(spark, out)
    assert len(want) == 5 and not looked
    # the last batch was written but not committed: it runs again and adds nothing
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for done in (last, last.with_name(f".{last.name}.crc")):
        done.unlink(missing_ok=True)
    ingest_stream(spark, str(landing), out, str(checkpoint)).awaitTermination(120)
    assert stored(spark, out) == want and looked == [1]
    # a new checkpoint is seeded: nothing is stored twice, what is new is taken
    dump(landing / "o-t" / "aa.json", {"message": "A third", "files": [file("z.go")]})
    ingest_stream(spark, str(landing), out, str(landed / "cp2")).awaitTermination(120)
    assert len(stored(spark, out)) == 6 and looked == [1]


def test_a_broken_landing_does_not_stand_for_a_commit(spark, landed):
    landing, out, checkpoint = landed / "diffs", str(landed / "stream"), str(landed / "cp")
    (landing / "o-r" / "zz.json").write_text("{")
    ingest_stream(spark, str(landing), out, checkpoint).awaitTermination(120)
    (landing / "o-r" / "zz.json").unlink()
    dump(landing / "p" / ".." / "o-r" / "zz.json", {"message": "Repaired", "files": [file("z.go")]})
    ingest_stream(spark, str(landing), out, str(landed / "cp2")).awaitTermination(120)
    assert [r["message"] for r in spark.read.parquet(out).where("sha = 'zz'").collect()] == ["repaired"]


def test_rejected_rows_are_stored_first_and_once(spark, landed, monkeypatch):
    (landed / "meta" / "cut.json").write_text('{"owner": "x"')
    out = str(landed / "b")
    args = (spark, str(landed / "meta"), out, token_parser, sentence_parser)
    write = jobs.writers.write_stage

    def stopping(df, path, *a, **k):
        if path == out:
            raise RuntimeError("stopped")
        write(df, path, *a, **k)

    with monkeypatch.context() as patch:
        patch.setattr(jobs.writers, "write_stage", stopping)
        with pytest.raises(RuntimeError):
            jobs.annotate_job(*args)

    def rejected():
        return sorted((r["sha"] or "", r["reason"]) for r in readers.read_stage(spark, f"{out}-rejected").collect())

    want = [("", "unreadable"), ("hh", "incomplete")]
    assert rejected() == want  # before any output
    for config in (StageConfig(), StageConfig(), StageConfig(overwrite_existing=True)):
        jobs.annotate_job(*args, config)
        assert rejected() == want
    dump(landed / "meta" / "cut.json", {"owner": "x", "name": "y", "commits_metadata": []})
    row = {"sha": "hh", "author": "dev", "committer": "dev", "message": "No the author here"}
    dump(landed / "meta" / "o-r.json", {"owner": "o", "name": "r", "commits_metadata": [row]})
    jobs.annotate_job(*args, StageConfig(overwrite_existing=True))
    assert rejected() == [("", "incomplete")]  # of the repository without commits
    drilled = str(landed / "drilled")
    dump(landed / "dumps" / "r.json", {"commits": [{"repository": "r", "hash": "a", "message": None}]})
    for _ in range(2):
        jobs.drill_job(spark, str(landed / "dumps"), drilled, token_parser, sentence_parser)
        assert spark.read.parquet(f"{drilled}-rejected").count() == 1


def test_only_the_parse_stages_carry_a_resource_profile(spark, landed):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    commits = readers.read_repo_metadata(spark, str(landed / "meta")).drop(readers.CORRUPT)
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", 0.5)).build
    plan = jobs.annotate(commits, token_parser, sentence_parser, profile=profile)._jdf.queryExecution().logical()

    def nodes(plan):
        found = [plan]
        for i in range(plan.children().size()):
            found += nodes(plan.children().apply(i))
        return found

    every = nodes(plan)
    carrying = [n for n in every if "profile" in [f for f in n.productElementNames().mkString(",").split(",")] and n.profile().isDefined()]
    assert [n.nodeName() for n in carrying] == ["MapInArrow", "MapInArrow"] and len(every) > 2
    assert all("gpu" in n.profile().get().toString() for n in carrying)


def test_parsing_of_whole_rows_changes_no_result(spark, landed):
    commits = readers.read_repo_metadata(spark, str(landed / "meta")).drop(readers.CORRUPT)
    rows = ann.annotate_rules(ann.with_subject(commits)).withColumn("_tokens", commits["sha"])
    one = parsing.with_parse(rows, "_tokens", token_parser, parsing.schemas.PARSE_TOKENS, when=ann.cheap_rules())
    other = parsing.parse_rows(rows, "_tokens", parsing.F.when(ann.cheap_rules(), rows["subject"]), token_parser, parsing.schemas.PARSE_TOKENS, None)
    assert other.columns == one.columns and other.schema.simpleString() == one.schema.simpleString()
    assert sorted(map(repr, other.collect())) == sorted(map(repr, one.collect()))
