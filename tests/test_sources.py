import json

import pytest
from pyspark.sql import functions as F

from commitloom import catalog, fixtures, schemas
from commitloom.operators import corpus
from commitloom.plans.work import quarantine
from commitloom.sources import files, readers, writers


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value), encoding="utf-8")


def test_repo_list(spark, tmp_path):
    path = tmp_path / "repositories.txt"
    path.write_text("https://host/own/one\n#https://host/own/two\nhttps://host/own/three/\nnoslash\n")
    rows = [tuple(r) for r in readers.read_repo_list(spark, str(path)).collect()]
    assert rows == [
        ("https://host/own/one", "own", "one"),
        ("https://host/own/three/", "three", ""),
        ("noslash", None, "noslash"),
    ]


def test_top_repos(spark, tmp_path):
    path = tmp_path / "top.csv"
    path.write_bytes("name,defaultBranch,mainLanguage,stars\ncafé/x,main,Go,5\n".encode("latin-1"))
    row = readers.read_top_repos(spark, str(path)).first()
    assert tuple(row) == ("café/x", "main", "Go", "café-x", "go")


def test_api_commits(spark, tmp_path):
    commits = [
        {"sha": s, "commit": {"author": {"name": "a", "x": 1}, "committer": {"name": "c"}, "message": "m\nn"}}
        for s in "pq"
    ]
    dump(tmp_path / "page.json", commits)
    rows = [tuple(r) for r in readers.read_api_commits(spark, str(tmp_path)).collect()]
    assert rows == [("p", "a", "c", "m\nn", None), ("q", "a", "c", "m\nn", None)]


def test_repo_metadata(spark, tmp_path):
    commit = {"sha": "p", "author": "a", "committer": "c", "message": "m"}
    dump(tmp_path / "o-r.json", {"owner": "o", "name": "r", "commits_metadata": [commit, {**commit, "sha": "q"}]})
    dump(tmp_path / "o-s.json", {"owner": "o", "name": "s", "commits_metadata": []})
    rows = [tuple(r) for r in readers.read_repo_metadata(spark, str(tmp_path)).collect()]
    want = [("o", "r", "p", "a", "c", "m", None), ("o", "r", "q", "a", "c", "m", None)]
    assert sorted(rows, key=repr) == sorted([*want, ("o", "s", *[None] * 5)], key=repr)


@pytest.mark.parametrize("reader", [readers.read_api_commits, readers.read_repo_metadata, readers.read_drilled])
def test_cut_off_files_are_kept_for_quarantine(spark, tmp_path, reader):
    commit = {"sha": "p", "author": "a", "committer": "c", "message": "m", "hash": "p"}
    whole = [commit] if reader is readers.read_api_commits else {"commits_metadata": [commit], "commits": [commit]}
    for i in range(9):
        dump(tmp_path / f"{i}.json", whole)
    (tmp_path / "cut.json").write_text('{"owner": "o", "commits')
    good, bad = quarantine(reader(spark, str(tmp_path)), {"unreadable": readers.is_readable()})
    assert len(good.collect()) == 9 and [r[readers.CORRUPT] for r in bad.collect()] == ['{"owner": "o", "commits']


def file(name, patch="+x", previous=None):
    return {"filename": name, "previous_filename": previous, "status": "modified", "patch": patch}


def test_raw_diffs(spark, tmp_path):
    dump(tmp_path / "o-r" / "aa.json", {"message": "m", "files": [file("a.py"), file("b.py", None)]})
    dump(tmp_path / "o-r" / "bb.json", {"message": "m", "files": []})
    dump(tmp_path / "o-r" / "deeper" / "cc.json", {"message": "m", "files": []})
    (tmp_path / "o-r" / "dd.json").write_text('{"message": ')
    (tmp_path / "o-r" / "notes.txt").write_text("x")
    rows = readers.read_raw_diffs(spark, str(tmp_path))
    good, bad = quarantine(rows, {"readable": readers.is_readable()})
    got = {r["sha"]: r for r in good.collect()}
    assert set(got) == {"aa", "bb"} and got["aa"]["repo_key"] == "o-r"
    assert [f["patch"] for f in got["aa"]["files"]] == ["+x", None]
    assert [r["sha"] for r in bad.collect()] == ["dd"]


def test_drilled_leaves_contents_unread(spark, tmp_path):
    one = {
        "repository": "r", "author": "a", "committer": "c", "message": "m", "hash": "h", "mixed_content": "NO",
        "files": [{"status": "ADD", "content_type": "Go", "patch": "+x", "path_before": None, "path_after": "a.go",
                   "content_before": None, "content_after": "x"}],
    }
    dump(tmp_path / "r.json", {"commits": [one]})
    (tmp_path / "r.txt").write_text("no json")
    df = readers.read_drilled(spark, str(tmp_path))
    assert df.count() == 1 and "content_after" not in df.schema["files"].simpleString()


def test_stage_csv_keeps_breaks_and_quotes(spark, tmp_path):
    header = "content_type,main_lang,message,sha,patch,file_count\n"
    (tmp_path / "a.csv").write_text(header + 'Go,Go,"say ""hi"", now",s1,"<add>x\n<del>y",1\n')
    (tmp_path / "b.csv").write_text(header + "Go,Go,,s2,p,2\n")
    rows = readers.read_stage_csv(spark, str(tmp_path), schemas.PROCESSED).orderBy("sha").collect()
    assert tuple(rows[0]) == ("Go", "Go", 'say "hi", now', "s1", "<add>x\n<del>y", 1)
    assert rows[1]["message"] is None and rows[1]["file_count"] == 2


def test_write_stage_replaces_only_its_units(spark, tmp_path):
    path = str(tmp_path / "stage")
    first = spark.createDataFrame([("o", "a", "1"), ("o", "b", "2")], "owner string, repo string, sha string")
    writers.write_stage(first, path, ["owner", "repo"])
    writers.write_stage(first.where("repo = 'b'").replace("2", "3"), path, ["owner", "repo"])
    rows = sorted((r["repo"], r["sha"]) for r in readers.read_stage(spark, path).collect())
    assert rows == [("a", "1"), ("b", "3")]
    assert not (tmp_path / "stage" / "owner=o" / "repo=c").exists()


def test_write_stage_without_adaptive_execution(spark, tmp_path):
    path = str(tmp_path / "stage")
    rows = spark.range(200).selectExpr("'o' AS owner", "'big' AS repo", "md5(string(id)) AS sha")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        writers.write_stage(rows, path, ["owner", "repo"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = list((tmp_path / "stage" / "owner=o" / "repo=big").glob("*.parquet"))
    assert len(parts) > 1  # one large repository is not one task
    assert readers.read_stage(spark, path).count() == 200


def test_splits(spark, tmp_path):
    path = str(tmp_path / "data")
    rows = corpus.split(spark.range(300).selectExpr("md5(string(id)) AS sha"))
    writers.export_splits(rows, path)
    assert readers.read_dataset(spark, path).count() == 300
    test = readers.read_dataset(spark, path, "test")
    assert test.count() == rows.where("split = 'test'").count() > 0


def test_splits_in_random_order(spark, tmp_path):
    path = str(tmp_path / "data")
    rows = corpus.split(spark.range(300).selectExpr("md5(string(id)) AS sha"))
    writers.export_splits(rows, path, seed="4")
    got = [r["sha"] for r in readers.read_dataset(spark, path, "train").coalesce(1).collect()]
    want = [r["sha"] for r in corpus.shuffle(rows.where("split = 'train'"), seed="4").collect()]
    assert sorted(got) == sorted(want) and got != sorted(got)
    if len(list((tmp_path / "data" / "split=train").glob("*.parquet"))) == 1:
        assert got == want


def test_report(spark, tmp_path):
    writers.write_report(spark.createDataFrame([("m", 1.5, None)], "Model string, Overall double, Go double"), str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("*.csv")
    assert part.read_text().splitlines() == ["Model,Overall,Go", "m,1.5,"]


def test_folder_names_stay_as_they_are(spark, tmp_path):
    rows = [("007", "42", "a"), ("o", "c++", "b")]
    df = spark.createDataFrame(rows, "owner string, repo string, sha string")
    writers.write_stage(df.where("owner = '007'"), str(tmp_path / "stage"), ["owner", "repo"])
    assert [(r.owner, r.repo) for r in readers.read_stage(spark, str(tmp_path / "stage")).collect()] == [("007", "42")]
    dump(tmp_path / "diffs" / "o-c++ é" / "s.json", {"message": "m", "files": []})
    assert [r.repo_key for r in readers.read_raw_diffs(spark, str(tmp_path / "diffs")).collect()] == ["o-c++ é"]


@pytest.mark.parametrize("size", [64, 300, 1000, 1 << 20])
def test_ranges_of_a_dump_equal_the_whole(spark, tmp_path, size):
    def commit(i):
        text = 'é漢 {"repository": \\ ]}, ' * (i % 5) + f"message {i}\n"
        file = {"status": "ADD", "content_type": "Go", "patch": text, "path_before": None, "path_after": "a.go", "content_after": "x" * 30}
        return {"repository": "r", "author": "dev", "committer": "d", "message": text, "hash": str(i), "mixed_content": "NO", "files": [file] * (i % 3)}

    dump(tmp_path / "a.json", {"commits": [commit(i) for i in range(40)]})
    (tmp_path / "b.json").write_text(json.dumps({"commits": [commit(i) for i in range(50, 60)]}, separators=(",", ":"), ensure_ascii=False) + "\n", encoding="utf-8")
    dump(tmp_path / "empty.json", {"commits": []})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = readers.read_drilled_ranges(spark, str(tmp_path))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, readers.read_drilled(spark, str(tmp_path)).collect()))
        if size < 1000:
            assert found.rdd.getNumPartitions() > 10
        # a broken tail: what is before it is read
        cut = json.dumps({"commits": [commit(i) for i in range(70, 75)]})
        (tmp_path / "cut.json").write_text(cut[: cut.rindex("message 74")])
        (tmp_path / "none.json").write_text('{"owner": "o"')
        good, bad = quarantine(readers.read_drilled_ranges(spark, str(tmp_path)), {"unreadable": readers.is_readable()})
        assert sorted(int(r.hash) for r in good.collect()) == [*range(40), *range(50, 60), *range(70, 74)]
        assert len(bad.collect()) == 2 and all(r[readers.CORRUPT] for r in bad.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_of_fixtures_are_wide_unless_they_are_counted(spark, tmp_path):
    """20 neighbouring parts of a repository are one file for each 8192 documents; of an unreadable one, a file each."""
    rows = [(i * 512, "a b c d", "en", source) for i in range(20) for source in ("s1", "s7")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    lost = F.col("repo").endswith("7")
    parts = catalog._metadata_rows(spark, str(tmp_path), lost).select("repo", "part").distinct().groupBy("repo").count()
    assert {tuple(r) for r in parts.collect()} == {("s1", 2), ("s7", 20)}
    fixtures.write_metadata(catalog._metadata_rows(spark, str(tmp_path)), f"{tmp_path}/files")
    assert len([f for f in (tmp_path / "files").glob("*.json") if f.stat().st_size]) == 4
    assert readers.read_repo_metadata(spark, f"{tmp_path}/files").count() == 40


def test_api_commits_are_paged(spark, tmp_path):
    commit = F.struct(*[F.struct(F.col(c).alias("name")).alias(c) for c in ("author", "committer")], "message")
    rows = spark.range(250).select(F.col("id").alias("doc_id"), F.format_string("s%d", "id").alias("sha"), F.lit("a").alias("author"), F.lit("c").alias("committer"), F.format_string("m\n\"%d", "id").alias("message"))
    fixtures.write_pages(rows.withColumn("commit", commit), F.floor(F.col("doc_id") / catalog.API_PAGE), f"{tmp_path}/pages")
    assert len([f for f in (tmp_path / "pages").glob("*.txt") if f.stat().st_size]) == 3
    found = readers.read_api_commits(spark, f"{tmp_path}/pages", "*.txt").select("sha", "author", "committer", "message", readers.CORRUPT)
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"s{i}", "a", "c", f'm\n"{i}', None) for i in range(250))


def _most_tasks(spark, work):
    """The tasks of the largest stage that ``work`` runs, 0 without any."""
    context, group = spark.sparkContext, f"g{id(work)}"
    context.setJobGroup(group, group)
    work()
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    return max((s.numTasks for s in stages if s), default=0)


def test_many_diff_files_are_listed_by_folder_or_by_few_tasks(spark, tmp_path):
    for i in range(90):
        dump(tmp_path / "diffs" / f"o-r{i % 3}" / f"s{i}.json", {"message": f"m{i}", "files": []})
    dump(tmp_path / "diffs" / "beside.json", {"message": "no repository", "files": []})
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    assert _most_tasks(spark, lambda: readers.read_raw_diffs(spark, str(tmp_path / "diffs"))) == 0
    names = [str(f) for f in (tmp_path / "diffs").glob("*/*.json")]
    assert 0 < _most_tasks(spark, lambda: readers.read_diff_files(spark, names)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(setting) == before
    found = readers.read_raw_diffs(spark, str(tmp_path / "diffs")).select("repo_key", "sha", "message")
    assert {tuple(r) for r in found.collect()} == {(f"o-r{i % 3}", f"s{i}", f"m{i}") for i in range(90)}


def test_built_diffs_are_files_written_by_the_tasks(spark, tmp_path):
    """Names and texts with marks; null flags go; calls add files; no checksum files, which Spark's writer makes beside each."""
    file = [("a.py", None, "modified", 'x\r\n"y"')]
    kind = "repo_key string, message string, files array<struct<filename:string,previous_filename:string,status:string,patch:string>>, broken boolean"
    keys = ["o-r", "o-a=b/c%d e*é[1]", "", None]
    rows = [(k, "m\n漢", file, i % 2 == 1) for i, k in enumerate(keys)] + [("o-r", "gone", file, None)]
    df = spark.createDataFrame(rows, kind)
    for folder in (f"{tmp_path}/plain", f"file://{tmp_path}/plain"):
        fixtures.write_diffs(df, folder)
    assert not list((tmp_path / "plain").rglob("*.crc")) and len(list((tmp_path / "plain").rglob("*.json"))) == 8
    found = readers.read_raw_diffs(spark, f"{tmp_path}/plain")
    got = sorted((r.repo_key, r[readers.CORRUPT] is None, r.message, r.files) for r in found.where("_corrupt_record IS NULL").collect())
    none = "repo_key=__HIVE_DEFAULT_PARTITION__"
    assert [g[:3] for g in got] == sorted([("repo_key=o-r", True, "m\n漢"), (none, True, "m\n漢")] * 2)
    assert all(g[3][0]["patch"] == 'x\r\n"y"' for g in got)
    assert len(found.where("_corrupt_record IS NOT NULL").collect()) == 4
    df.drop("broken").write.partitionBy("repo_key").json(f"{tmp_path}/spark")
    assert {f.name for f in (tmp_path / "plain").iterdir()} == {f.name for f in (tmp_path / "spark").iterdir() if f.is_dir()}


ODD = {
    "plain": b'{"message": "m", "files": [{"filename": "a.py", "patch": {"x":1}, "y": 2}]}', "cut": b'{"message": ', "blank": b" \n\t", "none": b"", "null": b"null",
    "text": b'"abc"', "control": b'\x01{"message": "m"}', "typed": b'{"message": "m", "files": "text"}', "more": b'{"message": "m"} xx', "marked": b'\xef\xbb\xbf{"message": "\xc3\xa9"}',
    "wide": '{"message": "\u6f22", "files": []}'.encode("utf-16"), "wide cut": '{"message": '.encode("utf-16"), "bytes": b'{"message": "\xff", "files": []}', "[x]{1} %41+#\u00e9\u00a0\U0001f600": b"{}",
    "several": b' [{"message": "1"}, {"message": "2", "files": []}]', "several none": b"[]", "several cut": b'[{"message": "1"}, {"mess', "several typed": b'[{"message": "1"}, {"files": "text"}]',
    "several mixed": b'[null, {"message": "1"}]', "_hidden": b"{}", ".hidden": b"{}", "long": b'{"message": "' + b"x" * 5_000_000 + b'"}',
}


def test_files_opened_by_tasks_are_read_as_sparks_reader_reads_them(spark, tmp_path):
    for folder in ("o-r", "o-c++ \u00e9%2F", "_o", ".o"):
        (tmp_path / folder).mkdir()
        for name, content in ODD.items():
            (tmp_path / folder / f"{name}.json").write_bytes(content)
    dump(tmp_path / "o-r" / "deeper.json" / "q.json", {})
    dump(tmp_path / "beside.json", {})
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        folders = [f for _, f in readers._folders(spark, path)]
        names = [readers.literal_path(f) for f in folders]
        reader = spark.read.schema(readers.with_corrupt(schemas.RAW_DIFF)).option("columnNameOfCorruptRecord", readers.CORRUPT).option("pathGlobFilter", "*.json")
        columns = ["_metadata.file_path", "_metadata.file_name", "message", "files", readers.CORRUPT]
        want = sorted(map(repr, reader.json(names, multiLine=True).select(*columns).collect()))
        listing = files.listed(spark, folders)
        assert sorted(map(repr, files.parsed(listing, schemas.RAW_DIFF, readers.CORRUPT).select(*columns).collect())) == want and len(want) > 70
        state = ["_metadata.file_path", "path", "_metadata.file_size", "_metadata.file_modification_time"]
        seen = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(names).select(*state)
        assert sorted(map(tuple, listing.collect())) == sorted(map(tuple, seen.where("file_size > 0").collect()))


def test_the_driver_holds_no_names_of_diff_files(spark, tmp_path):
    for i in range(9):
        dump(tmp_path / "diffs" / f"o-r{i % 2}" / f"s{i}.json", {"message": f"m{i}", "files": []})
    for found in (readers.read_raw_diffs(spark, str(tmp_path / "diffs")), readers.read_raw_diffs(spark, str(tmp_path / "diffs"), [str(tmp_path / "diffs" / "o-r1")])):
        assert found.inputFiles() == []
    assert sorted(r.message for r in found.collect()) == ["m1", "m3", "m5", "m7"]


def test_many_small_metadata_files_are_written_by_the_tasks_and_moved(spark, tmp_path):
    """As Spark's writer writes them, without the checksum files that it makes beside each; moved in place of others."""
    columns = ("'o' AS owner", "concat('r+', id % 3) AS repo", "id AS doc_id", "md5(string(id)) AS sha", "concat('a', char(10)) AS author")
    rows = spark.range(60).selectExpr(*columns, "if(id % 7 = 0, null, 'c') AS committer", "concat(char(233), char(34)) AS message", "id % 5 AS part")
    rows = rows.withColumn("broken", F.when(F.col("doc_id") != 59, F.col("repo").endswith("1")))
    found = []
    for folder, small in (("tasks", True), ("spark", False)):
        at, moved = tmp_path / folder, tmp_path / f"{folder}-moved"
        fixtures.write_metadata(rows, f"file://{at}", small=small)
        assert bool(list(at.glob(".*.crc"))) is not small
        assert len([f for f in at.glob("*.json") if f.stat().st_size]) == 15
        names = fixtures.move_files(spark, str(at), f"file://{moved}")
        assert sorted(f.name for f in moved.glob("*.json")) == sorted(names) and not [f for f in at.glob("*.json") if f.stat().st_size]
        found.append(sorted(map(repr, readers.read_repo_metadata(spark, str(moved)).select("owner", "repo", "sha", "author", "committer", "message", F.col(readers.CORRUPT).isNull()).collect())))
        fixtures.write_metadata(rows.withColumn("broken", F.lit(False)).where("doc_id < 59"), str(at), small=small)
        assert fixtures.move_files(spark, str(at), str(moved), names) == names
        assert readers.read_repo_metadata(spark, str(moved)).where(readers.is_readable()).count() == 59
    assert found[0] == found[1]
