import pytest
from pyspark.sql import functions as F

from commitloom.operators import annotate, corpus, filters

ANNOTATED = (
    "owner string, repo string, sha string, author string, subject string, is_bot boolean, is_chore boolean, "
    "subject_length int, subject_word_count int, verb_object_spacy boolean, verb_object_stanza boolean, "
    "fits_requirements boolean"
)


def annotated(spark, flags, **changed):
    base = {
        "owner": "o", "repo": "r", "sha": "s", "author": "dev", "subject": "add a parser",
        "is_bot": False, "is_chore": False, "subject_length": 12, "subject_word_count": 3,
        "fits_requirements": None,
    }
    rows = [{**base, **changed, "verb_object_spacy": a, "verb_object_stanza": b} for a, b in flags]
    return spark.createDataFrame(rows, ANNOTATED)


def test_masks(spark):
    df = annotated(spark, [(True, False), (False, True), (False, False), (True, None), (None, None)])
    got = df.select(
        annotate.requirements_mask().alias("e"), annotate.requirements_mask("compat").alias("c")
    ).collect()
    assert [r["e"] for r in got] == [True, True, False, True, False]
    assert [r["c"] for r in got] == [True, False, False, True, False]


@pytest.mark.parametrize(
    "change, fits",
    [
        ({"subject_length": 50}, True),
        ({"subject_length": 51}, False),
        ({"subject_word_count": 2}, False),
        ({"is_bot": True}, False),
        ({"is_chore": True}, False),
    ],
)
def test_mask_borders(spark, change, fits):
    assert annotated(spark, [(True, True)], **change).select(annotate.requirements_mask()).first()[0] == fits


def test_drill_filter_borders(spark):
    subjects = ["", "a b", "a b c", "a " * 25 + "b", "a " * 24 + "bc", "bump a b"]
    rows = [("dev", s, True, False) for s in subjects] + [
        ("x[bot]", "a b c", True, True),
        ("x[BOT]", "a b c", False, True),
        ("dev", "a b c", False, None),
    ]
    df = spark.createDataFrame(
        rows, "author string, subject string, verb_object_spacy boolean, verb_object_stanza boolean"
    )
    kept = [(r["author"], r["subject"]) for r in annotate.commit_quality_filter(df).collect()]
    assert kept == [("dev", "a b c"), ("dev", "a " * 24 + "bc"), ("x[BOT]", "a b c")]


def test_reapply_keeps_unparsed_rows(spark):
    df = annotated(spark, [(True, None), (None, None)], subject="Merge it all", is_chore=False)
    got = annotate.reapply_rules(df.withColumn("subject", F.lower("subject"))).collect()
    assert [(r["is_chore"], r["fits_requirements"]) for r in got] == [(True, False)] * 2


def test_incomplete_columns(spark):
    df = spark.createDataFrame([(1, None, 2), (3, 4, 5)], "a int, b int, c int")
    assert filters.drop_incomplete_columns(df).columns == ["a", "c"]
    assert filters.drop_incomplete_rows(df).count() == 1


def test_switches(spark):
    df = spark.createDataFrame([(1, "Go", "Go"), (2, "Mixed", "Go")], "file_count int, content_type string, main_lang string")
    assert filters.single_file(df).count() == 1 and filters.single_file(df, True).count() == 2
    assert filters.unmixed(df).count() == 1 and filters.unmixed(df, True).count() == 2
    assert filters.for_language(df, None).count() == 2 and filters.for_language(df, "PHP").count() == 0


def test_no_merges(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],)], "parents array<string>")
    assert filters.no_merges(df).count() == 2


def keyed(spark, n):
    return spark.range(n).select(F.md5(F.col("id").cast("string")).alias("sha"))


def test_split_shares_and_stability(spark):
    small, large = corpus.split(keyed(spark, 5000)), corpus.split(keyed(spark, 10000))
    assert large.join(small, ["sha", "split"], "left_semi").count() == 5000
    shares = {r["split"]: r["count"] / 10000 for r in large.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["test"] - 0.1) < 0.01
    other = corpus.split(keyed(spark, 5000), seed="1")
    assert other.join(small, ["sha", "split"], "left_semi").count() < 5000


def test_shuffle_and_sample(spark):
    df = keyed(spark, 300)
    order = [r["sha"] for r in corpus.shuffle(df).collect()]
    assert sorted(order) == sorted(r["sha"] for r in df.collect()) and order != sorted(order)
    assert order == [r["sha"] for r in corpus.shuffle(df.repartition(7)).collect()]
    assert order != [r["sha"] for r in corpus.shuffle(df, seed="1").collect()]
    assert [r["sha"] for r in corpus.sample_rows(df, 10).collect()] == order[:10]
    gaps = spark.createDataFrame([("b",), (None,), ("a",), ("a",)], "sha string")
    assert [r["sha"] for r in corpus.shuffle(gaps).collect()][0] is None and corpus.shuffle(gaps).count() == 4


def test_sample_with_replacement(spark):
    df = keyed(spark, 50)
    one = corpus.sample_with_replacement(df, 4000, seed="2")
    got = sorted(map(tuple, one.collect()), key=repr)
    assert sorted(r.draw for r in one.collect()) == list(range(4000)) and one.columns == [*df.columns, "draw"]
    assert got == sorted(map(tuple, corpus.sample_with_replacement(df.repartition(7), 4000, seed="2").collect()), key=repr)
    times = [r["count"] for r in one.groupBy("sha").count().collect()]
    assert len(times) == 50 and 40 < min(times) and max(times) < 130  # 80 expected, standard deviation 9
    other = corpus.sample_with_replacement(df, 4000, seed="3")
    assert got != sorted(map(tuple, other.collect()), key=repr)
    assert corpus.sample_with_replacement(df, 0).count() == 0
    assert corpus.sample_with_replacement(df.limit(0), 10).count() == 0
    single = spark.createDataFrame([("a", 1)], "sha string, draw int").drop("draw")
    assert corpus.sample_with_replacement(single, 5).count() == 5


def test_debug_head(spark):
    df = corpus.split(keyed(spark, 500))
    got = sorted((r["split"], r["sha"]) for r in corpus.debug_head(df, n=3).collect())
    rows = sorted((r["split"], r["sha"]) for r in df.collect())
    want = [row for s in ("test", "train", "valid") for row in [r for r in rows if r[0] == s][:3]]
    assert got == want


def test_gather_files_orders(spark):
    rows = [("s", i, f"f{i}.py", None, "modified", f"+{i}") for i in (10, 2, 1)]
    df = spark.createDataFrame(
        rows, "sha string, file_idx int, filename string, previous_filename string, status string, patch string"
    )
    files = corpus.gather_files(df, ("sha",)).first()["files"]
    assert [f["filename"] for f in files] == ["f1.py", "f2.py", "f10.py"]


def test_gather_files_keeps_forks_apart(spark):
    rows = [(repo, "s", i, f"{repo}{i}.py") for repo in ("a", "b") for i in (2, 1)]
    df = spark.createDataFrame(rows, "repo_key string, sha string, file_idx int, filename string")
    got = {r["repo_key"]: [f["filename"] for f in r["files"]] for r in corpus.gather_files(df).collect()}
    assert got == {"a": ["a1.py", "a2.py"], "b": ["b1.py", "b2.py"]}


def test_explode_files(spark):
    files = "array<struct<filename:string,previous_filename:string,status:string,patch:string>>"
    df = spark.createDataFrame(
        [("o", "r", "s", "m", [("a.py", None, "modified", "+x"), ("b", None, "added", "+y")])],
        f"owner string, repo string, sha string, message string, files {files}",
    )
    got = sorted(tuple(r) for r in corpus.explode_files(df).collect())
    assert got == [("Other", "o", "r", "s", "m", "b", "+y", True), ("Python", "o", "r", "s", "m", "a.py", "+x", True)]
    compat = corpus.explode_files(df, compat=True).select("language", "sha").distinct().collect()
    assert [tuple(r) for r in compat] == [("Other", "s.json")]


def test_funnel_totals(spark):
    rows = annotated(spark, [(True, False)], fits_requirements=True).unionByName(
        annotated(spark, [(False, False)], sha="t", repo="q", subject_length=60, fits_requirements=False)
    )
    keys = rows.select("owner", "repo", "sha")
    extra = spark.createDataFrame([("o", "q", "u")], "owner string, repo string, sha string")
    landed = keys.where("sha = 's'")
    flags = corpus.funnel_flags(keys.unionByName(extra), rows, landed, landed.limit(0))
    total = corpus.funnel(flags).where("owner IS NULL").first()
    assert (total["scraped"], total["annotated"], total["short_enough"], total["fitting"]) == (3, 2, 1, 1)
    assert (total["landed"], total["processed"]) == (1, 0)
