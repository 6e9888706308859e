from pyspark.sql import functions as F

from commitloom.plans import work


def pages(spark, n, mode):
    repos = spark.createDataFrame([("o", "r", n)], "owner string, repo string, commit_count long")
    return sorted(r["page"] for r in work.page_plan(repos, mode=mode).collect())


def test_page_plan(spark):
    golden = {50: (1, 1), 90: (1, 1), 180: (2, 2), 200: (2, 3), 0: (1, 0), -1: (0, 0)}
    for n, (compat, full) in golden.items():
        assert pages(spark, n, "compat") == list(range(1, compat + 1)), n
        assert pages(spark, n, "full") == list(range(1, full + 1)), n


def test_last_page(values):
    link = '<https://x/c?per_page=1&page=2>; rel="next", <https://x/c?per_page=1&page=57>; rel="last"'
    assert values([link, None, '<https://x>; rel="next"', "a,&page=z>;"], "string", work.last_page) == [57, None, None, None]


def test_pending_units(spark):
    units = spark.createDataFrame([("o", "a"), ("o", "b")], "owner string, repo string")
    done = units.where("repo = 'a'").withColumn("x", F.lit(1))
    assert [r["repo"] for r in work.pending_units(units, done, ["owner", "repo"]).collect()] == ["b"]
    assert work.pending_units(units, done, ["owner", "repo"], overwrite=True).count() == 2


def test_fetch_plan(spark):
    annotated = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", None)], "sha string, fits_requirements boolean")
    landed = spark.createDataFrame([("a",)], "sha string")
    assert [r["sha"] for r in work.diff_fetch_plan(annotated, landed, ["sha"]).collect()] == ["b"]


def test_quarantine_names_the_first_broken_rule(spark):
    df = spark.createDataFrame([(1, "x"), (-1, "x"), (1, None), (-1, None), (None, "x")], "a int, b string")
    good, bad = work.quarantine(df, {"positive": F.col("a") > 0, "present": F.col("b").isNotNull()})
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert sorted(r["reason"] for r in bad.collect()) == ["positive"] * 3 + ["present"]


def test_store_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (-1, "y")], "a int, b string")
    good, bad = work.store_checked(df, {"positive": F.col("a") > 0}, str(tmp_path / "t"))
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert [tuple(r) for r in bad.select("a", "b", "reason").collect()] == [(-1, "y", "positive")]
