from itertools import cycle

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitloom.llm import mixing, sharding


def plain_targets(sizes):
    """Shares of the sources, in order, by repeated sharing of the excess."""
    total, weights = sum(sizes), [w for w, _ in zip(cycle((1, 2, 3)), sizes)]
    stopped, target = set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        left = total - sum(3 * sizes[i] for i in stopped)
        level = left / sum(weights[i] for i in free) if free else 0
        above = [i for i in free if weights[i] * level > 3 * sizes[i]]
        if not above:
            break
        stopped |= set(above)
    for i in range(len(sizes)):
        target[i] = 3 * sizes[i] if i in stopped else weights[i] * level
    return target


def test_targets_rates_and_copies(spark):
    random = np.random.default_rng(5)
    sources = ["B", "é", None, "zero", "tiny"]
    scale = {"a": 400, "B": 120, "é": 80, None: 90, "zero": 0, "tiny": 2}
    rows = []
    for i in range(3000):
        s = "a" if i % 3 == 0 else sources[i % 5]
        rows.append((i if i % 50 else None, s, int(random.pareto(1.6) * scale[s]) if scale[s] else 0, "x"))
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, copies string")
    mixed = mixing.mix(docs)
    found = mixed.toPandas()
    assert len(found) == len(rows) and list(found.columns) == ["doc_id", "source", "size", "source_size", "target", "copies"]
    assert found["copies"].between(0, 3).all()
    order = sorted((s for s in scale if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    sizes = [sum(r[2] for r in rows if r[1] == s) for s in order]
    for source, size, target in zip(order, sizes, plain_targets(sizes)):
        own = found[found["source"].isna() if source is None else found["source"] == source]
        assert (own["source_size"] == size).all()
        assert own["target"].iloc[0] == pytest.approx(target)
        taken = (own["size"] * own["copies"]).sum()
        assert taken <= target * (1 + 1e-6) + 1e-6 and taken >= target - max(30, 0.005 * target)
    again = mixing.mix(docs.repartition(3)).groupBy().agg(F.sum(F.xxhash64("doc_id", "source", "size", "copies").cast("decimal(38,0)"))).first()
    assert again[0] == mixed.groupBy().agg(F.sum(F.xxhash64("doc_id", "source", "size", "copies").cast("decimal(38,0)"))).first()[0]


def test_mix_of_nothing_and_of_blank_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", 0), (2, None, 0)], empty.schema)
    assert sorted(r.target for r in mixing.mix(blank).collect()) == [0.0, 0.0]
    texts = spark.createDataFrame([(None,), ("",), (" \t",), ("a b\u00a0c  d\n",)], "t string")
    assert [r[0] for r in texts.select(mixing.words(F.col("t"))).collect()] == [0, 0, 0, 3]


def test_hypergeometric_has_its_mean_spread_and_range():
    random = np.random.default_rng(0)
    for good, bad, draws in [(5, 7, 4), (1000, 23000, 500), (0, 9, 3), (9, 0, 3), (3 * 10**9, 7 * 10**10, 10**6)]:
        drawn = np.array([sharding.hypergeometric(good, bad, draws, random) for _ in range(2000)])
        total = good + bad
        mean = draws * good / total
        variance = mean * bad / total * (total - draws) / max(1, total - 1)
        assert drawn.min() >= max(0, draws - bad) and drawn.max() <= min(draws, good)
        assert abs(drawn.mean() - mean) <= 5 * (variance / 2000) ** 0.5
        assert drawn.var() == pytest.approx(variance, rel=0.2)


def test_matrix_sums():
    counts = [0, 17, 1000, 3, 250]
    rows = np.array(sharding.matrix(counts, 24, 1))
    assert rows.sum(axis=1).tolist() == counts
    assert np.ptp(rows.sum(axis=0)) <= 1
    assert sharding.matrix(counts, 24, 1) == rows.tolist()
    assert sharding.matrix([], 24, 1) == []


@pytest.mark.parametrize("slice_rows", [50_000, 8])
def test_shards_are_exact_and_shuffled(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(sharding, "SLICE", slice_rows)
    rows = [(None if i % 90 == 0 else i % 700, f"t{i % 3}", "old", i) for i in range(2005)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, block int").repartition(5, "block")
    found = sharding.shuffle(docs, ["doc_id", "text"], seed=7).toPandas()
    assert sorted(found["block"]) == list(range(2005))
    sizes = found.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert len(sizes) == 24 and sizes["count"].between(83, 84).all()
    assert (sizes["min"] == 0).all() and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    assert abs(np.corrcoef(found["block"], found["shard"])[0, 1]) < 0.1
    assert abs(np.corrcoef(found["block"], found["slot"])[0, 1]) < 0.1
    assert sharding.shuffle(docs.limit(0), ["doc_id"]).count() == 0


def test_tilts_solve_the_dual(spark):
    random = np.random.default_rng(3)
    sizes = [(s, int(size), int(docs)) for s in "abcd" for size, docs in zip(random.integers(1, 900, 30), random.integers(1, 9, 30))]
    total = {s: sum(n * d for t, n, d in sizes if t == s) for s in "abcd"}
    count = {s: sum(d for t, _, d in sizes if t == s) for s in "abcd"}
    share = {"a": 0.2, "b": 1.0, "c": 1.7, "d": 2.9}
    sources = spark.createDataFrame([(s, total[s], count[s], share[s] * total[s]) for s in "abcd"], "source string, source_size long, docs long, target double")
    found = mixing.tilts(sources, spark.createDataFrame(sizes, "source string, size long, docs long"))
    for row in found.collect():
        mean = total[row.source] / count[row.source]

        def taken(tilt):
            return sum(d * n * min(3.0, np.exp(min(50.0, tilt * n / mean))) for s, n, d in sizes if s == row.source)

        low, high = -1e6, 1e6
        for _ in range(200):  # the gradient of the dual rises with the tilt
            middle = (low + high) / 2
            low, high = (middle, high) if taken(middle) < row.target else (low, middle)
        assert abs(taken(row.tilt) - row.target) <= 1e-6 * row.target
        assert abs(row.tilt - low) <= 1e-4 * max(1, abs(low))
