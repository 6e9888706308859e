import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitloom.functions import arrays as A
from commitloom.functions.text import present


def one(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} array<int>" for n in names))


def packed(spark, a, b, size):
    df = one(spark, a=a, b=b)
    return df.select(A.pack_pair(F.col("a"), F.col("b"), size).alias("x")).first()["x"]


def test_pack_pair_pads(spark):
    x = packed(spark, [11, 12], [8, 13], 10)
    assert x["input_ids"] == [0, 11, 12, 2, 2, 8, 13, 2, 1, 1]
    assert x["attention_mask"] == [1] * 8 + [0, 0]
    assert x["special_tokens_mask"] == [1, 0, 0, 1, 1, 0, 0, 1, 1, 1]


def test_pack_pair_cuts_the_patch_only(spark):
    x = packed(spark, list(range(11, 21)), [8, 9], 9)
    assert x["input_ids"] == [0, 11, 12, 13, 2, 2, 8, 9, 2]
    assert x["attention_mask"] == [1] * 9


@pytest.mark.parametrize(
    "a, b, fits", [([], [8, 9], True), ([11], [8, 9], False), ([11], [8, 9, 10], False), ([11], [8], True)]
)
def test_pack_pair_refuses_a_long_message(spark, a, b, fits):
    assert (packed(spark, a, b, 6) is not None) == fits


def labelled(spark, ids, special):
    df = one(spark, ids=ids, special=special).withColumn("span", A.message_span(F.col("ids")))
    y = A.message_labels(F.col("ids"), F.col("special"), F.col("span"))
    return df.withColumn("y", y).first()


def test_message_labels_exclude_the_marker(spark):
    ids = [0, 11, 2, 2, 8, 13, 14, 2, 1]
    row = labelled(spark, ids, [1, 0, 1, 1, 0, 0, 0, 1, 1])
    assert tuple(row["span"]) == (5, 7)
    assert row["y"]["labels"] == [-100] * 5 + [13, 14] + [-100] * 2
    assert row["y"]["special_tokens_mask"] == [1, 1, 1, 1, 1, 0, 0, 1, 1]


def test_message_labels_without_message(spark):
    row = labelled(spark, [0, 2, 2, 2, 1], [1, 1, 1, 1, 1])
    assert row["y"]["labels"] == [-100] * 5
    assert row["y"]["special_tokens_mask"] == [1] * 5


def test_message_span_needs_three_separators(spark):
    assert labelled(spark, [0, 2, 2, 5], [1, 1, 1, 0])["span"] is None


def test_pack_seq2seq(spark):
    df = one(spark, a=[11, 12, 13, 14], b=[21])
    x = df.select(A.pack_seq2seq(F.col("a"), F.col("b"), 5, 4).alias("x")).first()["x"]
    assert x["input_ids"] == [0, 11, 12, 13, 2]
    assert x["attention_mask"] == [1] * 5
    assert x["labels"] == [0, 21, 2, -100]


def test_mlm_mask_shares(spark):
    """Half of the free positions are chosen; of these 80/10/10 masked, random, kept."""
    n, per_row = 200, 200
    df = spark.range(n).select(
        "id",
        F.array_repeat(F.lit(7), per_row).alias("ids"),
        F.transform(F.sequence(F.lit(1), F.lit(per_row)), lambda i: (i % 4 == 0).cast("int")).alias("special"),
    )
    noise = A.mlm_mask(F.col("ids"), F.col("special"), F.col("id"), 1000, seed="1")
    rows = df.select("special", noise.alias("z")).collect()
    special = np.array([r["special"] for r in rows])
    inputs = np.array([r["z"]["input_ids"] for r in rows])
    labels = np.array([r["z"]["labels"] for r in rows])
    chosen = labels != -100
    assert not chosen[special == 1].any()
    assert (inputs[~chosen] == 7).all() and (labels[chosen] == 7).all()
    assert abs(chosen[special == 0].mean() - 0.5) < 0.02
    assert abs((inputs[chosen] == A.MASK).mean() - 0.8) < 0.02
    assert abs((inputs[chosen] == 7).mean() - 0.1) < 0.02
    assert inputs.min() >= 0 and inputs.max() < 1000
    again = df.select(noise.alias("z")).collect()
    assert [r["z"] for r in again] == [r["z"] for r in rows]
    other = A.mlm_mask(F.col("ids"), F.col("special"), F.col("id"), 1000, seed="1", epoch=1)
    assert [r["z"] for r in df.select(other.alias("z")).collect()] != [r["z"] for r in rows]


def test_mask_one_stays_in_the_span(spark):
    df = spark.range(500).select(
        "id",
        F.sequence(F.lit(100), F.lit(119)).alias("ids"),
        F.struct(F.lit(5).alias("start"), (5 + F.col("id") % 4).cast("int").alias("end")).alias("span"),
    )
    rows = df.select("id", present(A.mask_one(F.col("ids"), F.col("span"), F.col("id")))).collect()
    assert len(rows) == 375  # an empty span goes
    for row in rows:
        assert 5 <= row["position"] < 5 + row["id"] % 4
        assert row["answer"] == 100 + row["position"]
        want = list(range(100, 120))
        want[row["position"]] = A.MASK
        assert row["input_ids"] == want
    assert {r["position"] for r in rows if r["id"] % 4 == 3} == {5, 6, 7}


def test_mask_one_word(values):
    got = values(["add a parser", "  ", "x"], "string", lambda m: A.mask_one_word(m, F.lit("k")))
    assert got[0].split().count("<mask>") == 1 and len(got[0].split()) == 3
    assert got[1:] == [None, "<mask>"]


def test_argmax(values):
    logits = [[1.0, 3.0, 3.0], [2.0], [-1.0, -2.0], [0.0, float("nan"), 9.0]]
    assert values(logits, "array<float>", A.argmax_ids) == [1, 0, 0, 1]


def covered(array, sequence):
    n = len(sequence)
    starts = [i for i in range(len(array) - n + 1) if n and array[i : i + n] == sequence]
    return sorted({p for i in starts for p in range(i, i + n)})


def test_subsequence_positions(spark):
    draw = random.Random(3)
    rows = [([1, 1, 1, 2], [1, 1]), ([], [1]), ([1], [1, 2]), ([1, 2], [])]
    rows += [
        ([draw.randint(0, 2) for _ in range(draw.randint(0, 12))], [draw.randint(0, 2) for _ in range(draw.randint(0, 3))])
        for _ in range(300)
    ]
    df = spark.createDataFrame(rows, "a array<int>, s array<int>")
    got = df.select("a", "s", A.subsequence_positions(F.col("a"), F.col("s")).alias("p")).collect()
    assert all(r["p"] == covered(r["a"], r["s"]) for r in got)
