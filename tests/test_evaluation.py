import math
import random
import re
from collections import Counter

import pytest

from commitloom.operators import evaluation as E

SCHEMA = "model string, main_lang string, file_count int, prediction string, reference string"


def pairs(spark, rows):
    return spark.createDataFrame([("m", "Go", 1, p, r) for p, r in rows], SCHEMA)


def brute_bleu(rows, smooth):
    """Corpus BLEU over whitespace tokens, straight from its definition."""
    matches, possible, len_p, len_r = [0] * 4, [0] * 4, 0, 0
    for prediction, reference in rows:
        p, r = prediction.split(), reference.split()
        len_p, len_r = len_p + len(p), len_r + len(r)
        for n in range(1, 5):
            grams = [Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (p, r)]
            matches[n - 1] += sum((grams[0] & grams[1]).values())
            possible[n - 1] += max(len(p) - n + 1, 0)
    if len_p == 0:
        return 0.0
    add = 1 if smooth else 0
    precisions = [(m + add) / (t + add) if t + add else 0.0 for m, t in zip(matches, possible)]
    if min(precisions) == 0:
        return 0.0
    penalty = 1.0 if len_p > len_r else math.exp(1 - len_r / len_p)
    return round(100 * penalty * math.exp(sum(map(math.log, precisions)) / 4), 2)


def test_golden_bleu(spark):
    df = pairs(spark, [("add parser for json", "add parser for yaml"), ("fix bug", "fix the bug")])
    row = E.corpus_bleu(df, plain=True).first()
    assert [row[f"m{n}"] for n in range(1, 5)] == [5, 2, 1, 0]
    assert [row[f"t{n}"] for n in range(1, 5)] == [6, 4, 2, 1]
    assert (row["len_p"], row["len_r"], row["bleu"]) == (6, 7, 54.47)


@pytest.mark.parametrize("smooth", [True, False])
def test_bleu_agrees_with_brute_force(spark, smooth):
    draw = random.Random(2)
    words = "add the a parser fix bug".split()
    rows = [
        (" ".join(draw.choices(words, k=draw.randint(0, 9))), " ".join(draw.choices(words, k=draw.randint(1, 9))))
        for _ in range(200)
    ]
    got = E.corpus_bleu(pairs(spark, rows), smooth=smooth, plain=True).first()["bleu"]
    assert got == brute_bleu(rows, smooth)


def test_bleu_edges(spark):
    assert E.corpus_bleu(pairs(spark, [("", "a b")])).first()["bleu"] == 0.0
    assert E.corpus_bleu(pairs(spark, [("a b", "")])).first()["bleu"] is None
    assert E.corpus_bleu(pairs(spark, [("a", "b")]), smooth=False).first()["bleu"] == 0.0
    assert E.corpus_bleu(pairs(spark, [("a b c d e", "a b c d e")])).first()["bleu"] == 100.0


def test_13a_tokens(values):
    from commitloom.functions.bleu import bleu_tokens

    got = values(
        ["Fix x.y, 3.5 (a-b) 1-2 &amp; c!", "end-\nof line", "a. b"], "string", bleu_tokens
    )
    assert got == [
        ["Fix", "x", ".", "y", ",", "3.5", "(", "a-b", ")", "1", "-", "2", "&", "c", "!"],
        ["endof", "line"],
        ["a", ".", "b"],
    ]


def tokens_13a(text):
    """The tokenizer rules as published, one substitution after the other."""
    for found, put in (("<skipped>", ""), ("-\n", ""), ("\n", " ")):
        text = text.replace(found, put)
    for found, put in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(found, put)
    text = f" {text} "
    for pattern, put in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        text = re.sub(pattern, put, text)
    return text.split()


def test_13a_agrees_on_noise(values):
    from commitloom.functions.bleu import bleu_tokens

    draw = random.Random(8)
    alphabet = list("..,,..55--ab \n&;é(/'\"") + ["&amp;", "<skipped>", "-\n"]
    noise = ["".join(draw.choices(alphabet, k=draw.randint(0, 25))) for _ in range(4000)]
    assert values(noise, "string", bleu_tokens) == [tokens_13a(text) for text in noise]


def test_bleu_report(spark):
    rows = [
        ("m", "Go", 1, "add a parser now", "add a parser"),
        ("m", "Go", 3, "fix it", "fix the bug"),
        ("m", "Text", 2, "x y", "x z"),
        ("k", "Java", 2, "a b c", "a b c"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    report = {(r["model"], r["input"]): r for r in E.bleu_report(df, plain=True).collect()}
    assert set(report) == {("m", "Multi File"), ("m", "Single File"), ("k", "Multi File")}
    m = report["m", "Multi File"]
    assert m["Overall"] == brute_bleu([r[3:] for r in rows[:3]], True)  # with the Text row
    assert m["Go"] == brute_bleu([r[3:] for r in rows[:2]], True)
    assert m["Java"] is None
    single = report["m", "Single File"]
    assert single["Overall"] == single["Go"] == brute_bleu([rows[0][3:]], True)


def test_accuracy(spark):
    rows = [
        ("m", "Go", [1, 2, 3], [1, -100, 4]),
        ("m", "Java", [5], [5]),
        ("m", "Text", [6], [-100]),
        ("m", "Ruby", [1], [-100]),
    ]
    df = spark.createDataFrame(rows, "model string, main_lang string, predictions array<int>, labels array<int>")
    total = E.masked_accuracy(df).first()
    assert (total["correct"], total["labelled"]) == (2, 3)
    report = E.accuracy_report(df).first()
    assert report["Overall"] == pytest.approx(2 / 3)
    assert (report["Go"], report["Java"], report["Ruby"], report["PHP"]) == (0.5, 1.0, None, None)


def test_missing_predictions_are_wrong_and_null_texts_end_nothing(spark):
    rows = [([1], [1, 1]), (None, [2, -100]), ([3, 4], [3]), ([5], None)]
    df = spark.createDataFrame(rows, "predictions array<int>, labels array<int>")
    row = E.masked_accuracy(df).first()
    assert (row.correct, row.labelled) == (2, 4)
    pairs = [("a b", "a b"), (None, "a b"), ("a b", None)]
    texts = spark.createDataFrame(pairs, "prediction string, reference string")
    same = spark.createDataFrame([("a b", "a b"), ("", "a b")], texts.schema)
    assert E.corpus_bleu(texts).collect() == E.corpus_bleu(same).collect()


def test_common_ngrams_equal_counted_tuples():
    import random
    from collections import Counter

    from commitloom.functions.bleu import MAX_ORDER, common_ngrams

    draw = random.Random(4)
    for _ in range(400):
        p, r = ([draw.choice("abcé") for _ in range(draw.randrange(12))] for _ in range(2))
        grams = [[Counter(zip(*(t[i:] for i in range(n)))) for t in (p, r)] for n in range(1, MAX_ORDER + 1)]
        assert common_ngrams(p, r) == [sum((a & b).values()) for a, b in grams]
