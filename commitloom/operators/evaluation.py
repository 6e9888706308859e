"""Scores of predictions: corpus BLEU and masked-token accuracy, overall and per language.

Both are sums of per-row counts, so each report is one scan, one small aggregation
and a pivot over a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bleu as B
from ..functions.arrays import IGNORED
from ..functions.text import bind

# Report columns.
REPORT_LANGUAGES = ("Java", "Go", "PHP", "Javascript", "Ruby", "Python")
OVERALL = "Overall"
MULTI_FILE, SINGLE_FILE = "Multi File", "Single File"

_ORDERS = range(1, B.MAX_ORDER + 1)
BLEU_COUNTS = [f"m{n}" for n in _ORDERS] + [f"t{n}" for n in _ORDERS] + ["len_p", "len_r"]


def bleu_counts(pairs: DataFrame, keep: list[str], plain: bool = False) -> DataFrame:
    """Per pair: clipped matches, possible matches and lengths, next to the ``keep`` columns."""
    prediction, reference = F.col("prediction"), F.col("reference")
    if not plain:
        prediction, reference = B.bleu_text(prediction), B.bleu_text(reference)
    counted = pairs.select(*keep, B.match_counts(prediction, reference).alias("c"))
    return counted.select(
        *keep,
        "c.*",
        *[B.possible_matches(F.col("c.len_p"), n).alias(f"t{n}") for n in _ORDERS],
    )


def sum_counts(counts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def bleu_from_counts(smooth: bool = True) -> Column:
    return B.bleu_score(
        [F.col(f"m{n}") for n in _ORDERS],
        [F.col(f"t{n}") for n in _ORDERS],
        F.col("len_p"),
        F.col("len_r"),
        smooth,
    )


def corpus_bleu(
    pairs: DataFrame, keys: list[str] | None = None, smooth: bool = True, plain: bool = False
) -> DataFrame:
    """Corpus BLEU of (prediction, reference) pairs per group of ``keys``."""
    keys = keys or []
    totals = sum_counts(bleu_counts(pairs, keys, plain), keys, BLEU_COUNTS)
    return totals.withColumn("bleu", bleu_from_counts(smooth))


def _report(totals: DataFrame, keys: list[str], columns: list[str], score: Column) -> DataFrame:
    """Pivot (keys, main_lang) totals to one row per key: overall and the report languages."""
    sets = [[*keys], [*keys, "main_lang"]]
    grouped = totals.groupingSets(sets, *keys, "main_lang").agg(
        *[F.sum(c).alias(c) for c in columns],
        F.grouping("main_lang").alias("is_total"),
    )
    column = F.when(F.col("is_total") == 1, F.lit(OVERALL)).otherwise(F.col("main_lang"))
    return (
        grouped.select(*keys, column.alias("column"), score.alias("score"))
        .groupBy(*keys)
        .pivot("column", [OVERALL, *REPORT_LANGUAGES])
        .agg(F.first("score"))
    )


def bleu_report(pairs: DataFrame, smooth: bool = True, plain: bool = False) -> DataFrame:
    """BLEU per (model, input): 'Multi File' counts all pairs, 'Single File' one-file commits.

    ``pairs`` holds model, main_lang, file_count, prediction, reference. Pair counts
    are summed first; the two inputs and the overall column only re-add those few sums.
    """
    keys = ["model", "main_lang", "single"]
    flagged = pairs.withColumn("single", F.col("file_count") == 1)
    base = sum_counts(bleu_counts(flagged, keys, plain), keys, BLEU_COUNTS)
    inputs = F.when(
        F.col("single"), F.array(F.lit(MULTI_FILE), F.lit(SINGLE_FILE))
    ).otherwise(F.array(F.lit(MULTI_FILE)))
    tagged = base.withColumn("input", F.explode(inputs))
    return _report(tagged, ["model", "input"], BLEU_COUNTS, bleu_from_counts(smooth))


def hits(predictions: Column, labels: Column) -> Column:
    """struct<correct, labelled> over the positions that carry a label.

    A labelled position without a prediction is wrong; predictions beyond the labels count for nothing.
    """
    given = F.coalesce(predictions, F.array().cast("array<int>"))
    right = F.zip_with(given, labels, lambda p, l: F.when(l != IGNORED, F.coalesce(p == l, F.lit(False))))
    return bind(
        F.array_compact(right),
        lambda kept: F.struct(
            F.size(F.array_remove(kept, False)).cast("bigint").alias("correct"),
            F.size(kept).cast("bigint").alias("labelled"),
        ),
    )


def _accuracy() -> Column:
    return F.col("correct") / F.nullif(F.col("labelled"), F.lit(0))


def masked_accuracy(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of labelled positions predicted right, pooled over all rows of a group."""
    keys = keys or []
    counted = df.select(*keys, hits(F.col("predictions"), F.col("labels")).alias("h"))
    totals = sum_counts(counted.select(*keys, "h.*"), keys, ["correct", "labelled"])
    return totals.withColumn("accuracy", _accuracy())


def accuracy_report(df: DataFrame) -> DataFrame:
    """Accuracy per model, overall and per report language.

    ``df`` holds model, main_lang, predictions and labels (int arrays).
    """
    keys = ["model", "main_lang"]
    counted = df.select(*keys, hits(F.col("predictions"), F.col("labels")).alias("h"))
    totals = sum_counts(counted.select(*keys, "h.*"), keys, ["correct", "labelled"])
    return _report(totals, ["model"], ["correct", "labelled"], _accuracy())
