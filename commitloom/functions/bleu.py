"""BLEU tokens, per-pair match counts and the final formula."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import words

MAX_ORDER = 4

# Entities and punctuation rules of the 13a tokenizer, in order. The first
# class leaves out the blank: more blanks never change the words. The second rule, "a dot
# or comma after a non-digit", takes a following mark along, as the pairwise consumption of
# that rule does. Single characters and a rule begun at the mark halve the time.
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
PUNCTUATION_RULES = (
    (r'([{|}~\[\\\]^_`!"#$%&()*+:;<=>?@/])', " $1 "),
    (r"(?<![0-9])([.,])([.,]?)", " $1 $2"),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def bleu_text(text: Column) -> Column:
    """Text with blanks around the punctuation that 13a makes words of its own."""
    for found, put in (("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES):
        text = F.replace(text, F.lit(found), F.lit(put))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, put in PUNCTUATION_RULES:
        text = F.regexp_replace(text, pattern, put)
    return text


def bleu_tokens(text: Column, plain: bool = False) -> Column:
    """Tokens of a text: punctuation split off as 13a does, or plain whitespace words."""
    return words(text if plain else bleu_text(text))


def possible_matches(length: Column, order: int) -> Column:
    return F.greatest(length - (order - 1), F.lit(0))


def bleu_score(
    matches: list[Column],
    possible: list[Column],
    prediction_length: Column,
    reference_length: Column,
    smooth: bool = True,
) -> Column:
    """Corpus BLEU x 100, to two places, from summed counts.

    0 without predicted tokens or with a zero precision; null without reference tokens.
    """
    one = F.lit(1.0)
    if smooth:
        precisions = [(m + one) / (t + one) for m, t in zip(matches, possible)]
    else:
        precisions = [F.when(t > 0, m / t).otherwise(F.lit(0.0)) for m, t in zip(matches, possible)]
    logs = [F.ln(p) for p in precisions]
    mean = reduce(lambda a, b: a + b, logs) / F.lit(float(len(logs)))
    penalty = F.when(prediction_length > reference_length, one).otherwise(
        F.exp(one - reference_length / F.nullif(prediction_length, F.lit(0)))
    )
    score = F.when((prediction_length == 0) | (F.least(*precisions) == 0), F.lit(0.0)).otherwise(
        penalty * F.exp(mean)
    )
    return F.when(reference_length > 0, F.round(score * 100, 2))


def common_ngrams(prediction: list[str], reference: list[str]) -> list[int]:
    """For each order the n-grams of the prediction also in the reference, counted at most as often as there.

    An n-gram is a number: of its first n-1 words' number and its last word's. The numbers of both
    texts are made dense again at each order, so they never outgrow the square of the tokens.
    """
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    cut = len(prediction)
    every = np.fromiter(map(numbers.__getitem__, prediction + reference), np.int64, cut + len(reference))
    size, found = len(numbers), []
    words_p, words_r = grams_p, grams_r = every[:cut], every[cut:]
    kinds = size
    for n in range(MAX_ORDER):
        if n:
            pairs = (grams_p[:-1] * size + words_p[n:], grams_r[:-1] * size + words_r[n:])
            distinct, dense = np.unique(np.concatenate(pairs), return_inverse=True)
            cut, kinds = len(pairs[0]), len(distinct)
            grams_p, grams_r = dense[:cut], dense[cut:]
        clipped = np.minimum(np.bincount(grams_p, minlength=kinds), np.bincount(grams_r, minlength=kinds))
        found.append(int(clipped.sum()))
    return found


def match_counts(prediction: Column, reference: Column) -> Column:
    """struct<m1..m4, len_p, len_r> of two texts whose words are their tokens.

    A null prediction is an empty one; a null reference has null counts, which no sum
    includes. A match is an n-gram of the prediction also in the reference, counted at most as
    often as there. The counting stays in the row: as rows of their own, the n-grams to
    shuffle would be many times the text. Memory is bounded by one pair.
    """
    orders = range(1, MAX_ORDER + 1)
    names = [*(f"m{n}" for n in orders), "len_p", "len_r"]
    schema = T.StructType([T.StructField(name, T.LongType()) for name in names])

    @F.pandas_udf(schema)
    def count(predictions: pd.Series, references: pd.Series) -> pd.DataFrame:
        rows = [
            [*common_ngrams(p, r), len(p), len(r)]
            for p, r in zip(predictions.map(str.split), references.map(str.split))
        ]
        return pd.DataFrame(rows, columns=names, dtype="int64")

    counted = count(F.coalesce(prediction, F.lit("")), F.coalesce(reference, F.lit("")))
    return F.when(reference.isNotNull(), counted)
