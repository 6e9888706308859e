"""Quality rules: fixed rules on text statistics, then gradient-boosted trees with monotonic constraints."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

WINDOW = 8  # words
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and whether a higher value may only lower (-1) or raise (1) the score.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_ratio": -1,
    "dup_line_ratio": -1,
    "repeat_ratio": -1,
    "upper_ratio": 0,
    "digit_ratio": 0,
    "alpha_ratio": 0,
    "end_punct_ratio": 0,
    "punct_ratio": 0,
    "bang_ratio": -1,
    "distinct_ratio": 0,
    "words_a_line": 0,
    "top_word_ratio": 0,
    "long_word_ratio": 0,
}
MAX_LABELLED = 20_000  # labelled documents the trees are fitted on
_PUNCT = ".,;:!?"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more in the text; exact, by ranks of doubled length."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    ranks = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        values, ranks = np.unique(pairs, return_inverse=True)
        width += step
        if len(values) == len(pairs):
            return 0
    starts = np.bincount(ranks)[ranks] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(starts), 1)
    np.add.at(marks, np.flatnonzero(starts) + window, -1)
    return int((np.cumsum(marks) > 0).sum())


def statistics(text: str | None) -> tuple:
    """BASE counts, then the FEATURES of a whole text; null is an empty text."""
    text = text or ""
    words = _WORD.findall(text)
    n_words, chars = len(words), len(text)
    word_chars = chars - sum(map(text.count, _SPACE))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    per = 1 / max(1, n_words)
    per_char = 1 / max(1, word_chars)
    letters = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    digits = int(((letters >= 48) & (letters <= 57)).sum())
    alpha = upper + int(((letters >= 97) & (letters <= 122)).sum()) + int((letters >= 192).sum())
    counts = Counter(words)
    features = (
        np.log1p(n_words),
        word_chars * per,
        n_symbols * per,
        n_dup / max(1, len(lines)),
        n_repeat * per,
        upper * per_char,
        digits * per_char,
        alpha * per_char,
        sum(line.rstrip()[-1] in ".!?" for line in lines) / max(1, len(lines)),
        sum(map(text.count, _PUNCT)) * per,
        text.count("!") * per,
        len(counts) * per,
        n_words / max(1, len(lines)),
        (max(counts.values()) if counts else 0) * per,
        sum(len(w) > 18 for w in words) * per,
    )
    return (n_words, word_chars, n_symbols, n_dup, n_repeat, *map(float, features))


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat > 30 * n_words)


@dataclass
class Forest:
    """Trees as flat arrays: node i goes on to left[i] if feature[i] <= threshold[i], else to left[i] + 1."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row, all trees and rows at once; leaves lead to themselves."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[at]] > self.threshold[at]
            at = self.left[at] + right
        return self.base + self.value[at].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 5.0) -> Forest:
    """Boosted trees on the log loss; histogram splits; a monotonic feature never splits against its sign.

    A split on a constrained feature bounds the leaves on either side by the middle of its two
    values, so the whole score is monotonic. One class only, or no rows, gives a constant.
    """
    rate_up = (y.sum() + 1) / (len(y) + 2)
    forest = Forest(float(np.log(rate_up / (1 - rate_up))), *(np.zeros(0, t) for t in (int, int, float, int, float)), depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T] if len(y) else []
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1) if len(y) else None
    roots, feature, threshold, left, value = [], [], [], [], []

    def new() -> int:
        feature.append(0), threshold.append(np.inf), left.append(len(feature) - 1), value.append(0.0)
        return len(feature) - 1

    score = np.full(len(y), forest.base)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        roots.append(new())
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            here = float(np.clip(g / (h + ridge), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for f in range(x.shape[1]):
                    size = len(cuts[f]) + 1
                    b = binned[rows, f]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], None))
                    with np.errstate(all="ignore"):
                        a, c = np.clip(gs / (hs + ridge), low, high), np.clip((g - gs) / (h - hs + ridge), low, high)
                    gain = a * gs - a * a * (hs + ridge) / 2 + c * (g - gs) - c * c * (h - hs + ridge) / 2 - (here * g - here * here * (h + ridge) / 2)
                    fair = (ns >= least) & (len(rows) - ns >= least) & ((c - a) * signs[f] >= 0)
                    if fair.any() and (top := np.where(fair, gain, -1).argmax()) is not None and gain[top] > best[0]:
                        best = (gain[top], (f, int(top), float(a[top]), float(c[top])))
            if best[1] is None:
                value[node] = rate * here
                score[rows] += rate * here
                continue
            f, cut, a, c = best[1]
            lo, hi = new(), new()
            feature[node], threshold[node], left[node] = f, float(cuts[f][cut]), lo
            goes = binned[rows, f] <= cut
            middle = (a + c) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
            todo += [(lo, rows[goes], level + 1, *bounds[0]), (hi, rows[~goes], level + 1, *bounds[1])]
    ids = (np.array(a, t) for a, t in ((roots, int), (feature, int), (threshold, float), (left, int), (value, float)))
    forest.roots, forest.feature, forest.threshold, forest.left, forest.value = ids
    # a leaf leads to itself: its threshold is infinite
    return forest


def _table(texts, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=[*BASE, *FEATURES])[columns]


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_LABELLED
) -> Forest:
    """Trees fitted on at most ``limit`` labelled documents, taken by a hash of the key.

    Those that fail the base rules are left out: the trees judge the others. Null keys and labels
    other than 0 and 1 are left out, of repeated labels the lowest counts, of repeated documents the text with the least hash
    that passes the base rules. Without labels, or with
    one kind of label only, the trees are a constant. The driver gets the numbers of these
    documents, not their texts.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).filter("key is not null and y in (0, 1)")
    drawn = known.groupBy("key").agg(F.min("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(limit)
    # at most limit keys and numbers: broadcast, so that no text is shuffled
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), "key")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _table(batch["text"], ["n_words", "n_repeat_words", *FEATURES])
            order = np.fromiter((xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]), np.uint64, len(batch))
            yield found.assign(y=batch["y"].to_numpy(), key=batch["key"].to_numpy(), order=order.view(np.int64))

    kind = rows.schema["key"].dataType.simpleString()
    columns = ["n_words", "n_repeat_words", *FEATURES, "y"]
    measured = rows.mapInPandas(measure, "n_words long, n_repeat_words long, " + ", ".join(f"{c} double" for c in [*FEATURES, "y"]) + f", key {kind}, order long")
    fair = measured.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    one = fair.groupBy("key").agg(F.min(F.struct("order", *columns)).alias("row")).select("row.*")  # of a repeated key one text, by its hash
    table = one.select(*FEATURES, "y").orderBy(*FEATURES, "y").toPandas()  # at most limit rows
    return fit(table[[*FEATURES]].to_numpy(float), table["y"].to_numpy(float), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, forest: Forest, text: str = "text", cut: float = 0.0) -> DataFrame:
    """``docs`` with the base counts, score (log odds), base_failed and kept.

    base_failed: fewer than 20 words, or over 30% of the words in repeated windows. kept: the base
    rules pass and the score is at least ``cut``; the score can only fall with symbols, repeated lines, repeated
    words and exclamation marks. Whole texts are read; null, empty and blank ones have no words and fail.
    Repeated rows and null keys stay; columns with the names of results are replaced. Row-local, no
    shuffle; an empty table gives no rows.
    """
    kind = T.StructType([*(T.StructField(c, T.LongType()) for c in BASE), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            table = _table(batch, [*BASE, *FEATURES])
            yield table[[*BASE]].assign(score=forest.score(table[[*FEATURES]].to_numpy(float)))

    out = docs.withColumn("__found", found(F.col(f"`{text}`")))
    out = out.withColumns({c: F.col(f"__found.{c}") for c in (*BASE, "score")}).drop("__found")
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= cut))
