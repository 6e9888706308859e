"""Languages of documents as mixtures: expectation-maximisation over character n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 13  # hashed n-grams of one to three characters
MAX_A_LANGUAGE = 20_000  # training documents of a language, taken by a hash of the key
UNKNOWN = "und"
_STEPS = 30  # of expectation-maximisation
_LEAST = 0.05  # share of a language in a set
_PENALTY = 3.0  # log likelihood per language and log n-gram; overlapping n-grams count up to three times
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PART = 1 << 20  # characters counted at once
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without any letter.

    Letters are lower-cased, everything else is one blank; n-grams reach over word ends.
    """
    total = None
    text = text or ""
    for start in range(0, len(text), _PART):
        part = text[start : start + _PART].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[codes]
        if not is_letter.any():
            continue
        codes = np.where(is_letter, codes, 32).astype(np.uint64)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        codes = np.concatenate([[np.uint64(32)], codes[keep], [np.uint64(32)]]).astype(np.uint64)
        one = codes[codes != 32]
        two = codes[:-1] * np.uint64(0x110000) + codes[1:] + np.uint64(1 << 43)
        three = two[:-1] * np.uint64(0x110000) + codes[2:]
        hashed = (np.concatenate([one, two, three]) * _MIX) >> np.uint64(64 - SLOTS.bit_length() + 1)
        counts = np.bincount(hashed.astype(np.int64), minlength=SLOTS)
        total = counts if total is None else total + counts
    return total


@dataclass
class Languages:
    """Names in alphabetical order and their n-gram chances."""

    names: list[str]
    chances: np.ndarray

    def _mixture(self, chances: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the given languages that make the n-grams likeliest, and the log likelihood."""
        share = np.full(len(chances), 1 / len(chances))
        total = counts.sum()
        mixed = share @ chances
        for _ in range(_STEPS if len(chances) > 1 else 0):
            new = share * (chances @ (counts / mixed)) / total
            mixed = new @ chances
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-3:
                break
        return share, float(counts @ np.log(mixed))

    def predict(self, counts: np.ndarray | None) -> tuple[str, float, list[tuple[str, float]]]:
        """The main language, a score and the languages with their shares.

        Languages join the set in order of their share in the mixture of all, as long as each raises
        the log likelihood by more than the penalty. The score is the main language's share times its
        weight against the languages left out.
        """
        if counts is None or not self.names:
            return UNKNOWN, 0.0, []
        seen = np.flatnonzero(counts)
        counts = counts[seen].astype(float)
        chances = self.chances[:, seen]
        alone = np.log(chances) @ counts
        share, _ = self._mixture(chances, counts)
        best = int(alone.argmax())
        chosen, shares, likely = [best], np.ones(1), float(alone[best])
        penalty = _PENALTY * np.log(counts.sum() + 1)
        for other in np.argsort(-share, kind="stable"):
            if share[other] < _LEAST:
                break
            if other == best:
                continue
            new_shares, new_likely = self._mixture(chances[[*chosen, other]], counts)
            if new_likely - likely <= penalty or new_shares.min() < _LEAST:
                break
            chosen, shares, likely = [*chosen, int(other)], new_shares, new_likely
        out = np.delete(alone, chosen)
        weight = 1 / (1 + np.exp(np.clip((out - alone[best]) / _PENALTY, -700, 0)).sum())
        order = np.lexsort((chosen, -shares))
        found = [(self.names[chosen[i]], float(shares[i])) for i in order]
        return found[0][0], float(min(1.0, found[0][1] * weight)), found


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """N-gram counts of each language, one sum per partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if (counts := grams(text)) is not None:
                sums[lang] = sums.get(lang, 0) + counts
    for lang, counts in sums.items():
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "slot": seen, "n": counts[seen]})


def learn(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = MAX_A_LANGUAGE) -> Languages:
    """N-gram chances per language from labelled rows: about ``limit`` of each, all if there are fewer.

    Rows are taken by a hash of the key, so that reruns agree. The driver gets languages x SLOTS numbers.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Languages([], np.zeros((0, SLOTS)))
    draw = F.shiftrightunsigned(F.xxhash64("key"), 11).cast("double") / float(1 << 53)
    for name, size in sizes.items():
        if size > limit:
            rows = rows.filter((F.col("lang") != name) | (draw < limit / size))
    counted = rows.select("lang", "text").mapInPandas(_count, "lang string, slot int, n long")
    sums = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sums["lang"].unique())
    counts = np.full((len(names), SLOTS), 0.5)
    counts[sums["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int), sums["slot"].to_numpy(int)] += sums["n"].to_numpy(float)
    return Languages(names, counts / counts.sum(axis=1, keepdims=True))


def held_out(key: Column) -> Column:
    """Documents kept from training: crc32 of the key as text is 2 modulo 4; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and languages (array of lang and share, largest first).

    Whole texts are read. Null texts and texts without a letter are ``und`` with score 0 and no languages, and so
    is every text if nothing was learned. Equal likelihoods go to the first name. Repeated rows and
    null keys stay; other columns are kept, ones with the names of results are replaced. Row-local, no shuffle.
    """
    from pyspark.sql import types as T

    kind = T.StructType(
        [
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))),
        ]
    )

    @F.pandas_udf(kind)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [model.predict(grams(t)) for t in batch]
            yield pd.DataFrame(
                {
                    "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                    "languages": [[{"lang": n, "share": s} for n, s in f[2]] for f in found],
                }
            )

    found = docs.withColumn("__found", predict(F.col(f"`{text}`")))
    return found.withColumns({c: F.col(f"__found.{c}") for c in ("lang_pred", "score", "languages")}).drop("__found")
