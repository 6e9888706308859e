"""Periodic runs of words: branching tandem repeats of an enhanced suffix array, rotated and merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6  # words
MIN_EXPONENT = 4  # times the period
_SEGMENT = 1_500_000  # characters whose suffixes are sorted at once
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1]))


def _group_starts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted values the place of the first equal one, and how many are equal."""
    at = _firsts(values)
    sizes = np.diff(np.append(at, len(values)))
    return np.repeat(at, sizes), np.repeat(sizes, sizes)


def suffix_levels(ids: np.ndarray, depth: int | None = None) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... ids, by prefix doubling; equal prefixes share the first place.

    The last level is the inverse suffix array, or ranks by ``depth`` ids (a power of two). Only suffixes that still share a rank are sorted again.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    start, size = _group_starts(ids[order])
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, active, ahead = [rank], order[size > 1], 1
    while len(active) and ahead != depth:
        after = active + ahead
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        keys = rank[active] * (n + 1) + second
        by = np.argsort(keys, kind="stable")
        active, keys = active[by], keys[by]
        old, _ = _group_starts(rank[active])
        new, size = _group_starts(keys)
        rank = rank.copy()
        rank[active] += new - old
        levels.append(rank)
        active, ahead = active[size > 1], 2 * ahead
    return levels


def _common(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many ids the suffixes at x and y (x != y) have in common."""
    n, length = len(levels[0]), np.zeros(len(x), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        a, b = x + length, y + length
        inside = np.maximum(a, b) < n
        same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        length += same.astype(np.int64) << k
    return length


def _common_before(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many ids in front of x equal those in front of y (x < y)."""
    length = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        a, b = x - length - (1 << k), y - length - (1 << k)
        inside = a >= 0
        same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        length += same.astype(np.int64) << k
    return length


def _bounds(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last rank of the LCP interval with the depth of each place: stretches of no smaller value."""
    low, widest = [lcp], int(np.diff(np.append(np.flatnonzero(np.append(lcp, 0) < 1), len(lcp))).max(initial=1))
    while 2 << (len(low) - 1) <= widest:
        half = 1 << (len(low) - 1)
        low.append(np.minimum(low[-1][:-half], low[-1][half:]))
    depth, left, right = lcp[at], at.copy(), at.copy()
    for k in range(len(low) - 1, -1, -1):
        step, table = 1 << k, low[k]
        start = left - step
        fits = start >= 0
        left -= step * (fits & (table[np.where(fits, start, 0)] >= depth))
        fits = right + step < len(lcp)
        right += step * (fits & (table[np.where(fits, right + 1, 0)] >= depth))
    return left - 1, right


def _squares(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the branching tandem repeats whose LCP interval has ``least`` suffixes or more.

    Of each interval the suffixes of all children but the largest look whether the suffix one depth
    after or before them lies in the interval too, in another child.
    """
    rank, n = levels[-1], len(levels[-1])
    nothing = np.zeros(0, np.int64)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    shared = 1 + np.flatnonzero(levels[0][suffix[1:]] == levels[0][suffix[:-1]])
    if not len(shared):
        return nothing, nothing
    lcp[shared] = _common(levels, suffix[shared - 1], suffix[shared])
    left, right = _bounds(lcp, shared)
    large = right - left + 1 >= least
    left, right, splits = left[large], right[large], shared[large]
    if not len(splits):
        return nothing, nothing
    by = np.lexsort((splits, right, left))
    left, right, splits = left[by], right[by], splits[by]
    first = _firsts(left * n + right)  # of the splits of an interval
    # children: from the interval's start, then from each split
    begin = np.insert(splits, first, left[first])
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(splits))) + 1)
    start = _firsts(of)
    size = np.append(begin[1:], 0) - begin
    size[np.append(start[1:], len(of)) - 1] = (right[first] + 1) - begin[np.append(start[1:], len(of)) - 1]
    largest = np.lexsort((-size, of))[start]
    smaller = np.ones(len(of), bool)
    smaller[largest] = False
    begin, size, of = begin[smaller], size[smaller], of[smaller]
    where = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    low, high, depth = (np.repeat(x[first][of], size) for x in (left, right, lcp[splits]))
    child, end = np.repeat(begin, size), np.repeat(begin + size, size)
    i = suffix[where]
    found = []
    for j, square in ((i + depth, i), (i - depth, i - depth)):
        fits = (j >= 0) & (j < n)
        r = rank[np.where(fits, j, 0)]
        fits &= (low <= r) & (r <= high) & ((r < child) | (r >= end))
        found.append((square[fits], depth[fits]))
    return tuple(np.concatenate(x) for x in zip(*found))


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period.

    A run is a maximal stretch with a smallest period p and a length of ``min_length`` and ``min_exponent`` (2 or more) x p or
    more. The last p words of a run are the common prefix of ``min_exponent`` of its suffixes, so smaller intervals hold none.
    """
    if not len(ids):
        return (np.zeros(0, np.int64),) * 3
    levels = suffix_levels(ids)
    place, period = _squares(levels, min_exponent)
    start = place - _common_before(levels, place, place + period)  # rotated to the left as far as it goes
    end = place + 2 * period
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    if len(start):  # squares of one run meet; multiples of its period go
        first = _firsts(start * (len(ids) + 1) + end)
        start, end, period = start[first], end[first], period[first]
    long = end - start >= np.maximum(min_length, min_exponent * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and their number in each."""
    cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words, counts = cut.flatten(), np.diff(cut.offsets.to_numpy())
    full = pc.not_equal(words, "")
    if pc.sum(full).as_py() not in (None, len(words)):  # white space at an end
        text = np.repeat(np.arange(len(counts)), counts)[full.to_numpy(zero_copy_only=False)]
        words, counts = words.filter(full), np.bincount(text, minlength=len(counts))
    return words, counts


def _judged(keys: pa.Array, texts: pa.Array, min_length: int, min_exponent: int) -> pa.RecordBatch:
    words, counts = _words(texts)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    codes = words.dictionary_encode()
    # words of different texts are different ids, so no suffix looks beyond its text
    ids = text * max(1, len(codes.dictionary)) + codes.indices.to_numpy()
    start, length, period = runs_of(ids, min_length, min_exponent)
    owner = text[start]
    edges = np.bincount(start + period, minlength=len(words) + 1) - np.bincount(start + length, minlength=len(words) + 1)
    kept = np.cumsum(edges)[: len(words)] == 0
    left = np.append(0, np.cumsum(np.bincount(text[kept], minlength=len(counts))))
    lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(kept)) if not kept.all() else words)
    found = pa.StructArray.from_arrays([pa.array(x) for x in (start - (ends - counts)[owner], length, period)], fields=list(_RUN))
    offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(counts)))).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(offsets), found)
    return pa.RecordBatch.from_arrays([keys, runs, pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())], ["key", "runs", "collapsed"])


def _search(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(texts):  # a text beyond the bound is searched by itself
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + _SEGMENT, "right")))
                yield _judged(keys.slice(start, stop - start), texts.slice(start, stop - start), min_length, min_exponent)
                start = stop

    return run


def find_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """(key, runs, collapsed) for every row of ``docs``.

    Words are runs of anything but space and \\t \\n \\v \\f \\r, numbered from 0. ``runs`` has (start, length, period) of
    every maximal stretch of words with a smallest period and a length of at least ``min_length`` words and ``min_exponent``
    periods, by start and period. ``collapsed`` is the text's words joined by one space, without those that any run holds
    after its first period.

    Null, empty and blank texts have no runs and collapse to ''. Null keys and repeated rows stay, each row judged by
    itself; other columns are not read. An empty table gives no rows. Row-local: no shuffle. A task sorts the suffixes
    of about 1.5 million characters at once, or of one longer text; memory and time grow with n log n of that.
    """
    if min_exponent < 2:
        raise ValueError("a run holds its period twice or more")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(_search(min_length, min_exponent), schema).withColumnRenamed("key", key)
