"""Ranked lexical search: the best documents of each item, by a search over two hierarchies at once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

TOP = 50
BLOCK = 2_000  # items searched together
TERMS = 50_000  # distinct terms of the items searched together; a longer item is a block of its own
SEED = 64  # one document in so many is searched first, for lower bounds of the k-th scores
_LEAF = 16  # documents of a leaf
_FAN = 8  # children of a node, of both hierarchies
_CELLS = 1 << 22  # leaves x terms of a hierarchy of documents
_DOCS = 4096  # its documents at most
#: Bytes that are no part of a term become spaces, A-Z lower case.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order, with repeats, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Items:
    """A block of items: their vocabulary, and for each the places of its terms in it."""

    def __init__(self, texts: list[str | None]):
        each = [sorted(set(terms_of(t))) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set(chain.from_iterable(each))))}
        self.terms = [np.array([self.vocabulary[t] for t in ts], np.int64) for ts in each]

    def hierarchy(self, weights: np.ndarray) -> tuple:
        """A tree over the items that have terms: (items, terms, children) nodes. An item's coordinates are 0 or 1, so maxima are
        unions of terms. Items with the same heaviest term are side by side."""
        with_terms = [i for i, t in enumerate(self.terms) if len(t)]
        with_terms.sort(key=lambda i: (-weights[self.terms[i]].max(), self.terms[i][weights[self.terms[i]].argmax()], i))
        nodes = [(np.array([i]), self.terms[i], ()) for i in with_terms]
        while len(nodes) > 1:
            groups = [tuple(nodes[i : i + _FAN]) for i in range(0, len(nodes), _FAN)]
            nodes = [(np.concatenate([n[0] for n in g]), np.unique(np.concatenate([n[1] for n in g])), g) for g in groups]
        return nodes[0] if nodes else ()


def _vectors(vocabulary: dict[bytes, int]):
    """(key, text) batches to the number of terms, the places of terms known to the items, and their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places, times, offsets = [], [], [], [0]
            for text in batch.column(1):
                found = terms_of(text.as_py())
                counts = Counter(found)
                known = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                sizes.append(len(found))
                places.extend(p for p, _ in known)
                times.extend(c for _, c in known)
                offsets.append(len(places))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (places, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["key", "size", "terms", "times"])

    return run


class Documents:
    """A hierarchy over some documents: leaves of a few, nodes of a few below, each with the maxima of its coordinates.

    Coordinates are what a term adds to a score. Documents with the same heaviest term are side by side.
    """

    def __init__(self, values: np.ndarray, terms: np.ndarray, counts: np.ndarray, width: int):
        owner = np.repeat(np.arange(len(counts)), counts)
        heaviest = np.lexsort((-values, owner))[np.cumsum(counts) - counts]
        self.order = np.lexsort((-values[heaviest], terms[heaviest]))
        place = np.empty(len(counts), np.int64)
        place[self.order] = np.arange(len(counts))
        by = np.argsort(place[owner], kind="stable")
        self.owner, self.terms, self.values = place[owner][by], terms[by], values[by]
        self.ends = np.cumsum(counts[self.order])
        leaves = -(-len(counts) // _LEAF)
        maxima = np.zeros((leaves, width), np.int64)
        np.maximum.at(maxima, (self.owner // _LEAF, self.terms), self.values)
        self.levels = [maxima]  # from the leaves up
        while len(maxima) > 1:
            full = np.concatenate([maxima, np.zeros((-len(maxima) % _FAN, width), np.int64)])
            maxima = full.reshape(-1, _FAN, width).max(axis=1)
            self.levels.append(maxima)

    def bounds(self, level: int, nodes: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """No document below a node scores more with any subset of these terms."""
        return self.levels[level][np.ix_(nodes, terms)].sum(axis=1)

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        found = (nodes[:, None] * _FAN + np.arange(_FAN)).ravel()
        return found[found < len(self.levels[level - 1])]

    def scores(self, leaves: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents of some leaves; ``wanted`` marks the item's terms."""
        first = leaves * _LEAF
        last = np.minimum(first + _LEAF, len(self.ends))
        begin, end = np.where(first > 0, self.ends[first - 1], 0), self.ends[last - 1]
        sizes = end - begin
        entries = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        entries = entries[wanted[self.terms[entries]]]
        places, at = np.unique(self.owner[entries], return_inverse=True)
        total = np.zeros(len(places), np.int64)
        np.add.at(total, at, self.values[entries])
        return places, total


class Best:
    """The highest-scoring documents of each item so far; equal scores by key, null keys last."""

    def __init__(self, items: int, top: int, least: np.ndarray):
        self.top, self.least = top, least.copy()  # no lower score can be among an item's best
        self.scores = [np.zeros(0, np.int64) for _ in range(items)]
        self.keys: list[list] = [[] for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, keys: list) -> None:
        scores, keys = np.append(self.scores[item], scores), [*self.keys[item], *keys]
        if len(scores) > self.top:
            kth = np.partition(scores, len(scores) - self.top)[len(scores) - self.top]
            kept = np.flatnonzero(scores > kth).tolist()
            ties = sorted(np.flatnonzero(scores == kth).tolist(), key=lambda i: (keys[i] is None, keys[i]))
            kept += ties[: self.top - len(kept)]
            scores, keys = scores[kept], [keys[i] for i in kept]
        self.scores[item], self.keys[item] = scores, keys
        if len(scores) == self.top:
            self.least[item] = max(self.least[item], scores.min())


def dual_search(root: tuple, docs: Documents, keys: list, best: Best) -> int:
    """Adds what ``docs`` has to each item's best; how many scores were computed.

    Pairs of an item node and a document node go on only if their bound reaches the weakest k-th score of
    the node's items. A bound that equals it goes on, since the key decides between equal scores.
    """
    looked = 0
    wanted = np.zeros(docs.levels[0].shape[1], bool)

    def fitting(node: tuple, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = docs.bounds(level, nodes, node[1])
        fits = bounds >= max(1, best.least[node[0]].min())
        return nodes[fits], bounds[fits]

    def visit(node: tuple, level: int, nodes: np.ndarray) -> None:
        nonlocal looked
        nodes, bounds = fitting(node, level, nodes)
        if not len(nodes):
            return
        if level:  # the documents' side goes down first, then the items'
            level -= 1
            nodes, bounds = fitting(node, level, docs.below(level + 1, nodes))
        if node[2]:
            for child in node[2]:
                visit(child, level, nodes)
            return
        if level:
            visit(node, level, nodes)
            return
        item, terms, _ = node
        item = int(item[0])
        wanted[terms] = True
        by = np.argsort(-bounds, kind="stable")
        nodes, bounds, step = nodes[by], bounds[by], 4
        while len(nodes) and bounds[0] >= max(1, best.least[item]):
            places, scores = docs.scores(nodes[:step], wanted)
            looked += len(places)
            high = scores >= max(1, best.least[item])
            if high.any():
                best.add(item, scores[high], [keys[i] for i in docs.order[places[high]]])
            nodes, bounds, step = nodes[step:], bounds[step:], 2 * step
        wanted[terms] = False

    top = len(docs.levels) - 1
    visit(root, top, np.arange(len(docs.levels[top])))
    return looked


def _search(block: Items, weights: np.ndarray, documents: int, length: int, top: int, least: np.ndarray):
    """Batches of vectors to (item, key, score) rows: the best of a task's documents for each item of the block."""
    root = block.hierarchy(weights)
    count = max(_LEAF, min(_DOCS, _CELLS // max(1, len(weights)) * _LEAF))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(len(block.terms), top, least), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for start in range(0, len(batch), count):
                some = batch.slice(start, count)
                sizes = some.column(1).to_numpy()
                terms, times = some.column(2).flatten().to_numpy(), some.column(3).flatten().to_numpy().astype(np.int64)
                counts = some.column(2).value_lengths().to_numpy().astype(np.int64)
                full = counts > 0
                if not full.any():
                    continue
                m = 50 + 50 * sizes * documents // length
                values = weights[terms] * (1_000_000_000 * times // (1000 * times + 20 * np.repeat(m, counts)))
                keys = some.column(0).filter(pa.array(full)).to_pylist()
                dual_search(root, Documents(values, terms.astype(np.int64), counts[full], len(weights)), keys, best)
        if kind is not None:
            items = np.repeat(np.arange(len(best.keys)), [len(k) for k in best.keys]).astype(np.int32)
            scores = np.concatenate(best.scores) if best.scores else np.zeros(0, np.int64)
            keys = pa.array(list(chain.from_iterable(best.keys)), kind)
            yield pa.RecordBatch.from_arrays([pa.array(items), keys, pa.array(scores)], ["item", "key", "score"])

    return run


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list]:
    """The items in blocks of bounded number and vocabulary; the driver holds one block."""
    block, terms = [], set()
    for row in items.select(F.col(key).alias("key"), F.col(text).alias("text")).toLocalIterator():
        own = set(terms_of(row["text"]))
        if block and (len(block) == BLOCK or len(terms | own) > TERMS):
            yield block
            block, terms = [], set()
        block.append(row)
        terms |= own
    if block:
        yield block


def _best_of(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _ranked(docs: DataFrame, block: list, top: int) -> DataFrame:
    """(item, rank, key, score) of one block of items."""
    texts = Items([row["text"] for row in block])
    kind = docs.schema["key"].dataType.simpleString()
    vectors = docs.mapInArrow(_vectors(texts.vocabulary), f"key {kind}, size long, terms array<int>, times array<int>")
    vectors = scratch.stored(vectors.filter("size > 0"))
    documents, length = vectors.agg(F.count("*"), F.sum("size")).first()
    weights = np.full(len(texts.vocabulary), weight(documents, 0), np.int64)
    for term, holding in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = weight(documents, holding)

    def search(rows: DataFrame, least: np.ndarray) -> DataFrame:
        job = _search(texts, weights, documents, length or 1, top, least)
        return _best_of(rows.mapInArrow(job, f"item int, key {kind}, score long"), top)

    least = np.zeros(len(block), np.int64)
    some = search(vectors.filter(F.pmod(F.xxhash64("key", "size", "terms"), F.lit(SEED)) == 0), least)
    for item, score in some.filter(F.col("rank") == top).select("item", "score").collect():
        least[item] = score
    return search(vectors, least)


def rank(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_key, rank, key, score) of the ``top`` documents with the highest scores above 0 for each row of ``items``.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. A term's weight falls
    with the documents that hold it; a score sums, over the item's terms once each, weight times saturated
    occurrences, less in longer documents; all in integers. Equal scores rank by ascending key, null keys last.

    Items are a stated query set. The driver holds them in blocks of ``BLOCK`` items and ``TERMS`` distinct terms; for each
    block the documents are read once, as vectors over the block's terms, and searched map-only: every task builds a
    hierarchy over some thousand documents at a time and walks it together with that of the items, exactly. One
    document in ``SEED`` is searched before, only for lower bounds of the k-th scores; these save work and
    change no result. A task hands on ``top`` rows an item at most.

    Null texts have no terms, in documents and items; such items and such that no document scores for have no rows. Repeated
    rows of documents are documents of their own, repeated items are ranked each by itself. Other columns are not read. Empty tables give no
    rows. Keys are of a type that Python and Spark order alike: numbers, strings, dates.
    """
    spark = docs.sparkSession
    names = {f.name: f.dataType.simpleString() for f in items.schema}
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = spark.createDataFrame([], f"`{item_key}` {names[item_key]}, rank int, `{key}` {kind}, score long")
    for block in _blocks(items, item_key, item_text):
        numbered = spark.createDataFrame([(i, row["key"]) for i, row in enumerate(block)], f"item int, item_key {names[item_key]}")
        best = _ranked(rows, block, top).join(F.broadcast(numbered), "item")  # a block at most
        found = found.union(best.select("item_key", "rank", "key", "score"))
    return found


#: The same ranking of ``documents`` for ``benchmark``, all pairs with a term in common.
SQL = r"""
WITH folded AS (
    SELECT row_number() OVER () AS doc, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), docs AS (SELECT doc, doc_id, terms, len(terms) AS n FROM folded WHERE len(terms) > 0
), totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs
), wanted AS (
    SELECT DISTINCT item, item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
), times AS (
    SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) GROUP BY doc, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM times, totals GROUP BY term, big_n
), scores AS (
    SELECT item, item_id, doc_id, doc,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
    FROM wanted JOIN times USING (term) JOIN weights USING (term) JOIN docs USING (doc), totals
    GROUP BY item, item_id, doc_id, doc
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
