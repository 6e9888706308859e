"""Token counts of documents, encoded once per distinct text and kept in a cache of digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from .packing import WordTokenizer

CACHE = "tokenizer string, digest binary, n_tokens long"
#: Digests that are broadcast at most; 32 bytes each.
SMALL = 1_000_000
_SEGMENT = 1_000_000  # characters counted at once
_COUNTERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def version(path: str) -> str:
    """Digest of a tokenizer: its file and the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        content = file.read()
    return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + content).hexdigest()


def _is_byte_level(form: dict) -> bool:
    """Whether texts can be cut at single spaces and line breaks, as ``WordTokenizer`` does."""
    cut, model = form.get("pre_tokenizer") or {}, form.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    added = form.get("added_tokens") or []
    return plain and not form.get("normalizer") and not model.get("dropout") and all(x["special"] and not x["lstrip"] and not x["rstrip"] for x in added)


def _counter(path: str) -> Callable[[list[str]], np.ndarray]:
    """Counts of texts as the library gives them, without begin, end or added tokens, cut or padding."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(x) for x in pieces.encode(texts, num_threads=1)], np.int64)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    with open(path, encoding="utf-8") as file:
        form = json.load(file)

    def whole(text: str) -> int:
        return len(model.encode(text, add_special_tokens=False).ids)

    if not _is_byte_level(form):
        return lambda texts: np.array([whole(t) for t in texts], np.int64)
    words = WordTokenizer(path)
    special = [x["content"] for x in form.get("added_tokens") or []]

    def count(texts: list[str]) -> np.ndarray:
        found = words.count(texts)
        for i, text in enumerate(texts):
            if any(s in text for s in special):  # one token each, as is the library's default
                found[i] = whole(text)
        return found

    return count


def _encode(path: str):
    """(digest, text) batches to (digest, n_tokens); texts of a batch are counted in runs of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _COUNTERS.get(path) or _COUNTERS.setdefault(path, _counter(path))
        for batch in batches:
            digests, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(texts):
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + _SEGMENT, "right")))
                found = count(texts.slice(start, stop - start).to_pylist())
                yield pa.RecordBatch.from_arrays([digests.slice(start, stop - start), pa.array(found)], ["digest", "n_tokens"])
                start = stop

    return run


def digest(content: Column) -> Column:
    """32 bytes that stand for a content."""
    return F.unhex(F.sha2(content, 256))


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts under ``path``; an empty cache is made where there is none."""
    empty = spark.createDataFrame([], CACHE)
    empty.write.mode("ignore").partitionBy("tokenizer").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def _known(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer, once each: runs side by side may have appended the same."""
    stored = open_cache(spark, cache).filter(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_missing(contents: DataFrame, wanted: DataFrame, tokenizer: str, cache: str) -> None:
    """Encodes the texts of ``contents`` (digest, text) whose digest is not in the cache, once each; ``wanted`` has their digests.

    Each task keeps one text of a digest, so copies are met before the exchange however many there are. A cache that has
    nothing of this tokenizer needs no comparison. Else what is missing is written first: a small part (``SMALL``
    digests at most) is broadcast and only its texts move; beyond that digests are compared where the texts are.
    """
    spark = contents.sparkSession
    name = version(tokenizer)
    known = _known(spark, cache, name)
    one = F.first("text").alias("text")
    if known.isEmpty():
        texts = contents.groupBy("digest").agg(one)
    else:
        missing = scratch.stored(wanted.select("digest").distinct().join(known, "digest", "left_anti"))
        many = missing.count()
        if not many:
            return
        if many <= SMALL:
            texts = contents.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(one)
        else:
            texts = contents.groupBy("digest").agg(one).join(missing.hint("merge"), "digest", "left_semi")
    found = texts.select("digest", "text").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    found.withColumn("tokenizer", F.lit(name)).write.mode("append").partitionBy("tokenizer").parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for every row of ``docs``.

    Counts are those of the library that reads ``tokenizer`` (tokenizers for .json, sentencepiece for .model; a
    path that every executor can read): nothing added at the begin or end, special strings in texts by the
    library's default, no cut, no padding. They are kept in the table ``cache`` under the digests of the tokenizer and of the
    content; only distinct contents it does not have are encoded, and appended to it. Without ``cache`` it is a
    new table in the shared folder. A changed tokenizer file or library version has another digest, so
    its counts are encoded anew and old ones stay. The content is normalised by what changes no count: null is the empty
    text, and nothing else, since these tokenizers see every byte.

    Repeated rows, null and repeated keys keep a row each; other columns are not read. An empty table gives no
    rows. A lost executor repeats its tasks; an append that fails leaves no rows. Texts move once, one copy
    from each task; all other exchanges carry digests.
    """
    spark = docs.sparkSession
    cache = cache or scratch.new_folder(spark)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.octet_length(content).cast("long").alias("n_bytes"), digest(content).alias("digest"))
    rows = scratch.stored(rows)
    append_missing(docs.select(digest(content).alias("digest"), content.alias("text")), rows, tokenizer, cache)
    # written, so that the join has an exchange on each side and a digest with many rows can be split
    known = scratch.stored(rows.select("digest").distinct().join(_known(spark, cache, version(tokenizer)), "digest"))
    return rows.join(known, "digest").select(F.col("id").alias(key), "n_bytes", "n_tokens")
