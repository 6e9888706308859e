"""Packing without padding: documents cut into pieces of power-of-two length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 2048
END = 1  # id that ends every document
_CACHE = 250_000  # words whose ids a worker remembers; then it forgets those met in one call only
_SEGMENT = 1_000_000  # characters tokenized at once
_JOINED = 2000  # new words tokenized in one call
_SIGNS = ".,;:!?%$#&*<>|()[]{}+-=/_~^@\""  # not the apostrophe, which may start a unit
_TOKENIZERS: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of whole texts from a byte-level BPE file, with remembered words.

    The pre-tokenizer of such files starts a new unit at a space or line break between two
    characters that are not white space. So texts are cut there, each distinct word is tokenized once,
    and the ids are strung together by index arrays. A text with other white space is tokenized as a whole.
    A word that ends in signs is remembered without them: its ids are put together for a call and dropped after it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        (self.newline,) = self._whole("\n")
        self.space = self.model.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]  # as the model sees it
        self._empty()

    def _empty(self) -> None:
        """Empties the memory: places of known words, the calls that met them, and their ids one after the other."""
        self.words: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.met = np.zeros(1 << 12, np.int32)
        self.pool, self.used, self.known = np.zeros(1 << 14, "<u4"), 0, 0
        self.lasting = 0, 0  # ids and words that stay after a call

    def _forget(self) -> None:
        """Keeps the words met in more than one call since the last time, those met most if they fill half the memory."""
        met = self.met[: self.known]
        again = np.flatnonzero(met > 1)
        kept = np.zeros(self.known, bool)
        kept[again[np.argsort(-met[again], kind="stable")[: _CACHE // 2]]] = True
        kept = kept.tolist()
        words = {w: place for w, place in self.words.items() if kept[place]}
        places = np.fromiter(words.values(), np.int64, len(words))
        lengths = self.lengths[places].astype(np.int64)
        sizes = np.maximum(lengths, 0)
        ids = self._gathered(self.starts[places], sizes)
        self._empty()
        self._remember(list(words), ids, np.cumsum(sizes) - sizes, lengths, self.words)
        self.met[: self.known] = 1
        self.lasting = self.used, self.known

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.dtype("<u4"))

    def _put(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> range:
        """Places of new words; starts are places in ``ids``. Length -1: texts with the word are tokenized as a whole."""
        while self.known + len(starts) > len(self.starts):
            self.starts, self.lengths, self.met = (np.append(x, np.zeros_like(x)) for x in (self.starts, self.lengths, self.met))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        at = slice(self.known, self.known + len(starts))
        self.starts[at], self.lengths[at] = starts + self.used, lengths
        self.pool[self.used : self.used + len(ids)] = ids
        self.known += len(starts)
        self.used += len(ids)
        return range(at.start, at.stop)

    def _remember(self, names: list[str], ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, into: dict) -> None:
        """Keeps the ids of many words."""
        into.update(zip(names, self._put(ids, starts, lengths)))

    def _remember_each(self, names: list[str], ids: list[list[int]], into: dict) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._remember(names, np.fromiter(chain.from_iterable(ids), "<u4", lengths.sum()), np.cumsum(lengths) - lengths, lengths, into)

    def _remember_joined(self, names: list[str], joined: str, led: bool) -> None:
        """Keeps words that were tokenized as one text, each one led by or with line breaks between them."""
        ids = self._whole(joined)
        cuts = np.flatnonzero(ids == self.newline)
        starts, ends = (cuts, np.append(cuts[1:], len(ids))) if led else (np.append(0, cuts + 1), np.append(cuts, len(ids)))
        if len(starts) != len(names):
            raise ValueError("the tokenizer does not start a unit at each line break")
        self._remember(names, ids, starts, ends - starts, self.words)

    def _gathered(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of these stretches of memory, one after the other."""
        before = np.cumsum(lengths) - lengths
        return self.pool[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of new words; a word keeps its line break, or gets its space, in front."""
        units, plain, led, odd = [], [], [], []
        for word in words:
            if word.isascii() and word.isalpha():  # a unit with its space
                units.append(word)
                continue
            core = word[1:] if word[:1] == "\n" else word
            if core and not core[0].isspace() and not core[-1].isspace():
                (led if word[0] == "\n" else plain).append(word)
            else:
                odd.append(word)
        tokenize, space = self.model.model.tokenize, self.space
        self._remember_each(units, [[t.id for t in tokenize(space + w)] for w in units], self.words)
        for i in range(0, len(plain), _JOINED):
            some = plain[i : i + _JOINED]
            self._remember_joined(some, "\n".join([" " + w for w in some]), False)
        for i in range(0, len(led), _JOINED):
            some = led[i : i + _JOINED]
            self._remember_joined(some, "".join(some), True)
        nothing = np.zeros(len(odd), np.int64)
        self._remember(odd, np.zeros(0, "<u4"), nothing, nothing - 1, self.words)

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the ids of these distinct words stand, until the next call."""
        self.used, self.known = self.lasting
        cores, tails, tailed = [w.rstrip(_SIGNS) for w in words], [], []
        for i in [i for i, (core, word) in enumerate(zip(cores, words)) if len(core) < len(word)]:
            if cores[i][-1:].isalpha():  # signs after a letter are a unit of their own
                tails.append(words[i][len(cores[i]) :])
                tailed.append(i)
            else:
                cores[i] = words[i]
        distinct = dict.fromkeys(cores)
        new = [w for w in distinct if w not in self.words]
        if self.known + len(new) > _CACHE:
            self._forget()
            new = [w for w in distinct if w not in self.words]
        self._learn(new)
        signs = [t for t in dict.fromkeys(tails) if t not in self.tails]
        self._remember_each(signs, [self._whole(t).tolist() for t in signs], self.tails)
        self.lasting = self.used, self.known
        places = np.fromiter(map(self.words.__getitem__, cores), np.int64, len(cores))
        self.met[places] += 1  # once for each place
        pairs = np.column_stack([places[tailed], np.fromiter(map(self.tails.__getitem__, tails), np.int64, len(tails))])
        sizes = self.lengths[pairs].astype(np.int64)
        unknown = sizes[:, 0] < 0
        sizes[unknown] = 0
        total = sizes.sum(axis=1)
        ids = self._gathered(self.starts[pairs].ravel(), sizes.ravel())
        places[tailed] = self._put(ids, np.cumsum(total) - total, np.where(unknown, -1, total))
        return places

    def _parts(self, text: str) -> Iterator[str]:
        """The text in segments of bounded length, cut in front of a space between two words."""
        start = 0
        while len(text) - start > _SEGMENT:
            cut = text.find(" ", start + _SEGMENT)
            while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def _cut(self, texts: list[str]) -> tuple:
        """(parts, text of each part, is it the text's first, place of each word in memory, words of each part)."""
        parts, owner, first = [], [], []
        for n, text in enumerate(texts):
            for i, part in enumerate(self._parts(text) if len(text) > _SEGMENT else (text,)):
                parts.append(part)
                owner.append(n)
                first.append(i == 0)
        # A first part gets a line break in front: no space there. Others start with the space that was cut.
        led = ["\n" + p.replace("\n", " \n") if f else p[1:].replace("\n", " \n") for p, f in zip(parts, first)]
        cut = pc.split_pattern(pa.array(led, pa.large_string()), " ")
        words = cut.flatten().dictionary_encode()
        seen = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = self._places(seen)
        return parts, np.array(owner, np.int64), np.array(first, bool), places[words.indices.to_numpy()], np.diff(cut.offsets.to_numpy())

    def _sizes(self, places: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, and of each part; -1 for parts that are tokenized as a whole."""
        lengths = self.lengths[places].astype(np.int64)
        begin = np.cumsum(words) - words
        total = np.add.reduceat(lengths, begin) - first
        total[np.logical_or.reduceat(lengths < 0, begin)] = -1
        return lengths, total

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text; call it with texts of bounded total length."""
        if not texts:
            return np.zeros(0, np.int64)
        parts, owner, first, places, words = self._cut(texts)
        _, total = self._sizes(places, words, first)
        for i in np.flatnonzero(total < 0):
            total[i] = len(self._whole(parts[i]))
        return np.bincount(owner, total, len(texts)).astype(np.int64)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their number in each text."""
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        parts, owner, first, places, words = self._cut(texts)
        lengths, total = self._sizes(places, words, first)
        odd = np.flatnonzero(total < 0)
        whole = {i: self._whole(parts[i]) for i in odd}
        lengths[np.repeat(total < 0, words)] = 0
        starts = self.starts[places]
        lead = (np.cumsum(words) - words)[first & (total >= 0)]  # the id of the line break in front goes
        starts[lead] += 1
        lengths[lead] -= 1
        ids = self._gathered(starts, lengths)
        if len(odd):
            total[odd] = 0
            ends = np.append(0, np.cumsum(total))
            total[odd] = [len(whole[i]) for i in odd]
            pieces, at = [], 0
            for i in odd:
                pieces += [ids[at : ends[i]], whole[i]]
                at = ends[i]
            ids = np.concatenate([*pieces, ids[at:]])
        return ids, np.bincount(owner, total, len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; call it with texts of bounded total length."""
        ids, counts = self.flat(texts)
        ends = np.cumsum(counts)
        return [ids[end - n : end] for n, end in zip(counts, ends)]


def binary_lengths(total: int, context: int = CONTEXT) -> list[int]:
    """Whole contexts, then the powers of two that make up the rest, largest first."""
    whole, rest = divmod(total, context)
    return [context] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_lengths(totals: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of every piece of documents with these numbers of ids, in order; as ``binary_lengths``."""
    bits = 1 << np.arange(context.bit_length() - 2, -1, -1)
    times = np.column_stack([totals // context, (totals[:, None] & bits[None, :]) > 0]).astype(np.int64)
    lengths = np.tile(np.append(context, bits), len(totals))
    return np.repeat(np.repeat(np.arange(len(totals)), len(bits) + 1), times.ravel()), np.repeat(lengths, times.ravel())


def _pieces(path: str, context: int, with_ids: bool):
    def rows(keys: pa.Array, texts: list[str], tokenizer: WordTokenizer) -> pa.RecordBatch:
        bare, counts = tokenizer.flat(texts)
        totals = counts + 1
        ends = np.cumsum(totals)
        ids = np.full(ends[-1], END, "<u4")
        ids[np.repeat(np.arange(len(texts)), counts) + np.arange(len(bare))] = bare
        doc, length = cut_lengths(totals, context)
        at = np.cumsum(length) - length
        data = memoryview(ids).cast("B")
        crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist())]
        columns = [keys.take(pa.array(doc)), at - (ends - totals)[doc], length, np.array(crc, np.int64), totals[doc]]
        names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            columns.append(pa.array([bytes(data[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist())], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordTokenizer(path))
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(texts):  # runs of texts of about a segment; a longer text is a run of its own
                base = size[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(size, base + _SEGMENT, "right")))
                yield rows(keys.slice(start, stop - start), texts.slice(start, stop - start).to_pylist(), tokenizer)
                start = stop

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", context: int = CONTEXT, with_ids: bool = True) -> DataFrame:
    """A row per piece of every document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is its token ids and the id 1. It is cut into whole contexts and the powers of two
    that make up the rest. So every piece is a sequence of its own at a power of two: nothing is
    padded, no sequence crosses documents, and sequences of a length are a bucket to batch
    from (``write_buckets``). ``context`` must be a power of two. ``tokenizer`` is the path of a
    byte-level BPE file that every executor can read; special tokens in a text are ordinary text. ids
    are little-endian unsigned 32-bit numbers; ``with_ids=False`` leaves them out.

    Null and empty texts are one piece of one id. Null keys and repeated rows stay, each row packed by
    itself; other columns are not read. An empty table gives no rows. Row-local: no shuffle; a worker
    holds about a million characters and a bounded word memory.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context is a power of two")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = rows.mapInArrow(_pieces(tokenizer, context, with_ids), schema).withColumnRenamed("key", key)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per sequence length, to draw batches of equal lengths from."""
    pieces.write.partitionBy("length").parquet(path)
