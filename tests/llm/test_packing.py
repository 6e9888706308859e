import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from commitloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
WORDS = packing.WordTokenizer(PATH)
ALPHABET = "ab Zé\n\t  .,!'s%1 \u0085　ß<|\"日-\x1c"


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=20), max_size=5))
def test_word_ids_are_the_ids_of_the_text(texts):
    assert [ids.tolist() for ids in WORDS.encode(texts)] == [plain(t) for t in texts]


def test_remembered_words_are_bounded_and_segments_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE", 7)
    monkeypatch.setattr(packing, "_SEGMENT", 11)
    tokenizer = packing.WordTokenizer(PATH)
    texts = ["the quick,  brown fox.\njumps over  the lazy dog's back!! " * 5, "", " x", "a\n\nb c'd <|endoftext|> e"]
    for _ in range(2):
        assert [ids.tolist() for ids in tokenizer.encode(texts)] == [plain(t) for t in texts]


@pytest.mark.parametrize("total, lengths", [(1, [1]), (2048, [2048]), (2049, [2048, 1]), (7, [4, 2, 1]), (6144, [2048] * 3)])
def test_binary_lengths(total, lengths):
    assert packing.binary_lengths(total) == lengths


def test_pieces_rebuild_every_document(spark, tmp_path):
    texts = ["word " * 3000 + "end", None, "", "  ", "one", "one", "x　y\n z", "é" * 5000]
    rows = [(i if i != 4 else None, t, 1, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string")
    pieces = packing.pack(docs, PATH).toPandas()
    assert pieces["sequence_id"].is_unique and (pieces["offset"] == 0).all()
    for (key, text, *_) in rows:
        own = pieces[pieces["doc_id"].isna() if key is None else pieces["doc_id"] == key].sort_values("start")
        want = np.array([*plain(text or ""), packing.END], "<u4")
        assert (own["start"] == [0, *np.cumsum(own["length"])[:-1]]).all()
        assert b"".join(own["ids"]) == want.tobytes()
        assert all(n & (n - 1) == 0 and n <= 2048 for n in own["length"])
        assert (own["doc_tokens"] == len(want)).all()
        assert [zlib.crc32(b) for b in own["ids"]] == own["ids_crc32"].tolist()
    bare = packing.pack(docs, PATH, with_ids=False).toPandas()
    assert bare["ids_crc32"].sort_values().tolist() == pieces["ids_crc32"].sort_values().tolist()
    packing.write_buckets(packing.pack(docs, PATH), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(pieces)


def test_empty_table_and_bad_context(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, PATH, context=1000)


def test_remembered_words_stay_few_and_those_met_again_are_kept(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE", 40)
    tokenizer = packing.WordTokenizer(PATH)
    learned = []
    monkeypatch.setattr(tokenizer, "_learn", lambda words, learn=tokenizer._learn: (learned.extend(words), learn(words)))
    for i in range(60):  # two common words, and two that no other text has, each with four endings
        text = f"the house wörd{i} näme{i}x wörd{i}, näme{i}x. the, house! näme{i}x%%% wörd{i}?"
        assert [ids.tolist() for ids in tokenizer.encode([text])] == [plain(text)]
        assert tokenizer.count([text]).tolist() == [len(plain(text))]
        assert len(tokenizer.words) <= 40
        assert tokenizer.lasting[1] <= 60  # the signs are few
    assert learned.count("house") == 1


def test_memory_of_a_worker_is_bounded():
    """What a worker remembers and the arrays of a segment, over 288 000 different words."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join("".join(w) + s for w, s in zip(letters[rng.integers(0, 26, (12_000, 7))], [",", "", ".", ""] * 3000)) for _ in range(24)]
    batch = pa.record_batch([pa.array(range(24)), pa.array(texts)], ["key", "text"])
    list(packing._pieces(PATH, 2048, True)(iter([batch.slice(0, 1)])))  # loads the tokenizer
    tracemalloc.start()
    try:
        made = sum(out.num_rows for out in packing._pieces(PATH, 2048, True)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        packing._TOKENIZERS.clear()
    assert made > 24 and peak < 80_000_000
