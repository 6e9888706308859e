import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from commitloom.llm import counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LOWER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
TEXTS = [
    "one two two", "one two two", None, "", "  ", "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "x\n\n  y\t.z", "É日本 \u0085　don't!!", "w " * 3000 + "end", "A\r\nB", "a\nb",
]


def plain(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    model = Tokenizer.from_file(path)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def table(spark):
    rows = [(None if i == 3 else i % 9, t, 1, b"x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, digest binary").repartition(3)


@pytest.mark.parametrize("path", [PATH, LOWER, PIECES])
def test_counts_are_the_librarys(spark, path):
    count = plain(path)
    got = sorted(map(tuple, counts.token_counts(table(spark), path).collect()), key=str)
    want = [(None if i == 3 else i % 9, len((t or "").encode()), count(t or "")) for i, t in enumerate(TEXTS)]
    assert got == sorted(want, key=str)


def test_counts_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count = plain(PATH)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in counts.token_counts(docs, PATH).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), count(r.text)) for r in docs.collect()}


@pytest.mark.parametrize("small", [0, 1000])
def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(counts, "SMALL", small)
    cache = str(tmp_path / "cache")
    docs = table(spark)
    first = sorted(map(tuple, counts.token_counts(docs.filter("doc_id < 3"), PATH, cache).collect()))
    stored = spark.read.parquet(cache)
    texts = {t for i, t in enumerate(TEXTS) if i != 3 and i % 9 < 3}
    assert stored.count() == len({t or "" for t in texts}) and len(first) == docs.filter("doc_id < 3").count()
    # what is stored is taken, not encoded again: a marked count comes back
    marked = str(tmp_path / "marked")
    stored.withColumn("n_tokens", F.col("n_tokens") + 1000).write.partitionBy("tokenizer").parquet(marked)
    again = {(r.doc_id, r.n_bytes): r.n_tokens for r in counts.token_counts(docs, PATH, marked).collect()}
    count = plain(PATH)
    assert again == {(None if i == 3 else i % 9, len((t or "").encode())): count(t or "") + 1000 * ((t or "") in {x or "" for x in texts}) for i, t in enumerate(TEXTS)}
    assert spark.read.parquet(marked).count() == len({t or "" for t in TEXTS})
    before = spark.read.parquet(marked).inputFiles()
    counts.token_counts(docs, PATH, marked).collect()
    assert sorted(spark.read.parquet(marked).inputFiles()) == sorted(before)  # nothing missing, nothing written


def test_another_tokenizer_has_counts_of_its_own(spark, tmp_path):
    cache = str(tmp_path / "cache")
    one = counts.token_counts(table(spark), PATH, cache)
    two = counts.token_counts(table(spark), LOWER, cache)
    count = plain(LOWER)
    assert sorted(r.n_tokens for r in two.collect()) == sorted(count(t or "") for t in TEXTS)
    assert sorted(r.n_tokens for r in one.collect()) == sorted(plain(PATH)(t or "") for t in TEXTS)
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_counts_appended_twice_are_met_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    want = sorted(map(tuple, counts.token_counts(table(spark), PATH, cache).collect()), key=str)
    spark.read.parquet(cache).write.partitionBy("tokenizer").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert sorted(map(tuple, counts.token_counts(table(spark), PATH, cache).collect()), key=str) == want


def test_empty_table(spark):
    assert counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
