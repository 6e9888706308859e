"""The operators of this package as queries over the given tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bind
from . import counts, embeddings, html, languages, licenses, mixing, packing, quality, ranked, runs, sharding, simhash, urls


TOKEN_LIMIT = 512  # of op13


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", languages.held_out(F.col("doc_id")))
    model = languages.learn(docs.filter("not held_out"))
    found = languages.identify(docs.select("doc_id", "held_out", "text"), model)
    mixture = F.array_join(F.transform("languages", lambda x: x["lang"]), ",").alias("mixture")
    return found.select("doc_id", "held_out", "lang_pred", "score", mixture)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    ids, names = (F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licences"))
    return found.select("doc_id", ids, names, "restricted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train(docs, _table(spark, sf_dir, "labels"))
    judged = quality.judge(docs, forest)
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "score")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    dealt = sharding.shuffle(rows, ["doc_id", "size", "text_crc32"])
    return dealt.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def _partly_periodic(doc_id: Column, text: Column) -> Column:
    """The text; for a tenth of the documents its words from one on are replaced by repeats of the first of these."""
    code = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(code / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        unit = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(unit), F.lit(1), n - a)), " ")

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.when(code % 10 == 0, bind(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _partly_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.find_runs(docs)
    no_run = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    longer = lambda best, run: best["period"].isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    best = F.reduce("runs", no_run, lambda best, run: F.when(longer(best, run), run).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    report = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(report, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_dedup,
        op2_embedding_dedup,
        op3_mix_sources,
        op4_extract_html,
        op5_language_id,
        op6_url_filter,
        op7_pack,
        op8_license_scan,
        op9_quality_rules,
        op10_shard,
        op11_periodic_runs,
        op12_ranked_search,
        op13_token_counts,
    )
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": licenses.scan_sql(), "op12_ranked_search": ranked.SQL}
