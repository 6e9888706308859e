"""A training corpus made of ``documents``: judged, identified, without near copies, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.llm import catalog, languages, mixing, packing, quality, simhash
from commitloom.sources import scratch

LEAST_SCORE = 0.3  # of the main language


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the trees, learned from ``labels``."""
    names = docs.columns
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = docs.select(F.struct(*(f"`{c}`" for c in names)).alias("doc"), F.col("text").alias("text"))
    return quality.judge(held, forest).filter("kept").select("doc.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a known main language; learned from all whose language is given."""
    model = languages.learn(docs)
    held = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("doc"), F.col("text").alias("text"))
    found = languages.identify(held, model)
    return found.filter((F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; links by the fingerprints of ``op1``."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    held = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("doc"), "doc_id", "source", mixing.words(F.col("text")).alias("size"))
    mixed = mixing.mix(held).filter("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of all documents, each of a power of two."""
    return packing.pack(docs, catalog.tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: The trees, the mixtures and the fingerprints have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
