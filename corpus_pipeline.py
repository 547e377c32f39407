"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the
shared folder and reads again as the next stage's docs. All but the last return the columns
of ``documents``; repeated rows that mixing makes stay as rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from docketloom.llm.common import stage
from docketloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that score under the threshold."""
    scored = toxicity.score(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays."""
    kept = exact_dedup.deduplicate(docs, keep="largest").where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_text"))
    rows = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_text")), "left_semi")
    return rows.dropDuplicates(["doc_id", "sha"]).select(*COLUMNS)  # repeated rows


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; documents without words link with nothing and stay.

    Rows that share a doc_id (or have none) stay or go together.
    """
    groups = ngram_join.near_duplicates(docs, num=75, den=100, shingle=5)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents towards the target weights of their sources."""
    return mixing.mix(docs.select(*COLUMNS), temperature=0.7, epochs=1.0, seed=29).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, checked by decoding them."""
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None
"""SQL can't express the toxicity model; tests hold each stage against a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
