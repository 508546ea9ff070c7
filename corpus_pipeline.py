"""From raw documents to token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again for the next. All but the
last return the columns of ``documents``, whatever these are.

=========================  ====================================================
quality                    documents scored under ``QUALITY_AT`` go
near duplicates            one document of each group stays (5 words, 0.8)
decontamination            documents that hold a benchmark item's template go
mixing                     token budgets by domain, language and source
token files                encoded and written in doc_id order; one row per
                           document: doc_id, start, n_tokens, ids_crc32
=========================  ====================================================

Rows with a null doc_id pass the second and third stage untouched; repeated
rows end in the second; documents without a word end in the fourth, for there
is nothing to draw from them. No documents: no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortfold.llm import mixing, near_dup, quality, queries, templates, token_files
from cohortfold.llm.shared import Scratch

QUALITY_AT = queries.QUALITY_AT
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: Tokens that the mix takes, of those there are; nothing is taken twice.
MIX_BUDGET = (9, 10)
MIX_SEED = 7


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model, QUALITY_AT)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_dup.find_groups(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    stay = _without(docs, groups.filter("NOT kept"))
    return stay.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, templates.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(docs, queries.mix_levels(), queries.MIX_WEIGHTS, MIX_BUDGET, max_epochs=1, seed=MIX_SEED)
    return mix.apply(docs)


def token_table(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("corpus_tokens")
    token_files.write_tokens(docs, path, queries.tokenizer_file())
    return token_files.checksums(spark, path)


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("mixing sources to target weights", mixed_documents),
    ("token-ID output", token_table),
]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage_{k}")
        if k:
            scratch.drop(f"stage_{k - 1}")
    return docs
