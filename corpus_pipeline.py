"""Corpus cleaning in five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir), and its result is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakepress.llm import bpe, decontaminate, ngram_join, pii, shared, toxicity
from lakepress.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay; the field learns from this stage's own documents."""
    return toxicity.without_toxic(docs, shared.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word 5-grams, Jaccard 0.8 or more: of each group the document with the smallest id stays."""
    return ngram_join.near_duplicate_filter(docs, n=5, num=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.without_personal_data(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids and n_tokens; the text is what the ids decode to."""
    out = bpe.bpe_encode_decode(docs, tokenizer_file("byte_bpe_50k.json"))
    decoded = out.columns[-1]  # under another name if docs has a column decoded
    return out.withColumn("text", out[decoded]).drop(decoded)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("bpe", tokenize),
]

#: Fitted and iterative stages are beyond SQL; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared.shared_dir(spark)}/lakepress/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
