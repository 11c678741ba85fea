"""A training-data pipeline over documents: every stage works on all that the one before it kept.

1. quality rules: documents that fail their own rules or come from a rejected host go;
2. n-gram Jaccard join: of every group of near duplicates the document with the smallest id stays;
3. suffix-array dedup: passages of 50 words or more that occurred before are cut out of the texts;
4. mixing: documents are taken as often as their source's target weight asks, not at all, once, or twice (two rows);
5. byte-level BPE: the ids of what is left, with a check by decoding.

All stages but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, mixing, neardup, quality, suffixes
from spanloom.llm.core import work_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: Similarity joins, repeats of passages and BPE are beyond SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = work_path(spark)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{where}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{where}/{i}")
    return docs
