"""A training-text pipeline over ``documents``: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from designlens.llm import decontaminate, language_id, near_dedup, quality, unigram
from designlens.llm.queries import tokenizer_file
from designlens.shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is identified with some certainty."""
    return language_id.identify(docs).where("lid_kept").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; by length only those without words go, as short ones may be clean."""
    return quality.filter_quality(docs, quality.RULES | {"few_words": (lambda m: m.n_words < 1, ("n_words",))})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    return near_dedup.one_of_each_group(docs, words=5, threshold=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip of the documents that are left."""
    return unigram.encoded_digest(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Statistical and aligning stages have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
