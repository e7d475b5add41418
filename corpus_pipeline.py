"""Documents to token ids in five stages, each read from what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.bpe import with_bpe
from grainmill.llm.line_dedup import drop_common_lines
from grainmill.llm.mixture import mix_documents
from grainmill.llm.near_copies import keep_one_near_copy
from grainmill.llm.quality_rules import with_repetition_rules
from grainmill.llm.text import modest_batches, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.  A null text is empty, and an empty one goes; repeated rows are judged alike."""
    modest_batches(spark)
    return with_repetition_rules(docs, out="__rules").where("__rules.kept").drop("__rules")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents share; n_chars follows the text.

    A null text becomes an empty one.  Repeated rows count as documents each.
    """
    modest_batches(spark)
    cleaned = drop_common_lines(docs, out="__lines").withColumn("text", F.col("__lines.text"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).drop("__lines")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: five-word shingles, similarity 0.8 or more.

    A null text has no words, and all texts without words are copies of each
    other.  Null ids come last.  Repeated rows are copies too.
    """
    modest_batches(spark)
    return keep_one_near_copy(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target weight asks for.

    A null source is a source, the last one.  A null text has no words and comes
    with full passes only.  Repeated rows are taken one by one; those alike in id
    and text at the cut share it.
    """
    modest_batches(spark)
    return mix_documents(docs, F.array("source"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of the text that they decode to; none and that of nothing for a null text."""
    modest_batches(spark)
    encoded = with_bpe(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("bpe", bpe),
]

#: No SQL: DuckDB has neither XXH64 nor byte-level BPE.  tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
