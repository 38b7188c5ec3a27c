"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's rows as Parquet in the shared folder and reads them as the next one's docs.

1. quality: rows that the quality rules reject go.
2. near_duplicates: of each component of near copies the row of least doc_id stays
   (rows without a doc_id all stay).
3. personal_data: personal data in the text becomes its kind in brackets; n_chars follows.
4. mixture: each row as often as the mix takes it, perhaps not at all.
5. tokens: the ids of each row's text in place of the text, with digests.

Nulls, empty and repeated rows and empty tables are dealt with as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, mixing, pii, quality, simhash
from textloom.llm.tables import table
from textloom.scratch import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("personal_data", personal_data_stage),
    ("mixture", mixture_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Fingerprints, spans with look-behind and byte-level merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
