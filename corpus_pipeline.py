"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the docs of the next; all but the last have the
columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, private_data, scratch, toxicity
from millrace.llm.near_duplicates import keep_first
from millrace.llm.packing import pack
from millrace.llm.queries import pieces_digest


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression takes for toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return keep_first(docs)


def hide_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; no document goes."""
    clean = private_data.sanitise(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken as often as its target asks, whole documents."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pieces_digest(pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end=1))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", hide_private_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages have no equal in SQL; tests hold the whole run against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last one's rows.

    What a stage stored on its way goes as soon as its result is written, and the
    stages' results at the end, but for the last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.temporary(spark):
        for name, stage in STAGES[:-1]:
            with scratch.temporary(spark):
                docs = scratch.store(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        name, stage = STAGES[-1]
        return scratch.store(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
