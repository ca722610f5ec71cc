"""The queries of this subpackage: each applies one operator, with production
parameters, to its whole table. Each callable takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, mixing, private_data, toxicity
from .hashing_search import neighbours
from .html_text import extract
from .near_duplicates import near_duplicates
from .packing import pack
from .token_counts import token_counts
from .topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The columns of op3 from the pieces of `pack`."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end=1))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_key") % 100 == 0, k=10)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs, F.col("doc_id").isNotNull() & ~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_key") % 50 == 0, k=5)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_toxicity,
        op3_packing,
        op4_html_text,
        op5_private_data,
        op6_near_duplicates,
        op7_topk,
        op8_mixing,
        op9_language_id,
        op10_neighbours,
    )
}
#: The others have no equal in SQL; tests hold them against brute force or the libraries.
ORACLE_SQL: dict[str, str] = {"op8_mixing": mixing.oracle()}
