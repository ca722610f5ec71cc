"""Token counts of whole texts.

Arrow batches go to the tokenizer library and only lengths come back. Inside a
batch the pieces are grouped by bytes, not by rows, and long texts are cut at
safe boundaries, so one very long text costs no more memory than many short ones.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted each; further columns of the input are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordcache
from .batches import steps

_cache: dict[str, wordcache.LengthCache] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    `tokenizer` is the path of a tokenizers JSON file present on every executor.
    Special strings inside texts are treated as the library does by default; no
    token is added around a text.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _cache:
            _cache[tokenizer] = wordcache.LengthCache(tokenizer)
        lengths = _cache[tokenizer].lengths
        for batch in steps(batches, 1):
            found = lengths([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_key", "n_bytes", "n_tokens"]
            )

    kind = docs.schema[key].dataType.simpleString()
    sized = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    counted = sized.mapInArrow(count, f"doc_key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("doc_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
