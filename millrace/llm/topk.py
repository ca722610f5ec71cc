"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are turned into integers. A block of candidates is inverted: each
dimension is a term whose postings are the candidates' weights. A query scatters
its own weight of each term that it has, times the postings, into a dense array
of scores, one for each candidate of the block; a partition selection keeps the
best, and the blocks' results are merged.

Defined results: rows with a null id or vector, or with a null or non-finite
component, take no part; ties go to the smaller id; a query with fewer than k
candidates returns them all; rows that repeat an id are candidates each, but
never of a query with that id; an empty table gives an empty result. Vectors of
different widths don't meet. Weights are assumed to keep scores within 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from . import scratch, vectors

LOWEST = np.iinfo(np.int64).min


def quantise(matrix: np.ndarray, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    return np.floor(matrix * scale).astype("<i8")


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of all candidates for each query, term by term.

    `postings` has a row of weights for each term. Where every partial sum stays
    below 2 ** 53, doubles hold it exactly and several queries share one pass.
    """
    exact = np.abs(queries).max(initial=0) * 1.0 * np.abs(postings).max(initial=0) * max(1, len(postings)) < 2**53
    if exact:
        queries, postings = queries.astype(np.float64), postings.astype(np.float64)
    scores = np.zeros((len(queries), postings.shape[1]), postings.dtype)
    for term, weights in enumerate(postings):
        having = np.flatnonzero(queries[:, term])
        if len(having) == len(queries):
            scores += queries[:, term, None] * weights
        elif len(having):
            scores[having] += queries[having, term, None] * weights
    return scores.astype(np.int64)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """Each query's k candidates of the largest integer inner product: query_id, rank, vec_id, score."""

    def best(q_ids: np.ndarray, q: bytes, c_ids: np.ndarray, c: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, postings = np.frombuffer(q, "<i8").reshape(len(q_ids), width), np.frombuffer(c, "<i8").reshape(width, len(c_ids))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), 128):
            scores = accumulate(q[at : at + 128], postings)
            scores[q_ids[at : at + 128, None] == c_ids[None, :]] = LOWEST
            if scores.shape[1] > k:
                # All that reach the k-th best score: ties are settled by id later.
                least = np.partition(scores, -k, axis=1)[:, -k]
            else:
                least = np.full(len(scores), LOWEST + 1)
            i, j = np.nonzero((scores >= least[:, None]) & (scores > LOWEST))
            found.append((i + at, j, scores[i, j]))
        return tuple(map(np.concatenate, zip(*found)))

    own = vectors.usable(rows, key, vector)
    with scratch.temporary(rows.sparkSession):
        queries = vectors.blocks(own.where(is_query), vectors.QUERY_BLOCK, lambda m: quantise(m, scale).tobytes(), "query-blocks")
        # A candidate block is inverted when it is written: a row of postings for each term.
        candidates = vectors.blocks(own, vectors.CANDIDATE_BLOCK, lambda m: np.ascontiguousarray(quantise(m, scale).T).tobytes(), "candidate-blocks")
        return scratch.store(vectors.search(queries, candidates, k, best, "long"), "top-k", keep=True)
