"""Approximate nearest neighbours by multi-index hashing.

Binary codes are learned on a bounded sample: the sample is centred and rotated
so that signs lose little (iterative quantisation), from several random starts
whose bits are joined. A code is split into substrings of eight bits; every row
of a block is entered in the index of each substring, once, when the block is
written with its indexes. If two codes differ in at most r bits, some substring
of m differs in at most r // m: probing the buckets within that distance, in
every index, finds every code within radius r. What is found is checked by its
whole distance and reranked by the cosine of the floats.

The radius is learned with the codes: wide enough for RECALL of the true
neighbours of sampled queries. A corpus larger than the sample has neighbours
that are closer, so its recall is higher. Queries that find fewer than k rows
search again, with twice the radius, until they have k or the radius is the
whole code, which finds all.

Defined results: rows with a null id, a null or zero vector, or a null or
non-finite component take no part; ties go to the smaller id; rows that repeat
an id are candidates each, but never of a query with that id; an empty table
gives an empty result; vectors of different widths don't meet, and widths that
the sample misses get random rotations; further columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, vectors
from .sampling import bounded_sample

#: Bound of the sample for codes and radius, and of the queries among it.
SAMPLE = 8192
SAMPLE_QUERIES = 512
ROTATIONS = 2
#: Part of the sampled queries' true neighbours that lie within the radius.
RECALL = 0.985

_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class Codes:
    mean: np.ndarray
    rotations: np.ndarray  # (width, bits)
    radius: int

    @property
    def bits(self) -> int:
        return self.rotations.shape[1]

    def of(self, unit: np.ndarray) -> np.ndarray:
        """A byte for each substring."""
        return np.packbits((unit - self.mean) @ self.rotations > 0, axis=1)


def unit(matrix: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def learn(sample: np.ndarray, k: int, seed: int = 5, steps: int = 15) -> Codes:
    """Rotations by iterative quantisation, and the radius."""
    x = unit(sample)
    mean, width = x.mean(axis=0), x.shape[1]
    centred = x - mean
    rng, found = np.random.default_rng(seed), []
    for _ in range(ROTATIONS):
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.sign(centred @ turn).T @ centred)
            turn = (u @ v).T
        found.append(turn)
    bits = np.concatenate(found, axis=1)
    bits = bits[:, : bits.shape[1] // 8 * 8] if bits.shape[1] >= 8 else np.tile(bits, 8)
    codes = Codes(mean, bits, bits.shape[1])
    if len(x) > k:
        own = np.arange(min(SAMPLE_QUERIES, len(x)))
        cosines = x[own] @ x.T
        cosines[own, own] = -2
        near = np.argpartition(-cosines, min(k, len(x) - 1) - 1, axis=1)[:, :k]
        packed = codes.of(x)
        apart = np.sort(_BITS[packed[own][:, None, :] ^ packed[near]].sum(axis=2), axis=None)
        codes.radius = int(apart[min(len(apart) - 1, int(np.ceil(RECALL * len(apart))))])
    return codes


def untaught(width: int) -> Codes:
    """Codes of a width that the sample doesn't hold: random rotations, the same for all tasks."""
    rng = np.random.default_rng(width)
    turns = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(ROTATIONS)]
    bits = np.concatenate(turns * -(-8 // (ROTATIONS * width)), axis=1)
    bits = bits[:, : bits.shape[1] // 8 * 8]
    return Codes(np.zeros(width), bits, bits.shape[1] * 2 // 5)


class Index:
    """A block's floats, its codes, and the buckets of every substring of these."""

    def __init__(self, floats: np.ndarray, codes: np.ndarray, order: np.ndarray, begins: np.ndarray):
        self.floats, self.codes, self.order, self.begins = floats, codes, order, begins
        self.balls: dict[tuple[int, int, int], np.ndarray] = {}

    @classmethod
    def build(cls, floats: np.ndarray, codes: np.ndarray) -> Index:
        order = np.argsort(codes, axis=0, kind="stable").T.astype("<u2")
        counts = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(codes.shape[1])])
        return cls(floats, codes, order, np.concatenate([np.zeros((len(counts), 1), "<i4"), counts.cumsum(axis=1)], axis=1).astype("<i4"))

    def write(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.floats.astype("<f8"), self.codes, self.order, self.begins))

    @classmethod
    def read(cls, held: bytes, n: int, width: int, bits: int) -> Index:
        shapes, at, parts = [((n, width), "<f8"), ((n, bits // 8), "u1"), ((bits // 8, n), "<u2"), ((bits // 8, 257), "<i4")], 0, []
        for shape, kind in shapes:
            parts.append(np.frombuffer(held, kind, shape[0] * shape[1], at).reshape(shape))
            at += parts[-1].nbytes
        return cls(*parts)

    def _ball(self, j: int, value: int, radius: int) -> np.ndarray:
        """Marks for the rows in the buckets around a value of substring j; looked up once for all queries of a block."""
        if (j, value, radius) not in self.balls:
            marked, order, begins = np.zeros(len(self.codes), bool), self.order[j], self.begins[j]
            hit = [order[begins[v] : begins[v + 1]] for v in (_balls(radius) ^ value).tolist() if begins[v + 1] > begins[v]]
            if hit:
                marked[np.concatenate(hit)] = True
            self.balls[j, value, radius] = marked
        return self.balls[j, value, radius]

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within the radius."""
        marked = np.zeros(len(self.codes), bool)
        for j, value in enumerate(code.tolist()):
            marked |= self._ball(j, value, radius // len(code))
        found = np.flatnonzero(marked)
        return found[_BITS[self.codes[found] ^ code].sum(axis=1, dtype=np.int64) <= radius]


_made: dict[int, np.ndarray] = {}


def _balls(radius: int) -> np.ndarray:
    """The bytes of at most `radius` bits, fewest bits first."""
    if radius not in _made:
        values = np.flatnonzero(_BITS <= radius)
        _made[radius] = values[np.argsort(_BITS[values], kind="stable")]
    return _made[radius]


def neighbours(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest rows found, by cosine: query_id, rank, vec_id, score."""
    own = vectors.usable(rows, key, vector, nonzero=True)
    sample = bounded_sample(own, SAMPLE, "vec_key").select("vector").toArrow().column(0).to_pylist()
    by_width: dict[int, list[list[float]]] = {}
    for x in sample:
        by_width.setdefault(len(x), []).append(x)
    learned = {w: learn(np.array(x), k) for w, x in by_width.items()}

    def codes_of(width: int) -> Codes:
        if width not in learned:
            learned[width] = untaught(width)
        return learned[width]

    def indexed(matrix: np.ndarray) -> bytes:
        return Index.build(matrix, codes_of(matrix.shape[1]).of(unit(matrix))).write()

    def best_within(times: int) -> vectors.Best:
        def best(q_ids: np.ndarray, q: bytes, c_ids: np.ndarray, c: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            codes = codes_of(width)
            q = np.frombuffer(q, "<f8").reshape(len(q_ids), width)
            index, radius = Index.read(c, len(c_ids), width, codes.bits), min(codes.bits, max(1, codes.radius) * times)
            qu, cu = unit(q), unit(index.floats)
            own_codes, norms = codes.of(qu), np.sqrt((index.floats * index.floats).sum(axis=1))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for i in range(len(q)):
                at = index.probe(own_codes[i], radius)
                at = at[c_ids[at] != q_ids[i]]
                rough = cu[at] @ qu[i]
                if len(at) > 4 * k:
                    at = at[rough >= np.partition(rough, -k)[-k] - 1e-9]
                floats = index.floats[at]
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    exact = (floats * q[i]).sum(axis=1) / (norms[at] * np.sqrt((q[i] * q[i]).sum()))
                exact = np.where(np.isfinite(exact), exact, (cu[at] * qu[i]).sum(axis=1))
                found.append((np.full(len(at), i), at, exact))
            return tuple(map(np.concatenate, zip(*found)))

        return best

    with scratch.temporary(rows.sparkSession):
        candidates = vectors.blocks(own, vectors.CANDIDATE_BLOCK, indexed, "candidate-blocks")
        left, times, out = own.where(is_query), 1, None
        while True:
            queries = vectors.blocks(left, vectors.QUERY_BLOCK, lambda m: m.astype("<f8").tobytes(), "query-blocks")
            found = scratch.store(vectors.search(queries, candidates, k, best_within(times), "double"), "neighbours", keep=True)
            full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_key"))
            left = scratch.store(left.join(full, "vec_key", "left_anti"), "queries-left")
            done = not left.take(1) or all(times * max(1, c.radius) >= c.bits for c in learned.values()) and times >= 4
            if done:
                return found if out is None else out.unionByName(found)
            # The others' rows stay as they are.
            settled = found.join(left.select(F.col("vec_key").alias("query_id")).distinct(), "query_id", "left_anti")
            settled = scratch.store(settled, "neighbours-settled", keep=True)
            out, times = settled if out is None else out.unionByName(settled), times * 2
