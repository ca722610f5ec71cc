"""Both searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hashing_search as H
from millrace.llm import vectors
from millrace.llm.queries import QUERIES
from millrace.llm.topk import accumulate, top_k

SCHEMA = "vec_id long, embedding array<float>, vec_key int"


def brute(ids, scores_of, k, step):
    out = []
    for i in np.flatnonzero(ids % step == 0):
        scores = scores_of(i)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), n + 1, int(ids[j]), scores[j]) for n, j in enumerate(order)]
    return out


def table(spark, folder):
    rows = sorted(spark.read.parquet(f"{folder}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


@pytest.fixture(scope="module")
def folder(sf_dir):
    return sf_dir.replace("0.001", "0.1")


def test_topk_is_exact(spark, folder):
    ids, x = table(spark, folder)
    z = np.floor(1024 * x).astype(np.int64)
    got = sorted(map(tuple, QUERIES["op7_topk"](spark, folder).collect()))
    assert got == [(a, b, c, int(d)) for a, b, c, d in sorted(brute(ids, lambda i: z @ z[i], 10, 100))]


def test_neighbours_recall(spark, folder):
    ids, x = table(spark, folder)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = QUERIES["op10_neighbours"](spark, folder).collect()
    true = {(a, c): d for a, _, c, d in brute(ids, lambda i: u @ u[i], 5, 50)}
    assert len(rows) == len(true)
    assert sum((r.query_id, r.vec_id) in true for r in rows) >= 0.95 * len(true)
    at = {int(k): i for i, k in enumerate(ids)}
    for r in rows:
        a, b = x[at[r.query_id]], x[at[r.vec_id]]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(v == sorted(v) for v in by.values())


ODD = [
    (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
    (7, [0.0, 0.0], 1), (8, [], 1), (9, [-1.0, 0.5], 1), (10, [3.0, 1.0, 2.0], 1), (None, [9.0, 9.0], 1), (100, [2.0, 2.0], 1), (1, [1.0, 2.0], 1), (200, None, 1), (300, [5.0], 1),
]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATE_BLOCK", 2)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 1)
    rows = spark.createDataFrame(ODD, SCHEMA)
    got = [tuple(r) for r in top_k(rows, F.col("vec_key") % 100 == 0, k=10).orderBy("query_id", "rank").collect()]
    ids = [0, 1, 1, 2, 7, 9, 100]
    z = {0: (1024, 2048), 1: (1024, 2048), 2: (1024, 2048), 7: (0, 0), 9: (-1024, 512), 100: (2048, 2048)}
    for q in (0, 100):
        want = sorted(((-sum(a * b for a, b in zip(z[q], z[i])), i) for i in ids if i != q))
        assert [(c, d) for a, _, c, d in got if a == q] == [(i, -s) for s, i in want]
    assert {a for a, *_ in got} == {0, 100}  # 300 has no candidate of its width
    near = [tuple(r) for r in H.neighbours(rows, F.col("vec_key") % 50 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert [(a, b, c) for a, b, c, _ in near if a == 0] == [(0, 1, 1), (0, 2, 1), (0, 3, 2)]
    assert all(7 not in (a, c) for a, _, c, _ in near)
    for f in (top_k, H.neighbours):
        assert f(rows.limit(0), F.col("vec_key") % 100 == 0).count() == 0


def test_accumulation_is_exact_for_large_weights():
    q, c = np.array([[2**40, 3, 0]]), np.array([[2**20 + 1, 5], [7, 11], [1, 1]])
    assert accumulate(q, c).tolist() == (q.astype(object) @ c.astype(object)).astype(np.int64).tolist()


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (2000, 4)).astype(np.uint8)
    built = H.Index.build(np.zeros((2000, 3)), codes)
    index = H.Index.read(built.write(), 2000, 3, 32)  # as it comes from a stored block
    assert (index.codes == codes).all() and (index.begins == built.begins).all()
    for radius in (0, 3, 7, 12):
        for code in codes[:20]:
            apart = np.unpackbits(codes ^ code, axis=1).sum(axis=1)
            assert index.probe(code, radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_no_cell_holds_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATE_BLOCK", 10)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vectors, "CELL", 4)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1000)], "vec_key long, vector array<double>").repartition(3)
    tables = [vectors.blocks(x, n, lambda m: m.tobytes(), "blocks") for x, n in ((rows.where("vec_key % 10 = 0"), 5), (rows, 10))]
    cells = vectors._cells(*tables).select("q_group", "c_group", "q_block", "c_block").collect()
    n_q, n_c = (t.count() for t in tables)
    assert len(cells) == len({(r.q_block, r.c_block) for r in cells}) == n_q * n_c  # every pair of blocks once
    by = {}
    for r in cells:
        by.setdefault((r.q_group, r.c_group), []).append(r)
    assert len(by) >= n_q * n_c / 16 and max(map(len, by.values())) <= 16


@pytest.mark.parametrize("n", [2000, 6000])
def test_recall_on_clusters(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u, ids = x / np.linalg.norm(x, axis=1, keepdims=True), np.arange(n)
    true = {(a, c) for a, _, c, _ in brute(ids, lambda i: u @ u[i], 5, 50)}
    got = H.neighbours(rows, F.col("vec_key") % 50 == 0, k=5).collect()
    assert len(got) == len(true) and sum((r.query_id, r.vec_id) in true for r in got) >= 0.9 * len(true)


def test_queries_that_find_too_few_search_wider(spark, monkeypatch):
    """With a radius of 0 nothing but equal codes is found at first; all k come in the end."""
    learn = H.learn

    def narrow(*given, **named):
        codes = learn(*given, **named)
        codes.radius = 0
        return codes

    monkeypatch.setattr(H, "learn", narrow)
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    got = H.neighbours(rows, F.col("vec_key") % 50 == 0, k=5).collect()
    assert len(got) == 6 * 5 and {r.rank for r in got} == {1, 2, 3, 4, 5}
