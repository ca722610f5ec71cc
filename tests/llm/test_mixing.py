import re

import duckdb
import pytest

from millrace.llm import mixing as M
from millrace.llm.queries import ORACLE_SQL, QUERIES


def oracle(view, docs=None):
    c = duckdb.connect()
    if docs is not None:
        c.register("given", docs.toArrow())
    c.execute(f"CREATE VIEW documents AS SELECT * FROM {view}")
    return sorted(map(repr, c.execute(ORACLE_SQL["op8_mixing"]).fetchall()))


def test_documents_equal_sql(spark, sf_dir):
    got = sorted(repr(tuple(r)) for r in QUERIES["op8_mixing"](spark, sf_dir).collect())
    assert got == oracle(f"'{sf_dir}/documents.parquet'")


ROWS = [(i, "w " * (i % 7), "abcdefg"[i % 7 if i % 3 else 0], 1) for i in range(300)]
ROWS += [(900, None, "a", 1), (901, "", None, 1), (902, " \t\x0b x y z\n", None, 1), (None, "no key", "b", 1), (903, "long " * 30000, "g", 1), (5, "w w", "a", 1), (5, "w w", "a", 1), (904, "x", "", 1), (905, "", "empty", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, size int")


def test_odd_rows_equal_sql(docs):
    rows = M.taken(docs).collect()
    assert sorted(repr(tuple(r)) for r in rows) == oracle("given", docs)
    assert sorted(repr(tuple(r)) for r in M.taken(docs.repartition(7)).collect()) == oracle("given", docs)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id == 902} == {2}
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in by) - sum(r.size for r in rows)) < 1e-6


def water(sizes, weights, most=3):
    """Targets by sharing again and again what is above the limits."""
    aims, left, free = {}, float(sum(sizes.values())), dict(weights)
    while True:
        share = {k: left * w / sum(free.values()) for k, w in free.items()}
        above = [k for k in share if share[k] >= most * sizes[k]]
        if not above:
            return aims | share
        for k in above:
            aims[k] = most * sizes[k]
            left -= aims[k]
            del free[k]
        if not free:
            return aims


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 10, "c": 1000, "d": 2}, {"a": 5}, {"a": 0, "b": 3}, {"a": 0}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 40}])
def test_targets(spark, sizes):
    got = {r.name: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "name string, source_size long")).collect()}
    expected = water(sizes, {k: M.WEIGHTS[i % 3] for i, k in enumerate(sorted(sizes))})
    assert got == pytest.approx(expected)


def test_the_tree_keeps_quotas_and_levels_shards(spark):
    quotas = {"a": 400, "b": 57, "c": 1, "d": 0, "e": 70}
    rows = M.splitting_tree(spark.createDataFrame(list(quotas.items()), "name string, n_blocks long"), 8).collect()
    assert sorted((r.name, r.block) for r in rows) == sorted((k, i) for k, n in quotas.items() for i in range(n))
    every = [r.shard for r in rows]
    assert sorted(set(every)) == list(range(8)) and max(map(every.count, range(8))) - min(map(every.count, range(8))) <= 1
    share = [sum(r.name == "a" and r.shard == s for r in rows) for s in range(8)]
    assert len(set(share)) > 1 and all(30 < n < 66 for n in share)  # 50 on average, drawn
    with pytest.raises(ValueError):
        M.splitting_tree(spark.createDataFrame([("a", 1)], "name string, n_blocks long"), 6)


def test_halves_are_hypergeometric(spark):
    """Of 20 blocks, 6 of them of a, half go left: 3 of a on average, with the variance of draws without replacement."""
    nodes = spark.createDataFrame([(n, name, q) for n in range(1, 601) for name, q in (("a", 6), ("b", 14))], "node long, name string, quota long")
    left = {r.node // 2: r.quota for r in M.split(nodes).where("name = 'a' and node % 2 = 0").collect()}
    got = [left.get(n, 0) for n in range(1, 601)]
    mean = sum(got) / 600
    assert abs(mean - 3) < 0.2 and abs(sum((x - mean) ** 2 for x in got) / 600 - 10 * 0.3 * 0.7 * 10 / 19) < 0.25


def test_taken_words_lie_in_dealt_blocks(docs):
    """Every block is full but for the last of its source, and shards differ by a block of each source at most."""
    rows = M.taken(docs).collect()
    for r in rows:
        parts = [tuple(map(int, x.split(":"))) for x in r.parts.split(",") if x]
        assert sum(n for _, n in parts) == r.taken and all(0 <= s < M.LEAST_SHARDS and n > 0 for s, n in parts)
    by = {}
    for r in rows:
        for x in r.parts.split(","):
            if x:
                s, n = map(int, x.split(":"))
                by[s] = by.get(s, 0) + n
    assert len(by) == M.LEAST_SHARDS and max(by.values()) - min(by.values()) < 0.1 * max(by.values())


def test_sizes_do_not_change_what_is_taken(docs, monkeypatch):
    base = sorted((r.doc_id or 0, r.size, r.taken) for r in M.taken(docs).collect())
    monkeypatch.setattr(M, "WORDS_PER_SHARD", 500)
    monkeypatch.setattr(M, "BUCKET_ROWS", 1)
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in M.taken(docs).collect()) == base


def test_mixed_documents(docs):
    out = M.mix(docs)
    assert out.columns == docs.columns
    rows = [tuple(r) for r in out.collect()]
    assert rows == [tuple(r) for r in M.mix(docs).collect()]  # reruns agree, in order too
    assert set(rows) <= set(ROWS)
    # Every document as often as its copies say, rows that are repeated too.
    words = {r[0]: 0 for r in ROWS}
    for r in rows:
        words[r[0]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    for r in M.taken(docs).collect():
        if r.doc_id not in (5, 903):
            assert abs(words[r.doc_id] - r.taken) <= r.size / 2 + 1
    assert M.mix(docs.limit(0)).count() == 0 and M.taken(docs.limit(0)).count() == 0
