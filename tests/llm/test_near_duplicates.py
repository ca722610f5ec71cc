"""Classes against brute force over all pairs of texts."""

import itertools
import random
import re

import numpy as np
import pytest

from millrace.llm import near_duplicates as N
from millrace.llm.components import components
from millrace.llm.queries import QUERIES


def shingles(text):
    words = re.findall(r"\w+", text.lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """The smallest id of each row's class."""
    texts = {}
    for i, t in rows:
        texts.setdefault(t if t is not None else ("null", i), []).append(i)
    keys = list(texts)
    sets = [shingles(k) if isinstance(k, str) else frozenset() for k in keys]
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(keys)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                parent[find(a)] = find(b)
    classes = {}
    for k, key in enumerate(keys):
        classes.setdefault(find(k), []).extend(texts[key])
    return {i: min(ids) for ids in classes.values() for i in ids}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for f in range(12):  # families: copies, near copies of all degrees
        base = rng.choices(vocabulary, k=rng.choice([5, 8, 30, 120, 400]))
        for n in (0, 0, 1, 1, 2, 3, 5, 9):
            rows.append((len(rows), edited(base, n, rng)))
    hot = rng.choices(vocabulary, k=150)
    rows += [(len(rows) + i, edited(hot, rng.randrange(12), rng)) for i in range(250)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows += [(len(rows) + i, passage + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(20, 200)))) for i in range(120)]
    extra = [None, None, "", "", "!!!", "!!!", "?", "word", "Word", "WORD!", "one two three four", "one two three four five", "a b c d e " * 4000, "a b c d e " * 4001, "x " * 50]
    return rows + [(10000 + i, t) for i, t in enumerate(extra)]


def test_classes_equal_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NODES", 16)
    monkeypatch.setattr(N, "PAIRED", 3)  # hot shingles take several blocks
    docs = spark.createDataFrame([(i, t, 3) for i, t in corpus], "doc_id long, text string, h int")
    rows = N.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute(corpus)
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(corpus).values()))
    assert sorted(r.doc_id for r in rows if r.kept) == sorted(set(brute(corpus).values()))


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op6_near_duplicates"](spark, sf_dir).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute(docs)


def test_a_passage_repeated_in_one_copy_only(spark):
    """The index of the sets is 0.8 or more however often the passage stands in the second text."""
    rng = random.Random(12)
    rows = []
    for f in range(40):
        base, passage = ([f"f{f}w{rng.randrange(10**6)}" for _ in range(n)] for n in (110, 16))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + passage * (1, 4, 16, 64)[f % 4]))]
    expected = brute(rows)
    assert set(expected.values()) == set(range(0, 80, 2))
    buckets, _ = N.sketch([t for _, t in rows])
    assert all((buckets[i] == buckets[i + 1]).any() for i in range(0, 80, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()} == expected


def test_repeated_rows_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "same text here", "a"), (1, "same text here", "b"), (None, "same text here", "c"), (None, "alone", "d"), (None, None, "e"), (None, None, "e")], "doc_id long, text string, row string")
    assert sorted((str(r.class_id), r.class_size) for r in N.near_duplicates(docs).collect()) == sorted([("1", 3)] * 3 + [("None", 1)] * 3)
    assert sorted(r.text or "" for r in N.keep_first(docs).collect()) == ["", "", "alone", "same text here"]
    assert N.near_duplicates(docs.limit(0)).count() == 0 and N.keep_first(docs.limit(0)).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
    a[:60], b[-60:] = 0, 0
    both = (a > 0) & (b > 0)
    expected = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(both))
    m = 4096
    sign = [N.probminhash(np.zeros((w > 0).sum(), int), keys[w > 0], w[w > 0], 1, m)[0] for w in (a, b)]
    assert abs((sign[0] == sign[1]).mean() - expected) < 4 * np.sqrt(expected * (1 - expected) / m)


def test_a_signature_does_not_depend_on_its_batch():
    texts = ["a b c d e f", "x", "the quick brown fox jumps over the lazy dog " * 30]
    alone = [N.sketch([t]) for t in texts]
    together = N.sketch(texts)
    for i, (b, sets) in enumerate(alone):
        assert (b[0] == together[0][i]).all() and (sets[0] == together[1][i]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    names = lambda x: f"{x * 7919 % 10007:05d}"
    df = spark.createDataFrame([(names(a), names(b)) for a, b in edges], "a string, b string")
    got = {r.node: r.root for r in components(df).collect()}
    parent = {names(x): names(x) for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(names(a)), find(names(b))))
        parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert components(df.limit(0)).count() == 0
