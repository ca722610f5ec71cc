"""Token counts and packing against the tokenizer library itself."""

import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import wordcache
from millrace.llm.packing import DeficitRoundRobin, pack
from millrace.llm.queries import QUERIES, pieces_digest
from millrace.llm.token_counts import token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "it's we're 'sx x's, don't.", "<|endoftext|> a<|endoftext|>b", "<|startoftext|>x", "a  b\n\n c \t", "1,234.5 ½ ²", "Σίσυφος ΟΔΟΣ", "İ K Å é",
    "a\x1cb \x1d", "x  y　z", "\x85", "中文 字", "😀👍", "the the The, the.", "A" * 3000, "word " * 20000, "." * 500, "ab " * 50000,
]
SCHEMA = "doc_id long, text string, source string, n_tokens int, ids string, queue string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, ["a", "b", None][i % 3], 7, "x", "y") for i, x in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "no key", "a", 7, "x", "y")], SCHEMA)


def expected(texts, path):
    return [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(docs):
    rows = token_counts(docs, BYTES, limit=10).collect()
    assert len(rows) == len(TEXTS) + 2
    of = {r.doc_id: r for r in rows}
    for i, ids in enumerate(expected(TEXTS, BYTES)):
        assert (of[i].n_tokens, of[i].over_limit, of[i].n_bytes) == (len(ids), len(ids) > 10, len((TEXTS[i] or "").encode()))


def test_counts_of_documents(spark, sf_dir):
    rows = {r.doc_id: r.n_tokens for r in QUERIES["op1_token_counts"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert [rows[d.doc_id] for d in docs] == [len(x) for x in expected([d.text for d in docs], BYTES)]


def test_parts_of_long_texts_give_the_same_tokens():
    text = "Some words, and more of them.  Next\n" * 300
    parts = wordcache.cut_long(text, 200)
    assert len(parts) > 10 and "".join(parts) == text
    t = Tokenizer.from_file(BYTES)
    assert sum(len(t.encode(p).ids) for p in parts) == len(t.encode(text).ids)
    assert wordcache.cut_long("é" * 1000, 100) == ["é" * 1000]
    assert [len(b) for b in wordcache.byte_batches(["a" * 10] * 5 + ["b" * 100], 30)] == [3, 2, 1]


def whole(rows, ids_of, size=2048):
    """Asserts that pieces are a partition of the ids and sequences have no gap; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for k, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_is_a_partition(docs):
    once = docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    ids = {i: x + [1] for i, x in enumerate(expected(TEXTS, WORDS))}
    assert whole(pieces_digest(pack(once, WORDS)).collect(), ids) == 0
    assert whole(pieces_digest(pack(once, WORDS, size=64, targets={"a": 3, "b": 1})).collect(), ids, 64) == 0
    # Repeated rows and null keys are packed like others.
    assert pack(docs, WORDS).agg(F.sum("length")).first()[0] == sum(map(len, ids.values())) + len(ids[3]) + 3


def test_packing_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = {d.doc_id: x + [1] for d, x in zip(docs, expected([d.text for d in docs], WORDS))}
    assert whole(QUERIES["op3_packing"](spark, sf_dir).collect(), ids) == 0


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert token_counts(none, BYTES).count() == 0 and pack(none, WORDS).count() == 0


@pytest.mark.parametrize("totals, shares", [([3000, 1500, 500], None), ([900, 800, 0, 40], [1, 2, 3, 4]), ([5], None), ([100, 100], [1, 9]), ([64, 64], None)])
def test_windows_follow_the_shares(totals, shares):
    size = 64
    robin = DeficitRoundRobin(totals, shares, size)
    lines, held = [], defaultdict(lambda: [0] * len(totals))
    for k, total in enumerate(totals):
        if not total:
            continue
        starts, where, offsets = robin.edges(k, 0, total)
        for a, b, w, o in zip(starts, [*starts[1:], total], where, offsets):
            held[int(w)][k] += int(b - a)
            lines.append((int(w), int(o), int(b - a)))
    lines.sort()
    at = {}
    for w, o, n in lines:
        assert o == at.get(w, 0)
        at[w] = o + n
    assert all(n <= size and (n == size or n & (n - 1) == 0) for n in at.values())
    assert sum(at.values()) == sum(totals)
    # While all queues last, each has had its share of the windows so far, less than one token off.
    first = robin.phases[0]
    for k in range(len(totals) if first.quotas is None else 0):
        given = 0
        for w in range(first.windows):
            given += held[w][k]
            assert abs(given - (w + 1) * size * first.shares[k] / first.total) < 1
