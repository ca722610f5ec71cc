"""The whole run against the operators' own brute-force versions on a small corpus."""

import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import scratch

WORDS = [f"{a}{b}{c}" for a in ("ba", "ku", "mi", "to") for b in ("lan", "der", "pos", "rit") for c in ("", "en", "ix", "ola")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(6), tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(WORDS, k=rng.randrange(30, 120))
        if i % 6 == 0:
            words[3:3] = ["stinker", "lout", "stinker"]
        if i % 10 == 1:
            words.insert(5, f"name{i}@mail.org")
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i + 1][1], "en", "s0") for i in range(4)]  # copies
    near = rows[7][1].split()
    near[-1] = "changed"
    rows += [(2000, " ".join(near), "en", "s1"), (2001, None, None, None), (2002, "", "en", "s2")]
    spark.createDataFrame([(a, b, c, d, len(b) if b else 0) for a, b, c, d in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.store(stage(spark, docs, path), name)
        kept.append(docs)
        if name != "packing":
            assert docs.columns == columns
        if name == "mixing":
            mixed = [(r.doc_id, r.text) for r in docs.collect()]
            assert {i for i, _ in mixed} <= {r.doc_id for r in before.collect()}
    toxic = {i for i in range(0, 240, 6)}
    assert {r.doc_id for r in kept[0].collect()} == {r[0] for r in rows} - toxic
    copies = {1000 + i for i in range(4)} | {2000}
    assert {r.doc_id for r in kept[1].collect()} == {r[0] for r in rows} - toxic - {c for c in copies if not (1000 <= c < 2000 and (c - 1000 + 1) in toxic)}
    after = {r.doc_id: r for r in kept[2].collect()}
    assert len(after) == kept[1].count()
    for i, text, *_ in rows:
        if i in after:
            assert after[i].text == (re.sub(r"\S+@\S+", "[EMAIL]", text) if text else text)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in mixed)
    pieces = docs.collect()
    assert sum(r.length for r in pieces) == sum(want)
    wholes = {zlib.crc32(b"".join(i.to_bytes(4, "little") for i in t.encode(x or "", add_special_tokens=False).ids + [1])) for _, x in mixed}
    assert {r.ids_crc32 for r in pieces if r.length == r.doc_tokens} <= wholes
    again = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, again.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)
