import numpy as np
from pyspark.sql import functions as F

from millrace.llm import language_id as L
from millrace.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    rows = QUERIES["op9_language_id"](spark, folder).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and 150 < len(held) < 350
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit(docs, F.lit(True))
    german = docs.where("lang = 'de' AND n_chars BETWEEN 500 AND 3000").orderBy("doc_id").first().text
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "123 !?", 0.5), (None, german, 0.5), (4, german * 200, 0.5), (4, german * 200, 0.5), (5, "123 " * 50000, 0.5), (6, "x", 0.5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = L.predict(odd, model).collect()
    assert len(got) == 8
    for r in got:
        if r.doc_id in (1, 2, 3, 5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id in (None, 4):
            assert r.lang_pred == "de" and r.score > 0.5
    assert {r.lang_pred for r in L.predict(odd, None).collect()} == {"und"}
    assert L.fit(docs.limit(0), F.lit(True)) is None and L.fit(docs, F.lit(False)) is None
    assert L.predict(odd.limit(0), model).count() == 0


def test_windows_cover_the_text():
    data = bytes(range(256)) * 3 + b"x"
    own = L.windows_of(data)
    assert own.shape == (7, L.WINDOW) and own.tobytes().rstrip(b"\0").endswith(b"x") and own.tobytes()[: len(data)] == data
