import math

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import toxicity as T

WORDS = "the cat sat on mat and dog ran far away from home under old trees while rain fell".split()
SCHEMA = "doc_id long, text string, s string, severity int"


def made(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(WORDS, 20))
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + i % 5):
                words[int(rng.integers(20))] = str(rng.choice(["moronic", "scummy", "vileness"]))
        rows.append((i, " ".join(words), "x", 1))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_unseen_documents(spark):
    docs, labels = made(spark)
    model = T.fit(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    held = {r.doc_id: r for r in T.score(docs, model).collect() if r.doc_id % 2}
    assert not any(r.toxic for r in held.values())
    seen = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert sum(seen[i].toxic for i in range(0, 400, 4)) >= 95
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) and r.p_toxic >= 0 for r in seen.values())
    one, many = "a scummy cat", "a scummy moronic vileness scummy moronic"
    got = T.score(spark.createDataFrame([(0, one, "", 0), (1, many, "", 0), (2, "scummier dogs", "", 0)], SCHEMA), model).orderBy("doc_id").collect()
    assert got[1].severity > got[0].severity > 0.3 and got[2].severity > 0.01  # beginnings of words count


def test_edges(spark):
    docs, labels = made(spark)
    model = T.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "a", 5), (2, "", None, 5), (3, "!!! 42", "a", 5), (None, "moronic scummy", "a", 5), (4, "the cat " * 50000, "a", 5), (4, "the cat " * 50000, "a", 5)], SCHEMA)
    rows = T.score(odd, model).collect()
    assert len(rows) == 6 and sum(r.toxic for r in rows) == 1
    kept = T.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == 5
    assert T.score(odd.limit(0), model).count() == 0
    for bad in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert T.fit(docs, bad) is None
    assert {r.severity for r in T.score(odd, None).collect()} == {0.0}


def test_ordinal_weights_are_shared():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    grades = np.digitize(2 * x + rng.logistic(size=3000), [0.0, 2.0])
    w, t = T.fit_ordinal(np.arange(3000), np.zeros(3000, int), x, grades, np.ones(3000), 1, steps=1500)
    assert abs(w[0] - 2) < 0.3 and abs(t[0]) < 0.3 and abs(t[1] - 2) < 0.3


def test_planted_words_in_documents(spark, sf_dir):
    from millrace.llm.queries import QUERIES

    folder = sf_dir.replace("0.001", "0.01")
    rows = QUERIES["op2_toxicity"](spark, folder).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    toxic = {r.doc_id for r in rows if r.toxic}
    assert sum(labels[i] for i in labels if i in toxic) >= 0.7 * sum(labels.values())
    assert sum(1 - labels[i] for i in labels if i in toxic) <= 0.02 * len(labels)


def test_keys_of_any_type_and_a_slow_scorer(spark):
    docs, labels = made(spark)
    text = lambda df: df.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    model = T.fit(text(docs), text(labels))
    assert model is not None and len(model.thresholds) == 2
    rows = {r.doc_id: r for r in T.score(text(docs), model).collect()}
    for r in text(docs).collect():
        counts = {}
        for word in T.words_of(r.text):
            for f in T.features(word):
                if f in model.vocabulary:
                    counts[f] = counts.get(f, 0) + 1
        x = sum(model.weights[model.vocabulary[f]] * (1 + math.log(n)) for f, n in counts.items())
        above = [1 / (1 + math.exp(min(30, max(-30, t - x)))) for t in model.thresholds]
        assert abs(rows[r.doc_id].severity - sum(above)) < 1e-9 and abs(rows[r.doc_id].p_toxic - above[0]) < 1e-9
        grades = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
        assert rows[r.doc_id].grade == grades.index(max(grades))
