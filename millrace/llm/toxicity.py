"""Severity of toxic language by cumulative-link ordinal regression.

Sparse features are words and the beginnings of words, as exact strings: the
vocabulary is chosen on a labelled sample, so words outside it cannot collide
with it. With grades 0 < 1 < ... < K - 1 the model has one weight per feature,
shared by all thresholds: P(grade > j) = 1 / (1 + exp(t_j - w x)) with
t_0 < t_1 < ... . The expected severity is the sum of these over j.

Defined results: null, empty and word-free texts have no features and get the
severity of the intercepts alone, which is low; without labels of both kinds
every severity is 0; repeated rows are scored each, ties of grades go to the lower
one; texts are read whole, however long; keys may be of any type; an empty table
gives an empty result. Scoring adds one struct
column, whose name may be chosen, and keeps all others, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .batches import steps
from .sampling import bounded_sample

#: Bounds of the training sample (labelled documents of each kind) and of the vocabulary.
SAMPLE = 2500
VOCABULARY = 2048
#: Lengths of the beginnings of words that are features besides the words.
BEGINNINGS = (4, 5, 6, 7)
#: A feature occurs in this many documents of the sample at least.
LEAST = 4
#: and its log odds ratio between the kinds is so many standard errors from 0.
LEAST_Z = 3.2
#: Distinct words, of at most so many characters, that a worker remembers.
CACHE, CACHED_CHARS = 300_000, 40

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word, ended by "$", and its beginnings."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Ordinal:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -30, 30)))


class Scorer:
    """w x of texts; x is 1 + log(count) of each feature."""

    def __init__(self, model: Ordinal):
        self.model, self.known = model, {}

    def score(self, text: str | None) -> float:
        counts: Counter[int] = Counter()
        known, vocabulary = self.known, self.model.vocabulary
        for word, n in Counter(words_of(text)).items():
            own = known.get(word)
            if own is None:
                if len(known) > CACHE:
                    known.clear()
                own = [vocabulary[f] for f in features(word) if f in vocabulary]
                if len(word) <= CACHED_CHARS:
                    known[word] = own
            for i in own:
                counts[i] += n
        if not counts:
            return 0.0
        index = np.fromiter(counts.keys(), np.int64, len(counts))
        return float((1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) @ self.model.weights[index])


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, weights: np.ndarray, width: int, ridge: float = 3e-6, steps: int = 700) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the weighted likelihood; rows, columns and values are a sparse matrix."""
    n, levels = len(grades), int(grades.max())
    w, low, gaps = np.zeros(width), np.array([2.0]), np.zeros(levels - 1)
    params = [w, low, gaps]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = weights / weights.sum()
    for step in range(1, steps + 1):
        t = np.concatenate([low, low + np.cumsum(np.exp(gaps))])
        x = np.bincount(rows, values * w[columns], n)
        up = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(t[None, :] - x[:, None], -30, 30))), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        here, there = up[at, grades], up[at, grades + 1]
        p = np.maximum(here - there, 1e-9)
        # d log p / dx, and through each threshold
        dh, dt = here * (1 - here), there * (1 - there)
        dx = share * (dh - dt) / p
        by_t = np.zeros(levels + 2)
        np.add.at(by_t, grades, -share * dh / p)
        np.add.at(by_t, grades + 1, share * dt / p)
        by_t = by_t[1:-1]
        grads = [-(np.bincount(columns, values * dx[rows], width)) + ridge * w, np.array([-by_t.sum()]), -np.exp(gaps) * np.cumsum(by_t[::-1])[::-1][1:]]
        for q, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, np.concatenate([low, low + np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Ordinal | None:
    """Fits on at most SAMPLE labelled documents of each kind, chosen by a hash of their key.

    The labels say toxic or not. Severity is how much of a toxic document is
    toxic language: those with a larger share of toxic words than the median one
    are graded 2, the other toxic ones 1, the rest 0. Which words are toxic is learned on the
    other half of the sample, so no document grades itself. The sample is
    weighted back to the kinds' shares of all labels.
    """
    with scratch.temporary(docs.sparkSession):
        return _fit(docs, labels, key, text, label)


def _told(rows: np.ndarray, columns: np.ndarray, n: np.ndarray, base: np.ndarray, held: dict[int, int], width: int) -> np.ndarray:
    """Occurrences in each document of the features that the other half's labels show to be toxic.

    `held` has the numbers of sampled documents of each kind, those without any feature too.
    """
    half, told = np.zeros(len(base), int), np.zeros(len(base))
    for y in (0, 1):  # halves of each kind
        half[base == y] = np.arange((base == y).sum()) % 2
    for own in (0, 1):
        other, odds = half[rows] != own, np.zeros(width)
        for y, sign in ((1, 1), (0, -1)):
            seen = np.bincount(columns[other & (base[rows] == y)], minlength=width)
            odds += sign * np.log((seen + 0.5) / (np.maximum(held[y] / 2 - seen, 0) + 0.5))
        told += np.bincount(rows, np.where(~other & (odds[columns] > 2), n, 0), len(base))
    return told


def _fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Ordinal | None:
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    totals = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    chosen = [bounded_sample(marks.where(F.col("y") == y), SAMPLE, "k") for y in (0, 1)]
    # Two bounded lists: SAMPLE keys each.
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "k")
    # Numbered as it is written: keys may be of any type.
    sample = scratch.store(sample.select(F.monotonically_increasing_id().alias("k"), "text", "y"), "labelled-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1, rows=64):
            names, of, ns, ys = [], [], [], []
            for k, words, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found: Counter[str] = Counter()
                for word in words_of(words):
                    found.update(features(word))
                names += found.keys()
                ns += found.values()
                of += [k] * len(found)
                ys += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(of, pa.int64()), pa.array(ns, pa.int64()), pa.array(ys, pa.int32())], ["f", "k", "n", "y"])

    table = scratch.store(sample.select("k", "text", "y").mapInArrow(count, "f string, k long, n long, y int"), "labelled-features")
    held = sample.groupBy("y").agg(F.count("*").alias("n")).collect()
    held = {r.y: r.n for r in held}
    if len(held) < 2:
        return None
    clean, toxic = held[0], held[1]
    by_feature = table.groupBy("f").agg(F.sum("y").alias("t"), F.count("*").alias("d")).where(F.col("d") >= LEAST)
    a, b = F.col("t") + 0.5, F.col("d") - F.col("t") + 0.5
    odds = F.log(a / (toxic + 1 - a)) - F.log(b / (clean + 1 - b))
    strength = odds / F.sqrt(1 / a + 1 / (toxic + 1 - a) + 1 / b + 1 / (clean + 1 - b))
    vocabulary = by_feature.select("f", odds.alias("odds"), strength.alias("z")).where(F.abs("z") > LEAST_Z).orderBy(F.abs("z").desc(), "f").limit(VOCABULARY)
    chosen_features = vocabulary.collect()
    if not chosen_features:
        return None
    number = {r.f: i for i, r in enumerate(chosen_features)}
    # At most two samples' rows by the vocabulary, as numbers.
    numbers = docs.sparkSession.createDataFrame(list(number.items()), "f string, c int")
    entries = table.join(F.broadcast(numbers), "f").select("c", "k", "n", "y").orderBy("k", "c").toArrow()
    columns, k, n, y = (entries.column(i).to_numpy() for i in range(4))
    _, first, rows = np.unique(k, return_index=True, return_inverse=True)
    values, base = 1 + np.log(n.astype(np.float64)), y[first]
    # Documents without any chosen feature count through one row of each kind.
    bare = [max(0, clean - int((base == 0).sum())), max(0, toxic - int((base == 1).sum()))]
    sizes = table.where(F.col("f").endswith("$")).groupBy("k").agg(F.sum("n").alias("m")).orderBy("k").toArrow()
    sizes = sizes.column(1).to_numpy()[np.searchsorted(sizes.column(0).to_numpy(), k[first])]
    told = _told(rows, columns, n, base, held, len(number)) / sizes
    middle = np.median(told[base == 1]) if (base == 1).any() else 0
    grades = np.append(np.where(base == 0, 0, np.where(told > middle, 2, 1)), [0, 1]).astype(int)
    scale = {0: totals[0] / clean, 1: totals[1] / toxic}
    weights = np.append(np.where(base == 0, scale[0], scale[1]), [bare[0] * scale[0] + 1e-6, bare[1] * scale[1] + 1e-6])
    if grades.max() < 2:
        grades[-1] = 1
    w, thresholds = fit_ordinal(rows, columns, values, grades, weights, len(number))
    return Ordinal(number, w, thresholds)


def severity(model: Ordinal | None, text: Column) -> Column:
    """A struct of severity (expected grade), grade (the likeliest), p_toxic (of any grade above 0)."""

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame({"severity": np.zeros(len(texts)), "grade": np.zeros(len(texts), np.int32), "p_toxic": np.zeros(len(texts))})
        if "scorer" not in remembered:
            remembered["scorer"] = Scorer(model)
        one = remembered["scorer"].score
        up = model.above(np.array([one(x) for x in texts]))
        grades = -np.diff(up, axis=1, prepend=1, append=0)
        return pd.DataFrame({"severity": up.sum(axis=1), "grade": grades.argmax(axis=1).astype(np.int32), "p_toxic": up[:, 0]})

    remembered: dict[str, Scorer] = {}
    return score(text)


#: From this probability of a grade above 0 on a document counts as toxic.
TOXIC_FROM = 0.4


def score(docs: DataFrame, model: Ordinal | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, severity, grade, p_toxic, toxic."""
    found = docs.select(F.col(key), severity(model, F.col(text)).alias("s"))
    return found.select(key, "s.severity", "s.grade", "s.p_toxic", (F.col("s.p_toxic") >= TOXIC_FROM).alias("toxic"))


def keep_clean(docs: DataFrame, model: Ordinal | None, text: str = "text") -> DataFrame:
    """The documents that are not toxic, with their columns."""
    return docs.where(severity(model, F.col(text)).getField("p_toxic") < TOXIC_FROM)
