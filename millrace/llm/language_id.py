"""Language identification by a byte convolutional network.

A text is cut into windows of a fixed number of bytes, all of them, in batches.
Filters of several widths run over the bytes of a window; the largest response
of each filter and a softmax over these give the window's language. A text's
language is the mean over its windows, weighted by their letters.

With one-hot bytes as input a filter of width w is w tables of 256 weights, so a
convolution is a sum of table rows. The network is trained in numpy on windows
of a bounded sample of labelled documents.

Defined results: a null text, an empty one or one without letters is `und` with
score 0; if nothing is labelled every text is `und`; repeated rows are predicted
each; ties go to the first language by name; texts are read whole, however long;
further columns of the input are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .batches import steps
from .sampling import bounded_in_groups

WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
WINDOW = 128
#: Bounds of the training sample for each language: documents, and windows out of all of theirs.
SAMPLE_DOCS = 2000
SAMPLE_WINDOWS = 4096
#: Windows scored at once.
_AT_ONCE = 1024
UNKNOWN = "und"

_LETTER = np.zeros(256, np.float32)
_LETTER[128:] = 1
_LETTER[[*range(65, 91), *range(97, 123)]] = 1


@dataclass
class ByteConvolution:
    languages: list[str]
    tables: np.ndarray  # (largest width, 256, filters): rows past a filter's own width are 0
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, filters); the last positions see padding bytes."""
        reach = len(self.tables)
        padded = np.pad(windows, ((0, 0), (0, reach - 1)))
        out = self.tables[0].take(padded[:, :WINDOW], axis=0)
        for j in range(1, reach):
            first = FILTERS * sum(w <= j for w in WIDTHS)  # narrower filters end before byte j
            out[:, :, first:] += self.tables[j][:, first:].take(padded[:, j : j + WINDOW], axis=0)
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(windows).max(axis=1) + self.bias, 0)
        return softmax(pooled @ self.dense + self.shift)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text's bytes; the last is filled with zeros."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 500, batch: int = 256, rate: float = 0.01, seed: int = 7) -> ByteConvolution:
    """Adam on the cross-entropy of single windows; languages count alike."""
    rng = np.random.default_rng(seed)
    reach, filters, n = max(WIDTHS), FILTERS * len(WIDTHS), len(languages)
    tables = rng.normal(0, 0.3, (reach, 256, filters)).astype(np.float32)
    for i, w in enumerate(WIDTHS):
        tables[w:, :, i * FILTERS : (i + 1) * FILTERS] = 0
    model = ByteConvolution(languages, tables, np.zeros(filters, np.float32), rng.normal(0, 0.3, (filters, n)).astype(np.float32), np.zeros(n, np.float32))
    params = [model.tables, model.bias, model.dense, model.shift]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    members = [np.flatnonzero(labels == k) for k in range(n)]
    width = np.repeat(WIDTHS, FILTERS)
    column = np.arange(filters)
    for step in range(1, steps + 1):
        own = rng.integers(0, n, batch)
        rows = np.array([members[k][rng.integers(len(members[k]))] for k in own])
        x = windows[rows]
        out = model.responses(x)
        at = out.argmax(axis=1)
        top = np.take_along_axis(out, at[:, None, :], axis=1)[:, 0] + model.bias
        pooled = np.maximum(top, 0)
        error = softmax(pooled @ model.dense + model.shift)
        error[np.arange(batch), own] -= 1
        error /= batch
        back = (error @ model.dense.T) * (top > 0)
        grad = np.zeros_like(model.tables)
        padded = np.pad(x, ((0, 0), (0, reach - 1)))
        for j in range(reach):
            bytes_ = np.take_along_axis(padded, at + j, axis=1)
            np.add.at(grad[j], (bytes_, np.broadcast_to(column, bytes_.shape)), back * (j < width))
        for p, g, m, v in zip(params, (grad, back.sum(0), pooled.T @ error, error.sum(0)), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return model


def fit(docs: DataFrame, trainable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteConvolution | None:
    """Trains on at most SAMPLE_DOCS trainable documents of each language, chosen by a hash of
    their key, and on SAMPLE_WINDOWS of all windows of their whole texts, chosen by a hash of
    their bytes; None if there are none. Rows without a key are not learned from."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            names, found = [], []
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = windows_of(words.encode("utf-8", "surrogatepass"))
                own = own[_LETTER[own].sum(axis=1) * 2 >= np.count_nonzero(own, axis=1)]
                names += [name] * len(own)
                found += map(bytes, own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], ["lang", "bytes"])

    usable = docs.where(trainable & F.col(key).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
    usable = usable.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    with scratch.temporary(docs.sparkSession):
        # Keys first: texts move only for the documents that are chosen.
        chosen = scratch.store(bounded_in_groups(usable.select("lang", "k"), SAMPLE_DOCS, "lang", "k"), "language-sample")
        windows = usable.join(chosen.distinct(), ["lang", "k"]).select("lang", "text").mapInArrow(sample, "lang string, bytes binary")
        windows = scratch.store(windows, "language-windows")
        rows = bounded_in_groups(windows, SAMPLE_WINDOWS, "lang", "bytes").orderBy("lang", "bytes").collect()
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    windows = np.frombuffer(b"".join(bytes(r.bytes) for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([number[r.lang] for r in rows]), languages)


def _letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict_texts(model: ByteConvolution | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and the score of each whole text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, scores
    own = [i for i, x in enumerate(texts) if x and _letters(x)]
    parts = [windows_of(texts[i].encode("utf-8", "surrogatepass")) for i in own]
    if not own:
        return names, scores
    windows, of = np.concatenate(parts), np.repeat(np.arange(len(own)), [len(p) for p in parts])
    sums = np.zeros((len(own), len(model.languages)))
    for at in range(0, len(windows), _AT_ONCE):
        x, k = windows[at : at + _AT_ONCE], of[at : at + _AT_ONCE]
        weighted = model.probabilities(x).astype(np.float64) * (_LETTER[x].sum(axis=1, dtype=np.float64)[:, None] + 1e-3)
        begins = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sums[k[begins]] += np.add.reduceat(weighted, begins, axis=0)
    sums /= sums.sum(axis=1, keepdims=True)
    for i, row in zip(own, sums):
        names[i], scores[i] = model.languages[int(row.argmax())], float(row.max())
    return names, scores


def predict(docs: DataFrame, model: ByteConvolution | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1, rows=256):
            names, scores = predict_texts(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("text")).mapInArrow(run, f"doc_key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("doc_key", key)
