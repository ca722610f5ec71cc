"""Packing documents into fixed windows whose mixture of sources is controlled.

Each source is a queue of tokens. Every window gives each queue its share of
the window's places; the fraction of a place that a queue is owed is its
deficit, carried to the next window and, because the served total before any
window has a closed form, to the first window of any partition. Before window w
the queues up to k have been served floor(w * size * S_k / S) places, where S_k
sums their shares: the deficit of a queue stays below one token, the quotas of a
window add up to its size, and a task finds the places of its own tokens from the
shares alone, without running the windows before them.

Queues leave when they are empty, and the rest share the windows. What fills no
whole window at the very end is laid into sequences of a power of two, which
need no padding.

The ids are written once, as a table in the shared folder; totals and starting
places of the queues come from its small columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, wordcache
from .batches import steps

#: Queues of sources that are too small for a place in every window share this one.
POOLED = "\x00pooled"
_cache: dict[str, wordcache.IdCache] = {}


@dataclass
class Phase:
    """`windows` windows of `size` places, shared by the queues in proportion to `shares`.
    `quotas`, if given, are the places of the single window instead."""

    first: int
    windows: int
    size: int
    shares: list[int]
    quotas: list[int] | None = None
    served: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.cumulated, self.total = [0], sum(self.shares)
        for x in self.shares:
            self.cumulated.append(self.cumulated[-1] + x)

    def before(self, k: int, w: int) -> int:
        """Places given to the first k queues in the first w windows of this phase."""
        return w * self.size * self.cumulated[k] // self.total

    def given(self, k: int, windows: int) -> int:
        if self.quotas is not None:
            return self.quotas[k] if windows else 0
        return self.before(k + 1, windows) - self.before(k, windows)

    def line(self, k: int, w: int, n: int) -> np.ndarray:
        """before(k, w .. w + n) as an array, exact for any totals below 2 ** 46."""
        start, rest = divmod(w * self.size * self.cumulated[k], self.total)
        step, more = divmod(self.size * self.cumulated[k], self.total)
        i = np.arange(n + 1, dtype=np.int64)
        return start + i * step + (rest + i * more) // self.total


#: Windows whose places are computed at once.
_SPAN = 1 << 16


class DeficitRoundRobin:
    """The places of every token of every queue, given the queues' totals and shares."""

    def __init__(self, totals: list[int], shares: list[int] | None = None, size: int = 2048):
        self.size, self.phases = size, []
        left, window = list(totals), 0
        served = [0] * len(left)
        shares = list(shares or totals)

        def add(phase: Phase) -> None:
            nonlocal window
            phase.served = list(served)
            for k in range(len(left)):
                n = phase.given(k, phase.windows)
                left[k] -= n
                served[k] += n
            window += phase.windows
            self.phases.append(phase)

        while (rest := sum(left)) > 0:
            now = [s if n else 0 for s, n in zip(shares, left)]
            if sum(now) == 0:
                now = list(left)  # queues without a share come last, together
            total = sum(now)
            # A queue can be served up to one place ahead of its share.
            windows = min((max(0, n - 1) * total // (s * size) for s, n in zip(now, left) if s), default=0)
            if len([x for x in now if x]) == 1:
                windows = max(windows, max(left[k] for k in range(len(left)) if now[k]) // size)
            elif sum(map(min, ((-(-size * s // total)) for s in now), left)) and now == [*totals] and rest == sum(totals):
                windows = rest // size  # every queue ends with the same window
            if windows:
                add(Phase(window, windows, size, now))
                continue
            places = size if rest >= size else 1 << (rest.bit_length() - 1)
            quotas, open_ = [0] * len(left), places
            while open_:
                live = [k for k in range(len(left)) if left[k] > quotas[k] and now[k]] or [k for k in range(len(left)) if left[k] > quotas[k]]
                weight = sum(now[k] or 1 for k in live)
                for k in live:
                    n = min(open_, left[k] - quotas[k], max(1, places * (now[k] or 1) // weight))
                    quotas[k] += n
                    open_ -= n
            add(Phase(window, 1, places, now, quotas))
        self.sequences = window

    def edges(self, k: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the tokens a to b of queue k: where each part begins in the queue, its sequence, its offset there."""
        starts, where, offsets = [], [], []
        for phase in self.phases:
            begin = phase.served[k]
            whole = phase.given(k, phase.windows)
            if begin >= b or begin + whole <= a or not whole:
                continue
            if phase.quotas is not None:
                starts.append(np.array([begin]))
                where.append(np.array([phase.first]))
                offsets.append(np.array([sum(phase.quotas[:k])]))
                continue
            share = phase.shares[k] * phase.size
            w = max(0, max(0, a - begin - 1) * phase.total // share - 1)
            last = min(phase.windows, (b - begin + 1) * phase.total // share + 2)
            while w < last:
                n = min(_SPAN, last - w)
                low, high = phase.line(k, w, n), phase.line(k + 1, w, n)
                starts.append(begin + (high - low)[:-1])
                where.append(phase.first + w + np.arange(n, dtype=np.int64))
                offsets.append(low[1:] - low[:-1])
                w += n
        starts, where, offsets = map(np.concatenate, (starts, where, offsets))
        # Windows that give the queue no place begin where the next one does: the last one counts.
        keep = np.append(starts[1:] > starts[:-1], True)
        return starts[keep], where[keep], offsets[keep]


def _encode(docs: DataFrame, tokenizer: str, end: int, key: str, text: str, source: str) -> DataFrame:
    """key, source, part, place (tokens of this source before, in this part), n_tokens, ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _cache:
            _cache[tokenizer] = wordcache.IdCache(tokenizer)
        ids_of, tail = _cache[tokenizer].ids, end.to_bytes(2, "little")
        part, placed = TaskContext.get().partitionId(), {}
        for batch in steps(batches, 2):
            places, lengths, ids = [], [], []
            for name, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids.append((ids_of(words) if words else b"") + tail)
                lengths.append(len(ids[-1]) // 2)
                places.append(placed.get(name, 0))
                placed[name] = places[-1] + lengths[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(ids), pa.int64()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_key", "queue", "part", "place", "n_tokens", "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    # Sources are marked so that a null one and the pool clash with no name.
    name = F.when(F.col(source).isNull(), F.lit("\x00null")).otherwise(F.col(source).cast("string"))
    return docs.select(F.col(key).alias("doc_key"), name.alias("queue"), F.col(text).alias("text")).mapInArrow(
        encode, f"doc_key {kind}, queue string, part long, place long, n_tokens long, ids binary"
    )


def pack(
    docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, targets: dict[str, int] | None = None, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Packs all documents; one row per piece of a document.

    Returns key, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, queue. A document is its ids and `end`. The
    mixture of each window follows `targets` (source -> integer weight, null
    source as None; sources not named have weight 0 and come last), or else the
    sources' shares of all tokens, so that all queues end together. Sources that
    would get less than one place in a window share one queue.

    A null or empty text is packed as its end token; rows repeated in the input
    are packed each, as documents of their own; a null key stays null; further
    columns are ignored; an empty table gives no pieces.
    """
    with scratch.temporary(docs.sparkSession):
        return _packed(docs, tokenizer, size, end, targets, key, text, source)


def _packed(docs: DataFrame, tokenizer: str, size: int, end: int, targets: dict[str, int] | None, key: str, text: str, source: str) -> DataFrame:
    tokens = scratch.store(_encode(docs, tokenizer, end, key, text, source), "tokens", keep=True)
    parts = tokens.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n"))
    by_source = scratch.store(parts, "token-parts")
    sums = by_source.groupBy("queue").agg(F.sum("n").alias("n"))
    everything = sums.agg(F.sum("n")).first()[0] or 0
    named = {("\x00null" if k is None else k): int(v) for k, v in (targets or {}).items() if v > 0}
    if named:
        floor = sum(named.values())
        own = sums.where(F.col("queue").isin([k for k, v in named.items() if v * size >= floor]))
    else:
        # At most `size` queues are that large, so what is collected is bounded.
        own = sums.where(F.col("n") * size >= everything)
    queues = sorted((r.queue, r.n) for r in own.collect())
    names = [q for q, _ in queues] + [POOLED]
    totals = [n for _, n in queues]
    totals.append(everything - sum(totals))
    shares = None
    if named:
        shares = [named[q] for q in names[:-1]] + [max(0, sum(named.values()) - sum(named[q] for q in names[:-1]))]
    elif 0 < totals[-1] * size < everything and len(totals) > 1:
        # The pool itself is below one place a window: its queue is lengthened by the smallest of the others.
        k = totals.index(min(totals[:-1]))
        totals[-1] += totals.pop(k)
        names.pop(k)
    robin = DeficitRoundRobin(totals, shares, size)
    number = {q: k for k, q in enumerate(names)}
    pool = number[POOLED]

    pairs = F.create_map(*[x for q, k in number.items() for x in (F.lit(q), F.lit(k))])
    # Sums of parts first: a pool of many small sources is no task of its own.
    numbered = by_source.withColumn("k", F.coalesce(F.try_element_at(pairs, F.col("queue")), F.lit(pool)))
    over_parts = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_bases = numbered.groupBy("k", "part").agg(F.sum("n").alias("m")).withColumn("part_base", F.coalesce(F.sum("m").over(over_parts), F.lit(0))).drop("m")
    inside = Window.partitionBy("k", "part").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        numbered.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(part_bases, ["k", "part"])
        .select(F.col("queue").alias("q"), F.col("part").alias("p"), "k", (F.col("part_base") + F.col("inside")).alias("base"))
    )
    starts = scratch.store(starts, "token-starts", keep=True)
    placed = tokens.join(starts, (F.col("q") == F.col("queue")) & (F.col("p") == F.col("part"))).select(
        "doc_key", "queue", "k", (F.col("base") + F.col("place")).alias("begin"), "n_tokens", "ids"
    )
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few enough ids for the 32-bit offsets of a list.
        for batch in steps(batches, 5, 1 << 25):
            ks, begins, lengths = (batch.column(i).to_numpy() for i in (2, 3, 4))
            ids = batch.column(5)
            for k in np.unique(ks):
                rows = np.flatnonzero(ks == k)
                rows = rows[np.argsort(begins[rows], kind="stable")]
                b, n = begins[rows], lengths[rows]
                # Documents of one queue and part follow one another; a new part starts elsewhere.
                for run in np.split(np.arange(len(rows)), np.flatnonzero(b[1:] != b[:-1] + n[:-1]) + 1):
                    yield _pieces(robin, int(k), batch, rows[run], b[run], n[run], ids)

    out = placed.mapInArrow(cut, f"doc_key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue string")
    return out.withColumnRenamed("doc_key", key)


def _pieces(robin: DeficitRoundRobin, k: int, batch: pa.RecordBatch, rows: np.ndarray, begins: np.ndarray, lengths: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    a, b = int(begins[0]), int(begins[-1] + lengths[-1])
    starts, where, offsets = robin.edges(k, a, b)
    cuts = np.union1d(begins, starts[(starts > a) & (starts < b)])
    size = np.diff(np.append(cuts, b))
    doc = np.searchsorted(begins, cuts, side="right") - 1
    part = np.searchsorted(starts, cuts, side="right") - 1
    row = pa.array(rows[doc])
    wide = [np.frombuffer(ids[int(r)].as_buffer(), "<u2").astype("<u4") for r in rows]
    flat = np.concatenate(wide).tobytes()
    ends = np.append((cuts - a) * 4, len(flat)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat)])
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(row), pa.array(cuts - begins[doc]), pa.array(size), pieces, pa.array(lengths[doc]), pa.array(where[part]), pa.array(offsets[part] + cuts - starts[part]), batch.column(1).take(row)],
        ["doc_key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "queue"],
    )
