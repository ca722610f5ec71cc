"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its set of five-word shingles (lower-case runs of word characters;
fewer words make one shingle), however often each occurs. Two texts are linked
if the Jaccard index of their sets is 0.8 or more; so all weights are 1. Each
shingle is a Poisson process of its weight's rate whose arrivals fall on
components of the signature at random; the first arrival on a component names
it, and a document ends as soon as no later arrival can be first. Two signatures
agree in a component with the probability Jaccard of the weighted shingles,
which at weights of 1 is the Jaccard index.

Texts that are equal are one node. Nodes that agree in all components of a band
share a bucket, and all links inside buckets are verified on the sets:

1. In each bucket the nodes are compared with one of them, the pivot, and the
   links make classes. Large groups of near copies become one class by about one
   comparison a node. A second round takes its pivots from other classes.
2. Buckets that still hold several classes go to an exact join. A set that is
   0.8-alike to another shares one of its rarest shingles with it, the first fifth
   and one more in order of frequency; the unique ones among these need no
   partner. What a set holds from its first shared shingle on must suffice for the
   overlap. Shingles of few nodes give the pairs of nodes of different classes;
   the nodes of others meet in blocks of bounded bytes, but for those of the
   shingle's largest class, which need not meet one another. So no comparison is
   left out, texts that share only a frequent passage are not even looked at,
   and the pairs of a large group are never written.

Links are given as one row for each node that a block connects; contraction of
all links makes the classes. Shingles are compared by 32-bit hashes.

Defined results: equal texts, empty ones too, are in one class; a null text is a
class of its own row's key; texts without a word are near nothing but their
copies; repeated rows are in one class; the class id is the smallest key of the
class (null if all are null); a long text is sketched whole; other columns don't
matter, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .batches import steps
from .components import components

WORDS = 5
SIMILARITY = 0.8
#: Rows of a band and bands: 1 - (1 - 0.8 ** 6) ** 28 = 0.9998 of pairs at 0.8 share a bucket.
ROWS, BANDS = 6, 28
COMPONENTS = ROWS * BANDS
#: Rounds of comparisons with pivots, before the exact join.
ROUNDS = 2
#: Nodes of a shingle whose pairs are written, at most.
PAIRED = 32
#: Nodes, and shingles of all of them, in a block of the exact join.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 19
#: Shingles of a batch that are sketched together.
_AT_ONCE = 1 << 17
#: Words, of at most so many characters, and texts that a worker remembers.
_CACHE, _CACHED_CHARS, _SEEN = 500_000, 40, 200_000

_WORD = re.compile(r"\w+")
_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= _CACHED_CHARS:
            self[word] = found
        return found


_words = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit integers: every bit depends on every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of all shingles of a text, in order."""
    found = _WORD.findall(text.lower()) if text else []
    if not found:
        return np.zeros(0, _U)
    if len(_words) > _CACHE:
        _words.clear()
    hashes = np.fromiter(map(_words.__getitem__, found), _U, len(found))
    n = max(1, len(hashes) - words + 1)
    out = np.zeros(n, _U)
    for i in range(min(words, len(hashes))):
        out = (out ^ hashes[i : i + n]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return _mix(out)


def probminhash(doc: np.ndarray, keys: np.ndarray, weights: np.ndarray, docs: int, m: int = COMPONENTS) -> np.ndarray:
    """Signatures (docs, m) of weighted sets given as flat arrays: document, element, weight.

    Arrivals are drawn in rounds for the elements that can still be first
    somewhere; with few elements left, many arrivals are drawn in one round.
    Documents without elements keep zeros.
    """
    best = np.full(docs * m, np.inf)
    first = np.zeros(docs * m, _U)
    time, drawn = np.zeros(len(keys)), np.zeros(len(keys), _U)
    while len(keys):
        rounds = int(np.clip((1 << 16) // len(keys), 1, 256))
        number = drawn[:, None] + np.arange(1, rounds + 1, dtype=_U)
        seed = _mix(keys[:, None] + number * _U(0x9E3779B97F4A7C15))
        uniform = ((seed >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        arrival = time[:, None] + np.cumsum(-np.log(uniform), axis=1) / weights[:, None]
        place = (_mix(seed + _U(0xD1B54A32D192ED03)) % _U(m)).astype(np.int64) + doc[:, None] * m
        at, when = place.ravel(), arrival.ravel()
        np.minimum.at(best, at, when)
        won = when == best[at]
        first[at[won]] = np.repeat(keys, rounds)[won]
        time, drawn = arrival[:, -1], drawn + _U(rounds)
        last = best.reshape(docs, m).max(axis=1)
        keep = time < last[doc]
        doc, keys, weights, time, drawn = doc[keep], keys[keep], weights[keep], time[keep], drawn[keep]
    return first.reshape(docs, m)


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), parts.shape[:2]) * _U(0xA0761D6478BD642F)
    for i in range(ROWS):
        out = _mix(out + parts[:, :, i])
    return out.view(np.int64)


def sketch(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets and distinct shingles (32-bit, sorted) of each text."""
    buckets = np.zeros((len(texts), BANDS), np.int64)
    sets: list[np.ndarray] = []
    held: list[tuple[int, np.ndarray]] = []
    n = 0

    def flush() -> None:
        if not held:
            return
        doc = np.repeat(np.arange(len(held)), [len(k) for _, k in held])
        keys = np.concatenate([k for _, k in held])
        buckets[[i for i, _ in held]] = bands(probminhash(doc, keys, np.ones(len(keys)), len(held)))

    for i, text in enumerate(texts):
        keys = np.unique(shingles(text))
        sets.append(np.unique((keys >> _U(32)).astype(np.uint32)))
        if len(keys):
            held.append((i, keys))
            n += len(keys)
        if n > _AT_ONCE:
            flush()
            held, n = [], 0
    flush()
    return buckets, sets


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
    return pa.LargeListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.zeros(0, kind.to_pandas_dtype()), kind)).cast(pa.list_(kind))


def _node(text: Column) -> Column:
    """One hash of the whole text, 128 bits: equal texts are one node."""
    return F.unhex(F.md5(text.cast("string")))


def _sketches(docs: DataFrame, text: str) -> DataFrame:
    """h (of the text), buckets (none for texts without words), shingles; a task gives each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in steps(batches, 1):
            new = []
            for i, h in enumerate(batch.column(0).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    new.append(i)
            if len(seen) > _SEEN:
                seen.clear()
            if not new:
                continue
            batch = batch.take(pa.array(new))
            buckets, sets = sketch(batch.column(1).to_pylist())
            found = [b if len(s) else b[:0] for b, s in zip(buckets, sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found, pa.int64()), _lists([s.view(np.int32) for s in sets], pa.int32())], ["h", "buckets", "shingles"])

    plain = docs.where(F.col(text).isNotNull()).select(_node(F.col(text)).alias("h"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "h binary, buckets array<long>, shingles array<int>")


def _least_size(n: Column) -> Column:
    """Shingles that a set of n and one alike share at least."""
    return F.ceil(F.round(n * SIMILARITY, 6)).cast("int")


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike; the sizes are looked at before the sets are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(x) + len(y) - len(np.union1d(x, y))
                if both >= SIMILARITY * (len(x) + len(y) - both) - 1e-6:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    sizes = nodes.select("h", F.size("shingles").alias("n"))
    pairs = pairs.join(sizes.select(F.col("h").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("h").alias("b"), F.col("n").alias("n_b")), "b")
    pairs = pairs.where(_least_size(F.greatest("n_a", "n_b")) <= F.least("n_a", "n_b")).select("a", "b")
    sets = [nodes.select(F.col("h").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("a", "b")]
    return pairs.join(sets[0], "a").join(sets[1], "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _few(rare: DataFrame, live: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that share a shingle of few nodes and may be alike."""
    rows = rare.join(live.where(F.col("nodes") <= PAIRED).select("s"), "s")
    left, right = (rows.select("s", *(F.col(c).alias(f"{c}_{x}") for c in ("h", "root", "n", "left"))) for x in ("a", "b"))
    met = left.join(right, "s").where((F.col("h_a") < F.col("h_b")) & (F.col("root_a") != F.col("root_b")))
    # At the first shingle that both have, what is left of either set holds all of the overlap.
    pairs = met.groupBy(F.col("h_a").alias("a"), F.col("h_b").alias("b")).agg(F.max(F.least("left_a", "left_b")).alias("left"), F.first(F.col("n_a") + F.col("n_b")).alias("n"))
    return pairs.where(F.col("left") >= F.ceil(F.round(F.col("n") * (SIMILARITY / (1 + SIMILARITY)), 6))).select("a", "b")


def _meetings(rare: DataFrame, live: DataFrame) -> DataFrame:
    """s, i, j, side, h, root: which nodes of each shingle s of many nodes meet, in pairs of blocks.

    The nodes of the shingle's largest class make blocks below 0, the others from
    0 on; the former meet the latter, and these one another.
    """

    def blocks(nodes: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    of = live.where(F.col("nodes") > PAIRED).select(
        "s",
        F.col("home.root").alias("home"),
        blocks(F.col("home.nodes"), F.col("home.shingles")).alias("homes"),
        blocks(F.col("nodes") - F.col("home.nodes"), F.col("shingles") - F.col("home.shingles")).alias("others"),
    )
    rows = rare.join(of, "s")
    at_home = F.col("root") == F.col("home")
    # Spread by the shingle too, so that blocks of different shingles are not alike.
    block = F.pmod(F.xxhash64("h", "s"), F.when(at_home, F.col("homes")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("block", F.when(at_home, -1 - block).otherwise(block))
    others = F.sequence(F.lit(0), F.col("others") - 1)
    met = F.when(at_home, others).otherwise(F.concat(F.sequence(-F.col("homes"), F.lit(-1)), others))
    met = rows.withColumn("other", F.explode(met))
    return met.select("s", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "h", "root")


def _linked(group: pa.Table) -> pa.Table:
    """Links among the nodes of one pair of blocks: each node and the smallest that it is connected to here."""
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    nodes, roots = group.column("h").to_pylist(), group.column("root").to_pylist()
    side = group.column("side").to_numpy()
    sets = [x.values.to_numpy() for x in group.column("shingles")]
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        member = np.zeros((len(sets), width), np.float32)
        member[row[lo:hi], column[lo:hi] - at] = 1
        overlap += member @ member.T
    union = sizes[:, None] + sizes[None, :] - overlap
    alike = overlap >= SIMILARITY * union - 1e-6
    if i != j:  # pairs inside a block are seen where the block meets itself
        alike &= side[:, None] != side[None, :]
    np.fill_diagonal(alike, True)
    label = np.arange(len(sets))
    while True:
        least = np.where(alike, label[None, :], len(sets)).min(axis=1)
        least = np.minimum(label, least)[np.minimum(label, least)]
        if (least == label).all():
            break
        label = least
    moved = [x for x in np.flatnonzero(label != np.arange(len(sets))) if roots[x] != roots[label[x]]]
    return pa.table({"a": pa.array([nodes[x] for x in moved], pa.binary()), "b": pa.array([nodes[x] for x in label[moved]], pa.binary())})


def _exact_links(several: DataFrame, nodes: DataFrame) -> DataFrame:
    """All links (a, b) between the classes of the nodes `several` (h, root)."""
    held = scratch.store(several.join(nodes, "h").select("h", "root", "shingles", F.size("shingles").alias("n")), "near-several")
    flat = held.select("h", "root", "n", F.explode("shingles").alias("s"))
    frequent = flat.groupBy("s").agg(F.count("*").alias("of")).where(F.col("of") > 1)
    own = Window.partitionBy("h")
    common = flat.join(scratch.store(frequent, "near-frequent"), "s").withColumn("place", F.row_number().over(own.orderBy("of", "s"))).withColumn("common", F.count("*").over(own))
    # The rarest shingles of a set are its unique ones; what is left of the prefix are the first of the others.
    prefix = F.col("n") - _least_size(F.col("n")) + 1 - (F.col("n") - F.col("common"))
    rare = common.where(F.col("place") <= prefix).select("s", "h", "root", "n", (F.col("common") - F.col("place") + 1).alias("left"))
    rare = scratch.store(rare, "near-rare")
    by_class = rare.groupBy("s", "root").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    home = F.max(F.struct("nodes", "root", "shingles")).alias("home")
    live = by_class.groupBy("s").agg(home, F.sum("nodes").alias("nodes"), F.sum("shingles").alias("shingles")).where(F.col("nodes") > F.col("home.nodes"))
    live = scratch.store(live, "near-live")
    few = _verified(scratch.store(_few(rare, live), "near-pairs"), held)
    met = _meetings(rare, live).join(held.select("h", "shingles"), "h")
    return few.unionByName(met.groupBy("s", "i", "j").applyInArrow(_linked, "a binary, b binary"))


def near_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """h, root: the class of every distinct text that has a near duplicate."""
    sketches = scratch.store(_sketches(docs, text), "near-sketches")
    found = sketches.where(F.size("buckets") > 0).groupBy("h").agg(F.first("buckets").alias("buckets"))
    in_bucket = scratch.store(found.select("h", F.explode("buckets").alias("bucket")), "near-buckets")
    shared = in_bucket.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("bucket")
    members = scratch.store(in_bucket.join(scratch.store(shared, "near-shared"), "bucket"), "near-members")
    # What verification needs, once for each node that shares a bucket.
    held = sketches.select("h", "shingles").join(members.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("shingles").alias("shingles"))
    nodes = scratch.store(held, "near-held")
    # Nodes of no class yet are classes of their own; a pivot is the last node of the last class of its bucket.
    rows, edges, classes = members.withColumn("root", F.col("h")), None, None
    for number in range(ROUNDS + 1):
        ends = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max(F.struct("root", "h")).alias("top")).where(F.col("low") != F.col("top.root"))
        ends = scratch.store(ends.select("bucket", F.col("top.root").alias("its_root"), F.col("top.h").alias("pivot")), "near-pivots")
        open_rows = rows.join(ends, "bucket")
        if number == ROUNDS:
            more = _exact_links(open_rows.select("h", "root").distinct(), nodes)
        else:
            pairs = open_rows.where(F.col("root") != F.col("its_root")).select(F.col("h").alias("a"), F.col("pivot").alias("b")).distinct()
            more = _verified(scratch.store(pairs, "near-pairs"), nodes)
        more = scratch.store(more, "near-edges")
        edges = more if edges is None else edges.unionByName(more)
        classes = components(edges)
        renamed = members.join(classes.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
        rows = scratch.store(renamed, "near-rows") if number < ROUNDS else rows
    return classes.select(F.col("node").alias("h"), "root")


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(h, root of its class) of texts with near duplicates, (class, first key, number of rows) of all classes."""
    near = near_classes(docs, text)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_key"), _node(F.col(text)).alias("h"))
    by_text = rows.groupBy("h").agg(F.min("doc_key").alias("first"), F.count("*").alias("n"))
    of = scratch.store(by_text.join(near, "h", "left").withColumn("root", F.coalesce("root", "h")), "near-roots")
    classes = scratch.store(of.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size")), "near-classes")
    return of.select("h", "root"), classes


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id (smallest key of its class), class_size (rows), kept (it is that one)."""
    with scratch.temporary(docs.sparkSession):
        of, classes = _classes(docs, key, text)
        by_text = scratch.store(of.join(classes, "root").select("h", "class_id", "class_size"), "near-class-of-text", keep=True)
    rows = docs.select(F.col(key).alias("doc_key"), _node(F.col(text)).alias("h"))
    out = rows.join(by_text, "h", "left")
    own = F.when(F.col("h").isNull(), F.col("doc_key")).otherwise(F.col("class_id"))
    return out.select(
        F.col("doc_key").alias(key), own.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.col("doc_key").eqNullSafe(own).alias("kept")
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their columns, one of each class: that with the smallest key, null keys last.

    Rows without a text stay, each.
    """
    ids = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_key"), _node(F.col(text)).alias("h"))
    # The smallest of (key is null, key, h): one key and one text for each text, then for each class.
    least = F.min(F.struct(F.col("doc_key").isNull().alias("last"), "doc_key", "h")).alias("m")
    with scratch.temporary(docs.sparkSession):
        near = near_classes(docs, text)
        of_text = ids.groupBy("h").agg(least).join(near, "h", "left").select("m", F.coalesce("root", "h").alias("root"))
        winners = of_text.groupBy("root").agg(F.min("m").alias("m")).select(F.col("m.doc_key").alias("won_key"), F.col("m.h").alias("won_h"))
        winners = scratch.store(winners, "near-winners", keep=True)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("doc_key"), _node(F.col(text)).alias("h"))
    kept = own.where(F.col("h").isNotNull()).join(winners, (F.col("h") == F.col("won_h")) & F.col("doc_key").eqNullSafe(F.col("won_key")))
    # Rows that repeat key and text are one document.
    kept = kept.dropDuplicates(["h", "won_key"]).select("row").unionByName(own.where(F.col("h").isNull()).select("row"))
    return kept.select("row.*")
