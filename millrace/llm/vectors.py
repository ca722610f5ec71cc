"""What both vector searches share: usable rows, and blocks of queries and candidates.

A stated set of queries meets all candidates in blocks, which are written once.
Blocks are dealt to cells, a few query blocks by a few candidate blocks: a
candidate block is sent to each group of query blocks, a query block to each
group of candidate blocks, and a cell is one key of the join. So a task reads
its cell's blocks and never all candidates, and more machines take more cells. A
task keeps, for each query of a cell, only the best rows; the rest of the merging
is a ranking per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Queries of a block: its matrix of 64 doubles a row is 1 MB.
QUERY_BLOCK = 2048
#: Candidates of a block.
CANDIDATE_BLOCK = 4096
#: Query blocks, and candidate blocks, of a cell at most.
CELL = 16


def usable(rows: DataFrame, key: str, vector: str, nonzero: bool = False) -> DataFrame:
    """vec_key and vector (doubles) of the rows that take part: no null, no null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0))
    if nonzero:
        out = out.where(F.exists(v, lambda x: x != 0))
    return out.select(F.col(key).cast("long").alias("vec_key"), v.alias("vector"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The doubles of a list column, one after another, and the lengths of its rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())


def pack_blocks(batches: Iterator[pa.RecordBatch], rows: int, code: Callable[[np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most `rows` vectors of one width; `code` turns their matrix into what is kept."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            ids = batch.column(0).to_numpy()
            values, widths = _flat(batch.column(1))
            ends = np.cumsum(widths)
            keys, blocks, sizes = [], [], []
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                matrix = values[(ends[own] - width)[:, None] + np.arange(width)]
                keys.append(ids[own].astype("<i8").tobytes())
                blocks.append(code(matrix))
                sizes.append(int(width))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blocks, pa.binary()), pa.array(sizes, pa.int32())], ["ids", "held", "width"])


def blocks(rows: DataFrame, size: int, code: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
    """A stored table of blocks: width, number (from 0, within the width), ids, held."""
    made = rows.mapInArrow(lambda it: pack_blocks(_gather(it, size), size, code), "ids binary, held binary, width int")
    # Ids are drawn once, when a block is written; the numbers come from them.
    made = scratch.store(made.withColumn("id", F.monotonically_increasing_id()), name)
    numbers = made.select("id", (F.row_number().over(Window.partitionBy("width").orderBy("id")) - 1).alias("number"))
    return made.join(scratch.store(numbers, f"{name}-numbers"), "id").drop("id")


def _cells(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The blocks of each cell (width, q_group, c_group), every pair of blocks of one width once."""
    n, tasks = candidates.count(), queries.sparkSession.sparkContext.defaultParallelism
    # Small tables are cut finer, so that all tasks have work.
    sizes = {"q": CELL, "c": int(min(CELL, max(1, n // (3 * tasks))))}
    sides = {}
    for x, table in (("q", queries), ("c", candidates)):
        sides[x] = table.select("width", F.floor(F.col("number") / sizes[x]).alias(f"{x}_group"), F.col("number").alias(f"{x}_block"), F.col("ids").alias(f"{x}_ids"), F.col("held").alias(f"{x}_held"))
    groups = {x: table.groupBy("width").agg(F.floor(F.max("number") / sizes[x]).alias("last")) for x, table in (("q", queries), ("c", candidates))}
    left = sides["q"].join(groups["c"], "width").withColumn("c_group", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    right = sides["c"].join(groups["q"], "width").withColumn("q_group", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    return right.join(left, ["width", "q_group", "c_group"])


Best = Callable[[np.ndarray, bytes, np.ndarray, bytes, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def search(queries: DataFrame, candidates: DataFrame, k: int, best: Best, score_type: str) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score; from two tables of `blocks`.

    `best(query ids, queries, candidate ids, candidates, width)` returns query
    positions, candidate positions and scores, k best or more of each query.
    """
    kind = np.float64 if score_type == "double" else np.int64

    def top(q_ids: np.ndarray, c_ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Of each query the k best; ties to the smaller id.
        order = np.lexsort((c_ids, -scores, q_ids))
        q_ids, c_ids, scores = q_ids[order], c_ids[order], scores[order]
        begins = np.flatnonzero(np.append(True, q_ids[1:] != q_ids[:-1])) if len(q_ids) else np.array([], np.int64)
        place = np.arange(len(q_ids)) - np.repeat(begins, np.diff(np.append(begins, len(q_ids))))
        return q_ids[place < k], c_ids[place < k], scores[place < k]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for q_ids, c_ids, scores in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(c_ids), pa.array(scores.astype(kind))], ["query_id", "vec_id", "score"])
            held.clear()

        for whole in batches:
            for at in range(whole.num_rows):
                row = {c: whole.column(c)[at] for c in whole.schema.names}
                here = tuple(row[c].as_py() for c in ("width", "q_group", "c_group"))
                if here != cell:
                    yield from flush()
                    cell = here
                q_ids, c_ids = (np.frombuffer(row[c].as_buffer(), "<i8") for c in ("q_ids", "c_ids"))
                i, j, scores = best(q_ids, row["q_held"].as_buffer(), c_ids, row["c_held"].as_buffer(), here[0])
                found, block = (q_ids[i], c_ids[j], scores), row["q_block"].as_py()
                if block in held:
                    found = tuple(map(np.concatenate, zip(held[block], found)))
                held[block] = top(*found)
        yield from flush()

    cells = _cells(queries, candidates)
    columns = ["width", "q_group", "c_group", "q_block", "q_ids", "q_held", "c_ids", "c_held"]
    found = cells.select(*columns).mapInArrow(meet, f"query_id long, vec_id long, score {score_type}")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _gather(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Joins small batches of a task so that its blocks are full."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
