"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a target of words, its share by weight, but at most MOST times
its size; what is above goes to the others by weight until none is above. A
source's documents are put in an order drawn by a hash, and its words on a line
in that order; its target covers the line so many whole times and a beginning of
it once more. The taken line is cut in blocks. A tree splits the sources' exact
numbers of blocks among the output shards: each node draws half of its blocks
without replacement, which gives its left half a multivariate-hypergeometric
number of each source's, so every shard gets as many blocks and a random mixture
whose mean is the whole mixture. Each source then deals its blocks to the shards
in a permuted order. What is taken of a document are the words of it that lie in
dealt blocks. A shard shuffles its documents by another hash. All draws are
hashes: reruns agree.

Everything is DataFrame expressions. Numbers follow the size of the mix: shards
hold about WORDS_PER_SHARD words, so the tree has BLOCKS_PER_SHARD rows for each
of them, and its root, which is one task, some millions at 100 TB; the hash order
is cut in buckets of about BUCKET_ROWS documents, whose sums give the places on
the lines, so a source with a third of all rows is no task of its own. Sources
are rows, never a list; targets take one sort of them. Texts take no part but in
the last join.

Defined results: a null text has size 0 and nothing is taken of it; the null
source is a source, after all others; rows repeated in the input are documents
each; a null key is kept; a document longer than a block lies in several; other
columns don't matter, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST = 3
#: Output shards: a power of two, at least LEAST_SHARDS, and blocks of each.
LEAST_SHARDS = 16
WORDS_PER_SHARD = 1 << 27
BLOCKS_PER_SHARD = 64
#: Parts of a shard, each for a task of its own, when the mix is written.
SLICES = 8
#: Documents of a bucket of the hash order, on average, at most; and its least number of hexadecimal digits.
BUCKET_ROWS = 1 << 19
BUCKET_DIGITS = 2
SEED = 20


def n_words(text: Column) -> Column:
    """Runs of characters other than blank, tab, newline, vertical tab, form feed and return."""
    # Each run, with the space after it, becomes one letter.
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]++", "")
    return F.length(F.regexp_replace(bare, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def _source(source: Column) -> Column:
    """Never null, in the order of code points with the null source last."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _order(key: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """name, source_size, target of each source, from name and source_size: a row for each source."""
    by_name, every = Window.orderBy("name"), Window.partitionBy()
    cycle = F.array(*map(F.lit, weights))
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    # Sources reach their limit in the order of limit / weight; one is capped if its share of what the earlier ones leave is above its limit.
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "name").rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
    left = left.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    capped = F.col("source_size") * most * F.col("open") <= F.col("weight") * F.col("rest")
    left = left.withColumn("free", F.when(~capped, F.struct(F.col("source_size") / F.col("weight"), "name", "rest", "open")))
    # The first that isn't capped sets the level of all later ones.
    level = F.min("free").over(every)
    share = F.when(level.isNull() | capped & (F.struct(F.col("source_size") / F.col("weight"), "name") < F.struct(level["col1"], level["name"])), (F.col("source_size") * most).cast("double"))
    return left.select("name", "source_size", share.otherwise((F.col("weight") * level["rest"]) / level["open"]).alias("target"))


def _drawn(*parts: Column | int | str) -> Column:
    """A draw: a text whose order is random, and the same in every run."""
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *((x if isinstance(x, Column) else F.lit(str(x))).cast("string") for x in parts)))


def _each(quota: str, first: int) -> Column:
    return F.explode(F.sequence(F.lit(first).cast("long"), F.col(quota).cast("long") + (first - 1)))


def split(nodes: DataFrame) -> DataFrame:
    """node, name, quota of both halves of each node, from its own: exact numbers of blocks of each source.

    A node's blocks are drawn without replacement; the first half of the draws,
    the odd one too, goes left. Halves keep no row for sources that they have none of.
    """
    blocks = nodes.select("node", "name", _each("quota", 1).alias("i"))
    drawn = Window.partitionBy("node").orderBy(_drawn(F.col("node"), F.col("name"), F.col("i")), "name", "i")
    half = F.ceil(F.count("*").over(Window.partitionBy("node")) / 2)
    counted = blocks.withColumn("goes", (F.row_number().over(drawn) <= half).cast("long")).groupBy("node", "name").agg(F.sum("goes").alias("l"), F.count("*").alias("n"))
    halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("quota")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("l")).alias("quota")))
    return counted.select("name", F.explode(halves).alias("h")).select("h.node", "name", "h.quota").where(F.col("quota") > 0)


def splitting_tree(blocks: DataFrame, shards: int) -> DataFrame:
    """name, block (from 0), shard of all blocks; from name and n_blocks of each source."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    some = blocks.where(F.col("n_blocks") > 0)
    nodes = some.select(F.lit(1).cast("long").alias("node"), "name", F.col("n_blocks").cast("long").alias("quota"))
    for _ in range(shards.bit_length() - 1):
        nodes = split(nodes)
    own = Window.partitionBy("name")
    seats = nodes.select((F.col("node") - shards).alias("shard"), "name", _each("quota", 1).alias("i")).withColumn("seat", F.row_number().over(own.orderBy("shard", "i")))
    dealt = some.select("name", _each("n_blocks", 0).alias("block")).withColumn("seat", F.row_number().over(own.orderBy(_drawn("deal", F.col("name"), F.col("block")), "block")))
    return dealt.join(seats, ["name", "seat"]).select("name", "block", "shard")


@dataclass
class Draw:
    """What is drawn: `placed`, the documents on their sources' lines, with `copies`
    (copy, begin, words: what the target covers of each time the line is run
    through); `tree`, the blocks' shards; `block`, their length."""

    placed: DataFrame
    tree: DataFrame
    block: int
    shards: int

    def pieces(self) -> DataFrame:
        """The parts of documents in dealt blocks: columns of `placed`, copy, block, words, shard."""
        taken = self.placed.select("*", F.explode("copies").alias("c")).drop("copies")
        first, last = (F.floor(x / self.block) for x in (F.col("c.begin"), F.col("c.begin") + F.col("c.words") - 1))
        cut = taken.withColumn("block", F.explode(F.sequence(first, last)))
        end = F.least(F.col("c.begin") + F.col("c.words"), (F.col("block") + 1) * self.block)
        cut = cut.withColumn("words", end - F.greatest(F.col("c.begin"), F.col("block") * self.block)).withColumn("copy", F.col("c.copy"))
        return cut.join(self.tree, ["name", "block"])


def _draw(sized: DataFrame, weights: tuple[int, ...]) -> Draw:
    """From name, size and order of the documents; further columns stay."""
    n, digits = sized.count(), BUCKET_DIGITS
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("order", 1, digits))
    buckets = scratch.store(sized.groupBy("name", "bucket").agg(F.sum("size").alias("n")), "mix-buckets")
    aims = targets(buckets.groupBy("name").agg(F.sum("n").alias("source_size")), weights)
    aims = scratch.store(aims.withColumn("wanted", F.floor(F.col("target") + 0.5)), "mix-targets")
    total, shards = aims.agg(F.sum("wanted")).first()[0] or 0, LEAST_SHARDS
    while shards * WORDS_PER_SHARD < total:
        shards *= 2
    block = max(1, -(-total // (shards * BLOCKS_PER_SHARD)))
    tree = splitting_tree(aims.select("name", F.ceil(F.col("wanted") / block).alias("n_blocks")), shards)
    tree = scratch.store(tree, "mix-tree", keep=True)

    line = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.withColumn("base", F.coalesce(F.sum("n").over(line), F.lit(0))).select("name", "bucket", "base").join(aims, "name")
    bases = scratch.store(bases, "mix-bases")
    inside = Window.partitionBy("name", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["name", "bucket"])
    placed = placed.withColumn("begin", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")
    whole = F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(F.lit(0)).cast("int")
    part = F.greatest(F.lit(0), F.least(F.col("wanted") - whole * F.col("source_size") - F.col("begin"), F.col("size")))
    numbers = F.when(F.col("size") > 0, F.filter(F.sequence(F.lit(0), F.lit(MOST)), lambda c: (c < whole) | (c == whole) & (part > 0))).otherwise(F.array().cast("array<int>"))
    copies = F.transform(
        numbers,
        lambda c: F.struct(c.alias("copy"), (c * F.col("source_size") + F.col("begin")).alias("begin"), F.when(c < whole, F.col("size")).otherwise(part).alias("words")),
    )
    return Draw(scratch.store(placed.withColumn("copies", copies).drop("wanted"), "mix-placed", keep=True), tree, block, shards)


def _sized(docs: DataFrame, key: str, text: str, source: str, *more: Column) -> DataFrame:
    """The one pass over the texts for names, sizes and the hash order."""
    own = docs.select(_source(F.col(source)).alias("name"), n_words(F.col(text)).alias("size"), _order(F.col(key), F.col(text)).alias("order"), *more)
    return scratch.store(own, "mix-sized")


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: key, size, source_size, target, taken (words, repeats counted), parts.

    `parts` lists the shards and words of its parts, as shard:words, in the order of the line.
    """
    with scratch.temporary(docs.sparkSession):
        drawn = _draw(_sized(docs, key, text, source, F.col(key).alias("doc_key")), weights)
    columns = ["doc_key", "size", "source_size", "target"]
    # No two documents with words begin at one place of a line.
    grouped = drawn.pieces().groupBy("name", "begin").agg(
        *(F.first(c).alias(c) for c in columns), F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("copy", "block", "shard", "words"))).alias("parts")
    )
    parts = F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["words"].cast("string"))), ",")
    some = grouped.select(*columns, "taken", parts.alias("parts"))
    none = drawn.placed.where(F.size("copies") == 0).select(*columns, F.lit(0).cast("long").alias("taken"), F.lit("").alias("parts"))
    return some.unionByName(none).withColumnRenamed("doc_key", key)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed documents, whole, with their columns: one row for each copy, shard by shard, shuffled inside a shard.

    A document lies in the shard of the block in which its copy begins. Documents
    are not cut: one that the end of a source's target cuts is taken once more
    if at least half of it fits.
    """
    # Rows that are equal in all columns are told apart by nothing, and need not be.
    same = [F.xxhash64(F.lit(i), *(F.col(f"`{c}`") for c in docs.columns)).alias(f"same{i}") for i in (1, 2)]
    with scratch.temporary(docs.sparkSession):
        drawn = _draw(_sized(docs, key, text, source, *same), weights)
    copies = drawn.placed.select("name", "order", "size", "begin", "same1", "same2", F.explode("copies").alias("c")).where(F.col("c.words") * 2 >= F.col("size"))
    copies = copies.withColumn("block", F.floor(F.col("c.begin") / drawn.block)).join(drawn.tree, ["name", "block"])
    copies = copies.select("same1", "same2", "shard", F.xxhash64(F.lit(SEED + 2), "order", "c.copy", "begin").alias("at"))
    copies = copies.withColumn("slot", F.col("shard") * SLICES + F.pmod("at", F.lit(SLICES)))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *same).dropDuplicates(["same1", "same2"])
    out = rows.join(copies, ["same1", "same2"]).select("row", "slot", "at")
    return out.repartition("slot").sortWithinPartitions("slot", "at").select("row.*")


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> str:
    """The rows of `taken` over `documents` in DuckDB's SQL, for mixes of LEAST_SHARDS shards."""
    levels = LEAST_SHARDS.bit_length() - 1
    split = "".join(
        f"""
    b{k} AS (SELECT node, name, unnest(range(1, quota + 1)) AS i FROM n{k}),
    r{k} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY md5('{SEED}|' || node || '|' || name || '|' || i), name, i) <= ceil(count(*) OVER (PARTITION BY node) / 2) AS goes FROM b{k}),
    n{k + 1} AS (SELECT * FROM (
      SELECT 2 * node AS node, name, CAST(count(*) FILTER (goes) AS BIGINT) AS quota FROM r{k} GROUP BY node, name UNION ALL
      SELECT 2 * node + 1, name, CAST(count(*) FILTER (NOT goes) AS BIGINT) FROM r{k} GROUP BY node, name) WHERE quota > 0),"""
        for k in range(levels)
    )
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce('s' || source, 't') AS name,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS o
      FROM documents),
    s AS (SELECT name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY name),
    w AS (SELECT *, CAST([{', '.join(map(str, weights))}][(row_number() OVER (ORDER BY name) - 1) % {len(weights)} + 1] AS BIGINT) AS weight FROM s),
    l AS (
      SELECT *, CAST(source_size AS DOUBLE) / weight AS ratio,
             CAST(sum(source_size) OVER () - coalesce(sum({most} * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
             CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open
      FROM w),
    c AS (SELECT *, row_number() OVER (ORDER BY ratio, name) AS place, {most} * source_size * open <= weight * rest AS capped FROM l),
    f AS (SELECT min(place) AS place FROM c WHERE NOT capped),
    t AS (
      SELECT c.name, c.source_size,
             CASE WHEN f.place IS NULL OR c.place < f.place THEN CAST({most} * c.source_size AS DOUBLE)
                  ELSE CAST(c.weight * x.rest AS DOUBLE) / CAST(x.open AS DOUBLE) END AS target
      FROM c CROSS JOIN f LEFT JOIN c x ON x.place = f.place),
    p AS (
      SELECT d.doc_id, d.name, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS wanted,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.name ORDER BY d.o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
             row_number() OVER () AS id
      FROM d JOIN t USING (name)),
    k AS (SELECT CAST(greatest(1, ceil(coalesce(sum(CAST(floor(target + 0.5) AS BIGINT)), 0) / {LEAST_SHARDS * BLOCKS_PER_SHARD})) AS BIGINT) AS block FROM t),
    nb AS (SELECT name, CAST(ceil(CAST(floor(target + 0.5) AS BIGINT) / block) AS BIGINT) AS n_blocks FROM t, k),
    n0 AS (SELECT CAST(1 AS BIGINT) AS node, name, n_blocks AS quota FROM nb WHERE n_blocks > 0),{split}
    seats AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY shard, i) AS seat FROM (SELECT node - {LEAST_SHARDS} AS shard, name, unnest(range(1, quota + 1)) AS i FROM n{levels})),
    deal AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5('{SEED}|deal|' || name || '|' || block), block) AS seat FROM (SELECT name, unnest(range(0, n_blocks)) AS block FROM nb)),
    tree AS (SELECT deal.name, deal.block, shard FROM deal JOIN seats USING (name, seat)),
    c1 AS (SELECT *, unnest(range(0, {most + 1})) AS copy FROM p WHERE size > 0),
    c2 AS (SELECT *, copy * source_size + start AS first, CASE WHEN copy < wanted // source_size THEN size WHEN copy = wanted // source_size THEN greatest(0, least(wanted % source_size - start, size)) ELSE 0 END AS words FROM c1),
    c3 AS (SELECT *, unnest(range(first // (SELECT block FROM k), (first + words - 1) // (SELECT block FROM k) + 1)) AS b FROM c2 WHERE words > 0),
    c4 AS (SELECT c3.id, c3.copy, c3.b, tree.shard, least(first + words, (b + 1) * (SELECT block FROM k)) - greatest(first, b * (SELECT block FROM k)) AS n FROM c3 JOIN tree ON tree.name = c3.name AND tree.block = c3.b),
    c5 AS (SELECT id, CAST(sum(n) AS BIGINT) AS taken, string_agg(shard || ':' || n, ',' ORDER BY copy, b) AS parts FROM c4 GROUP BY id)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(parts, '') AS parts FROM p LEFT JOIN c5 USING (id)"""
