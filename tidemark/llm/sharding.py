"""K-d tree sharding by bytes, in DataFrame operations only.

Equal texts are one group; a group above an eighth of a shard's bytes is cut into pieces, by a hash of the id and of the row's number among those of the same id, so that
rows repeated under one id are spread too; every other group is one piece (pieces says how many). A piece has a size and three metadata coordinates: the
logarithm of its size, and the ranks of its language and source (the group's smallest) among those that occur. The tree splits the pieces at a weighted median along the dimension that is widest in the node,
until a leaf is one shard; a node of k shards gives floor(k / 2) / k of its bytes to the left. Medians are read from a
histogram of up to 512 parts per node, made on the executors: the driver sees 24 * 512 sums and never a row. The parts
hold about 1/512 of the node's pieces each, not of its bytes: a cut is off by at most the bytes of the part that it falls in, which may be
a large share of the node's where a few very long texts hold much of it. Nodes below refine a part, so the balance suffers and no row does.

Slots number a shard's rows without gaps: rows are spread over parts by a hash, the parts are counted, and
each part numbers its own rows after those of the parts before it; no task orders a whole shard.

Defined results: a null text has 0 bytes plus the 8 of each row, and the crc32 of an empty text; null and empty texts
are one group; a null language or source ranks first; pieces that tie in a dimension go by a hash; a very long text is one piece, which no cut divides; repeated rows get slots of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import copy_numbers, shared_table, small, unit_hash

SHARDS = 24
ROW_BYTES = 8
#: Histogram parts per node, and rows that one task numbers.
PARTS, SLOT_ROWS = 512, 20_000
#: A group above 1 / WHOLE of a shard is cut into pieces of 1 / PIECE of a shard.
WHOLE, PIECE = 8, 64
DIMENSIONS = ("d_size", "d_lang", "d_source")
#: The keys that bound the parts.
QUANTILES = f"percentile_approx(key, array({', '.join(f'{i / PARTS!r}D' for i in range(1, PARTS))}), {20 * PARTS})"


@dataclass(frozen=True)
class Node:
    """An inner node: pieces whose key along the dimension is at most the cut go left."""

    dimension: str
    low: float
    high: float
    cut: int
    left: int
    right: int


def ranks(groups: DataFrame) -> DataFrame:
    """dim (d_lang, d_source), value, rank (from 1) of the values that occur: sorted over ranges of them, and numbered after those of the ranges before."""
    values = groups.select(F.lit("d_lang").alias("dim"), F.col("lang").alias("value")).union(groups.select(F.lit("d_source"), F.col("source"))).where("value IS NOT NULL").distinct()
    sorted_ = values.repartitionByRange("dim", "value").sortWithinPartitions("dim", "value").withColumn("arrival", F.monotonically_increasing_id())
    return copy_numbers(shared_table(sorted_), ["dim"], "rank").select("dim", "value", (F.col("rank") + 1).alias("rank"))


def place(dimension: str, low: float, high: float) -> Column:
    """The coordinate scaled to 30 bits, then 32 bits of the piece's hash: an order without large ties."""
    span = max(high - low, 1e-9)
    scaled = F.floor((F.least(F.greatest(F.col(dimension), F.lit(low)), F.lit(high)) - low) / span * float((1 << 30) - 1))
    return F.shiftleft(scaled.cast("long"), 32) + F.pmod(F.xxhash64("g", "piece"), F.lit(1 << 32))


def walk(tree: dict[int, Node], at: int = 1) -> Column:
    """The leaf of a piece, as nested conditions."""
    if at not in tree:
        return F.lit(at)
    n = tree[at]
    return F.when(place(n.dimension, n.low, n.high) <= n.cut, walk(tree, n.left)).otherwise(walk(tree, n.right))


def grow(pieces: DataFrame, shards: int) -> tuple[dict[int, Node], dict[int, int]]:
    """The tree over the pieces, and the shard number of each leaf."""
    tree: dict[int, Node] = {}
    open_nodes = {1: shards}
    leaves: list[int] = []
    world = None
    while open_nodes:
        leaves += [k for k, n in open_nodes.items() if n == 1]
        open_nodes = {k: n for k, n in open_nodes.items() if n > 1}
        if not open_nodes:
            break
        here = pieces.withColumn("node", walk(tree)).where(F.col("node").isin(list(open_nodes)))
        spans = [f(d).alias(f"{d}_{f.__name__}") for d in DIMENSIONS for f in (F.min, F.max)]
        found = {r["node"]: r for r in here.groupBy("node").agg(*spans).collect()}  # one row per node, 24 at most
        if world is None:
            world = found.get(1)
        chosen: dict[int, tuple[str, float, float]] = {}
        for k in open_nodes:
            r = found.get(k)
            if r is None:
                chosen[k] = (DIMENSIONS[0], 0.0, 1.0)
                continue
            width = {d: (r[f"{d}_max"] - r[f"{d}_min"]) / max(world[f"{d}_max"] - world[f"{d}_min"], 1e-9) for d in DIMENSIONS}
            best = max(DIMENSIONS, key=lambda d: width[d])
            chosen[k] = (best, r[f"{best}_min"], r[f"{best}_max"])
        key = F.coalesce(*[F.when(F.col("node") == k, place(*c)) for k, c in chosen.items()])
        keyed = here.select("node", "bytes", key.alias("key"))
        found = keyed.groupBy("node").agg(F.array_sort(F.array_distinct(F.expr(QUANTILES))).alias("edges")).collect()  # 24 rows of PARTS numbers at most
        edges = {r["node"]: r["edges"] for r in found}
        sums: dict[int, dict[int, int]] = {}
        if edges:
            own = F.coalesce(*[F.when(F.col("node") == k, F.expr(f"array({', '.join(f'{v}L' for v in e)})")) for k, e in edges.items()])
            for r in keyed.groupBy("node", position(F.col("key"), own).alias("part")).agg(F.sum("bytes").alias("b")).collect():  # 24 * PARTS rows at most
                sums.setdefault(r["node"], {})[r["part"]] = r["b"]
        following: dict[int, int] = {}
        for k, n in open_nodes.items():
            parts, e = sums.get(k, {}), edges.get(k, [0])
            goal = sum(parts.values()) * (n // 2) / n
            upto, best = 0, None
            for i, v in enumerate(e):
                upto += parts.get(i, 0)
                if best is None or abs(upto - goal) < best[0]:
                    best = (abs(upto - goal), v)
            tree[k] = Node(*chosen[k], best[1], 2 * k, 2 * k + 1)
            following |= {2 * k: n // 2, 2 * k + 1: n - n // 2}
        open_nodes = following
    return tree, {k: i for i, k in enumerate(sorted(leaves, key=lambda k: f"{k:b}"))}


def position(key: Column, edges: Column) -> Column:
    """How many of the sorted edges, fewer than PARTS, are below the key: halving steps, each of which goes ahead if the edge that it reaches is below."""
    steps = F.expr(f"array({', '.join(str(PARTS >> i) for i in range(1, PARTS.bit_length()))})")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < key, at + step).otherwise(at))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, lang, source, pieces for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kept = docs.select("doc_id", "lang", "source", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g"))
    rows = shared_table(kept.withColumn("arrival", F.monotonically_increasing_id()))
    group = ["g", "text_crc32", "size"]
    groups = shared_table(rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source")))
    total = groups.agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("n")).first()
    n_rows = total["n"] or 0
    shard_bytes = max((total["b"] or 0) / shards, 1.0)
    held = F.col("size") * F.col("n")
    pieces_ = F.when(held <= shard_bytes / WHOLE, 1).otherwise(F.ceil(held / (shard_bytes / PIECE))).cast("long")
    known = shared_table(ranks(groups))
    n_known = known.count()
    for d, c in (("d_lang", "lang"), ("d_source", "source")):
        own = known.where(F.col("dim") == d).select(F.col("value").alias(c), F.col("rank").cast("double").alias(d))
        groups = groups.join(small(own, n_known), c, "left")
    groups = groups.select(*group, "n", pieces_.alias("pieces"), F.log2(F.col("size")).alias("d_size"), F.coalesce("d_lang", F.lit(0.0)).alias("d_lang"), F.coalesce("d_source", F.lit(0.0)).alias("d_source"))
    joined = shared_table(rows.join(shared_table(groups), group))
    # rows of large groups are numbered within their id: all others have few rows of one id and text
    large = (F.col("pieces") > 1) | (F.col("n") > SLOT_ROWS)
    numbered = copy_numbers(joined.where(large), ["g", "doc_id"], "copy")
    every = joined.where(~large).withColumn("copy", F.lit(0).cast("long")).unionByName(numbered)
    joined = shared_table(every.withColumn("piece", F.floor(unit_hash(F.col("doc_id"), F.col("g"), F.col("copy")) * F.col("pieces"))))
    pieces = shared_table(joined.groupBy("g", "piece", *DIMENSIONS).agg(F.sum("size").alias("bytes")))
    tree, numbers = grow(pieces, shards)
    names = F.create_map(*[F.lit(x) for k, v in numbers.items() for x in (k, v)])
    placed = joined.withColumn("node", walk(tree)).withColumn("shard", F.element_at(names, F.col("node")))
    spread = max(1, -(-n_rows // (shards * SLOT_ROWS)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "g", "copy"), F.lit(spread)).cast("int"))
    placed = shared_table(placed.select("doc_id", "size", "text_crc32", "shard", "part", "g", "copy", "lang", "source", "pieces"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")
    counts = counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), before.alias("before"))
    counts = small(counts, shards * spread)
    slots = placed.withColumn("slot", F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "g", "copy")) - 1)
    slots = slots.join(counts, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("before")).alias("slot"), "lang", "source", "pieces")


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """assign() under the law it holds: sizes of shards are near equal; no row has a shard in a grown set."""
    out = assign(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "lang", "source", "pieces")
