"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target number of words: its weight's share of all words, at most ``ceiling`` times its own words,
the excess going to the others by weight. A source's whole part of target / words is certain copies of each of its documents. For the words still
missing each document has an inclusion probability, which grows with its size: k (1 + size / the source's mean size), with the k at which the expected words are
those that are missing, and 1 where that is above 1. Documents of probability 1 are taken first; the others are ranked by random odds over inclusion
odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the words are reached. So a longer document is likelier, and the shortest at
least about half as likely as one of mean size.

k follows from sums per size, of which a source has few; the rank of a document is cut by two histograms of 1,024 parts each per source and by an
ordered sum within one part of 2**20. No task orders the documents of a source, however large the source is. What comes back to the rows is
one cut per source.

Defined results: null texts have no words and, as empty ones, are never ranked; rows of null source are one source, last in order; a source without words
has target 0; rows of one id, source and size are interchangeable: they are numbered, each number has a rank of its own, and which row has which isn't said; ranks that tie go
by id and number; a null id ranks as an id of its own; very long texts are counted whole, and one above the missing words is taken if over half of it fits; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_PATTERN, bit_map, copy_numbers, fresh, maybe, shared_table, small

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix-1"
FINE, COARSE = 1 << 20, 1 << 10


@dataclass(frozen=True)
class Mix:
    """The plan for each source, how a row's number of copies follows from it, and which ids have several rows of one source and size (as a bit map)."""

    sources: DataFrame
    n_sources: int
    seed: str
    again: tuple[DataFrame, int]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def named(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def draw(doc_id: Column, copy: Column, seed: str) -> Column:
    """A number in (0, 1) that the id and, from the second on, the number among equal rows decide: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), named(doc_id), F.when(copy > 0, F.concat(F.lit(":"), copy.cast("string"))).otherwise(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weigh(size: Column) -> Column:
    """What a document's inclusion probability is k times of."""
    return size * F.col("n_rows").cast("double") / F.col("source_size").cast("double") + 1.0


def rank(u: Column, p: Column) -> Column:
    """q / (1 + q) for q = (u / (1 - u)) / (p / (1 - p)), in (0, 1), with 0 < p < 1."""
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def targets(sizes: DataFrame, weights: Sequence[float], ceiling: float) -> DataFrame:
    """Per source: source_size, target, whole copies, and the part of a copy that is left to draw.

    The targets are min(ceiling * source_size, level * weight) with the one level at which they add up to all words: sources ordered by ceiling *
    size / weight are full as long as the level, with them full, is above that. The windows run over one row per source.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("full", F.lit(float(ceiling)) * F.col("source_size"))
    by = W.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    rest = by.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.sum("full").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(every) - before) / F.sum("weight").over(rest))
    s = s.withColumn("open", F.col("level") * F.col("weight") < F.col("full"))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("open"), F.col("full") / F.col("weight"))).over(every))
    s = s.withColumn("target", F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least("full", F.col("level") * F.col("weight"))))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))
    s = s.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("whole", F.floor("share"))
    part = F.col("share") - F.col("whole")
    return s.select("source", "source_size", "n_rows", "target", "whole", part.alias("part"), (part * F.col("source_size")).alias("missing"))


def calibrated(sources: DataFrame, n: int, rows: DataFrame) -> DataFrame:
    """sources with k, and missing less the words of documents that are certain; full: the largest size that isn't.

    Sizes of a source from the largest down are certain as long as the k that is left without them gives them 1 or more. The windows run over a row per source and size.
    """
    sizes = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("c"))
    same = F.col("z.source").eqNullSafe(F.col("s.source"))
    g = sizes.alias("z").join(small(sources.where("part > 0"), n).alias("s"), same).select("s.*", "z.size", "z.c")
    down = W.partitionBy("source").orderBy(F.desc("size"))
    words = F.col("size") * F.col("c")
    square = F.col("size").cast("decimal(20,0)") * words.cast("decimal(18,0)")
    above = F.coalesce(F.sum(words).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = down.rowsBetween(0, W.unboundedFollowing)
    left = F.sum(square).over(rest).cast("double") * F.col("n_rows").cast("double") / F.col("source_size").cast("double") + F.sum(words).over(rest).cast("double")
    g = g.withColumn("above", above).withColumn("k", (F.col("missing") - F.col("above")) / left)
    k = g.where(F.col("k") * weigh(F.col("size")) < 1).groupBy("source").agg(F.max_by(F.struct("k", "above", "size"), "size").alias("m"))
    k = k.select(F.col("source").alias("ks"), F.col("m.k").alias("k"), F.col("m.above").alias("above"), F.col("m.size").alias("full"))
    found = sources.join(k, F.col("source").eqNullSafe(F.col("ks")), "left").drop("ks")
    return found.withColumn("missing", F.col("missing") - F.coalesce("above", F.lit(0))).drop("above")


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: float = CEILING, seed: str = SEED) -> Mix:
    """One row per source: source_size, target, whole, part, k, and the cut of the rank below which one more copy is taken."""
    given = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    rows = shared_table(given.withColumn("arrival", F.monotonically_increasing_id()))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = shared_table(targets(sums, weights, ceiling))
    n = sources.count()
    sources = shared_table(calibrated(sources, n, rows))
    equal = rows.where("size > 0").groupBy("doc_id", "source", "size").count().where("count > 1").select(named(F.col("doc_id")).alias("id")).distinct()
    again = bit_map(shared_table(equal), 16)
    marked = maybe(rows.withColumn("key", named(F.col("doc_id"))), again, "several", ["doc_id", "source", "size", "arrival"], "key")
    several = copy_numbers(marked.where("several").drop("several"), ["doc_id", "source", "size"], "copy")
    rows = marked.where("NOT several").drop("several").withColumn("copy", F.lit(0).cast("long")).unionByName(several)
    same = F.col("s.source").eqNullSafe(F.col("d.source"))
    drawn = rows.alias("d").join(small(sources, n).alias("s"), same).where((F.col("part") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("full")))
    ranked = drawn.select("d.source", "doc_id", "copy", "size", "missing", rank(draw(F.col("doc_id"), F.col("copy"), seed), F.col("k") * weigh(F.col("size"))).alias("r"))
    ranked = shared_table(ranked.withColumn("fine", F.floor(F.col("r") * FINE)))

    def crossing(df: DataFrame, part: Column) -> DataFrame:
        """The part of each source in which the missing words are reached, and the words before it."""
        sums = df.groupBy("source", part.alias("k")).agg(F.sum("size").alias("s"), F.min("missing").alias("missing"), F.min("base").alias("base"))
        total = F.sum("s").over(W.partitionBy("source").orderBy("k").rowsBetween(W.unboundedPreceding, 0)) + F.col("base")
        sums = sums.withColumn("upto", total).where((F.col("upto") > F.col("missing")) & (F.col("upto") - F.col("s") <= F.col("missing")))
        return sums.select("source", "k", (F.col("upto") - F.col("s")).alias("base"))

    def within(df: DataFrame, cut: DataFrame, part: Column) -> DataFrame:
        return df.drop("base").alias("r").join(small(cut, n).alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (part == F.col("c.k"))).select("r.*", "c.base")

    coarse = F.floor(F.col("fine") / (FINE // COARSE))
    first = within(ranked, crossing(ranked.withColumn("base", F.lit(0)), coarse), coarse)
    second = crossing(first, F.col("fine"))
    last = within(first, second, F.col("fine")).withColumn("low", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("r", "low", "copy").rowsBetween(W.unboundedPreceding, 0)) + F.col("base")
    taken = last.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("missing"))
    cut = taken.groupBy("source").agg(F.max(F.struct("r", "low", "copy")).alias("cut"))
    cut = second.select(F.col("source").alias("cs"), F.col("k").alias("cut_fine")).join(cut.withColumnRenamed("source", "ts"), F.col("cs").eqNullSafe(F.col("ts")), "left")
    cut = cut.select("cs", "cut_fine", F.col("cut.r").alias("cut_r"), F.col("cut.low").alias("cut_id"), F.col("cut.copy").alias("cut_copy"))
    found = sources.drop("missing").join(cut, F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs")
    return Mix(shared_table(found), n, seed, again)


def copies(mix: Mix, rows: DataFrame, keep: Sequence[str], size: str) -> DataFrame:
    """rows with the columns to keep and, for each row, source_size, target and copies (names made fresh against rows).

    Only rows whose id the bit map marks, those of repeated ids, are written out and numbered.
    """
    names = {x: fresh(x, rows.columns) for x in ("source_size", "target", "copies")}
    own = {x: fresh(x, rows.columns) for x in ("key", "several", "arrival", "copy", "task", "own")}
    marked = maybe(rows.withColumn(own["key"], named(F.col("doc_id"))), mix.again, own["several"], rows.columns, own["key"])
    several = marked.where(own["several"]).drop(own["several"])
    # under plain names, as the rows' own columns may be called anything
    plain = several.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col("doc_id"), F.col("source"), F.col(size).alias("size"), F.monotonically_increasing_id().alias("arrival"))
    numbered = copy_numbers(shared_table(plain), ["doc_id", "source", "size"], "copy")
    numbered = numbered.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns], F.col("copy").alias(own["copy"]))
    every = marked.where(~F.col(own["several"])).drop(own["several"]).withColumn(own["copy"], F.lit(0).cast("long")).unionByName(numbered)
    low, copy, words = F.coalesce(F.col("d.doc_id"), F.lit(-(1 << 63))), F.col(f"d.{own['copy']}"), F.col(f"d.`{size}`")
    weight = words * F.col("s.n_rows").cast("double") / F.col("s.source_size").cast("double") + 1.0
    open_ = (F.col("s.part") > 0) & (words > 0) & (words <= F.col("s.full"))
    r = F.when(open_, rank(draw(F.col("d.doc_id"), copy, mix.seed), F.col("s.k") * weight))
    fine = F.floor(r * FINE)
    at = (fine == F.col("s.cut_fine")) & (F.struct(r, low, copy) <= F.struct("s.cut_r", "s.cut_id", "s.cut_copy"))
    drawn = open_ & (F.col("s.cut_fine").isNull() | (fine < F.col("s.cut_fine")) | F.coalesce(at, F.lit(False)))
    certain = (F.col("s.part") > 0) & (words > F.col("s.full"))
    n = F.col("s.whole") + F.when(drawn | certain, 1).otherwise(0)
    joined = every.alias("d").join(small(mix.sources, mix.n_sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return joined.select(*[F.col(f"d.`{x}`") for x in keep], F.col("s.source_size").alias(names["source_size"]), F.col("s.target").alias(names["target"]), n.cast("long").alias(names["copies"]))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for each row of docs."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = copies(plan(docs, **how), rows, ["doc_id", "source", "size"], "size")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of docs as many times as it is taken, with the columns of docs."""
    size = fresh("size", docs.columns)
    rows = docs.withColumn(size, word_count(F.col("text")))
    name = fresh("copies", rows.columns)
    out = copies(plan(docs, **how), rows, docs.columns, size)
    many = F.explode(F.array_repeat(F.lit(0), F.col(f"`{name}`").cast("int")))
    return out.where(F.col(f"`{name}`") > 0).withColumn(name, many).select(*[F.col(f"`{x}`") for x in docs.columns])
