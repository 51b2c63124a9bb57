"""Near-duplicates by SetSketch registers, banded, estimated jointly, and verified on whole shingle sets.

Every document's set of word shingles gives ``registers`` numbers: register i is the truncated, exponentially spaced
floor(1 - log_b(e_i / rate)) of the set's smallest i-th hash taken as an exponential variate e_i. Registers of a union are
the maxima of the parts' registers; the more alike two sets are, the more of their registers are equal.

1. Documents of one set are one text from here on (a grouping with partial minima; copies are never paired).
2. Bands of ``ROWS`` registers are keys; the number of bands keeps the odds of missing a pair at the threshold
   under ``MISS``. Each member of a bucket is paired with the bucket's smallest id only, its hub.
3. Pairs are screened by the likelihood of their Jaccard similarity given how many registers are smaller, greater
   and equal, jointly with both sets' sizes; what is likely far below the threshold goes.
4. Pairs left are verified exactly: spokes stream by their hub's set, a large hub's in several blocks.
5. Links give components. Buckets that still hold several are gone through exhaustively, in blocks of ``BLOCK`` members
   against the members outside of the bucket's largest component: every pair of the bucket that is not yet in one
   component is screened on registers and, where that is not conclusive, verified on whole sets.
   A pair is looked at in the first of its common bands only, and a task emits links, not pairs.
6. Components of all links.

So a bucket of n members costs n pairs and not n squared, unless its members differ; no pair of a common bucket
whose screening leaves it possible goes unverified, and no link is lost between them.

Defined results: a text without words, or null, has an empty set and is linked with nothing; a text of fewer words
than a shingle has its whole sequence as one shingle; repeated rows get a row each and equal component ids; rows of one id with different
texts are placed by their own texts; a row of null id takes part with null as its id where no other row has its
set, and then has component null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .arrowmap import map_text
from .common import bit_map, fresh, maybe, shared_table
from .components import components

ROWS, MISS = 5, 1e-6
BASE, RATE = 1.04, 20.0
#: A pair whose likeliest similarity is this many standard deviations below the threshold is let go.
SCREEN = 5.0
BLOCK, SPREAD = 512, 64


@dataclass(frozen=True)
class Sketcher:
    words: int
    percent: int

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def registers(self) -> int:
        return self.bands * ROWS

    @property
    def least(self) -> float:
        t = self.percent / 100
        return t - SCREEN * math.sqrt(t * (1 - t) / self.registers)

    def sketch(self, sets: list[np.ndarray]) -> np.ndarray:
        """Registers of each set; none of them may be empty."""
        n = np.array([len(s) for s in sets])
        x = np.concatenate(sets)
        first = np.cumsum(n) - n
        flips, steps = tk.stream(101, self.registers), tk.stream(202, self.registers) | tk.U64(1)
        least = np.empty((self.registers, len(sets)), dtype=tk.U64)
        work = np.empty_like(x)
        with np.errstate(over="ignore"):
            for i in range(self.registers):
                np.bitwise_xor(x, flips[i], out=work)
                np.multiply(work, steps[i], out=work)
                np.minimum.reduceat(work, first, out=least[i])
        u = np.minimum((least.T.astype(np.float64) + 1) / 2.0**64, 1 - 1e-15)
        k = np.floor(1 - (np.log(-np.log1p(-u)) - math.log(RATE)) / math.log(BASE))
        return np.clip(k, 0, 65535).astype(np.uint16)

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """Rows by bands: a hash of each band's registers, with the number of the band in its last six bits."""
        parts = registers.reshape(len(registers), self.bands, ROWS).astype(tk.U64)
        with np.errstate(over="ignore"):
            h = tk.mix((parts * tk.stream(303, ROWS)).sum(axis=2, dtype=tk.U64) + tk.stream(404, self.bands))
        return (h & ~tk.U64(63) | np.arange(self.bands, dtype=tk.U64)).view(np.int64)

    def likeliest(self, up: np.ndarray, down: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The similarity of the largest likelihood, given the numbers of registers that are greater in the first set and in the second, and the sets' sizes."""
        u, v = n / (n + m), m / (n + m)
        most = np.minimum(u / v, v / u)
        j = most[:, None] * np.linspace(0, 1, 101)[None, :]

        def p(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

        a = np.maximum(p(u[:, None] - v[:, None] * j), 1e-12)
        b = np.maximum(p(v[:, None] - u[:, None] * j), 1e-12)
        same = np.maximum(1 - a - b, 1e-12)
        like = up[:, None] * np.log(a) + down[:, None] * np.log(b) + (self.registers - up - down)[:, None] * np.log(same)
        return j[np.arange(len(j)), like.argmax(axis=1)]

    def possible(self, r: np.ndarray, s: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Which pairs of sketches may be of similar sets: by sizes first, then by likelihood."""
        out = 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
        if out.any():
            r, s = r[out], s[out]
            out[out] = self.likeliest((r > s).sum(axis=1), (r < s).sum(axis=1), n[out].astype(float), m[out].astype(float)) >= self.least
        return out

    def linked(self, common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | bool:
        return 100 * common >= self.percent * (n + m - common)

    def sets(self, chunk: tk.Chunk) -> list[np.ndarray]:
        return tk.shingle_sets(chunk, tk.FOLDED, self.words)


SKETCH = "n bigint, hi bigint, lo bigint, sketch binary"


def binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row."""
    width = rows.shape[1] * rows.itemsize
    where = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(rows))])


def sketches_of(column: pa.Array, registers: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, registers)


def sketched(how: Sketcher) -> Callable[[pa.Array], list[pa.Array]]:
    def apply(texts: pa.Array) -> list[pa.Array]:
        n, hi, lo, rows = [], [], [], []
        for chunk in tk.chunks(texts, 1 << 18):
            sets = how.sets(chunk)
            size = np.array([len(s) for s in sets])
            some = size > 0
            h, low, r = np.zeros(len(sets), dtype=tk.U64), np.zeros(len(sets), dtype=tk.U64), np.zeros((len(sets), how.registers), dtype=np.uint16)
            if some.any():
                full = [s for s in sets if len(s)]
                x = np.concatenate(full)
                first = np.cumsum(size[some]) - size[some]
                with np.errstate(over="ignore"):
                    h[some] = np.add.reduceat(tk.mix(x + tk.U64(0x5851F42D4C957F2D)), first)
                    low[some] = np.add.reduceat(tk.mix(x ^ tk.U64(0x14057B7EF767814F)), first)
                r[some] = how.sketch(full)
            n.append(size)
            hi.append(h)
            lo.append(low)
            rows.append(r)
        return [pa.array(np.concatenate(n), pa.int64()), *[pa.array(np.concatenate(v).view(np.int64)) for v in (hi, lo)], binary(np.concatenate(rows))]

    return apply


def banded(reps: DataFrame, how: Sketcher) -> DataFrame:
    """key, doc: a row for each band of each distinct set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = how.keys(sketches_of(b.column(1), how.registers))
                ids = np.repeat(b.column(0).to_numpy(), how.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "doc"])

    return reps.select("doc", "sketch").mapInArrow(run, "key bigint, doc bigint")


def screened(pairs: DataFrame, reps: DataFrame, how: Sketcher) -> DataFrame:
    """The dealt pairs doc, hub, block that the sketches leave possible."""
    a = reps.select(F.col("doc"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    b = reps.select(F.col("doc").alias("hub"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 4096):
                part = x.slice(at, 4096)
                r, s = (sketches_of(part.column(c), how.registers) for c in (4, 6))
                ok = how.possible(r, s, part.column(3).to_numpy(), part.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays(part.columns[:3], names=["doc", "hub", "block"]).filter(pa.array(ok))

    heads = pairs.select("hub", "block").distinct().join(b, "hub")
    joined = pairs.join(a, "doc").join(heads, ["hub", "block"]).select("doc", "hub", "block", "n1", "s1", "n2", "s2")
    return joined.mapInArrow(run, "doc bigint, hub bigint, block bigint")


def verified(pairs: DataFrame, texts: DataFrame, how: Sketcher) -> DataFrame:
    """The dealt pairs doc, hub, block whose whole sets are similar, as a, b."""
    t = needed(texts, pairs.select(F.col("doc").alias("id")).union(pairs.select("hub")).distinct())
    spokes = pairs.join(t, F.col("doc") == F.col("id")).select("hub", "block", F.lit(1).alias("role"), "doc", "text")
    heads = pairs.select("hub", "block").distinct().join(t, F.col("hub") == F.col("id")).select("hub", "block", F.lit(0).alias("role"), F.col("hub").alias("doc"), "text")
    rows = heads.unionByName(spokes).repartition("hub", "block").sortWithinPartitions("hub", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for x in batches:
            hub, block, role, doc = (x.column(i).to_pylist() for i in range(4))
            found = []
            for chunk in tk.chunks(x.column(4)):
                for i, s in enumerate(how.sets(chunk), chunk.first):
                    if (hub[i], block[i]) != at:
                        at, heads = (hub[i], block[i]), []
                    if not role[i]:
                        heads.append(s)
                    elif len(s) and any(len(h) and how.linked(common(h, s), len(h), len(s)) for h in heads):
                        found.append((doc[i], hub[i]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def dealt(pairs: DataFrame) -> DataFrame:
    """pairs doc, hub with a block each: spokes of hubs that have more than BLOCK of them are spread over SPREAD blocks."""
    large = pairs.groupBy("hub").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select(F.col("hub").alias("id"))
    marked = maybe(pairs, bit_map(large, 16), "large", ["doc", "hub"], "hub")
    return marked.select("doc", "hub", F.when(F.col("large"), F.pmod(F.xxhash64("doc"), F.lit(SPREAD))).otherwise(0).alias("block"))


def needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the texts whose id may be one of ids (a column id). What is left to shuffle follows the ids and not the texts."""
    t = maybe(texts.where(F.col("text").isNotNull()), bit_map(ids, 8), "set_bit", ["doc_id", "text"])
    return t.where("set_bit").select(F.col("doc_id").alias("id"), "text")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


class Group:
    """Members of a block of a bucket: those of the block, and guests that are compared with them."""

    def __init__(self, how: Sketcher, key: int):
        self.how, self.band = how, key & 63
        self.own: list[tuple] = []  # doc, label, hub, n, sketch, set
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.root.get(x, x)) != x:
            x = y
        return x

    def close(self) -> None:
        """Call when all own members are there."""
        self.doc, self.label, self.n = (np.array([r[i] for r in self.own], dtype=np.int64) for i in (0, 1, 3))
        self.sketch = np.stack([r[4] for r in self.own])
        self.index = None

    def candidates(self, row: tuple, upto: int) -> np.ndarray:
        """Places of the first upto own members that the row may be similar to and isn't yet known to be one with."""
        doc, label, hub, n, sketch = row[:5]
        ok = (self.label[:upto] != label) & (self.doc[:upto] != hub) & (self.doc[:upto] != doc)
        if doc == hub or not ok.any():
            return np.empty(0, dtype=np.int64)
        at = np.flatnonzero(ok & (100 * np.minimum(self.n[:upto], n) >= self.how.percent * np.maximum(self.n[:upto], n)))
        if not len(at):
            return at
        same = (self.sketch[at] == sketch).reshape(len(at), self.how.bands, ROWS).all(axis=2)
        at = at[same.argmax(axis=1) == self.band]  # pairs of an earlier common band are looked at there
        if len(at):
            at = at[self.how.possible(np.repeat(sketch[None, :], len(at), axis=0), self.sketch[at], np.full(len(at), n), self.n[at])]
        return at

    def links(self, row: tuple, upto: int) -> list[tuple[int, int]]:
        """Links of the row with own members of components that it isn't in, one for each."""
        at = self.candidates(row, upto)
        at = at[[self.find(int(x)) != self.find(row[1]) for x in self.label[at]]] if len(at) else at
        if not len(at):
            return []
        if self.index is None:
            h = np.concatenate([r[5] for r in self.own])
            who = np.repeat(np.arange(len(self.own)), [len(r[5]) for r in self.own])
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            self.index = keys, np.append(first, len(h)), who[order]
        keys, bounds, who = self.index
        where = np.minimum(np.searchsorted(keys, row[5]), len(keys) - 1)
        where = where[keys[where] == row[5]]
        n = bounds[where + 1] - bounds[where]
        pick = np.repeat(bounds[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(who[pick], minlength=len(self.own))[at]
        out = []
        for i in at[self.how.linked(shared, len(row[5]), self.n[at])].tolist():
            if self.find(int(self.label[i])) != self.find(row[1]):
                self.root[self.find(row[1])] = self.find(int(self.label[i]))
                out.append((row[0], int(self.doc[i])))
        return out


def grouped(batches: Iterator[pa.RecordBatch], how: Sketcher, exact: bool) -> Iterator[tuple[tuple, Group, tuple, int]]:
    """For each row of a (key, block) its group and the number of own members before it; own members come first.

    Columns: key, block, guest, doc, label, hub, n, sketch, and text if exact.
    """

    def rows() -> Iterator[tuple[tuple, tuple]]:
        for x in batches:
            cols = [x.column(i).to_pylist() for i in range(7)]
            sk = sketches_of(x.column(7), how.registers)
            if exact:
                for chunk in tk.chunks(x.column(8)):
                    for i, s in enumerate(how.sets(chunk), chunk.first):
                        yield (cols[0][i], cols[1][i], cols[2][i]), (cols[3][i], cols[4][i], cols[5][i], cols[6][i], sk[i], s)
            else:
                for i in range(x.num_rows):
                    yield (cols[0][i], cols[1][i], cols[2][i]), (cols[3][i], cols[4][i], cols[5][i], cols[6][i], sk[i])

    at, group, closed = None, None, True
    for (key, block, guest), row in rows():
        if (key, block) != at:
            if group is not None and not closed:
                group.close()
                yield from ((at, group, r, i) for i, r in enumerate(group.own))
            at, group, closed = (key, block), Group(how, key), False
        if guest:
            if not closed:
                if not group.own:
                    continue
                group.close()
                closed = True
                yield from ((at, group, r, i) for i, r in enumerate(group.own))
            yield at, group, row, len(group.own)
        else:
            group.own.append(row)
    if group is not None and not closed and group.own:
        group.close()
        yield from ((at, group, r, i) for i, r in enumerate(group.own))


MEMBER = "key bigint, block bigint, guest boolean, doc bigint, label bigint, hub bigint, n bigint, sketch binary"


def between(members: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, how: Sketcher) -> DataFrame:
    """Links a, b between members of one bucket that are in different components so far."""
    m = members.join(labels, F.col("doc") == F.col("node"), "left").select("key", "hub", "doc", F.coalesce("component", "doc").alias("label"))
    parts = m.groupBy("key", "label").agg(F.count("*").alias("c"))
    several = parts.groupBy("key").agg(F.count("*").alias("labels"), F.sum("c").alias("c"), F.max_by("label", F.struct("c", "label")).alias("major")).where("labels > 1")
    several = several.select("key", F.ceil(F.col("c") / BLOCK).alias("blocks"), "major")
    m = m.join(several, "key").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    every = F.when(F.col("label") == F.col("major"), F.array("own")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    m = m.withColumn("block", F.explode(every)).withColumn("guest", F.col("block") != F.col("own"))
    m = m.join(reps.select("doc", "n", "sketch"), "doc").select("key", "block", "guest", "doc", "label", "hub", "n", "sketch")
    m = m.repartition("key", "block").sortWithinPartitions("key", "block", "guest")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a possible pair."""
        out: dict[tuple, tuple] = {}
        last = None
        for at, group, row, upto in grouped(batches, how, exact=False):
            if at != last:
                if len(out) >= 1024:
                    yield packed(out)
                    out = {}
                last = at
            found = group.candidates(row, upto)
            if len(found):
                out[*at, row[0]] = (*at, upto == len(group.own) and not any(r is row for r in group.own), *row)
                for i in found.tolist():
                    own = group.own[i]
                    out[*at, own[0]] = (*at, False, *own)
        if out:
            yield packed(out)

    def packed(out: dict[tuple, tuple]) -> pa.RecordBatch:
        rows = list(out.values())
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], binary(np.stack([r[7] for r in rows]))], names=[c.split(" ")[0] for c in MEMBER.split(", ")])

    some = shared_table(m.mapInArrow(wanted, MEMBER).dropDuplicates(["key", "block", "doc"]))
    if some.isEmpty():
        return some.select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    t = needed(texts, some.select(F.col("doc").alias("id")).distinct())
    rows = some.join(t, F.col("doc") == F.col("id")).drop("id").repartition("key", "block").sortWithinPartitions("key", "block", "guest")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for _, group, row, upto in grouped(batches, how, exact=True):
            found += group.links(row, upto)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(exact, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    how = Sketcher(words, percent)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every = shared_table(map_text(ids, ["doc_id"], lambda: sketched(how), SKETCH))
    sets = every.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch"))
    reps = shared_table(sets.where("doc IS NOT NULL"))
    bands = banded(reps, how)
    hubs = bands.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = shared_table(bands.join(hubs, "key").select("key", "hub", "doc"))
    pairs = shared_table(dealt(shared_table(members.where("doc != hub").select("doc", "hub").distinct())))
    pairs = shared_table(screened(pairs, reps, how))
    links = shared_table(verified(pairs, ids, how))
    labels = components(links)
    more = shared_table(between(members, labels, reps, ids, how))
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    first = reps.join(labels, F.col("doc") == F.col("node"), "left").select("n", "hi", "lo", F.coalesce("component", "doc").alias("component"))
    found = every.drop("sketch").join(first, ["n", "hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, that of the smallest id, with the columns of docs.

    A row is known by its id, or, where other rows have that id too or it is null, by a hash of id and text, which counts as smaller than any id. So texts
    under one id are placed, and stay or go, each by itself; of rows equal in id and text one stays; rows of null id are as others. Texts without words are linked with
    nothing and stay, once per id.
    """
    names = {x: fresh(x, docs.columns) for x in ("set_bit", "row_key")}
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    own = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseOR(F.lit(-(1 << 63)))
    marked = maybe(docs, bit_map(shared_table(again), 16), names["set_bit"], docs.columns)
    key = F.when(F.col(names["set_bit"]) | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id").cast("bigint"))
    keyed = marked.withColumn(names["row_key"], key).drop(names["set_bit"])
    found = shared_table(near_duplicates(keyed.select(F.col(names["row_key"]).alias("doc_id"), "text"), words, percent).select("doc_id", "kept"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    equal = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    # only rows that may be among those gone or equal are shuffled with their texts
    rows = maybe(keyed, bit_map(gone.union(equal), 8), names["set_bit"], keyed.columns, names["row_key"])
    plain, other = rows.where(~F.col(names["set_bit"])).select(*[F.col(f"`{c}`") for c in docs.columns]), rows.where(names["set_bit"])
    left = other.join(gone, F.col(names["row_key"]) == F.col("id"), "left_anti").dropDuplicates([names["row_key"]])
    return plain.unionByName(left.select(*[F.col(f"`{c}`") for c in docs.columns]))
