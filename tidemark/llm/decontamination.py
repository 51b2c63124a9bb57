"""Benchmark decontamination by winnowed fingerprints.

Words are runs of ASCII digits and letters (A-Z as a-z) and of anything beyond ASCII. A window is ``span`` consecutive
words of a benchmark item; an item of fewer words is one window. On both sides the hash of every ``gram`` words is
formed, and of each run of span - gram + 1 such hashes the smallest is kept, the last of equals: a span that both
sides share has the same smallest hash in both, so it meets in a fingerprint for certain. Document fingerprints found
among the items' are extended: all windows around them are compared whole, as 64-bit hashes of their words. Items
shorter than a window have no such guarantee and are looked up at every position, by length.

A benchmark of at most ``block_bytes`` of text, the usual case, is sent to executors as one index: a single scan of the documents and no shuffle. A larger one
is fingerprinted on the executors, and a bit map of its fingerprints and window hashes, of 16 MB at most, is what is sent. A scan of the
documents gives the windows that pass it, which are few, and these are joined with the items' windows by a shuffle: there is one scan whatever the
benchmark's size, and neither it nor its hits come to the driver.

Defined results: a null or empty text has no words and is clean; items without an id or without words are not
looked for; repeated items count once per item_id; repeated documents get a row each; without items every document is
clean; very long texts are gone through whole, in parts of bounded size for hashing; windows that several items share count for each; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .arrowmap import map_text
from .common import fresh, shared_table

SPAN, GRAM = 10, 6
#: Text of a block of items; its index takes about 40 bytes a word.
BLOCK_BYTES = 16 << 20
REPORT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<first:bigint,past:bigint>>, items array<string>"


def winnow(h: np.ndarray, whole: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest of each width hashes, the last of equals; whole[i]: the i-th run of hashes is within one row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    least, at = h[:n].copy(), np.arange(n)
    for i in range(1, width):
        other = h[i : i + n]
        better = other <= least
        np.copyto(least, other, where=better)
        np.copyto(at, np.arange(i, i + n), where=better)
    return np.unique(at[whole[:n]])


def member(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash its place among the sorted keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == h, at, -1)


@dataclass(frozen=True)
class Index:
    """Fingerprints of long items, and by window length the window hashes with the items that have them."""

    span: int
    gram: int
    prints: np.ndarray
    lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # hashes, bounds, item numbers
    names: list[str]

    @classmethod
    def of(cls, items: Sequence[tuple[str, str]], span: int, gram: int) -> Index:
        names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(names)}
        prints, pairs = [np.empty(0, dtype=tk.U64)], {}
        width = span - gram + 1
        for chunk in tk.chunks(pa.array([text for _, text in items], type=pa.large_string())):
            w = tk.words(chunk, tk.ALNUM)
            g, _ = tk.grams(w, gram)
            _, whole = tk.grams(w, span)
            prints.append(g[winnow(g, whole, width)] if len(whole) else g[:0])
            counts = w.counts(len(chunk))
            owner = np.array([number[items[chunk.first + i][0]] for i in range(len(chunk))])
            for k in np.unique(np.minimum(counts[counts > 0], span)).tolist():
                h, same = tk.grams(w, k)
                own = same & ((counts[w.row[: len(same)]] == k) if k < span else (counts[w.row[: len(same)]] >= span))
                pairs.setdefault(k, []).append(np.stack([h[own], owner[w.row[: len(same)][own]].astype(tk.U64)]))
        lengths = {}
        for k, found in pairs.items():
            h, who = np.unique(np.concatenate(found, axis=1), axis=1)
            keys, first = np.unique(h, return_index=True)
            lengths[k] = keys, np.append(first, len(h)), who.astype(np.int64)
        return cls(span, gram, np.unique(np.concatenate(prints)), lengths, names)

    def windows(self, w: tk.Words) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """First words, length, and places among the window hashes, of all windows that occur."""
        found = []
        if self.span in self.lengths:
            g, _ = tk.grams(w, self.gram)
            whole_h, whole = tk.grams(w, self.span)
            width = self.span - self.gram + 1
            at = winnow(g, whole, width)
            at = at[member(self.prints, g[at]) >= 0]
            near = np.unique((at[:, None] - np.arange(width)).ravel())
            near = near[(near >= 0) & (near < len(whole))]
            near = near[whole[near]]
            place = member(self.lengths[self.span][0], whole_h[near])
            found.append((near[place >= 0], self.span, place[place >= 0]))
        for k, (keys, _, _) in self.lengths.items():
            if k < self.span:
                h, same = tk.grams(w, k)
                place = member(keys, h)
                at = np.flatnonzero((place >= 0) & same)
                found.append((at, k, place[at]))
        return found

    def report(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of REPORT."""
        n_words, n_hit, items, spans = [], [], [], []
        for chunk in tk.chunks(texts):
            w = tk.words(chunk, tk.ALNUM)
            n_words.append(w.counts(len(chunk)))
            cover = np.zeros(len(w) + 1, dtype=np.int64)
            owners: dict[int, set[int]] = {}
            for at, k, place in self.windows(w):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + k, -1)
                _, bounds, who = self.lengths[k]
                both = np.unique(w.row[at] * len(bounds) + place)  # each window once per row
                for row, p in zip((both // len(bounds)).tolist(), (both % len(bounds)).tolist()):
                    owners.setdefault(row, set()).update(who[bounds[p] : bounds[p + 1]].tolist())
            hit = np.cumsum(cover[:-1]) > 0
            n_hit.append(np.bincount(w.row[hit], minlength=len(chunk)))
            rows: list[list[dict]] = [[] for _ in range(len(chunk))]
            if hit.any():
                start_of = w.bounds(len(chunk))
                at = np.flatnonzero(hit)
                cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(w.row[at]) != 0)) + 1
                for part in np.split(at, cut):
                    row = int(w.row[part[0]])
                    rows[row].append({"first": int(part[0] - start_of[row]), "past": int(part[-1] + 1 - start_of[row])})
            spans += rows
            items += [sorted(self.names[i] for i in owners.get(r, ())) for r in range(len(chunk))]
        return columns(np.concatenate(n_words), np.concatenate(n_hit), items, spans)


def digest(items: Sequence[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def columns(n_words: np.ndarray, n_hit: np.ndarray, items: list[list[str]], spans: list[list[dict]]) -> list[pa.Array]:
    span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([digest(x) for x in items]), pa.array(n_hit > 0), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]


def listed(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The distinct items that have an id and a text, and their bytes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    return items, items.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0


def scan(docs: DataFrame, keep: Sequence[str], items: DataFrame, names: Sequence[str], span: int, gram: int) -> DataFrame:
    """docs' columns to keep and REPORT's under the given names, for items that one index holds."""
    rows = items.select("item", "text").collect()  # bounded by block_bytes
    index = docs.sparkSession.sparkContext.broadcast(Index.of([(r["item"], r["text"]) for r in rows], span, gram))
    parts = [p.split(" ", 1) for p in REPORT.split(", ")]
    schema = ", ".join(f"`{name}` {kind}" for name, (_, kind) in zip(names, parts))
    return map_text(docs, keep, lambda: index.value.report, schema)


def decontamination(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each of docs: its columns to keep and n_words, n_hit, n_items, items_sha256, contaminated, spans (of hit words), items.

    Names that clash with those of columns to keep get an underscore.
    """
    names = [fresh(p.split(" ", 1)[0], keep) for p in REPORT.split(", ")]
    items, size = listed(benchmark)
    if size <= block_bytes:
        return scan(docs, keep, items, names, span, gram)
    return joined(docs, keep, items, names, span, gram)


#: Salts that tell fingerprints, windows and lengths apart in one bit map.
_PRINT, _WINDOW = (tk.U64(x) for x in tk.stream(606, 2))
MOST_BITS, MAP_ROW = 27, 32_768


def marks(texts: pa.Array, span: int, gram: int) -> list[pa.Array]:
    """For each item its fingerprints, and the lengths and hashes of its windows."""
    prints, lengths, hashes = [], [], []
    for chunk in tk.chunks(texts):
        w = tk.words(chunk, tk.ALNUM)
        bounds = w.bounds(len(chunk))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            part = tk.Words(w.start[a:b], w.end[a:b], w.row[a:b], w.hash[a:b])
            k = min(b - a, span)
            g, whole = tk.grams(part, gram)[0], np.ones(max(b - a - span + 1, 0), dtype=bool)
            h = np.unique(tk.grams(part, k)[0]) if k else np.empty(0, dtype=tk.U64)
            prints.append(np.unique(g[winnow(g, whole, span - gram + 1)]).view(np.int64) if len(whole) else np.empty(0, dtype=np.int64))
            lengths.append(k)
            hashes.append(h.view(np.int64))
    return [pa.array(prints, pa.list_(pa.int64())), pa.array(lengths, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))]


def bit_of(h: np.ndarray, salt: np.uint64, bits: int) -> np.ndarray:
    return (tk.mix(h ^ salt) & tk.U64(bits - 1)).astype(np.int64)


def passing(bitmap: np.ndarray, h: np.ndarray, salt: np.uint64) -> np.ndarray:
    at = bit_of(h, salt, len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def candidates(texts: pa.Array, bitmap: np.ndarray, lengths: Sequence[int], span: int, gram: int) -> list[pa.Array]:
    """n_words, and the windows that the bit map lets pass: length, hash, first word. Long ones are looked at around fingerprints that pass."""
    n_words, found = [], []
    for chunk in tk.chunks(texts):
        w = tk.words(chunk, tk.ALNUM)
        n_words.append(w.counts(len(chunk)))
        first_of = w.bounds(len(chunk))
        rows: list[list[dict]] = [[] for _ in range(len(chunk))]
        for k in lengths:
            h, whole = tk.grams(w, k)
            at = np.flatnonzero(whole)
            if k == span:
                g, width = tk.grams(w, gram)[0], span - gram + 1
                near = winnow(g, whole, width)
                near = near[passing(bitmap, g[near], _PRINT)]
                at = np.unique((near[:, None] - np.arange(width)).ravel())
                at = at[(at >= 0) & (at < len(whole))]
                at = at[whole[at]]
            at = at[passing(bitmap, h[at], _WINDOW ^ tk.U64(k))]
            for i, x in zip(at.tolist(), h[at].view(np.int64).tolist()):
                row = int(w.row[i])
                rows[row].append({"k": k, "h": x, "first": i - int(first_of[row])})
        found += rows
    kind = pa.list_(pa.struct([("k", pa.int32()), ("h", pa.int64()), ("first", pa.int64())]))
    return [pa.array(np.concatenate(n_words), pa.int64()), pa.array(found, kind)]


def bit_rows(windows: DataFrame, items: DataFrame, span: int) -> tuple[np.ndarray, list[int]]:
    """The bit map of the items' fingerprints and windows, 2**MOST_BITS bits at most, and the lengths of windows. Its bits are gathered on the executors."""
    sums = items.agg(F.sum(F.size("prints") + F.size("hashes"))).first()[0] or 0
    bits = 1 << min(MOST_BITS, max(18, (16 * sums).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.empty(0, dtype=np.int64)]
            for prints, k, hashes in zip(*(b.column(i) for i in range(3))):
                out.append(bit_of(np.array(prints.as_py(), dtype=np.int64).view(tk.U64), _PRINT, bits))
                out.append(bit_of(np.array(hashes.as_py(), dtype=np.int64).view(tk.U64), _WINDOW ^ tk.U64(k.as_py()), bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["p"])

    places = items.select("prints", "k", "hashes").mapInArrow(run, "p bigint")
    rows = places.groupBy(F.floor(F.col("p") / MAP_ROW).alias("r")).agg(F.bitmap_construct_agg(F.col("p") % MAP_ROW).alias("map")).collect()  # 16 MB at most
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        bitmap[r["r"] * (MAP_ROW // 8) : (r["r"] + 1) * (MAP_ROW // 8)] = np.frombuffer(r["map"], dtype=np.uint8)
    return bitmap, [r["k"] for r in items.where("k > 0").select("k").distinct().orderBy("k").collect()]  # span lengths at most


def joined(docs: DataFrame, keep: Sequence[str], items: DataFrame, names: Sequence[str], span: int, gram: int) -> DataFrame:
    """decontamination() by a join of windows. Rows are written once with what the bit map lets pass, and known by a number from then on."""
    marked = shared_table(map_text(items, ["item"], lambda: lambda texts: marks(texts, span, gram), "prints array<bigint>, k int, hashes array<bigint>"))
    windows = marked.select("item", F.col("k").alias("wk"), F.explode("hashes").alias("wh")).distinct()
    held = docs.sparkSession.sparkContext.broadcast(bit_rows(windows, marked, span))
    row, counted, cand = (fresh(x, [*keep, *names]) for x in ("row_number", "counted", "candidates"))
    rows = map_text(docs, keep, lambda: lambda texts: candidates(texts, *held.value, span, gram), f"`{counted}` bigint, `{cand}` array<struct<k:int,h:bigint,first:bigint>>")
    rows = shared_table(rows.withColumn(row, F.monotonically_increasing_id()))
    some = rows.where(F.size(F.col(f"`{cand}`")) > 0).select(F.col(f"`{row}`").alias("row"), F.explode(F.col(f"`{cand}`")).alias("c")).select("row", "c.*")
    hits = some.join(windows, (F.col("k") == F.col("wk")) & (F.col("h") == F.col("wh")))
    span_ = F.struct(F.col("first"), (F.col("first") + F.col("k")).alias("past"))
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set(span_)).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    kind = "array<struct<first:bigint,past:bigint>>"
    start = F.array().cast(kind)
    last = lambda a: F.element_at(a, -1)
    joins = lambda a, x: (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["past"] >= x["first"])
    longer = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["first"].alias("first"), F.greatest(last(a)["past"], x["past"]).alias("past"))))
    united = F.aggregate("spans", start, lambda a, x: F.when(joins(a, x), longer(a, x)).otherwise(F.concat(a, F.array(F.struct(x["first"].alias("first"), x["past"].alias("past"))))).cast(kind))
    found = found.select(F.col("row").alias("found_row"), united.alias("found_spans"), F.col("items").alias("found_items"))
    both = rows.join(found, F.col(f"`{row}`") == F.col("found_row"), "left")
    spans, who = F.coalesce("found_spans", F.array().cast(kind)), F.coalesce("found_items", F.array().cast("array<string>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["past"] - x["first"])
    got = (F.col(f"`{counted}`"), n_hit, F.size(who).cast("bigint"), F.sha2(F.array_join(who, ",").cast("binary"), 256), F.col("found_row").isNotNull(), spans, who)
    return both.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(name) for c, name in zip(got, names)])


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without a hit, with their columns."""
    out = decontamination(docs, benchmark, docs.columns, **how)
    return out.where(~F.col(f"`{fresh('contaminated', docs.columns)}`")).select(*[F.col(f"`{c}`") for c in docs.columns])

