"""Toxicity: bags of subwords, averaged embeddings, a linear softmax.

Words between blanks (A-Z as a-z) are broken into themselves and their byte n-grams of ``GRAMS`` with word ends marked; each
hashes to one of ``BUCKETS`` embeddings. A word's vector is the mean of its subwords', a text's the mean of its distinct words',
and a softmax over the classes stands on that. Embeddings and softmax are trained jointly in numpy, so a misspelt insult
that was never seen shares most n-gram vectors with the insult. As the softmax is linear, what a trained bucket adds
to the log odds is one number; texts are scored by looking those up, whole batches at once.

Up to ``sample`` labelled rows of the learning folds, and up to ``SAMPLE_BYTES`` of their texts, are fitted (chosen by a
hash of the id; a text that alone is longer is not). Only subwords that the labelled texts say something of are trained, others stay at zero: they would learn the sample by heart. Without labels the score is 0.5; with one class it is near that class's share.

Defined results: null and empty texts, which have no words, get the score of the intercept; repeated rows get a row
each; equal texts tie; a very long text is scored whole, in parts that end where a word does; ids that are labelled both ways are not learned from; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from . import textkernel as tk
from .arrowmap import map_text
from .common import fold, unit_hash
from .textstats import labelled_ids, of_row, repeated

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
SAMPLE, SAMPLE_BYTES = 6_000, 24 << 20
GRAMS = (3, 4, 5, 6)
BUCKETS, DIM = 1 << 18, 4
STEPS, RATE, DECAY = 200, 0.03, 1e-6
#: Words of no meaning that every mean also counts, so that a few words are less than certain.
SHRINK = 50
#: Standard errors and texts from which on a bucket is trained.
LEAST_Z, LEAST_TEXTS = 5.0, 5


@dataclass
class Subwords:
    """For each word of a chunk its subwords' buckets: word i has those from bounds[i] to bounds[i + 1]."""

    bounds: np.ndarray
    buckets: np.ndarray


def pad(chunk: tk.Chunk) -> tuple[tk.Chunk, np.ndarray]:
    """The chunk with a blank before and after every row, and for each byte of it whether it's a word's."""
    n, rows = len(chunk.data), len(chunk)
    size = np.diff(chunk.offsets)
    data = np.full(n + 2 * rows, 32, dtype=np.uint8)
    data[np.arange(n) + np.repeat(2 * np.arange(rows) + 1, size)] = chunk.data
    offsets = chunk.offsets + 2 * np.arange(rows + 1)
    return tk.Chunk(chunk.first, data, offsets), tk.FOLDED.inside[data]


def gram_hashes(data: np.ndarray, inside: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of GRAMS: where a gram of one word begins (its marks included) and the bucket of it."""
    code = np.where(inside, tk.FOLDED.code[data], tk.stream(909, 1)[0])
    up, down = tk.Powers.of(len(data) + 1)
    out = []
    with np.errstate(over="ignore"):
        upto = np.concatenate([np.zeros(1, dtype=tk.U64), np.cumsum(code * up[: len(data)], dtype=tk.U64)])
        blank = np.concatenate([[0], np.cumsum(~inside)])
        for k in GRAMS:
            n = len(data) - k + 1
            if n <= 0:
                continue
            # the bytes between first and last are a word's; not both ends alone with nothing between
            at = np.flatnonzero(blank[k - 1 : k - 1 + n] - blank[1 : 1 + n] == 0)
            h = (upto[at + k] - upto[at]) * down[at]
            out.append((at, (tk.mix(h + tk.U64(k)) >> tk.U64(46)).astype(np.int64)))
    return out


def pieces(chunk: tk.Chunk, limit: int = tk.CHUNK_BYTES) -> Iterator[tuple[int, tk.Chunk]]:
    """A chunk as it is, or one long text in parts of about limit bytes that end where a word does, with the row that each begins in."""
    n = len(chunk.data)
    if n <= 2 * limit:
        yield 0, chunk
        return
    for row in range(len(chunk)):
        at, past = int(chunk.offsets[row]), int(chunk.offsets[row + 1])
        while at < past:
            to = min(at + limit, past)
            while to < past and tk.FOLDED.inside[chunk.data[to]]:
                rest = np.flatnonzero(~tk.FOLDED.inside[chunk.data[to : min(to + limit, past)]])
                to = to + int(rest[0]) if len(rest) else min(to + limit, past)
            yield row, tk.Chunk(chunk.first, chunk.data[at:to], np.array([0, to - at]))
            at = to


def word_scores(chunk: tk.Chunk, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each word of a chunk, and the mean of the table over its subwords."""
    found = []
    for row, part in pieces(chunk):
        w, s = part_scores(part, table)
        found.append((w.row + row, w.hash, s))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64), np.empty(0, dtype=tk.U64), np.empty(0))


def part_scores(chunk: tk.Chunk, table: np.ndarray) -> tuple[tk.Words, np.ndarray]:
    padded, inside = pad(chunk)
    w = tk.words(padded, tk.FOLDED)
    if not len(w):
        return w, np.empty(0)
    total, count = np.zeros(len(padded.data) + 1), np.zeros(len(padded.data) + 1)
    for at, bucket in gram_hashes(padded.data, inside):
        total[at] += table[bucket]
        count[at] += 1
    # grams that begin at the blank before a word or in it belong to the word
    pairs = np.stack([w.start - 1, w.end], axis=1).ravel()
    own, n = np.add.reduceat(total, pairs)[::2], np.add.reduceat(count, pairs)[::2]
    whole = table[(tk.mix(w.hash) >> tk.U64(46)).astype(np.int64)]
    return w, (own + whole) / (n + 1)


def subwords(chunk: tk.Chunk) -> tuple[tk.Words, Subwords]:
    padded, inside = pad(chunk)
    w = tk.words(padded, tk.FOLDED)
    at, bucket = [np.arange(len(w))], [(tk.mix(w.hash) >> tk.U64(46)).astype(np.int64)]
    for where, b in gram_hashes(padded.data, inside):
        owner = np.searchsorted(w.start - 1, where, side="right") - 1
        ok = (owner >= 0) & (where < w.end[np.maximum(owner, 0)]) if len(w) else np.zeros(len(where), dtype=bool)
        at.append(owner[ok])
        bucket.append(b[ok])
    who, what = np.concatenate(at), np.concatenate(bucket)
    order = np.argsort(who, kind="stable")
    return w, Subwords(np.searchsorted(who[order], np.arange(len(w) + 1)), what[order])


@dataclass(frozen=True)
class Model:
    """What each bucket adds to the log odds, and the intercept."""

    table: np.ndarray
    intercept: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = []
        for chunk in tk.chunks(texts, 1 << 19):
            row, h, s = word_scores(chunk, self.table)
            _, later = repeated(of_row(h, row))
            row, s = row[~later], s[~later]
            n = np.bincount(row, minlength=len(chunk))
            out.append(self.intercept + np.bincount(row, s, minlength=len(chunk)) / (n + SHRINK))
        return np.concatenate(out) if out else np.empty(0)

    def score(self, texts: pa.Array) -> list[pa.Array]:
        return [pa.array(1 / (1 + np.exp(-np.clip(self.logits(texts), -35, 35))))]


def entries(chunk: tk.Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and their weights in the rows' averages; each pair once. wanted: buckets to look at, by default all."""
    w, sub = subwords(chunk)
    _, later = repeated(of_row(w.hash, w.row))
    n = np.bincount(w.row[~later], minlength=len(chunk))
    size = np.diff(sub.bounds)
    owner = np.repeat(np.arange(len(w)), size)
    keep = ~later[owner]
    if wanted is not None:
        keep &= wanted[sub.buckets]
    owner, bucket = owner[keep], sub.buckets[keep]
    row = w.row[owner]
    pair, at = np.unique(row * BUCKETS + bucket, return_inverse=True)
    weight = np.bincount(at, 1 / (size[owner] * (n[row] + SHRINK)), len(pair))
    return pair // BUCKETS, pair % BUCKETS, weight


def speaking(texts: pa.Array, y: np.ndarray) -> np.ndarray:
    """Buckets whose share of texts differs between the classes by LEAST_Z standard errors, or by fewer where there are few texts.

    Others, nearly all, would only learn the sample's texts by heart, and keep embeddings of zero.
    """
    seen = np.zeros((2, BUCKETS))
    for chunk in tk.chunks(texts, 1 << 19):
        row, bucket, _ = entries(chunk)
        for k in (0, 1):
            seen[k] += np.bincount(bucket[y[row + chunk.first] == k], minlength=BUCKETS)
    n = np.array([(y == k).sum() for k in (0, 1)])
    if not n.all():
        return np.zeros(BUCKETS, dtype=bool)
    p = seen.sum(axis=0) / n.sum()
    z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n).sum())
    # a bucket that tells n texts apart entirely is sqrt(n) standard errors off: with few labels less is asked
    return (np.abs(z) >= min(LEAST_Z, np.sqrt(n.sum()) / 3)) & (seen.sum(axis=0) >= min(LEAST_TEXTS, 1 + n.sum() / 20))


def fit(texts: list[str], toxic: np.ndarray, seed: int = 3) -> Model:
    """Full-batch Adam on the cross-entropy of embeddings and softmax together."""
    table = np.zeros(BUCKETS)
    if not len(texts):
        return Model(table, 0.0)
    y = np.asarray(toxic, dtype=int)
    share = (y.sum() + 0.5) / (len(y) + 1)
    column = pa.array(texts, pa.large_string())
    wanted = speaking(column, y)
    parts = [(row + c.first, bucket, weight) for c in tk.chunks(column, 1 << 19) for row, bucket, weight in [entries(c, wanted)]]
    doc, bucket, weight = (np.concatenate(x) for x in zip(*parts))
    if not len(doc):
        return Model(table, float(np.log(share / (1 - share))))
    used, place = np.unique(bucket, return_inverse=True)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 0.5, (DIM, 2)), np.log([1 - share, share])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, STEPS + 1):
        e, s, b = params
        v = e[place] * weight[:, None]
        h = np.stack([np.bincount(doc, v[:, i], len(y)) for i in range(DIM)], axis=1)
        z = h @ s * GAIN + b
        d = np.exp(z - z.max(axis=1, keepdims=True))
        d /= d.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        dv = (d @ s.T * GAIN)[doc] * weight[:, None]
        de = np.stack([np.bincount(place, dv[:, i], len(used)) for i in range(DIM)], axis=1)
        for k, g in enumerate([de + DECAY * e, h.T @ d * GAIN + DECAY * s, d.sum(axis=0)]):
            m, q = moments[k]
            m = 0.9 * m + 0.1 * g
            q = 0.99 * q + 0.01 * g * g
            moments[k] = m, q
            params[k] = params[k] - RATE * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-9)
    e, s, b = params
    table[used] = e @ (s[:, 1] - s[:, 0]) * GAIN
    return Model(table, float(b[1] - b[0]))


#: Averages are multiplied by this before the softmax, which sets the scale on which embeddings learn.
GAIN = 100.0

def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int, most_bytes: int) -> tuple[list[str], np.ndarray]:
    """About sample labelled texts at most, in an order that a hash of the id decides, as long as they have most_bytes bytes together; longer ones are passed over."""
    ids = labelled_ids(labels, label, sample)
    draw = unit_hash(F.col("doc_id"), F.lit(f"{label} text"))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(ids, "doc_id")
    sizes = texts.select("doc_id", draw.alias("draw"), F.octet_length("text").alias("b")).where(F.col("b") <= most_bytes).collect()  # a row per text of the sample
    left, taken = most_bytes, set()
    for r in sorted(sizes, key=lambda r: (r["draw"], r["doc_id"], r["b"])):
        if r["b"] <= left:
            taken.add((r["doc_id"], r["b"]))
            left -= r["b"]
    chosen = shared.local(docs.sparkSession, sorted(taken), f"id {docs.schema['doc_id'].dataType.simpleString()}, b int")
    rows = texts.join(chosen, (F.col("doc_id") == F.col("id")) & (F.octet_length("text") == F.col("b"))).select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"])
    return rows["text"].tolist(), rows["y"].to_numpy(dtype=int)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    learning = labels.where(fold("doc_id", FOLDS) != HELD_OUT)
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled_texts(docs, learning, "toxic", sample, SAMPLE_BYTES)))
    scored = map_text(docs, ["doc_id"], lambda: model.value.score, "score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
