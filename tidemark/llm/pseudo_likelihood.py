"""Language-model scores by masked pseudo-likelihood.

A small network predicts every word of a text from the ``SIDE`` words before and the ``SIDE`` after it, the word itself masked: the
neighbours' embeddings side by side, a tanh layer, a softmax over ``CLASSES`` classes of words and one over the words of
the class. A document's score is the sum of its words' conditional log-probabilities.

The vocabulary of the network is the most frequent words of all documents; every other word is one of ``OTHERS`` hash buckets to it, and
is scored as log p(bucket) + log p(word | bucket). Word counts are taken over the whole corpus: of a bucket with N words, D of them
distinct, a word that occurs n times has n / (N + D), and D / (N + D) is the share of unseen words, spread over the bucket's hashes. Every
task holds the counts of up to ``HELD`` words, the most frequent; those of rarer words are joined, so that no word is left out.

Training sees every document once. A hash of its id and text says in which of ``ROUNDS`` rounds and in which part of the round: a part for each ``PART`` words of
the corpus, ``MOST_PARTS`` at most, of more words beyond that. Every part starts from the common parameters, goes through its documents in order of
the hash, in minibatches, and gives its parameters with the number of words it saw; these are averaged by weight, in order of the parts, in a tree
of ``FAN`` per step, so that the driver gets FAN sets of parameters at most. Scores thus follow from the rows and not from how a table is split into files or tasks. Rows equal in id and text are put
together before the shuffle and count by their number, so that no part is large for them. Biases start at the corpus's word frequencies, so that
an untrained network is a unigram model.

Defined results: a text without words, or null, has n_tokens 0, log_prob 0 and no mean; repeated rows get a row each and
weigh in training as often; words that tie in count go by their hash; a very long text is scored whole, in batches of words; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .arrowmap import map_text
from .common import shared_table

SIDE, DIM, HIDDEN = 2, 12, 24
CLASSES, PER_CLASS, OTHERS = 32, 64, 256
SIZE = CLASSES * PER_CLASS
KNOWN = SIZE - OTHERS
#: Words whose counts every task holds, 16 bytes each, and the log-probability of a hash among those of its bucket.
HELD, LOG_HASH = 1 << 20, -(64 * np.log(2) - np.log(OTHERS))
ROUNDS, BATCH, RATE, FAN = 3, 8192, 0.01, 16
PART, MOST_PARTS = 1 << 19, 1 << 14
SHAPES = {"e": (SIZE + 1, DIM), "w": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "o": (CLASSES, HIDDEN, PER_CLASS), "ob": (CLASSES, PER_CLASS)}
Params = dict[str, np.ndarray]


def packed(p: Params) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in SHAPES)


def unpacked(data: bytes) -> Params:
    flat, out, at = np.frombuffer(data, dtype=np.float32), {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).copy()
        at += n
    return out


@dataclass
class Vocabulary:
    """Known words' hashes in order, the id of each, and how many words the documents have: ids are by falling count, so that classes go by frequency."""

    hashes: np.ndarray
    ids: np.ndarray
    words: int

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes: one look into a table by their first 16 bits, a search where several known words share those."""
        held, ids, several = self.table
        slot = (h >> tk.U64(48)).astype(np.int64)
        out = np.where(held[slot] == h, ids[slot], KNOWN + (h & tk.U64(OTHERS - 1)).astype(np.int64))
        if len(several) and len(at := np.flatnonzero(several[slot])):
            place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[place] == h[at]
            out[at[hit]] = self.ids[place[hit]]
        return out

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot = (self.hashes >> tk.U64(48)).astype(np.int64)
        held, ids = np.zeros(1 << 16, dtype=tk.U64), np.full(1 << 16, KNOWN)
        held[slot], ids[slot] = self.hashes, self.ids
        several = np.bincount(slot, minlength=1 << 16) > 1
        return held, ids, several if several.any() else np.empty(0, dtype=bool)


@dataclass
class Others:
    """Counts of the words outside the vocabulary: all and distinct ones of each bucket, and of each word that is held, by hash.

    Words with fewer than least occurrences are in counts only; there are none if least is 1.
    """

    total: np.ndarray
    distinct: np.ndarray
    hashes: np.ndarray
    n: np.ndarray
    least: int

    @cached_property
    def log_all(self) -> np.ndarray:
        return np.log(self.total + np.maximum(self.distinct, 1))

    @cached_property
    def log_unseen(self) -> np.ndarray:
        """Of a word that was not counted, before log_all is taken off."""
        return np.log(np.maximum(self.distinct, 1)) + LOG_HASH

    def log_probs(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log p(word | bucket) of hashes, and which are left to the join: they have the part of their bucket only."""
        k = (h & tk.U64(OTHERS - 1)).astype(np.int64)
        found, n = np.zeros(len(h), dtype=bool), np.ones(len(h), dtype=np.int64)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = self.hashes[place] == h
            n[found] = self.n[place[found]]
        rare = ~found if self.least > 1 else np.zeros(len(h), dtype=bool)
        return np.where(found | rare, np.log(n), self.log_unseen[k]) - self.log_all[k], rare


def context(tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The ids of the words around each word; SIZE stands for none."""
    out = np.full((len(tokens), 2 * SIDE), SIZE)
    for k in range(1, SIDE + 1):
        same = row[k:] == row[:-k]
        out[k:, SIDE - k][same] = tokens[:-k][same]
        out[:-k, SIDE + k - 1][same] = tokens[k:][same]
    return out


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One entry of each row of log_softmax(z); z is used up."""
    most = z.max(axis=1)
    own = z[np.arange(len(z)), at] - most
    z -= most[:, None]
    np.exp(z, out=z)
    return own - np.log(z.sum(axis=1))


def by_class(tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the words of each class that occurs."""
    kind = tokens // PER_CLASS
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for k in range(CLASSES):
        if bounds[k] < bounds[k + 1]:
            yield k, order[bounds[k] : bounds[k + 1]]


def log_probs(p: Params, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    """The log-probability of each word given those around it."""
    out = np.empty(len(tokens))
    for at in range(0, len(tokens), BATCH):
        t, c = tokens[at : at + BATCH], around[at : at + BATCH]
        h = np.tanh(p["e"][c].reshape(len(t), -1) @ p["w"] + p["b"])
        part = log_softmax_at(h @ p["c"] + p["cb"], t // PER_CLASS).astype(np.float64)
        for k, own in by_class(t):
            part[own] += log_softmax_at(h[own] @ p["o"][k] + p["ob"][k], t[own] % PER_CLASS)
        out[at : at + BATCH] = part
    return out


def gradients(p: Params, t: np.ndarray, c: np.ndarray, weight: np.ndarray | None = None) -> Params:
    """Of the mean negative log-probability of a batch, by weight if there is one."""
    share = np.full((len(t), 1), np.float32(1 / len(t))) if weight is None else (weight / weight.sum()).astype(np.float32)[:, None]
    x = p["e"][c].reshape(len(t), -1)
    h = np.tanh(x @ p["w"] + p["b"])
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = np.exp(log_softmax(h @ p["c"] + p["cb"]))
    d[np.arange(len(t)), t // PER_CLASS] -= 1
    d *= share
    g["c"], g["cb"] = h.T @ d, d.sum(axis=0)
    dh = d @ p["c"].T
    for k, own in by_class(t):
        d = np.exp(log_softmax(h[own] @ p["o"][k] + p["ob"][k]))
        d[np.arange(len(own)), t[own] % PER_CLASS] -= 1
        d *= share[own]
        g["o"][k], g["ob"][k] = h[own].T @ d, d.sum(axis=0)
        dh[own] += d @ p["o"][k].T
    dz = dh * (1 - h * h)
    g["w"], g["b"] = x.T @ dz, dz.sum(axis=0)
    dx = (dz @ p["w"].T).reshape(-1, DIM)
    flat = c.ravel()
    for i in range(DIM):
        g["e"][:, i] = np.bincount(flat, dx[:, i], SIZE + 1)
    return g


class Trainer:
    """Adam from given parameters, over documents in the order in which they come."""

    def __init__(self, p: Params):
        self.p, self.step, self.seen = p, 0, 0.0
        self.left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting: list[tuple[np.ndarray, int]] = []
        self.n = 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.q = {k: np.zeros_like(v) for k, v in p.items()}

    def add(self, tokens: np.ndarray, times: int) -> None:
        """A document, and how often it counts."""
        self.waiting.append((tokens, times))
        self.n += len(tokens)
        if self.n >= BATCH:
            self.go(False)

    def go(self, last: bool) -> None:
        """Learn whole batches of what waits, and the rest too if it is the last."""
        if self.waiting:
            n = [len(t) for t, _ in self.waiting]
            t = np.concatenate([t for t, _ in self.waiting]).astype(np.int64)
            self.left.append((t, context(t, np.repeat(np.arange(len(n)), n)), np.repeat([float(k) for _, k in self.waiting], n)))
        if not self.left:
            return
        t, c, w = (np.concatenate(x) for x in zip(*self.left))
        upto = len(t) if last else len(t) - len(t) % BATCH
        for at in range(0, upto, BATCH):
            to = min(at + BATCH, upto)
            self.learn(t[at:to], c[at:to], w[at:to])
        self.left, self.waiting, self.n = [(t[upto:], c[upto:], w[upto:])], [], len(t) - upto

    def learn(self, tokens: np.ndarray, around: np.ndarray, weight: np.ndarray) -> None:
        self.step += 1
        self.seen += weight.sum()
        for k, g in gradients(self.p, tokens, around, weight).items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.q[k] += 0.01 * (g * g - self.q[k])
            rate = RATE * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            self.p[k] -= np.float32(rate) * self.m[k] / (np.sqrt(self.q[k]) + np.float32(1e-6))


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, n of all words of all documents; counted in each task first, and given on whenever its table is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, dtype=tk.U64), np.empty(0, dtype=np.int64)
        for b in batches:
            for chunk in tk.chunks(b.column(0)):
                h, n = np.unique(tk.words(chunk, tk.FOLDED).hash, return_counts=True)
                both = np.concatenate([keys, h])
                keys, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["hash", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["hash", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def held_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes in order and counts of the most frequent words, up to HELD, and the smallest count that is in: all words of a count are in or out."""
    upto, least = 0, None
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["n"]):  # a row per distinct count
        least = r["n"] + 1 if least is None else least
        if upto + r["words"] > HELD:
            break
        upto, least = upto + r["words"], r["n"]
    else:
        least = 1
    t = counts.where(F.col("n") >= least).toArrow()  # HELD rows at most
    hashes, n = t["hash"].to_numpy().view(tk.U64), t["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order], least


def start(docs: DataFrame, seed: int) -> tuple[Vocabulary, Params, Others, DataFrame]:
    """The vocabulary, parameters that know word frequencies only, and the counts of other words: what is held, and of all words."""
    counts = shared_table(word_counts(docs))
    other = counts.groupBy(F.pmod("hash", F.lit(OTHERS)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("d"))  # a row per bucket; corrected below
    top = counts.orderBy(F.desc("n"), "hash").limit(KNOWN).collect()  # the vocabulary, of fixed size
    n, distinct = np.zeros(SIZE), np.zeros(OTHERS)
    for r in other.collect():
        n[KNOWN + r["k"]], distinct[r["k"]] = r["n"], r["d"]
    hashes = np.array([r["hash"] for r in top], dtype=np.int64)
    for i, r in enumerate(top):
        n[i] = r["n"]
        n[KNOWN + r["hash"] % OTHERS] -= r["n"]
        distinct[r["hash"] % OTHERS] -= 1
    others = Others(n[KNOWN:].copy(), distinct, *held_counts(counts))
    words = int(n.sum())
    n = np.maximum(n, 0) + 0.5
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    p["b"][:] = 0
    of_class = n.reshape(CLASSES, PER_CLASS)
    p["cb"] = np.log(of_class.sum(axis=1) / n.sum()).astype(np.float32)
    p["ob"] = np.log(of_class / of_class.sum(axis=1, keepdims=True)).astype(np.float32)
    order = np.argsort(hashes.view(tk.U64))
    return Vocabulary(hashes.view(tk.U64)[order], order.astype(np.int64), words), p, others, counts


LEARNED = "part int, weight double, params binary"


def learned(part: int, weight: float, params: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(weight)]), pa.array([params], pa.binary())], names=["part", "weight", "params"])


def dealt(docs: DataFrame, held, turn: int, rounds: int, parts: int) -> DataFrame:
    """part, key, tokens, times of the documents whose turn it is, those of a part in order in one task; 2 bytes a word, rows equal in a batch once."""
    key = F.xxhash64("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value[0]
        for b in batches:
            part, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            times: dict[tuple[int, int, bytes], int] = {}
            for chunk in tk.chunks(b.column(2)):
                w = tk.words(chunk, tk.FOLDED)
                ids = words.tokens(w.hash).astype("<i2")
                ends = np.cumsum(w.counts(len(chunk)))
                for i, (at, to) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist()), chunk.first):
                    if at < to:
                        row = part[i], keys[i], ids[at:to].tobytes()
                        times[row] = times.get(row, 0) + 1
            kinds = (pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in times], k) for i, k in enumerate(kinds)], pa.array(list(times.values()), pa.int64())], names=["part", "key", "tokens", "times"])

    mine = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", key).where(F.pmod("key", F.lit(rounds)) == turn)
    mine = mine.select(F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).cast("int").alias("part"), "key", "text")
    tokens = mine.mapInArrow(run, "part int, key bigint, tokens binary, times bigint")
    return tokens.repartitionById(parts, "part").sortWithinPartitions("part", "key", "tokens")


def trained(docs: DataFrame, vocabulary: Vocabulary, p: Params, turn: int, rounds: int) -> Params:
    """The parameters after one round over the documents whose turn it is."""
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, packed(p)))
    n = max(1, min(MOST_PARTS, -(-vocabulary.words // (rounds * PART))))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, int]]:
        """part, tokens, times; equal rows, which are neighbours, once."""
        last, times = None, 0
        for b in batches:
            for part, key, tokens, k in zip(*(c.to_pylist() for c in b.columns)):
                if (part, key, tokens) != last:
                    if last:
                        yield last[0], last[2], times
                    last, times = (part, key, tokens), 0
                times += k
        if last:
            yield last[0], last[2], times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(documents(batches), key=itemgetter(0)):
            trainer = Trainer(unpacked(held.value[1]))
            for _, tokens, times in rows:
                trainer.add(np.frombuffer(tokens, dtype="<i2"), times)
            trainer.go(True)
            yield learned(part, trainer.seen, packed(trainer.p))

    parts = shared_table(dealt(docs, held, turn, rounds, n).mapInArrow(run, LEARNED))
    while n > FAN:
        n = -(-n // FAN)
        groups = parts.withColumn("group", F.floor(F.col("part") / FAN).cast("int")).repartitionById(n, "group").sortWithinPartitions("part")
        parts = shared_table(groups.drop("group").mapInArrow(averaged, LEARNED))
    rows = sorted(parts.collect(), key=lambda r: r["part"])  # FAN at most
    if not rows:
        return p
    return unpacked(next(averaged(learned(r["part"], r["weight"], bytes(r["params"])) for r in rows)).column(2)[0].as_py())


def averaged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each FAN parts, which come in order: the parameters' mean by weight, one row at a time in memory."""
    rows = ((part // FAN, w, data.as_py()) for b in batches for part, w, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
    for group, of_group in groupby(rows, key=itemgetter(0)):
        total, weight = 0.0, 0.0
        for _, w, data in of_group:
            total, weight = total + np.frombuffer(data, dtype=np.float32).astype(np.float64) * w, weight + w
        yield learned(group, weight, (total / weight).astype(np.float32).tobytes())


def scorer(vocabulary: Vocabulary, p: Params, others: Others):
    def apply(texts: pa.Array) -> list[pa.Array]:
        n, total, left, left_n = [], [], [], []
        for chunk in tk.chunks(texts):
            w = tk.words(chunk, tk.FOLDED)
            t = vocabulary.tokens(w.hash)
            part = log_probs(p, t, context(t, w.row))
            at = np.flatnonzero(t >= KNOWN)
            within, rare = others.log_probs(w.hash[at])
            part[at] += within
            n.append(w.counts(len(chunk)))
            total.append(np.bincount(w.row, part, len(chunk)))
            left.append(w.hash[at[rare]])
            left_n.append(np.bincount(w.row[at[rare]], minlength=len(chunk)))
        n, total = np.concatenate(n), np.concatenate(total)
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(left_n))]).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(left).view(np.int64)))
        return [pa.array(n, pa.int64()), pa.array(total, pa.float64()), mean, rest]

    return apply


def fit(docs: DataFrame, rounds: int = ROUNDS, seed: int = 5) -> tuple[Vocabulary, Params, Others, DataFrame]:
    vocabulary, p, others, counts = start(docs, seed)
    for turn in range(rounds):
        p = trained(docs, vocabulary, p, turn, rounds)
    return vocabulary, p, others, counts


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, mean_log_prob, log_prob (natural, summed over the words) and n_tokens for each row of docs."""
    *model, counts = fit(docs, rounds)
    others = model[2]
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    scored = map_text(docs, ["doc_id"], lambda: scorer(*held.value), "n_tokens bigint, log_prob double, mean_log_prob double, rare array<bigint>")
    if others.least == 1:
        return scored.select("doc_id", "mean_log_prob", "log_prob", "n_tokens")
    scored = shared_table(scored.withColumn("row", F.monotonically_increasing_id()))
    words = scored.select("row", F.explode("rare").alias("hash")).join(counts.where(F.col("n") < others.least), "hash", "left")
    unseen = F.element_at(F.array(*[F.lit(float(x)) for x in others.log_unseen]), (F.pmod("hash", F.lit(OTHERS)) + 1).cast("int"))
    more = words.groupBy("row").agg(F.sum(F.coalesce(F.log(F.col("n").cast("double")), unseen)).alias("more"))
    whole = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
    out = scored.drop("rare").join(more, "row", "left").withColumn("log_prob", whole)
    return out.select("doc_id", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"), "log_prob", "n_tokens")
