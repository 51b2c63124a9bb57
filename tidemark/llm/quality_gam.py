"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles. Boosting goes around the features in a cycle: a tree of up to four leaves
over a feature's bins is fitted to the logistic loss's gradients and, scaled by a small rate, added to
the feature's lookup table. Then the pairs whose coarse grid explains most of what is left get tables of their
own in the same way, from trees of one cut along each side. A score is the sigmoid of an intercept and one lookup
per feature and pair, added up for whole batches at once.

Up to ``sample`` labelled rows of the learning folds are fitted (chosen by a hash of the id). Without labels the
score is 0.5; with one class it is near that class.

Defined results: null and empty texts are scored by their counts of zero; equal texts tie; very long texts are counted whole; repeated rows get a row each; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats as ts
from .common import fold, shared_table

SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE = 120, 0.1


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def step(g: np.ndarray, h: np.ndarray, damp: float = 1.0) -> np.ndarray:
    return g / (h + damp)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A value per bin: the bins are cut one after another where that gains most of g squared over h."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best, found = 1e-12, None
        for i, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            left = cg[:-1] ** 2 / (ch[:-1] + 1)
            right = (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
            gain = left + right - cg[-1] ** 2 / (ch[-1] + 1)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (i, a + k + 1)
        if found is None:
            break
        i, at = found
        a, b = parts[i]
        parts[i : i + 1] = [(a, at), (at, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = step(g[a:b].sum(), h[a:b].sum())
    return out


def cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a grid cut once along each side, and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, value = -1.0, np.zeros_like(g)
    for i in range(1, len(g)):
        for j in range(1, g.shape[1]):
            quarters = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            a = np.array([c[i, j] for c in (cg, ch)]), np.array([c[i, -1] - c[i, j] for c in (cg, ch)]), np.array([c[-1, j] - c[i, j] for c in (cg, ch)])
            sums = [*a, np.array([c[-1, -1] for c in (cg, ch)]) - a[0] - a[1] - a[2]]
            gain = sum(s[0] ** 2 / (s[1] + 1) for s in sums)
            if gain > best:
                best, value = gain, np.zeros_like(g)
                for where, s in zip(quarters, sums):
                    value[where] = step(s[0], s[1])
    return value, best - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)


@dataclass(frozen=True)
class Gam:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[i], x[:, i])]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.coarse[i], x[:, i]), np.searchsorted(self.coarse[j], x[:, j])]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def edges_of(v: np.ndarray, bins: int) -> np.ndarray:
    q = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
    return q


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Gam:
    n, m = x.shape
    if not n:
        return Gam(0.0, [np.empty(0)] * m, [np.zeros(1)] * m, [np.empty(0)] * m, [])
    p = (y.sum() + 0.5) / (n + 1)
    edges = [edges_of(x[:, i], BINS) for i in range(m)]
    coarse = [edges_of(x[:, i], PAIR_BINS) for i in range(m)]
    at = [np.searchsorted(edges[i], x[:, i]) for i in range(m)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(n, np.log(p / (1 - p)))
    for _ in range(rounds):
        for i in range(m):
            s = sigmoid(z)
            v = RATE * tree(np.bincount(at[i], y - s, len(tables[i])), np.bincount(at[i], s * (1 - s), len(tables[i])))
            tables[i] += v
            z += v[at[i]]
    grid = [np.searchsorted(coarse[i], x[:, i]) for i in range(m)]

    def on_grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(grid[i] * shape[1] + grid[j], v, shape[0] * shape[1]).reshape(shape)

    s = sigmoid(z)
    gains = {(i, j): cross(on_grid(i, j, y - s), on_grid(i, j, s * (1 - s)))[1] for i, j in combinations(range(m), 2)}
    pairs = {ij: np.zeros((len(coarse[ij[0]]) + 1, len(coarse[ij[1]]) + 1)) for ij in sorted(gains, key=lambda ij: -gains[ij])[:PAIRS]}
    for _ in range(rounds // 4):
        for (i, j), t in pairs.items():
            s = sigmoid(z)
            v = RATE * cross(on_grid(i, j, y - s), on_grid(i, j, s * (1 - s)))[0]
            t += v
            z += v[grid[i], grid[j]]
    return Gam(float(np.log(p / (1 - p))), edges, tables, coarse, [(i, j, t) for (i, j), t in pairs.items()])


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    counted = shared_table(ts.text_stats(docs))
    learning = labels.where(fold("doc_id", FOLDS) != HELD_OUT)
    model = docs.sparkSession.sparkContext.broadcast(fit(*ts.labelled_sample(counted, ts.labelled_ids(learning, "quality", sample))))
    features = counted.select("doc_id", *[ts.feature(f).alias(f) for f in ts.FEATURES])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(ts.FEATURES))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(x.reshape(-1, len(ts.FEATURES))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = features.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
