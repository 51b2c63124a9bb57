"""Quality rules: base thresholds, and a decision list learned by sequential covering.

The list is learned from statistics of labelled documents. Each rule is a conjunction of thresholds for junk: on two
thirds of the rows not yet covered it grows by the condition of the largest information gain until it covers no good
row; on the other third its last conditions are pruned while that raises (junk - good) / (junk + good). It stays if
more than half of what it covers there is junk, and the rows it covers go. Rules come out in order as nested Spark
conditions over the counts, with their text as rule.

Up to ``sample`` labelled rows are fitted (chosen by a hash of the id). Without labels, or without two classes,
the list is empty and only the base rules reject.

Defined results: null and empty texts have no words and fail the base rules; equal texts tie, the first of equal conditions in the list of features is taken; very long texts are counted whole; repeated rows get a row each; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats as ts
from .common import fresh, shared_table

SAMPLE = 20_000
LEAST_WORDS, MOST_REPEATED = 50, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, ts.FEATURES.index(self.feature)]
        return v > self.value if self.above else v <= self.value

    def column(self) -> Column:
        c = ts.feature(self.feature)
        return c > self.value if self.above else c <= self.value


Rule = tuple[Condition, ...]


def covers(rule: Sequence[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def cuts(v: np.ndarray, most: int = 48) -> np.ndarray:
    """Thresholds between neighbouring quantiles."""
    q = np.unique(np.quantile(v, np.linspace(0, 1, most)))
    return (q[1:] + q[:-1]) / 2


def grown(x: np.ndarray, y: np.ndarray, most: int = 4) -> list[Condition]:
    """y: 1 is junk. Conditions by the largest gain p (log2 p/(p+n) - log2 of the same before)."""
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < most and (n := (~y[inside]).sum()) > 0 and (p := y[inside].sum()) > 0:
        before = np.log2(p / (p + n))
        best, found = 1e-9, None
        for name in ts.FEATURES:
            v = x[inside, ts.FEATURES.index(name)]
            for value in cuts(v):
                high = v > value
                for above, part in ((True, high), (False, ~high)):
                    a = y[inside][part].sum()
                    if a and (gain := a * (np.log2(a / part.sum()) - before)) > best:
                        best, found = gain, Condition(name, above, float(value))
        if found is None:
            break
        rule.append(found)
        inside &= found.holds(x)
    return rule


def pruned(rule: list[Condition], x: np.ndarray, y: np.ndarray) -> list[Condition]:
    def worth(r: Sequence[Condition]) -> float:
        inside = covers(r, x)
        return (2 * y[inside].sum() - inside.sum()) / max(inside.sum(), 1)

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn(x: np.ndarray, junk: np.ndarray, most: int = 12, least: int = 3, seed: int = 7) -> list[Rule]:
    """An ordered list of rules for junk."""
    rules: list[Rule] = []
    y = junk.astype(bool)
    left = np.ones(len(x), dtype=bool)
    deal = np.random.default_rng(seed).permutation(len(x)) % 3
    while len(rules) < most and y[left].sum() >= least and (~y[left]).sum() > 0:
        growing, pruning = left & (deal != 0), left & (deal == 0)
        rule = grown(x[growing], y[growing])
        if not rule:
            break
        if pruning.any():
            rule = pruned(rule, x[pruning], y[pruning])
        tried = covers(rule, x) & (pruning if covers(rule, x[pruning]).any() else growing)
        if 2 * y[tried].sum() <= tried.sum() or not (covers(rule, x) & left & y).sum() >= least:
            break
        rules.append(tuple(rule))
        left &= ~covers(rule, x)
    return rules


def verdict(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Whether a row is kept, and the text of the rule that rejects it (null if none does)."""
    kept, name = F.lit(True), F.lit(None).cast("string")
    for rule in reversed(rules):
        inside = F.lit(True)
        for c in rule:
            inside = inside & c.column()
        kept = F.when(inside, False).otherwise(kept)
        name = F.when(inside, " and ".join(map(str, rule))).otherwise(name)
    return kept, name


def fit(stats_table: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    x, quality = ts.labelled_sample(stats_table, ts.labelled_ids(labels, "quality", sample))
    return learn(x, quality == 0)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the rejecting rule for each row of docs."""
    counted = shared_table(ts.text_stats(docs))
    return judged(counted, fit(counted, labels, sample)).select("doc_id", *BASE, "base_failed", "kept", "rule")


def judged(counted: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """counted with base_failed, kept and rule."""
    kept, name = verdict(rules)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & kept).withColumn("rule", F.when(F.col("base_failed"), "base").otherwise(name))


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. Counts are made twice, once for the labelled
    sample and once beside the texts, so that no text is shuffled or written."""
    chosen = docs.select("doc_id", "text").join(ts.labelled_ids(labels, "quality", sample), "doc_id", "left_semi")
    rules = fit(shared_table(ts.text_stats(chosen)), labels, sample)
    packed = fresh("counts", docs.columns)
    names = {n: fresh(f"counted_{n}", docs.columns) for n in ts.NAMES}
    schema = ", ".join(f"`{names[n]}` bigint" for n in ts.NAMES)
    wide = ts.map_text(docs, docs.columns, lambda: ts.stats, schema)
    inner = wide.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*[F.col(f"`{names[n]}`").alias(n) for n in ts.NAMES]).alias(packed))
    whole = fresh("row", docs.columns)
    rows = inner.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col(f"`{packed}`").alias(packed)).select(whole, f"`{packed}`.*")
    return judged(rows, rules).where("kept").select(*[F.col(f"`{whole}`.`{c}`").alias(c) for c in docs.columns])
