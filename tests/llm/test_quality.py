import random
import re

import numpy as np
import pytest

from tidemark.llm import quality_gam as gam
from tidemark.llm import quality_rules as rules
from tidemark.llm import textstats as ts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, cover = {}, set()
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {i + k for i in at for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(60, 200))]
        kind = rng.choice(["good", "good", "good", "signs", "shouts"])
        if kind == "signs":
            w = [x + rng.choice(["###", "$$$", "&&&"]) for x in w]
        if kind == "shouts":
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), int(kind == "good")))
    return rows


def test_counts_equal_brute_force(spark, edges):
    for r in rules.quality_rules(edges, spark.createDataFrame([], "doc_id bigint, quality int")).collect():
        text = next((e["text"] for e in edges.collect() if e["doc_id"] == r["doc_id"]), None) if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            n, c, s, d, p = brute(text)
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, c, s, d, p)
            assert r["base_failed"] == (n < 50 or 100 * p > 50 * n)
            assert r["kept"] == (not r["base_failed"])


def test_learned_list_rejects_junk_and_keeps_clean(spark):
    rows = sample(600, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]], "doc_id bigint, quality int")
    out = {r["doc_id"]: r for r in rules.quality_rules(docs, labels).collect()}
    rest = [(out[i]["kept"], q) for i, _, q in rows[300:] if not out[i]["base_failed"]]
    assert all(k for k, q in rest if q) and sum(not k for k, q in rest if not q) > 0.95 * sum(not q for _, q in rest)
    assert all((r["rule"] is None) == r["kept"] for r in out.values())


def test_columns_agree_with_numpy(spark):
    rows = sample(200, 3)
    counted = ts.text_stats(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).cache()
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    x, y = ts.labelled_sample(counted, ts.labelled_ids(labels, "quality", 1000))
    learned = rules.learn(x, y == 0)
    assert learned
    want = ~np.any([rules.covers(r, x) for r in learned], axis=0)
    kept, _ = rules.verdict(learned)
    got = [r["k"] for r in counted.orderBy("doc_id", "n_words").select(kept.alias("k")).collect()]
    assert got == want.tolist()


def test_no_labels_and_one_class():
    assert rules.learn(np.zeros((0, len(ts.FEATURES))), np.zeros(0, dtype=bool)) == []
    assert rules.learn(np.ones((9, len(ts.FEATURES))), np.ones(9, dtype=bool)) == []


def test_rule_edges(spark, edges, clashing, nothing, labels):
    assert rules.quality_rules(nothing, labels).count() == 0
    kept = rules.kept_documents(clashing, labels)
    assert kept.columns == clashing.columns
    want = sorted(str(r["doc_id"]) for r in rules.quality_rules(edges, labels).collect() if r["kept"])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_gam_is_accurate_on_held_out_rows(spark):
    rows = sample(700, 5)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    want = {r[0]: r[2] for r in rows}
    held = [r for r in gam.quality_scores(docs, labels).collect() if r["held_out"]]
    assert len(held) > 80 and sum(r["predicted"] == want[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_held_out_labels_are_not_learned(spark):
    rows = sample(300, 6)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    flip = [(i, q) for i, _, q in rows]
    import zlib

    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in flip]
    a, b = (sorted(map(str, gam.quality_scores(docs, spark.createDataFrame(x, "doc_id bigint, quality int")).collect())) for x in (flip, other))
    assert a == b


def test_gam_tables_add_up():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # an interaction only
    model = gam.fit(x, y, 60)
    assert ((model.score(x) > 0.5) == y).mean() > 0.85
    one = model.intercept + sum(t[np.searchsorted(e, x[3, i])] for i, (t, e) in enumerate(zip(model.tables, model.edges)))
    one += sum(t[np.searchsorted(model.coarse[i], x[3, i]), np.searchsorted(model.coarse[j], x[3, j])] for i, j, t in model.pairs)
    assert model.logit(x[3:4])[0] == pytest.approx(one)


def test_gam_edges(spark, edges, clashing, nothing, labels, no_labels):
    assert gam.quality_scores(edges, labels).count() == edges.count()
    assert {r["score"] for r in gam.quality_scores(clashing, no_labels).collect()} == {0.5}
    assert gam.quality_scores(nothing, labels).count() == 0
