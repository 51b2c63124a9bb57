import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import components as comp
from tidemark.llm import neardup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(s), find(i)) for i, s in sets}


def noisy(rng, base, share):
    return [w if rng.random() > share else f"n{rng.randrange(10**9)}" for w in base]


def corpus(seed, groups, singles):
    rng = random.Random(seed)
    out = []
    for size, length, most in groups:
        base = [f"w{rng.randrange(500)}" for _ in range(length)]
        out += [" ".join(noisy(rng, base, rng.random() * most)) for _ in range(size)]
    out += [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 80))) for _ in range(singles)]
    out += out[:10]
    rng.shuffle(out)
    return list(enumerate(out))


def found(spark, rows, k, percent):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(docs, k, percent).collect()}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rows = corpus(1, [(60, 120, 0.06), (30, 60, 0.04), (40, 200, 0.02)], 60)
    assert found(spark, rows, k, percent) == brute(rows, k, percent)


def test_buckets_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rows = corpus(2, [(150, 150, 0.07)], 20)
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_edges(spark, edges):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(edges).collect()]
    assert len(rows) == edges.count()
    by = {r[0]: r for r in rows if r[0] is not None}
    assert by[0][1:] == (0, 0, True) and by[1][1:] == (0, 1, True) and by[2][1:] == (0, 2, True)
    assert by[5][2] == by[14][2] == by[15][2] == 5 and not by[14][3] and by[9][2] == 8
    assert by[3][1] == 1 and by[4][1] == 1 and by[4][2] == 4
    assert sum(r[0] == 5 for r in rows) == 3


def test_empty_and_clashing(spark, nothing, clashing):
    assert nd.near_duplicates(nothing).count() == 0
    kept = nd.distinct_documents(clashing)
    assert kept.columns == clashing.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[None] == 2 and all(n == 1 for i, n in ids.items() if i is not None)
    assert nd.distinct_documents(nothing).count() == 0


def test_distinct_keeps_one_of_each_group(spark):
    rows = corpus(3, [(25, 100, 0.01)], 30)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {c for _, c in brute(rows, 5, 80).values()}
    assert {r["doc_id"] for r in nd.distinct_documents(docs).collect()} == want


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(5)
    how = nd.Sketcher(3, 85)
    for j in (0.3, 0.6, 0.9):
        n = 600
        both = int(2 * n * j / (1 + j))
        x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = np.sort(x[:n]), np.sort(x[n - both :])
        r = how.sketch([a, b])
        est = how.likeliest((r[:1] > r[1:]).sum(1), (r[:1] < r[1:]).sum(1), np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(est - j) < 0.12


def test_registers_of_a_union_are_maxima():
    rng = np.random.default_rng(6)
    how = nd.Sketcher(3, 85)
    a, b = (np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64)) for _ in range(2))
    r = how.sketch([a, b, np.unique(np.concatenate([a, b]))])
    assert (np.maximum(r[0], r[1]) == r[2]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 199), (199, 201), (7, 7)]
    got = {r["node"]: r["component"] for r in comp.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 200: 199, 201: 199}
    assert comp.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_random(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    label = {}
    for s in sorted(near):
        todo = [s] if s not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = s
                todo += near[x]
    got = {r["node"]: r["component"] for r in comp.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: c for n, c in label.items() if n != c}


def test_texts_under_one_id_are_placed_each(spark):
    """One id has a text of its own and a near copy of another's: only the copy goes. Copies without an id are one."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    other, third = (" ".join(f"{c}{rng.randrange(500)}" for _ in range(90)) for c in "vu")
    near = " ".join(base[:-1] + ["end"])
    rows = [(1, " ".join(base)), (2, near), (3, other), (3, near), (3, other), (None, third), (None, third), (5, third), (9, "")]
    left = sorted(((r["doc_id"], r["text"]) for r in nd.distinct_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    texts = sorted(t for _, t in left)
    assert texts == sorted([other, third, "", next(t for t in texts if t in (near, " ".join(base)))]) and (3, other) in left and (9, "") in left
