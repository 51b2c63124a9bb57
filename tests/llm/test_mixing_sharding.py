import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import mixing, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(n, seed, sources=7, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = "s0" if rng.random() < hot else rng.choice([f"s{k}" for k in range(sources)] + [None])
        text = rng.choice([None, "", " "]) if rng.random() < 0.05 else " ".join(["w"] * rng.randrange(1, 60))
        rows.append((i, text, s))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_equals_sql(spark, seed):
    rows = documents(3000, seed)
    if seed == 3:  # repeated ids, and one that has a third of all rows
        rows = [(i // 3, t, s) for i, t, s in rows] + [(7, "w " * 9, "s1")] * 1500 + [(None, "w w", "s2")] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((tuple(r)[:5] for r in mixing.mix_report(docs).collect()), key=str)
    c = duckdb.connect()
    rows_ = docs.toPandas()
    rows_["doc_id"] = rows_["doc_id"].astype("Int64")
    c.register("documents", rows_.astype({"text": object, "source": object}).where(lambda d: d.notna(), None))
    want = sorted(c.sql(queries.OP4_SQL).fetchall(), key=str)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) <= 1e-9 * max(1, b[3]) for a, b in zip(got, want))


def test_targets_are_reshared_and_met(spark):
    rows = documents(4000, 5)
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    taken, size, target = Counter(), {}, {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    open_ = [s for s in order if target[s] < 3 * size[s] - 1e-9]
    assert len({round(target[s] / weight[s], 6) for s in open_}) == 1
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)


def test_repeated_rows_meet_the_target(spark):
    rows = [(i, "w " * 10, "a") for i in range(1000)] + [(1, "w " * 10, "a")] * 1000 + [(5000 + i, "w " * 20, "b") for i in range(300)] + [(None, "w w w", "b")] * 500
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 10


def test_inclusion_follows_the_odds(spark):
    """Over seeds, documents are taken as often as their probabilities say: k (1 + size / mean size), those above 1 always."""
    sizes = [5, 10, 20, 40, 400] * 320
    rows = [(i, "w " * n, "a") for i, n in enumerate(sizes)] + [(10_000 + i, "w " * 50, s) for i in range(240) for s in "bc"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").cache()
    seen, seeds = Counter(), 3
    for k in range(seeds):
        out = mixing.mix_report(docs, weights=(1, 1, 1), seed=f"s{k}").where("source = 'a'").collect()
        part = out[0]["target"] / out[0]["source_size"]
        assert part < 1
        for r in out:
            seen[r["size"]] += r["copies"]
    mean, total = sum(sizes) / len(sizes), sum(sizes)
    k = part * total / sum(n * (1 + n / mean) for n in sizes)
    for n in (5, 10, 20, 40, 400):
        p = min(1, k * (1 + n / mean))
        assert abs(seen[n] / (320 * seeds) - p) < 5 * (p * (1 - p) / (320 * seeds)) ** 0.5 + 0.03


def test_mixed_documents(spark, edges, clashing, nothing):
    out = mixing.mix_documents(clashing)
    assert out.columns == clashing.columns
    report = mixing.mix_report(edges).collect()
    assert len(report) == edges.count()
    want = Counter()
    for r in report:
        want[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert got == +want
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0
    assert sorted(map(str, mixing.mix_report(edges).collect())) == sorted(map(str, report))


def test_one_source_and_sizeless(spark):
    one = spark.createDataFrame([(i, "a b c", "x") for i in range(10)], "doc_id bigint, text string, source string")
    assert all(r["taken"] == 3 for r in mixing.mix_report(one).collect())
    blank = spark.createDataFrame([(i, " ", f"x{i % 2}") for i in range(4)], "doc_id bigint, text string, source string")
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mix_report(blank).collect())


def test_shards(spark):
    rng = random.Random(3)
    texts = ["hot text " * 20] * 1500 + [f"copy {i % 40} " * 9 for i in range(400)] + ["z" * rng.randrange(1, 400) + str(i) for i in range(3000)]
    rows = [(i, t, rng.choice(["en", "fr", "de"]), f"src{rng.randrange(9)}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = sharding.shard_report(docs).collect()
    by, groups = defaultdict(list), defaultdict(set)
    for r in got:
        t = texts[r["doc_id"]].encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r)
        groups[t].add(r["shard"])
    assert sorted(by) == list(range(24))
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    mean = sum(sizes) / 24
    assert max(sizes) < 1.06 * mean and min(sizes) > 0.94 * mean
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    assert {len(s) for t, s in groups.items() if not t.startswith(b"hot")} == {1}
    assert sorted(map(str, sharding.shard_report(docs).collect())) == sorted(map(str, got))


def test_repeated_rows_of_one_id(spark, monkeypatch):
    """Nine tenths of the rows are one id and text: sizes are near equal, and no slot is given twice."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
    rows = [(7, "the same text " * 9, "en", "s")] * 9000 + [(100 + i, f"text {i} " * (1 + i % 30), "en", "s") for i in range(1000)]
    got = sharding.shard_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(6)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert len(sizes) == 24 and max(sizes) < 1.06 * sum(sizes) / 24 and min(sizes) > 0.94 * sum(sizes) / 24
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())


def test_shards_are_leaves_of_a_naive_tree(spark):
    """Every split halves the shards along the dimension that is widest there, by naive coordinates: all of the left is at or below all of the right."""
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(1, 3000) + str(i), rng.choice(["en", "fr", "de", None]), f"https://{rng.choice('abcdefgh')}.org") for i in range(4000)]
    got = sharding.shard_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    order = [{v: i for i, v in enumerate(sorted({r[c] for r in rows if r[c] is not None}), 1)} for c in (2, 3)]
    points = {i: (math.log2(len(t) + 8), order[0].get(lang, 0), order[1].get(source, 0)) for i, t, lang, source in rows}
    world = [max(p[d] for p in points.values()) - min(p[d] for p in points.values()) for d in range(3)]
    used = set()

    def check(mine, low, n):
        if n == 1:
            return
        width = [(max(points[r["doc_id"]][d] for r in mine) - min(points[r["doc_id"]][d] for r in mine)) / world[d] for d in range(3)]
        d = width.index(max(width))
        used.add(d)
        left, right = ([r for r in mine if (r["shard"] < low + n // 2) == side] for side in (True, False))
        assert max(points[r["doc_id"]][d] for r in left) <= min(points[r["doc_id"]][d] for r in right) + 1e-6
        share = sum(r["size"] for r in left) / sum(r["size"] for r in mine)
        assert abs(share - (n // 2) / n) < 0.02
        check(left, low, n // 2), check(right, low + n // 2, n - n // 2)

    check(got, 0, 24)
    assert used == {0, 1, 2}


def test_slots_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 as int)) AS text", "'en' AS lang", "'s' AS source")
    by = defaultdict(list)
    for r in sharding.shard_report(docs).collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shard_edges(spark, edges, clashing, nothing):
    rows = sharding.shard_report(edges).collect()
    assert len(rows) == edges.count() and all(0 <= r["shard"] < 24 for r in rows)
    null = next(r for r in rows if r["doc_id"] == 0)
    assert null["size"] == 8 and null["text_crc32"] == 0
    assert sharding.shard_report(clashing).count() == clashing.count()
    assert sharding.shard_report(nothing).count() == 0
