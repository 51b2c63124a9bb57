import hashlib
import random
import re

import pytest

from tidemark.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        if name is not None and w:
            k = min(10, len(w))
            for i in range(len(w) - k + 1):
                windows.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for win, who in windows.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= who
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    item = lambda n: [f"t{rng.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(item(rng.choice([1, 3, 6, 9, 10, 11, 25, 40])))) for i in range(25)] + [(3, "Again, this is item three in other words; ten words at least."), (90, "..."), (91, None), (None, "no id but ten words a b c d e f g h"), (92, "Ä-ö ß! É"), (7, None)]
    docs = []
    for i in range(60):
        w = item(rng.randrange(0, 60))
        if rng.random() < 0.7:
            source = words(rng.choice(items)[1])
            a = rng.randrange(len(source) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = source[a : a + rng.randrange(1, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n", "-"]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    return docs + [(1, docs[1][1]), (99, None), (None, items[4][1])], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_equals_brute_force(spark, block_bytes):
    docs, items = cases(3)
    got = dc.decontamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes)
    rows = sorted((tuple(r)[:6] for r in got.collect()), key=str)
    assert rows == brute(docs, items)


def test_spans_are_the_hit_words(spark):
    docs, items = cases(4)
    got = dc.decontamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    for r in got.collect():
        assert sum(s["past"] - s["first"] for s in r["spans"]) == r["n_hit"] and len(r["items"]) == r["n_items"]


def test_a_passage_cut_into_a_clean_text_is_caught(spark):
    rng = random.Random(8)
    item = " ".join(f"b{rng.randrange(10**6)}" for _ in range(60))
    clean = " ".join(f"c{rng.randrange(10**6)}" for _ in range(500))
    docs = [(0, clean), (1, clean + " " + " ".join(item.split()[20:30]) + " end"), (2, clean + " " + " ".join(item.split()[20:29]) + " end")]
    benchmark = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    left = dc.clean_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), benchmark)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2]


def test_edges(spark, edges, clashing, nothing):
    benchmark = spark.createDataFrame([(1, "a b c"), (2, "")], "item_id bigint, text string")
    none = benchmark.limit(0)
    rows = dc.decontamination(edges, benchmark).collect()
    assert len(rows) == edges.count() and {r["doc_id"] for r in rows if r["contaminated"]} == {5, 14, 15}
    assert not any(r["contaminated"] for r in dc.decontamination(edges, none).collect())
    assert dc.decontamination(nothing, benchmark).count() == 0
    left = dc.clean_documents(clashing, benchmark)
    assert left.columns == clashing.columns and left.count() == clashing.count() - 5
    again = dc.decontamination(clashing, benchmark, clashing.columns, block_bytes=4)
    assert again.where("contaminated_").count() == 5 and len(again.columns) == len(clashing.columns) + 7
