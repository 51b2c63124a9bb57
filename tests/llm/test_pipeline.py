"""The pipeline against a version made of brute-force stages."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb

import corpus_pipeline as cp
from tidemark.llm import quality_rules, queries, textstats
from tidemark.llm.common import documents, table

from .test_decontamination import brute as brute_hits
from .test_neardup import brute as brute_groups
from .test_quality import brute as brute_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, folder):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([6, 15, 40])))) for i in range(12)]
    texts = []
    for i in range(260):
        w = [word() for _ in range(rng.randrange(30, 160))]
        kind = rng.random()
        if kind < 0.15:
            w = [x + rng.choice(["###", "$$$"]) for x in w]
        elif kind < 0.3:
            w[10:10] = rng.choice(items)[1].split()
        elif kind < 0.5 and texts:
            w = [x if rng.random() > 0.02 else word() for x in (rng.choice(texts) or "x").split()]
        elif kind < 0.55:
            w = w[:3] * 40
        texts.append(" ".join(w))
    texts += [None, "", " ", texts[0], texts[1]]
    docs = [(i, t, "en", f"s{rng.randrange(4)}" if rng.random() < 0.6 else "s0", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int("###" not in (t or "") and "$$$" not in (t or "")), 0) for i, t in enumerate(texts[:200])]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = write(spark, folder)
    by = {d[0]: d for d in docs}

    # the learned list is taken as it is; what it and the base rules do to a document is worked out here
    learned = quality_rules.fit(textstats.text_stats(documents(spark, folder)).cache(), table(spark, folder, "labels"))
    verdicts = {r["doc_id"]: r for r in quality_rules.judged(textstats.text_stats(documents(spark, folder)), learned).collect()}
    left = []
    for i, t, *_ in docs:
        n, _, _, _, p = brute_counts(t)
        failed = n < 50 or 100 * p > 50 * n
        assert verdicts[i]["base_failed"] == failed
        if not failed and verdicts[i]["kept"]:
            left.append(i)
    assert learned and 50 < len(left) < 220
    groups = brute_groups([(i, by[i][1]) for i in left], 5, 80)
    left = sorted({c for _, c in groups.values()})
    hits = {r[0]: r[5] for r in brute_hits([(i, by[i][1]) for i in left], items)}
    left = [i for i in left if not hits[i]]

    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, by[i][1], by[i][3]) for i in left])
    want = Counter({r[0]: r[4] // r[1] for r in c.sql(queries.OP4_SQL).fetchall() if r[1]})

    rows = cp.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in rows) == +want
    slots = defaultdict(list)
    for r in rows:
        data = (by[r["doc_id"]][1] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_stages_return_documents(spark, tmp_path):
    write(spark, str(tmp_path))
    docs = documents(spark, str(tmp_path))
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_no_documents(spark, tmp_path):
    write(spark, str(tmp_path))
    docs = documents(spark, str(tmp_path)).limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
