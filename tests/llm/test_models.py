import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import language_id as li
from tidemark.llm import pseudo_likelihood as pl
from tidemark.llm import textkernel as tk
from tidemark.llm import toxicity as tx

INSULTS = ["blorgfest", "snarkwit", "grumblatz", "dunderknob", "fizzlebrat", "moldwarpen"]


def speech(n, seed, insults=INSULTS):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(rng.choice(["ta", "re", "mi", "lo", "su", "ne", "ka"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(insults)
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = speech(1200, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in tx.toxicity_scores(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert {i for i in got if got[i]["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(p == y for p, y in held) > 0.97 * len(held)


def test_misspelt_insults_share_subwords():
    rows = speech(1500, 2)
    model = tx.fit([r[1] for r in rows], np.array([r[2] for r in rows]))
    plain = rows[0][1] if not rows[0][2] else rows[1][1]
    odd = plain + " blorgfestt snarkwitz"
    a, b = model.score(pa.array([plain, odd]))[0].to_pylist()
    assert b > 0.3 > a


def test_word_scores_are_means_over_subwords():
    rng = np.random.default_rng(3)
    table = rng.normal(size=tx.BUCKETS)
    chunk = next(tk.chunks(pa.array(["Über a  tiny Test", "", "again test\n"])))
    row, h, s = tx.word_scores(chunk, table)
    _, sub = tx.subwords(chunk)
    want = [table[sub.buckets[a:b]].mean() for a, b in zip(sub.bounds[:-1], sub.bounds[1:])]
    assert np.allclose(s, want) and row.tolist() == [0, 0, 0, 0, 2, 2] and h[3] == h[5]


def test_long_texts_in_parts_score_as_in_one():
    rng = np.random.default_rng(4)
    table = rng.normal(size=tx.BUCKETS)
    text = " ".join("".join(rng.choice(list("abcé"), rng.integers(1, 12))) for _ in range(400)) + " " + "y" * 300
    chunk = next(tk.chunks(pa.array([text, "z z"])))
    parts = list(tx.pieces(chunk, 100))
    assert len(parts) > 10 and b"".join(p.data.tobytes() for _, p in parts) == (text + "z z").encode()
    got = [np.concatenate(x) for x in zip(*[(w.row + row, w.hash, s) for row, p in parts for w, s in [tx.part_scores(p, table)]])]
    want = tx.word_scores(chunk, table)
    assert all(np.allclose(a.astype(float), b.astype(float)) for a, b in zip(got, want))


def test_hashes_do_not_depend_on_how_many_bytes_are_hashed_at_once(monkeypatch):
    texts = pa.array(["ab cd " + "q" * 1000 + " ef", "", "x" * 333, "cd"])
    plain = tk.words(next(tk.chunks(texts)), tk.FOLDED)
    monkeypatch.setattr(tk, "HASH_BYTES", 64)
    small = tk.words(next(tk.chunks(texts)), tk.FOLDED)
    assert (plain.hash == small.hash).all() and plain.hash[1] == plain.hash[5] and len(set(plain.hash.tolist())) == 5


def test_toxicity_edges(spark, edges, clashing, nothing, labels, no_labels):
    assert tx.toxicity_scores(edges, labels).count() == edges.count()
    assert {r["score"] for r in tx.toxicity_scores(clashing, no_labels).collect()} == {0.5}
    assert tx.toxicity_scores(nothing, labels).count() == 0
    one = tx.fit(["a b c", "d e f"], np.array([1, 1]))
    assert one.score(pa.array(["x", None]))[0][0].as_py() > 0.7


SYLLABLES = {"en": ["the", "ing", "er", "on", "th", "at"], "de": ["sch", "ung", "ein", "ß", "ü", "heit"], "fr": ["eau", "é", "tion", "oi", "que", "le"]}


def tongues(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(4, 80))), lang))
    return rows


def test_language_on_held_out_rows(spark):
    rows = tongues(600, 4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in li.language_ids(docs).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) > 0.97 * len(held)


def test_language_of_held_out_rows_is_not_learned(spark):
    rows = tongues(200, 5)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (sorted(map(str, li.language_ids(spark.createDataFrame(x, "doc_id bigint, text string, lang string")).collect())) for x in (rows, other))
    assert a == b


def test_language_edges(spark, edges, clashing, nothing):
    rows = li.language_ids(edges).collect()
    assert len(rows) == edges.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 11))
    assert {r["lang_pred"] for r in rows} <= {"en", "fr", "und"}
    assert li.language_ids(clashing).count() == clashing.count() and li.language_ids(nothing).count() == 0
    assert {r["lang_pred"] for r in li.language_ids(edges.withColumn("lang", edges["lang"].substr(9, 1)).where("lang = 'zz'")).collect()} == set()


def naive(p, tokens, i):
    around = [tokens[i + d] if 0 <= i + d < len(tokens) else pl.SIZE for d in (*range(-pl.SIDE, 0), *range(1, pl.SIDE + 1))]
    h = np.tanh(np.concatenate([p["e"][c] for c in around]).astype(float) @ p["w"] + p["b"])
    k, j = divmod(tokens[i], pl.PER_CLASS)
    z, o = h @ p["c"] + p["cb"], h @ p["o"][k] + p["ob"][k]
    return z[k] - np.log(np.exp(z).sum()) + o[j] - np.log(np.exp(o).sum())


def test_log_probabilities_equal_a_naive_network():
    rng = np.random.default_rng(7)
    p = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in pl.SHAPES.items()}
    docs = [rng.integers(0, pl.SIZE, n) for n in (1, 2, 9, 40)]
    t, row = np.concatenate(docs), np.repeat(np.arange(4), [len(d) for d in docs])
    got = pl.log_probs(p, t, pl.context(t, row))
    want = [naive(p, d, i) for d in docs for i in range(len(d))]
    assert np.allclose(got, want, atol=1e-3)


def test_gradients_equal_differences():
    rng = np.random.default_rng(8)
    p = {k: rng.normal(0, 0.3, s) for k, s in pl.SHAPES.items()}
    t = rng.integers(0, pl.SIZE, 30)
    c = pl.context(t, np.zeros(30, dtype=int))
    g = pl.gradients(p, t, c)
    for k in pl.SHAPES:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        high, low = ({**p, k: p[k].copy()} for _ in range(2))
        high[k][at] += 1e-4
        low[k][at] -= 1e-4
        want = -(pl.log_probs(high, t, c).mean() - pl.log_probs(low, t, c).mean()) / 2e-4
        assert g[k][at] == pytest.approx(want, rel=1e-3)


def test_counts_are_those_of_all_texts(spark, edges):
    texts = [r["text"] or "" for r in edges.collect()]
    want = Counter(w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    rows = pl.word_counts(edges).collect()
    assert sorted(r["n"] for r in rows) == sorted(want.values())


def test_training_beats_word_frequencies(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):  # each word follows from the one before
        w = [rng.randrange(40)]
        while len(w) < 60:
            w.append((w[-1] * 7 + rng.choice([1, 2])) % 40)
        rows.append((i, " ".join(f"v{x}" for x in w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    mean = lambda rounds: docs.sparkSession.createDataFrame(pl.lm_scores(docs, rounds).toPandas()).selectExpr("sum(log_prob) / sum(n_tokens) AS m").first()["m"]
    from tidemark.llm import pseudo_likelihood

    old = pseudo_likelihood.BATCH
    pseudo_likelihood.BATCH = 256
    try:
        assert mean(2) > mean(0) + 0.3
    finally:
        pseudo_likelihood.BATCH = old


def test_language_model_does_not_depend_on_the_layout(spark, monkeypatch):
    """Several parts and two levels of averages; rows repeated, and in other orders and splits of the table."""
    monkeypatch.setattr(pl, "PART", 50)
    monkeypatch.setattr(pl, "FAN", 4)
    rows = [r[:2] for r in speech(60, 9)] + [(7, "ta remi lo lo")] * 40 + [(None, "su su neka"), (None, None), (60, "")]
    random.Random(1).shuffle(rows)
    one, other = (spark.createDataFrame(r, "doc_id bigint, text string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 7)))
    p, q = (pl.fit(df, 2)[1] for df in (one, other))
    assert all(np.array_equal(p[k], q[k]) for k in pl.SHAPES)
    first = pl.start(one, 5)[1]
    assert any(not np.array_equal(p[k], first[k]) for k in pl.SHAPES)


def test_rows_weigh_in_gradients_as_often_as_they_occur():
    rng = np.random.default_rng(4)
    p = {k: rng.normal(0, 0.3, s) for k, s in pl.SHAPES.items()}
    t = rng.integers(0, pl.SIZE, 6)
    c = pl.context(t, np.zeros(6, dtype=int))
    times = np.array([1, 3, 1, 1, 2, 1])
    weighed, repeated = pl.gradients(p, t, c, times.astype(float)), pl.gradients(p, np.repeat(t, times), np.repeat(c, times, axis=0))
    assert all(np.allclose(weighed[k], repeated[k], atol=1e-6) for k in pl.SHAPES)


def test_language_model_edges(spark, edges, clashing, nothing):
    rows = pl.lm_scores(edges).collect()
    assert len(rows) == edges.count()
    none = next(r for r in rows if r["doc_id"] == 0)
    assert none["n_tokens"] == 0 and none["log_prob"] == 0 and none["mean_log_prob"] is None
    assert all(r["log_prob"] < 0 for r in rows if r["n_tokens"])
    assert pl.lm_scores(clashing, 1).count() == clashing.count() and pl.lm_scores(nothing).count() == 0


def test_words_outside_the_vocabulary_are_scored_by_their_counts(spark, monkeypatch):
    known = [f"k{i}" for i in range(pl.KNOWN)]
    docs = [" ".join(known * 9)] + [" ".join(["k0", f"x{i}"] * (1 + i % 4)) for i in range(600)] + ["k0 x3", "k0 k1", "", None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    words = lambda t: (t or "").split()
    n = Counter(w for t in docs for w in words(t))
    chunk = lambda t: next(iter(tk.chunks(pa.array([t]))))
    bucket = {w: int(tk.words(chunk(w), tk.FOLDED).hash[0] & tk.U64(pl.OTHERS - 1)) for w in n}
    other = [w for w in n if w[0] == "x"]
    total, distinct = Counter(), Counter(bucket[w] for w in other)
    for w in other:
        total[bucket[w]] += n[w]
    vocabulary, p, _, _ = pl.fit(df, 0)

    def want(text):
        if not words(text):
            return 0.0
        w = tk.words(chunk(text), tk.FOLDED)
        t = vocabulary.tokens(w.hash)
        within = [np.log(n[x] / (total[bucket[x]] + distinct[bucket[x]])) for x in words(text) if x[0] == "x"]
        return pl.log_probs(p, t, pl.context(t, w.row)).sum() + sum(within)

    for held in (pl.HELD, pl.KNOWN + 200, 0):  # all counts in the tasks, some, none
        monkeypatch.setattr(pl, "HELD", held)
        rows = {r["doc_id"]: r for r in pl.lm_scores(df, 0).collect()}
        assert len(rows) == len(docs)
        for i, t in enumerate(docs):
            assert rows[i]["log_prob"] == pytest.approx(want(t), rel=1e-4, abs=1e-6)
            assert (rows[i]["mean_log_prob"] is None) == (not words(t))


def test_an_unseen_word_scores_below_every_counted_one():
    hashes = np.array([7, 7 + pl.OTHERS], dtype=tk.U64)
    others = pl.Others(np.full(pl.OTHERS, 4.0), np.full(pl.OTHERS, 2.0), hashes, np.array([3, 1]), 1)
    got, rare = others.log_probs(np.array([7, 7 + pl.OTHERS, 7 + 2 * pl.OTHERS], dtype=tk.U64))
    assert not rare.any() and np.allclose(got[:2], np.log([3 / 6, 1 / 6])) and got[2] < got[1] - 20


def test_toxicity_equals_a_naive_score():
    """From text to log odds without vectors: the mean over distinct words of the mean over a word's subwords, shrunk."""
    from tidemark.llm import toxicity as tox

    rng = np.random.default_rng(4)
    table = rng.normal(0, 1, tox.BUCKETS)
    model = tox.Model(table, -0.5)
    texts = ["you absolute foool", "a b a", "", None, "Ünï ödd  wörds wörds", "x" * 40]
    whole = {}
    for t in texts:
        for w in (t or "").split():
            _, sub = tox.subwords(next(tox.tk.chunks(pa.array([w], pa.large_string()))))
            whole[w.lower()] = table[sub.buckets].mean()
    for t, got in zip(texts, model.logits(pa.array(texts, pa.large_string()))):
        words = {w.lower() for w in (t or "").split()}
        assert abs(got - (-0.5 + sum(whole[w] for w in words) / (len(words) + tox.SHRINK))) < 1e-9


def test_few_labels_are_learned_from():
    from tidemark.llm import toxicity as tox

    texts = ["you vile grunk"] * 4 + ["what a lovely day"] * 8
    model = tox.fit(texts, np.array([1] * 4 + [0] * 8))
    bad, good = model.logits(pa.array(["such a grunk", "such a day"], pa.large_string()))
    assert bad > good


def test_language_equals_naive_votes(spark):
    import zstandard

    from tidemark.llm import language_id as li

    made = {"aa": li.plain("the cat sat on the mat and the dog ran to the house " * 40).encode(), "bb": li.plain("der hund lief in das haus und die katze schlief auf der matte " * 40).encode()}
    texts = ["the dog sat in the house and the cat ran", "die katze lief auf das haus " * 60, None, "12 ??"]
    pred, score, _ = li.classifier(made)(pa.array(texts))
    for t, p, s in zip(texts, pred.to_pylist(), score.to_pylist()):
        if t is None or not any(c.isalpha() for c in t):
            assert (p, s) == ("und", 0.0)
            continue
        data, votes = li.plain(t).encode(), {}
        for i in range(0, len(data), li.PIECE):
            piece, sizes = data[i : i + li.PIECE], {}
            for name, content in made.items():
                how = zstandard.ZstdCompressionParameters.from_level(li.LEVEL, min_match=li.MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sizes[name] = len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(piece))
            best = min(sizes, key=sizes.get)
            votes[best] = votes.get(best, 0) + len(piece)
        assert p == max(votes, key=votes.get) and 0 < s <= 1


def test_languages_are_bounded(spark):
    from tidemark.llm import language_id as li

    rows = [(i, "some words of a text", "en") for i in range(60)] + [(100 + i, "andere worte", f"x{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert len(li.learned(docs, 4096, 3)) == 3 and "en" in li.learned(docs, 4096, 1)
