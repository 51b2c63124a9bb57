import random

import pytest

#: Names that operators use themselves, in a table that has them already.
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, Score double, size bigint, target double, copies bigint, kept boolean, set_bit boolean, contaminated boolean, text_read string, n bigint, hi bigint, shard int, counts int"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_texts():
    """Null, empty, blank, one word, line breaks, signs, beyond ASCII, one endless word, a very long text, repeats."""
    rng = random.Random(4)
    long = " ".join(words(rng, 30_000))
    return [None, "", " \t\n\r\x0b\x0c ", "one", "Two words", "a b c", "ÄÖ ß é日本 emoji😀 x", "x" * 50_000, long, long, "line\n\nline\r\nline \n", "# * $ % & | < > #", "A a A a A a A a A a A a A a", "\x00 nul \x1f unit\x85next", "a b c", " a  b c\n"]


@pytest.fixture
def edges(spark):
    texts = edge_texts()
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", None, "s0"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "null id text here", None, None, 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def clashing(spark, edges):
    extra = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 7, 0.5, 9, 1.0, 3, False, True, True, "zz", 1, 2, 3, 4) for r in edges.collect()]
    return spark.createDataFrame(extra, CLASH)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    rows = [(i, [0, 1, None][i % 3], [1, 0, None, 0][i % 4]) for i in range(14)] + [(3, 1, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
