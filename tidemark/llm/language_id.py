"""Language identification by compression.

Each language has a raw-content Zstandard dictionary of sampled text. Dictionaries and texts are in lower case, with one
blank for whatever isn't letters, so that layout and case decide nothing. A text is cut into pieces of ``PIECE`` bytes, each
piece is compressed with every language's dictionary, and the language of the smallest size wins it; the language that wins most bytes is
chosen, of equals that of the smallest sum of sizes. So one passage that a dictionary happens to have verbatim is one
piece, however much it saves. Each piece won counts 1 - 2 ** -(bytes saved against the second / ``HALF``) of its bytes to the score, and a choice
that saves less than ``MARGIN`` of the second's size over its pieces is marked as rejected.

Dictionaries are learned from rows of the learning folds that have a language and letters, of the ``LANGUAGES`` languages that most rows have (a bound on what
is collected, sent, and tried on each text: a column of dirty values must not make it endless). A hash of the id chooses rows, and of each a window of
``WINDOW`` characters whose place the hash decides, so many that a language's windows have about ``dictionary`` characters together; all that is drawn is used.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if no language
was learned; a language beyond those learned is never predicted; ties go by votes, then sizes, then the name; a very long text is gone through whole, piece by piece; repeated
rows get a row each, and may be drawn each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_text
from .common import fold, small, unit_hash

FOLDS, HELD_OUT = 4, 2
WINDOW, DICTIONARY, LANGUAGES = 400, 96 << 10, 64
#: Matches of three bytes count, as short texts have few longer ones.
PIECE, LEVEL, MATCH = 512, 3, 3
MARGIN, HALF = 0.01, 4.0
LETTER = re.compile(r"[^\W\d_]")
BETWEEN = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    return f" {BETWEEN.sub(' ', text.lower()).strip()} "


def learned(docs: DataFrame, dictionary: int, languages: int) -> dict[str, bytes]:
    """A dictionary for each language: pieces of texts, those of the smallest hashes last, as near matches are cheapest."""
    rows = docs.select("doc_id", "text", "lang").where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    taken = F.least(F.char_length("text"), F.lit(WINDOW))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(taken).alias("chars")).orderBy(F.desc("n"), "lang").limit(languages).drop("n")
    draw = unit_hash(F.col("doc_id"), F.col("text"))
    at = (F.pmod(F.xxhash64("doc_id", F.lit("at")), F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1) + 1).cast("int")
    drawn = rows.join(small(counts, languages), "lang").where(draw < dictionary / F.col("chars")).select("lang", draw.alias("draw"), F.substring(F.col("text"), at, F.lit(WINDOW)).alias("piece"))
    found: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], -r["draw"], r["piece"])):  # about dictionary characters per language
        found.setdefault(r["lang"], []).append(plain(r["piece"]))
    return {lang: "".join(pieces).encode() for lang, pieces in sorted(found.items())}


def chosen(sizes: np.ndarray, length: np.ndarray) -> tuple[int, float, float, float]:
    """Of sizes by pieces and languages: the language chosen, its score, the bytes that it saves and those of the seconds in its pieces."""
    each = sizes.argmin(axis=1)
    least = sizes.min(axis=1)
    second = np.partition(sizes, 1, axis=1)[:, 1] if sizes.shape[1] > 1 else length
    gap = np.maximum(second - least, 0)
    votes = np.bincount(each, length, minlength=sizes.shape[1])
    best = min(range(sizes.shape[1]), key=lambda k: (-votes[k], sizes[:, k].sum(), k))
    own = each == best
    return best, float((length * (1 - 2.0 ** (-gap / HALF)))[own].sum() / length.sum()), float(gap[own].sum()), float(second[own].sum())


def classifier(dictionaries: dict[str, bytes]) -> Callable[[pa.Array], list[pa.Array]]:
    """lang_pred, score, rejected for a column of texts."""
    import zstandard

    langs = list(dictionaries)
    made = []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
        d.precompute_compress(compression_params=how)
        made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)

    def apply(texts: pa.Array) -> list[pa.Array]:
        pred, score, rejected = [], [], []
        for v in texts:
            text = v.as_py()
            if text is None or not langs or not LETTER.search(text):
                pred.append("und")
                score.append(0.0)
                rejected.append(True)
                continue
            data = plain(text).encode()
            pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
            sizes = np.array([[len(c(p)) for c in made] for p in pieces])
            best, won, gap, rest = chosen(sizes, np.array([len(p) for p in pieces]))
            pred.append(langs[best])
            score.append(won)
            rejected.append(gap < MARGIN * rest)
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return apply


def language_ids(docs: DataFrame, dictionary: int = DICTIONARY, languages: int = LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for each row of docs."""
    known = docs.sparkSession.sparkContext.broadcast(learned(docs, dictionary, languages))
    out = map_text(docs, ["doc_id"], lambda: classifier(known.value), "lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
