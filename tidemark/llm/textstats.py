"""Counts of a text's words, lines and characters, for rules and classifiers.

Words are runs of anything but blanks, as they stand. Every count is over the whole text; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .arrowmap import map_text
from .common import small, unit_hash

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_letters", "n_upper", "n_digits", "n_wide", "n_bangs", "n_bars", "n_stops", "n_distinct", "n_long")
SCHEMA = ", ".join(f"{n} bigint" for n in NAMES)
LINE = tk.Alphabet(np.arange(256) != 10, np.where(np.arange(256) != 10, tk.stream(23, 256), tk.U64(0)))


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_FIRST = (np.arange(256) & 0xC0) != 0x80
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_WIDE = _FIRST & (np.arange(256) >= 0x80)
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz") | _WIDE
#: The characters that count as symbols.
_SYMBOL = _class("#*$%&|<>")
_BYTES = {"n_chars": _FIRST, "n_letters": _LETTER, "n_upper": _UPPER, "n_digits": _class("0123456789"), "n_wide": _WIDE, "n_bangs": _class("!?"), "n_bars": _class("|"), "n_stops": _class(".,;:"), "n_symbols": _SYMBOL}


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    some = later.copy()
    some[order[:-1][same]] = True
    return some, later


def of_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes made different between rows."""
    with np.errstate(over="ignore"):
        return tk.mix(h + tk.stream(5, 1)[0] * row.astype(tk.U64))


def stats(texts: pa.Array) -> list[pa.Array]:
    """The columns of SCHEMA."""
    out: dict[str, list[np.ndarray]] = {n: [] for n in NAMES}
    for chunk in tk.chunks(texts):
        rows, data, offsets = len(chunk), chunk.data, chunk.offsets

        def per_row(marks: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(marks)])
            return upto[offsets[1:]] - upto[offsets[:-1]]

        for name, kind in _BYTES.items():
            out[name].append(per_row(kind[data]))
        inside = tk.EXACT.inside[data]
        out["word_chars"].append(per_row(inside & _FIRST[data]))
        w = tk.words(chunk, tk.EXACT)
        out["n_words"].append(w.counts(rows))
        out["n_long"].append(np.bincount(w.row[w.end - w.start > 12], minlength=rows))
        _, later = repeated(of_row(w.hash, w.row))
        out["n_distinct"].append(np.bincount(w.row[~later], minlength=rows))
        h, whole = tk.grams(w, 3)
        cover = np.zeros(len(w) + 1, dtype=np.int64)
        if whole.any():
            at = np.flatnonzero(whole)
            some, _ = repeated(of_row(h[at], w.row[at]))
            cover[at[some]] += 1
            cover[at[some] + 3] -= 1
        out["n_repeat_words"].append(np.bincount(w.row[np.cumsum(cover[:-1]) > 0], minlength=rows))
        start, end, row = tk.runs(chunk, LINE.inside[data])
        lines, dups = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
        if len(start):
            with np.errstate(over="ignore"):
                h = tk.mix(tk.run_sums(data, start, end, LINE.code) + (end - start).astype(tk.U64))
            upto = np.concatenate([[0], np.cumsum(inside)])
            worded = upto[end] > upto[start]
            h, row = h[worded], row[worded]
            _, later = repeated(of_row(h, row))
            lines, dups = np.bincount(row, minlength=rows), np.bincount(row[later], minlength=rows)
        out["n_lines"].append(lines)
        out["n_dup_lines"].append(dups)
    return [pa.array(np.concatenate(out[n]) if out[n] else [], pa.int64()) for n in NAMES]


def text_stats(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row for each of docs: its columns to keep, which must not be named as those of SCHEMA, and those of SCHEMA."""
    return map_text(docs, keep, lambda: stats, SCHEMA)


#: Shares that rules and classifiers look at, as numerator and denominator.
SHARES = {
    "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"), "upper_share": ("n_upper", "n_letters"), "digit_share": ("n_digits", "n_chars"), "wide_share": ("n_wide", "n_chars"), "bangs_per_word": ("n_bangs", "n_words"),
    "bars_per_word": ("n_bars", "n_words"), "stops_per_word": ("n_stops", "n_words"), "distinct_share": ("n_distinct", "n_words"), "long_share": ("n_long", "n_words"),
}
FEATURES = ("n_words", *SHARES)


def feature(name: str) -> Column:
    """A feature as an expression over the counts; 0 where its denominator is."""
    if name not in SHARES:
        return F.col(name).cast("double")
    a, b = SHARES[name]
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


def labelled_ids(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, y of about limit labelled rows at most, which a hash of the id chooses; broadcast, as their number is bounded.

    Ids that have both labels are left out; labels other than 0 and 1, and null ids, too.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    n = own.count()
    return small(own.where(unit_hash(F.col("doc_id"), F.lit(label)) < limit / max(n, 1)), 2 * min(n, limit))


def labelled_sample(stats_table: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the rows of labelled ids."""
    rows = stats_table.join(ids, "doc_id").select("y", "doc_id", *[feature(f).alias(f) for f in FEATURES]).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES])  # reruns agree
    return rows[list(FEATURES)].to_numpy(dtype=float).reshape(-1, len(FEATURES)), rows["y"].to_numpy(dtype=int)
