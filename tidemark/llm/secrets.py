"""Secret scans: three fixed patterns, and high-entropy strings found by sliding windows.

Candidates of the entropy method are runs of ``[A-Za-z0-9+/_=.-]`` of a window's length or more. Each is given the
narrowest class its characters fit (hex in one case, hex-like, letters and digits, or base64 with URL signs), and a window of
the class's length slides over it; so it does over each segment between signs, which has a class of its own. The window's Shannon
entropy is kept up incrementally: one count goes up, one goes down, and sum(n log2 n) follows. A candidate is a secret if one
of its windows reaches the class's threshold and is not allowed. Allowed are windows like words (most of their pairs of letters are common in
words, or ascend as in an alphabet), of numbers only, or with a placeholder; UUIDs are cut out first. So a path or a host is no secret, and a key
in it is one. A candidate that overlaps a pattern's span adds nothing.

All spans are in code points of the whole text, the end exclusive. Defined results: a null text is taken as empty; texts without
spans get the digest of an empty string; spans of one start go by their kind; very long texts are gone through whole; repeated rows get a row each; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk
from .arrowmap import map_text
from .common import fresh

# The patterns of the three kinds, and how many characters of the named group a match needs.
KINDS = (
    ("assign", re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8),
    ("access", re.compile(rb"(AKIA[A-Z0-9]+)"), 16),
    ("hex", re.compile(rb"([0-9a-f]{32,})"), 32),
)

#: Class of a candidate: characters, window length, entropy in bits from which a window is a secret's.
CLASSES = (
    ("hex", re.compile(rb"[0-9a-f]+|[0-9A-F]+"), 24, 3.0),
    ("alnum", re.compile(rb"[0-9A-Za-z]+"), 20, 3.6),
    ("base64", re.compile(rb"[0-9A-Za-z+/_=.-]+"), 20, 3.8),
)
CANDIDATE = np.zeros(256, dtype=bool)
CANDIDATE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")] = True
SHORTEST = min(c[2] for c in CLASSES)
UUID = re.compile(rb"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
SIGNS = re.compile(rb"[+/_=.-]+")
PLACEHOLDER = re.compile(rb"example|EXAMPLE|placeholder|xxxx|XXXX|your[_-]|dummy|0123456789|abcdefgh")
#: The commonest pairs of letters of English, German, French and Spanish prose and of program text: 9 in 10 of theirs, 3 in 10 of random ones.
PAIRS = (
    b"aa ab ac ad ae ag ai al am an ao ap ar as at au ba be bj bl bo bu by ca ce ch ci ck cl co cr ct da de di "
    b"do ds dt du ea eb ec ed ee ef eh ei el em en eo ep er es et eu ev ew ex ey ez fa ff fi fo fr fu ga ge gi "
    b"gs ha hb he hh hi hl hn ho hr hs ht ic id ie if ig il im in io ip ir is it iv ja ke la ld le lf li ll lo "
    b"ls lt lu ly ma me mi mo mp na nb nc nd ne ng nh ni nl nn no nr ns nt nu nw ob oc od of oi ol om on op or "
    b"os ot ou ow pa pe pf pi pl po pp pr pt qu ra rb re rg rh ri rm rn ro rr rs rt ru ry sa sc se sh si so sp "
    b"ss st su ta te th ti to tr ts tt tu ty tz ue ul um un uo up ur us ut ux va ve vi wa wh wi xc xt yp ze zu"
).split()
#: A window is like words if so much of its pairs of neighbours (two digits or a sign don't count) are of words or ascend.
WORDS = 0.6


def _kinds_of_pairs() -> np.ndarray:
    """By two bytes: 0 does not count, 1 not as in words, 2 as in words. A capital within a word is not."""
    letters, digits = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789"
    out, common = np.zeros((256, 256), dtype=np.uint8), set(PAIRS)
    for a in letters + digits:
        for b in letters + digits:
            if a in letters or b in letters:
                capital = chr(a).islower() and chr(b).isupper()
                out[a, b] = 2 if b == a + 1 or (bytes([a, b]).lower() in common and not capital) else 1
    return out


_PAIRS = [row.tolist() for row in _kinds_of_pairs()]


def _terms(n: int) -> list[float]:
    return [0.0] + [i * math.log2(i) for i in range(1, n + 1)]


_TERMS = _terms(max(c[2] for c in CLASSES) + 1)


def window_entropy(s: bytes, width: int) -> float:
    """The largest Shannon entropy, in bits, of width consecutive characters."""
    counts = [0] * 256
    total = 0.0
    best = 0.0
    for i, c in enumerate(s):
        n = counts[c]
        total += _TERMS[n + 1] - _TERMS[n]
        counts[c] = n + 1
        if i >= width:
            c = s[i - width]
            n = counts[c]
            total += _TERMS[n - 1] - _TERMS[n]
            counts[c] = n - 1
        if i >= width - 1:
            best = max(best, math.log2(width) - total / width)
    return best


def has_secret_window(s: bytes, width: int, least: float) -> bool:
    """Whether a window reaches the entropy and is not allowed."""
    counts = [0] * 256
    total, counted, like = 0.0, 0, 0
    most = (math.log2(width) - least) * width
    barred = [(m.start(), m.end()) for m in PLACEHOLDER.finditer(s)]
    kinds = [_PAIRS[a][b] for a, b in zip(s, s[1:])]
    for i, c in enumerate(s):
        n = counts[c]
        total += _TERMS[n + 1] - _TERMS[n]
        counts[c] = n + 1
        if i and (k := kinds[i - 1]):
            counted, like = counted + 1, like + k - 1
        if i >= width:
            c = s[i - width]
            n = counts[c]
            total += _TERMS[n - 1] - _TERMS[n]
            counts[c] = n - 1
            if k := kinds[i - width]:
                counted, like = counted - 1, like - k + 1
        if i >= width - 1 and total <= most and like < WORDS * counted and not any(a <= i and i - width < b - 1 for a, b in barred):
            return True
    return False


def is_secret(s: bytes) -> str | None:
    """The class by which a candidate, or a segment of it, is a secret."""
    for part in UUID.split(s):
        bare = part.strip(b"=.-_/+")
        segments = SIGNS.split(bare)
        for piece in [bare, *segments] if len(segments) > 1 else [bare]:
            for name, fits, width, least in CLASSES:
                if fits.fullmatch(piece):
                    if len(piece) >= width and has_secret_window(piece, width, least):
                        return name
                    break
    return None


def pattern_spans(text: bytes) -> list[tuple[int, int, int, str]]:
    """Byte start, place of the kind, byte end, kind."""
    out = []
    for at, (kind, pattern, least) in enumerate(KINDS):
        out += [(m.start(), at, m.end(), kind) for m in pattern.finditer(text) if m.end(1) - m.start(1) >= least]
    return sorted(out)


def digest(spans: Sequence[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


REPORT = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"


def report(texts: pa.Array) -> list[pa.Array]:
    """The columns of REPORT."""
    counts: list[list[int]] = [[], [], [], []]
    shas, lists = [], []
    for chunk in tk.chunks(texts):
        start, end, row = tk.runs(chunk, CANDIDATE[chunk.data])
        long = end - start >= SHORTEST
        bounds = np.searchsorted(row[long], np.arange(len(chunk) + 1)).tolist()
        start, end = start[long].tolist(), end[long].tolist()
        data, offsets = chunk.data.tobytes(), chunk.offsets.tolist()
        for r in range(len(chunk)):
            lo = offsets[r]
            text = data[lo : offsets[r + 1]]
            base = pattern_spans(text)
            more = []
            for i in range(bounds[r], bounds[r + 1]):
                a, b = start[i] - lo, end[i] - lo
                if not any(x < b and a < y for x, _, y, _ in base) and (kind := is_secret(text[a:b])):
                    more.append((a, len(KINDS), b, f"entropy_{kind}"))
            where = points(text, [*base, *more])
            base, every = where[: len(base)], sorted(where)
            for at in range(3):
                counts[at].append(sum(x[1] == at for x in base))
            counts[3].append(len(more))
            shas.append(hashlib.sha256(digest(base).encode()).hexdigest())
            lists.append(digest(every))
    return [*[pa.array(x, pa.int64()) for x in counts[:3]], pa.array(shas, pa.string()), pa.array(lists, pa.string()), pa.array(counts[3], pa.int64())]


def points(text: bytes, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The spans in code points instead of bytes."""
    if not spans:
        return []
    ends = np.array(sorted({x for a, _, b, _ in spans for x in (a, b)}))
    first = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(first)])
    at = dict(zip(ends.tolist(), upto[ends].tolist()))
    return [(at[a], k, at[b], kind) for a, k, b, kind in spans]


def secret_scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row for each of docs: its columns to keep and those of REPORT."""
    parts = [p.split(" ", 1) for p in REPORT.split(", ")]
    schema = ", ".join(f"`{fresh(name, keep)}` {kind}" for name, kind in parts)
    return map_text(docs, keep, lambda: report, schema)
