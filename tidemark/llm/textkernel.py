"""Byte-level text kernels over Arrow string columns, vectorised in numpy.

A column is cut into chunks of a bounded number of bytes (one longer text is a chunk by itself), so that a worker's
memory follows the chunk and not the batch. White space and ASCII letters are single bytes in UTF-8, so
that the word rules of the operators can be applied to bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 18
#: Bytes hashed at once: what hashing needs beside a text doesn't grow with it.
HASH_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C13 & ~7 | 3  # 3 modulo 8: powers of it differ in high and low bits


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(33)
        h *= U64(0xC4CEB9FE1A85EC53)
        h ^= h >> U64(33)
    return h


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, HASH_BYTES + 1)
            for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
                steps = np.full(n, base, dtype=U64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


@dataclass(frozen=True)
class Alphabet:
    """Which bytes words are made of, and a random code for each of them."""

    inside: np.ndarray
    code: np.ndarray

    @classmethod
    def of(cls, outside: str, lower: bool, seed: int = 11) -> Alphabet:
        inside = np.ones(256, dtype=bool)
        inside[[ord(c) for c in outside]] = False
        code = stream(seed, 256)
        if lower:
            inside[65:91] = inside[97:123]
            code[65:91] = code[97:123]
        code[~inside] = 0
        return cls(inside, code)


BLANKS = " \t\n\v\f\r"
#: Runs of non-blank bytes, as they are and with A-Z as a-z.
EXACT = Alphabet.of(BLANKS, lower=False)
FOLDED = Alphabet.of(BLANKS, lower=True)
#: Runs of digits, letters and everything beyond ASCII, with A-Z as a-z.
ALNUM = Alphabet.of("".join(chr(i) for i in range(128) if not chr(i).isalnum()), lower=True)


@dataclass
class Chunk:
    """Rows first to first + n of a batch: their bytes, and where each row begins and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Null texts are taken as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a chunk in order: first byte, byte after the last, row in the chunk, and a 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)

    def bounds(self, rows: int) -> np.ndarray:
        """Row r has the words from bounds[r] to bounds[r + 1]."""
        return np.searchsorted(self.row, np.arange(rows + 1))


def runs(chunk: Chunk, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes within a row: start, end, row."""
    n = len(chunk.data)
    if not n:
        return (np.empty(0, dtype=np.int64),) * 3
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(chunk.offsets[1:], start, side="right")


def run_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each run of bytes the sum of their codes times powers of the multiplier, from 0 at the run's start, modulo 2**64.

    The code of bytes between runs is 0. Runs are summed in groups of HASH_BYTES; a longer one in parts.
    """
    out = np.empty(len(start), dtype=U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            first = start[at]
            to = max(at + 1, int(np.searchsorted(end, first + HASH_BYTES, side="right")))
            n = int(end[to - 1] - first)
            up, down = Powers.of(min(n, HASH_BYTES))
            if n <= HASH_BYTES:
                where = start[at:to] - first
                out[at:to] = np.add.reduceat(code[data[first : first + n]] * up[:n], where) * down[where]
            else:
                total = 0
                for k in range(0, n, HASH_BYTES):
                    part = code[data[first + k : first + min(n, k + HASH_BYTES)]]
                    total += int((part * up[: len(part)]).sum(dtype=U64)) * pow(_MULTIPLIER, k, 1 << 64)
                out[at] = U64(total % (1 << 64))
            at = to
    return out


def words(chunk: Chunk, alphabet: Alphabet) -> Words:
    start, end, row = runs(chunk, alphabet.inside[chunk.data])
    return Words(start, end, row, mix(run_sums(chunk.data, start, end, alphabet.code)))


_STEPS = stream(77, 64) | U64(1)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position on, and whether they are all in one row."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64), np.empty(0, dtype=bool)
    with np.errstate(over="ignore"):
        h = np.full(n, U64(k) * U64(0xD6E8FEB86659FD93), dtype=U64)
        for i in range(k):
            h += w.hash[i : i + n] * _STEPS[i]
    return mix(h), w.row[:n] == w.row[k - 1 :]


def shingle_sets(chunk: Chunk, alphabet: Alphabet, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a row of fewer words has its whole sequence as one."""
    w = words(chunk, alphabet)
    bounds = w.bounds(len(chunk))
    h, _ = grams(w, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif b > a:
            part = Words(w.start[a:b], w.end[a:b], w.row[a:b], w.hash[a:b])
            out.append(grams(part, b - a)[0])
        else:
            out.append(np.empty(0, dtype=U64))
    return out
