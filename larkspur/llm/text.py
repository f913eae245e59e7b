"""Words and their hashes, for whole Arrow columns at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside a
character, so splitting the encoded text is the same as splitting the text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that part words, for SQL and for Python.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.RandomState(20240607)
_BYTE = [_RNG.randint(0, 2**63, 256).astype(_U) * _U(2) + _U(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row.

    The optimizer may merge a projection into the lambda that uses it, which would compute it again for
    every element; a lambda's own argument is never merged.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_words(text: Column) -> Column:
    """array<string> of a text's words; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = out[0], out[1]
        if size <= 1 << 22:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[s:e], by their order, for each run."""
    p, inv = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


class Words:
    """The words of some texts: where they start and end in `data`, and which text each is of."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, gap: np.ndarray = _GAP):
        inside = ~gap[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = bounds[:-1][bounds[:-1] < bounds[1:]]  # of texts that aren't empty
        first[edges] = inside[edges]
        last[edges[1:] - 1] = inside[edges[1:] - 1]
        self.data, self.bounds = data, bounds
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: The first word of each text, and the number of words at the end.
        self.firsts = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.firsts)

    def hashes(self, kind: int = 0) -> np.ndarray:
        return run_hashes(_BYTE[kind][self.data], self.starts, self.ends, _BASE[kind])


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return _FOLD[data]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its bounds in them; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0] if len(texts) else np.zeros(1, np.int64)


def slices(data: np.ndarray, bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, bytes, bounds) of runs of texts, of about `most` bytes unless one text is longer."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


@cache
def reuse_memory() -> bool:
    """Lets this process keep what arrays of up to 32 MB leave free (64 MB of it at most), where malloc is glibc's; otherwise each new array
    is mapped and cleared again, a quarter of the time of short steps over arrays of some 100 KB. Whether it could."""
    try:
        put = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError, TypeError):
        return False
    return bool(put(-3, 32 << 20) and put(-1, 64 << 20))  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
