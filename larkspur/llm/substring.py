"""Substring dedup: windows of words that start in an earlier document, found by a count-min prefilter.

A window is `width` consecutive words of a document. Documents are dealt to chunks of bounded size.

1. Each chunk sketches its windows: in each of `depth` rows a window's cell is a hash of its words, and the
   sketch is the cells that its documents use, and whether more than one of them does. The rows are as wide as `spread` times the
   windows of the whole table, so the share of false repeats stays as the table grows; they are cut into segments, and a sketch
   is sent sparsely, its sorted cells as Elias-Fano codes. A segment's task merges the sketches of all chunks and tells each
   chunk which of its cells are used twice or more in all. A merged count is never below a window's true count.
2. Each chunk groups the windows that every row estimates repeated by a 128-bit digest of their words, and sends a row per
   digest with its first document; the digests' first documents over all chunks come back where they are earlier. The chunk then
   marks the words of windows that start in an earlier document.

A window in very many documents is one row per chunk. The text is shuffled once: the three passes read the same exchange.

Nulls: a null text has no words; a null id counts as later than all ids. Rows that repeat an id don't remove from each
other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import total_chars, with_chunks
from .text import Words, buffers, mix, powers, run_hashes, signed, slices

_U = np.uint64
_LATE = np.iinfo(np.int64).max
_TURN = [0x9FB21C651E98DF25, 0xD6E8FEB86659FD93]
_SEED = [0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D]
#: Hashes that fall in a segment of a sketch's row, about; and cells of a segment that are counted in an array, else by sorting.
SEGMENT_HASHES, DENSE_CELLS = 1 << 22, 1 << 27


def pack_bits(x: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each number, the least first."""
    return np.packbits(np.unpackbits(x.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little"), bitorder="little").tobytes() if width else b""


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.int64)
    if width > 57:  # a number may lie in nine bytes
        out = np.zeros((n, 8), np.uint8)
        out[:] = np.packbits(np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width), axis=1, bitorder="little")
        return out.view("<i8").ravel().astype(np.int64)
    size = (n * width + 7) // 8
    own = np.zeros(size + 8, np.uint8)
    own[:size] = data[:size]
    bit = np.arange(n, dtype=np.int64) * width
    x = np.ndarray(size + 1, "<u8", own, 0, (1,))[bit >> 3]  # the eight bytes from the one that holds a number's first bit
    x >>= (bit & 7).view(_U)
    x &= _U((1 << width) - 1)
    return x.view(np.int64)


def pack_cells(cells: np.ndarray, several: np.ndarray, universe: int) -> bytes:
    """Sorted distinct cells below `universe` and a bit for each, as Elias-Fano codes."""
    n = len(cells)
    low = max(0, int(universe // max(n, 1)).bit_length() - 1)
    high = np.zeros((universe >> low) + n + 1, np.uint8)
    high[(cells >> low) + np.arange(n)] = 1
    return np.array([n, low], "<u4").tobytes() + np.packbits(several).tobytes() + np.packbits(high).tobytes() + pack_bits(cells, low)


def unpack_cells(data: bytes, universe: int) -> tuple[np.ndarray, np.ndarray]:
    n, low = (int(x) for x in np.frombuffer(data, "<u4", 2))
    raw, at = np.frombuffer(data, np.uint8), 8
    several = np.unpackbits(raw[at : (at := at + (n + 7) // 8)], count=n).astype(bool)
    size = (universe >> low) + n + 1
    high = np.flatnonzero(np.unpackbits(raw[at : (at := at + (size + 7) // 8)], count=size))
    cells = (high - np.arange(n)) << low
    return cells | unpack_bits(raw[at:], n, low), several


def windows(texts: pa.Array, width: int, kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text, first word, words of each text, a 64-bit hash per kind) of all windows, by text and place."""
    data, bounds = buffers(texts)
    text, start, counts, hashes = [], [], [], [[] for _ in kinds]
    for lo, _, part, edges in slices(data, bounds):
        words = Words(part, edges)
        own = np.maximum(words.counts - (width - 1), 0)
        of = np.repeat(np.arange(len(own)), own)
        first = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        begin = words.firsts[:-1][of] + first
        for k, kind in enumerate(kinds):
            hashes[k].append(run_hashes(words.hashes(kind), begin, begin + width, _TURN[kind]))
        text.append(of + lo)
        start.append(first)
        counts.append(words.counts)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(text, np.int64), join(start, np.int64), join(counts, np.int64), [join(h, _U) for h in hashes]


class Sketch:
    """The shape of the merged sketch: `depth` rows of `cells`, in segments."""

    def __init__(self, n_hashes: int, depth: int, spread: int):
        self.depth = depth
        self.segments = max(1, -(-n_hashes // SEGMENT_HASHES), min(64, n_hashes >> 17))
        self.size = max(1024, -(-n_hashes * spread // self.segments))

    def rows(self, h: np.ndarray):
        """For each row and segment: its number, which hashes fall in it, their cells."""
        for row in range(self.depth):
            x = mix(h + _U(_SEED[row % 2] * (2 * row + 1) & (2**64 - 1)))
            segment = ((x >> _U(32)) * _U(self.segments)) >> _U(32)
            cell = (((x * _U(_TURN[0])) >> _U(11)) % _U(self.size)).astype(np.int64)
            order = (np.sort(segment << _U(32) | np.arange(len(h), dtype=_U)) & _U(0xFFFFFFFF)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(segment[order].astype(np.int64), prepend=-1, append=-1)) if len(h) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # segments that have hashes
                at = order[lo:hi]
                yield row * self.segments + int(segment[at[0]]), at, cell[at]

    def sorted_cells(self, h: np.ndarray):
        """For each row and segment: its number, the cells of its hashes, sorted; which hashes fall in it, and the order that sorts them."""
        for number, at, cell in self.rows(h):
            bits = len(cell).bit_length()
            if self.size.bit_length() + bits < 63:  # cells and places in one number sort quickest
                both = np.sort(cell << bits | np.arange(len(cell)))
                cell, order = both >> bits, both & ((1 << bits) - 1)
            else:
                order = np.argsort(cell, kind="stable")
                cell = cell[order]
            yield number, cell, at, order

    def cells(self, h: np.ndarray, text: np.ndarray):
        """For each row and segment: its number, the sorted cells that are used, if by several texts, which windows, each's place among the cells."""
        for number, cell, at, order in self.sorted_cells(h):
            new = np.diff(cell, prepend=-1) != 0
            first, place = np.flatnonzero(new), np.empty(len(cell), np.int64)
            place[order] = np.cumsum(new) - 1
            of = text[at][order]
            yield number, cell[first], np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first), at, place


def cells_twice(sketches: pa.ChunkedArray, shape: Sketch) -> list[np.ndarray]:
    """For each sketch of a segment, which of its cells are used twice or more in all."""
    parts = [unpack_cells(data.as_py(), shape.size) for data in sketches]
    if shape.size <= DENSE_CELLS:
        count = np.zeros(shape.size, np.uint8)
        for cells, several in parts:
            count[cells] = np.minimum(count[cells] + 1 + several, 2)
        return [count[cells] > 1 for cells, _ in parts]
    used = np.sort(np.concatenate([x for cells, several in parts for x in (cells, cells[several])]))
    again = used[1:][used[1:] == used[:-1]]
    again = np.append(again[np.diff(again, prepend=-1) != 0], shape.size)
    return [again[np.searchsorted(again, cells)] == cells for cells, _ in parts]


def merge_sketches(group: pa.Table, shape: Sketch) -> pa.Table:
    """One segment's sketches of all chunks: for each chunk, which of its cells are used twice or more in all."""
    marks = [np.packbits(twice).tobytes() for twice in cells_twice(group.column("cells"), shape)]
    return pa.table({"segment": group.column("segment"), "chunk": group.column("chunk"), "marks": pa.array(marks, pa.binary())})


def repeated(shape: Sketch, h: np.ndarray, text: np.ndarray, marks: pa.Table) -> np.ndarray:
    """Which hashes of a chunk every row of the merged sketch holds to be used twice or more."""
    by, twice = dict(zip(marks.column("segment").to_pylist(), marks.column("marks").to_pylist(), strict=True)), np.ones(len(h), bool)
    for number, used, _, at, place in shape.cells(h, text):
        if len(used):
            twice[at] &= np.unpackbits(np.frombuffer(by[number], np.uint8), count=len(used)).astype(bool)[place]
    return twice


def dedup_substrings(docs: DataFrame, *, width: int = 50, chunk_chars: int = 8_000_000, depth: int = 2, spread: int = 8, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by one space; only if with_text) of each row.

    A word is removed if a window covers it whose words also start a window of a document with a smaller id.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = total_chars(own)
    shape = Sketch(total // 5, depth, spread)  # about as many windows as words
    chunked = with_chunks(own, chunk_chars, "doc_id", "text", total)

    def sketch(key, group):
        text, _, _, (h,) = windows(group.column("text"), width, (0,))
        out = [(number, pack_cells(used, several, shape.size)) for number, used, several, _, _ in shape.cells(h, text) if len(used)]
        numbers, cells = zip(*out, strict=True) if out else ((), ())
        return pa.table({"segment": pa.array(numbers, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(out), pa.int64()), "cells": pa.array(cells, pa.binary())})

    def merge(key, group):
        return merge_sketches(group, shape)

    def ids(group) -> np.ndarray:
        return group.column("doc_id").combine_chunks().fill_null(_LATE).to_numpy()

    def ask(key, group, marks):
        text, _, _, (a, b) = windows(group.column("text"), width, (0, 1))
        keep = repeated(shape, a, text, marks)
        a, b, doc = a[keep], b[keep], ids(group)[text[keep]]
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(first)
        last = np.maximum.reduceat(doc, at) if len(at) else doc
        return pa.table({"a": pa.array(signed(a[at])), "b": pa.array(signed(b[at])), "chunk": pa.array([key[0].as_py()] * len(at), pa.int64()), "first": pa.array(doc[at]), "last": pa.array(last)})

    def answer(key, group, found):
        text, start, counts, (a, b) = windows(group.column("text"), width, (0, 1))
        doc, gone = ids(group), np.zeros(counts.sum(), bool)
        fa, fb = (found.column(c).to_numpy().view(_U) for c in ("a", "b"))
        order = np.argsort(fa, kind="stable")
        fa, fb, first = fa[order], fb[order], found.column("first").to_numpy()[order]
        base = np.cumsum(counts) - counts
        if len(fa) and len(a):
            lo, hi = np.searchsorted(fa, a, "left"), np.searchsorted(fa, a, "right")
            remove = np.zeros(len(a), bool)
            for k in range(int((hi - lo).max())):  # one round, but where 64 bits of two digests agree
                at = np.minimum(lo + k, len(fa) - 1)
                remove |= (lo + k < hi) & (fb[at] == b) & (first[at] < doc[text])
            edge = np.zeros(counts.sum() + 1, np.int64)
            begin = base[text[remove]] + start[remove]
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + width, -1)
            gone = np.cumsum(edge)[:-1] > 0
        out = []
        for i, t in enumerate(group.column("text")):
            w, own_gone = (t.as_py() or "").encode().split(), gone[base[i] : base[i] + counts[i]]
            n = int(own_gone.sum())
            kept = b" ".join(compress(w, (~own_gone).tolist()) if n else w)
            out.append((len(w), n, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        cols = list(zip(*out, strict=True)) or [()] * 4
        columns = {"doc_id": group.column("doc_id"), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_sha256": pa.array(cols[2], pa.string())}
        return pa.table(columns | ({"kept": pa.array(cols[3], pa.string())} if with_text else {}))

    sketches = chunked.groupBy("chunk").applyInArrow(sketch, "segment long, chunk long, cells binary")
    marks = sketches.groupBy("segment").applyInArrow(merge, "segment long, chunk long, marks binary")
    asked = chunked.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(ask, "a long, b long, chunk long, first long, last long")
    digest = Window.partitionBy("a", "b")
    found = asked.withColumns({"least": F.min("first").over(digest)}).where(F.col("least") < F.col("last")).select("chunk", "a", "b", F.col("least").alias("first"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(answer, schema)
