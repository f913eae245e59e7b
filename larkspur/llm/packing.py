"""Hierarchical multi-length packing of token ids into training sequences.

Windows have one of several context sizes (tiers). A document gives as many whole windows of the largest
size as it fills; what remains is routed to the smallest tier that holds it. Each tier is packed from the
longest down: a remainder opens a window of its tier, the window's gap takes the longest remainders of this or a
shorter tier that fit, and when none fits one is cut to close the gap. Windows of a tier are dealt to step groups of equal
token counts; a group's number is its partition's alone, and a partition's last group of a tier is the only one that can be short.
Only the last window of a pool can be short; it is cut into tier sizes, and what is then left is padded.

Pools follow the partitions of the input: no shuffle, and a lost task packs the same rows again. A pool
holds at most `pool_tokens` ids.

Nulls: a null text is empty (one piece, the end id); a null doc_id is carried. Repeated rows are packed
each. Remainders of equal length go by their order in the partition. A very long text is encoded whole, in one task's memory.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Encoder:
    """Ids of texts as the tokenizer file gives them, as little-endian uint32 bytes.

    The file's merges are numbered as its ids are, so the quicker rank encoder over the same vocabulary and
    pattern gives the same ids. Texts with characters on whose classes the two libraries' tables may
    differ go to the tokenizer itself, and so do those with runs of one kind too long for the other's regular expressions.
    """

    #: The pattern of byte-level BPE vocabularies of this kind. Fixed value.
    PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in ids.items() if all(c in byte for c in piece)}
        self.ranked = tiktoken.Encoding(path, pat_str=self.PARTS, mergeable_ranks=ranks, special_tokens={})
        self.plain = re.compile("[\n\r\t\x20-\x7e\xa1-\u017f\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u2018-\u201d\u4e00-\u9fa5\u3041-\u3096\u30a1-\u30fa]*").fullmatch
        self.run = re.compile(r"\s{4096}|\S{65536}").search
        self.path, self.tokenizer = path, None

    def exact(self, text: str) -> np.ndarray:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = True
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> bytes:
        quick = self.plain(text) and (len(text) < 4096 or not self.run(text))
        ids = self.ranked.encode_to_numpy(text) if quick else self.exact(text)
        return ids.astype("<u4", copy=False).tobytes()


class Pool:
    """Packs one pool of remainders; pieces come out as rows of SCHEMA."""

    def __init__(self, tiers: list[int], step_tokens: int, first: int):
        """first: of the pool's sequences and step groups."""
        self.tiers, self.step_tokens, self.first = tiers, step_tokens, first
        self.sequence, self.dealt = first, dict.fromkeys(tiers, 0)
        self.items: dict[int, list] = {t: [] for t in tiers}  # by tier: (length, order, doc_id, start, ids, doc_tokens)
        self.rows: list[tuple] = []
        self.order = self.held = 0

    def window(self, tier: int, pieces: list[tuple]) -> None:
        """pieces: (length, order, doc_id, start, ids, doc_tokens), in their order in the window."""
        group, at = self.first + self.dealt[tier] // max(1, self.step_tokens // tier), 0
        self.dealt[tier] += 1
        for length, _, doc, start, ids, total in pieces:
            self.rows.append((doc, start, length, zlib.crc32(ids), total, self.sequence, at, tier, group))
            at += length
        self.sequence += 1

    def add(self, doc, ids: bytes) -> None:
        total, top, at = len(ids) // 4, self.tiers[-1], 0
        while total - at >= top:
            self.window(top, [(top, 0, doc, at, ids[4 * at : 4 * (at + top)], total)])
            at += top
        if at < total:
            self.put((total - at, self.order, doc, at, ids[4 * at :], total))
            self.order += 1

    def put(self, item: tuple) -> None:
        insort(self.items[next(t for t in self.tiers if t >= item[0])], item, key=lambda x: x[:2])
        self.held += item[0]

    def take(self, tier: int, i: int) -> tuple:
        item = self.items[tier].pop(i)
        self.held -= item[0]
        return item

    def fill(self, tier: int, gap: int) -> tuple | None:
        """The longest remainder of at most `gap` ids of this tier or a shorter one; else one that is cut to `gap`."""
        up_to = self.tiers[: self.tiers.index(tier) + 1]
        for t in reversed(up_to):
            if i := bisect_right(self.items[t], gap, key=lambda x: x[0]):
                return self.take(t, i - 1)
        for t in up_to:  # all are longer than the gap
            if self.items[t]:
                length, order, doc, start, ids, total = self.take(t, 0)
                self.put((length - gap, order, doc, start + gap, ids[4 * gap :], total))
                return gap, order, doc, start, ids[: 4 * gap], total
        return None

    def flush(self) -> list[tuple]:
        for tier in reversed(self.tiers):
            while self.items[tier]:
                pieces = [self.take(tier, len(self.items[tier]) - 1)]
                gap = tier - pieces[0][0]
                while gap and (piece := self.fill(tier, gap)):
                    pieces.append(piece)
                    gap -= piece[0]
                if gap:
                    self.cut(pieces)
                else:
                    self.window(tier, pieces)
        rows, self.rows = self.rows, []
        return rows

    def cut(self, pieces: list[tuple]) -> None:
        """The last, short window: as windows of the tiers' sizes, and one that is padded to the largest."""
        left = sum(p[0] for p in pieces)
        while left:
            tier = next((t for t in reversed(self.tiers) if t <= left), None)
            room, out = min(left, tier or left), []
            left -= room
            while room:
                length, order, doc, start, ids, total = pieces.pop(0)
                n = min(length, room)
                out.append((n, order, doc, start, ids[: 4 * n], total))
                room -= n
                if n < length:
                    pieces.insert(0, (length - n, order, doc, start + n, ids[4 * n :], total))
            self.window(tier or self.tiers[-1], out)


def pack_documents(docs: DataFrame, vocabulary: str, *, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, step_tokens: int = 32_768, pool_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it starts in the document's ids (its text's and `end_id`), its
    length, the CRC-32 of its ids, the document's ids, and the sequence, offset, tier and step group it is in.

    tiers: powers of two, ascending. A sequence holds exactly its tier's ids, but for at most one a pool,
    which is padded to the largest tier. vocabulary: path of a `tokenizers` file, there on every executor.
    """
    sizes = sorted(tiers)

    def pack(batches):
        encode, part = Encoder(vocabulary), TaskContext.get().partitionId()
        pool = Pool(sizes, step_tokens, part << 36)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc in enumerate(ids):
                pool.add(doc, encode(texts[i].as_py() or "") + end)
                if pool.held > pool_tokens:
                    yield table(pool.flush())
                elif len(pool.rows) > 50_000:
                    rows, pool.rows = pool.rows, []
                    yield table(rows)
        yield table(pool.flush())

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def table(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(pack, SCHEMA)
