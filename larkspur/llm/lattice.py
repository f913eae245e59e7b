"""Subword lattice likelihood: the marginal probability of a text over all segmentations into a vocabulary's pieces.

The vocabulary is given; it is never trained. Its file orders the pieces by score (a merge vocabulary's scores
are ranks, not logarithms), so a piece's first weight is Zipf's at its rank. Expectation-maximisation over the training documents'
words refines the weights, the first ones staying as pseudo-counts. A text's words, lower-cased and each after the vocabulary's
mark of a word's start, are segmented in every way: a forward recursion in log space sums the
weights. The document's probability is the product over its words and one end.

What the corpus gives is its word counts, summed in each task before the shuffle, then once per word. To score, documents
are dealt to chunks of bounded size; a chunk asks for each of its distinct words once, the counts are joined by word, and the answers go back
to the chunk. A word has at most a row per chunk, however common it is. The driver gets a weight per piece of the vocabulary.

Nulls: a null text is empty: its one token is the end. A document with a null id is scored and learned from, as not held
out. Repeated rows count and are scored each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import with_chunks
from .store import saved

#: The mark of a word's start in sentencepiece vocabularies. Fixed value.
MARK = "▁"
_NONE = float("-inf")


def read_vocabulary(path: str) -> tuple[list[str], dict[int, int], np.ndarray]:
    """Pieces by id, the ids of the byte pieces by byte, and the first weights (they sum to 1)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)])
    ranks = np.empty(n)
    ranks[np.argsort(-scores, kind="stable")] = np.arange(1, n + 1)
    weights = 1.0 / (ranks + 10.0)
    bytes_ = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces[i], weights[i] = "", 0.0
        elif model.is_byte(i):
            pieces[i], weights[i] = "", 1.0 / n  # reached by their bytes only
    return pieces, bytes_, weights / weights.sum()


class Lattice:
    """Sums over segmentations of many words at once. Weights are natural logarithms.

    A word's nodes are the places between its characters; its arcs are the pieces found at each place, by walking the
    vocabulary's trie one character at a time for all places together.
    """

    def __init__(self, pieces: list[str], bytes_: dict[int, int], weights: np.ndarray):
        self.log, self.bytes = np.log(np.maximum(weights, 1e-300)), bytes_
        child: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = child.setdefault((node, c), len(child) + 1)
            if piece:
                ends[node] = i
        steps = sorted((n << 21 | ord(c), to) for (n, c), to in child.items())
        self.keys, self.to = np.array([k for k, _ in steps], np.int64), np.array([t for _, t in steps], np.int64)
        self.piece = np.full(len(child) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def arcs(self, words: list[str]):
        """(source node, target node, piece or -1, weight) of all arcs, the words' first nodes and each node's place in its word, and
        the byte pieces of the arcs without a piece."""
        n = np.array([len(w) + 1 for w in words], np.int64)
        chars = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), n)
        node = np.arange(len(chars)) + word  # a word has one node more than it has characters
        stop = np.cumsum(n)[word]
        at, state, source, target, piece = np.arange(len(chars)), np.zeros(len(chars), np.int64), [], [], []
        alone, length = np.zeros(len(chars), bool), 0
        while len(at):
            length += 1
            key = state << 21 | chars[at + length - 1]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[k] == key
            at, state = at[ok], self.to[k[ok]]
            got = self.piece[state]
            here = got >= 0
            source.append(node[at[here]])
            target.append(node[at[here]] + length)
            piece.append(got[here])
            if length == 1:
                alone[at[here]] = True
            on = at + length < stop[at]
            at, state = at[on], state[on]
        odd = np.flatnonzero(~alone)
        spelled = [[self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass") if b in self.bytes] for c in chars[odd].tolist()]
        source, target, piece = np.concatenate([*source, node[odd]]), np.concatenate([*target, node[odd] + 1]), np.concatenate([*piece, np.full(len(odd), -1)])
        weight = self.log[piece]
        if len(odd):
            weight[-len(odd) :] = [self.log[x].sum() for x in spelled]
        first = np.cumsum(n + 1) - (n + 1)
        place = np.arange(len(chars) + len(words)) - np.repeat(first, n + 1)
        return source, target, piece, weight, first, place, spelled

    @staticmethod
    def sums(by: np.ndarray, other: np.ndarray, weight: np.ndarray, level: np.ndarray, values: np.ndarray) -> None:
        """values[b] = log of the sum of exp(values[other] + weight) over arcs with by = b, level by level."""
        order = np.argsort(level << 40 | by, kind="stable")
        by, other, weight, level = by[order], other[order], weight[order], level[order]
        cuts = np.flatnonzero(np.diff(level, prepend=-1, append=-1)) if len(level) else np.zeros(1, int)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x, own = values[other[lo:hi]] + weight[lo:hi], by[lo:hi]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            top = np.maximum.reduceat(x, heads)
            values[own[heads]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(heads, append=len(x)))), heads))

    def forward(self, arcs) -> np.ndarray:
        source, target, _, weight, first, place, _ = arcs
        out = np.full(len(place), _NONE)
        out[first] = 0.0
        self.sums(target, source, weight, place[target], out)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """The log of the summed weight of all segmentations of each word."""
        if not words:
            return np.zeros(0)
        arcs = self.arcs(words)
        return self.forward(arcs)[np.append(arcs[4][1:], len(arcs[5])) - 1]

    def expect(self, words: list[str], times: np.ndarray, counts: np.ndarray) -> None:
        """Adds to counts how often each piece is expected in the words' segmentations."""
        if not words:
            return
        arcs = self.arcs(words)
        source, target, piece, weight, first, place, spelled = arcs
        ahead, last = self.forward(arcs), np.append(first[1:], len(place)) - 1
        behind = np.full(len(place), _NONE)
        behind[last] = 0.0
        self.sums(source, target, weight, place.max() - place[source], behind)
        word = np.searchsorted(first, source, "right") - 1
        share = times[word] * np.exp(ahead[source] + weight + behind[target] - ahead[last][word])
        own = piece >= 0
        counts += np.bincount(piece[own], share[own], len(counts))
        for x, pieces in zip(share[~own].tolist(), spelled, strict=True):
            for i in pieces:
                counts[i] += x


def held_out(id_col: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == part, F.lit(False))


def lowered(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased: bytes know no other letters or blanks."""
    return (text or "").encode().lower().split()


def word_counts(texts: DataFrame, most: int = 200_000) -> DataFrame:
    """word and n over a column of texts. A task sums its words before they are shuffled, `most` at a time."""

    def count(batches):
        own: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                own.update(lowered(text.as_py()))
                if len(own) > most:
                    yield table(own)
                    own = Counter()
        yield table(own)

    def table(own):
        return pa.record_batch([pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, n_docs: int, vocabulary: str, rounds: int, prior: float) -> tuple[np.ndarray, float]:
    """The pieces' weights and the end's, from word counts."""
    pieces, bytes_, first = read_vocabulary(vocabulary)
    weights, end = first, n_docs + prior
    for _ in range(rounds):
        now = weights

        def expect(batches, now=now):
            lattice, out = Lattice(*read_vocabulary(vocabulary)[:2], now), np.zeros(len(now))
            for b in batches:
                for i in range(0, b.num_rows, 5000):
                    part = b.slice(i, 5000)
                    lattice.expect(part.column(0).to_pylist(), part.column(1).to_numpy().astype(float), out)
            at = np.flatnonzero(out)
            yield pa.record_batch([pa.array(at), pa.array(out[at])], names=["piece", "n"])

        got = counts.select("word", "n").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        expected = first * prior * len(first)
        for r in got:
            expected[r.piece] += r.n
        weights = expected / (expected.sum() + end)
    return weights, end / (end + (expected.sum() if rounds else end))


def lattice_scores(docs: DataFrame, vocabulary: str, *, rounds: int = 2, prior: float = 0.1, chunk_chars: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word unigrams) and score (the lattice's log10
    probability of the text). Learns from the documents that aren't held out.

    rounds: of expectation-maximisation. prior: pseudo-counts per piece. chunk_chars: of texts that are scored at a time.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    counts = saved(word_counts(own.where(~F.col("held_out")).select("text")), "words")
    n_docs = own.where(~F.col("held_out")).select("doc_id").count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)
    weights, end = fit(counts, n_docs, vocabulary, rounds, prior)
    scale, log10 = total + distinct + 1, math.log10(math.e)

    chunked = with_chunks(own, chunk_chars)

    def ask(key, group):
        words: set = set()
        for text in group.column("text"):
            words.update(lowered(text.as_py()))
        return pa.table({"word": pa.array(list(words), pa.binary()).cast(pa.string()), "chunk": pa.array([key[0].as_py()] * len(words), pa.int64())})

    def weigh(batches):
        lattice = Lattice(*read_vocabulary(vocabulary)[:2], weights)
        for b in batches:  # sorted by word, so that a word's rows are next to each other
            coded = b.column(0).dictionary_encode()
            value = lattice.words(coded.dictionary.to_pylist()) * log10
            yield pa.record_batch([*b.columns, pa.array(value[coded.indices.to_numpy()])], names=["word", "chunk", "c", "w"])

    def answer(key, group, words):
        place = {w: i for i, w in enumerate(words.column("word").cast(pa.binary()).to_pylist())}.__getitem__
        c, weight = words.column("c").to_numpy(), words.column("w").to_numpy()
        base = np.log10((c + 1) / scale)
        end_base, end_weight = math.log10((n_docs + 1) / scale), math.log10(end)
        rows = []
        for text in group.column("text"):
            w = lowered(text.as_py())
            at = np.fromiter(map(place, w), np.int32, len(w))
            rows.append((len(w) + 1, int((c[at] > 0).sum()) + (n_docs > 0), float(base[at].sum()) + end_base, float(weight[at].sum()) + end_weight))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table({"doc_id": group.column("doc_id"), "held_out": group.column("held_out"), "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()), "train_tokens": pa.array([total] * len(rows), pa.int64()), "base_score": pa.array(cols[2], pa.float64()), "score": pa.array(cols[3], pa.float64())})

    asked = chunked.groupBy("chunk").applyInArrow(ask, "word string, chunk long")
    known = asked.join(counts, "word", "left").select("word", "chunk", F.coalesce("n", F.lit(0)).cast("long").alias("c")).mapInArrow(weigh, "word string, chunk long, c long, w double")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunked.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(answer, schema)
