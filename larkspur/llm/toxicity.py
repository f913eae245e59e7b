"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes, to 2**BITS places, of its lower-cased words, pairs of neighbours, and
pairs with one word between. Training takes a bounded sample of labelled documents (`max_rows`, a third of
them toxic at most, by a hash of their ids) in one task: per-coordinate rates and an L1 penalty leave few weights other than zero, which the driver
gets and sends along with the scoring function: there are 2**BITS places, so 16 MB bound them. Scoring reads every text once, without a shuffle.

Nulls: a null text has no features, so its score is the bias's; labels with a null id or label are left out; documents with
a null id are scored and not held out. Several labels of an id: the largest. Repeated rows are scored each. With no
labelled rows every score is 0.5. A very long text is scored whole, in slices of memory; examples are learned in the order of a hash of their
ids. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, buffers, lower, mix, slices

BITS = 20
_U = np.uint64
_GAP = np.ones(256, bool)
for _b in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
    _GAP[_b] = False


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each place in the texts; not distinct."""
    words = Words(lower(data), bounds, _GAP)
    h, text = words.hashes(), np.repeat(np.arange(len(bounds) - 1), words.counts)
    out, of = [h], [text]
    for gap, salt in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            out.append(mix(h[:-gap] * _U(salt) + h[gap:])[same])
            of.append(text[gap:][same])
    return np.concatenate(of), (np.concatenate(out) >> _U(64 - BITS)).astype(np.int64)


def distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(text << BITS | feature)
    return both >> BITS, both & ((1 << BITS) - 1)


class Ftrl:
    """Weights are implied by the gradient sums z and the squared-gradient sums n of each coordinate."""

    def __init__(self, places: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(places + 1), np.zeros(places + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def learn(self, i: np.ndarray, y: int) -> None:
        """i: the example's places, the bias's (the last) among them."""
        w = self.weights(i)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_288, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that aren't zero; the place 2**BITS is the bias."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    one = known.groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    first = lambda y, n: one.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = first(1, max_rows // 3).unionAll(first(0, max_rows - max_rows // 3))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # max_rows rows of 12 bytes

    def extract(batches):
        for b in batches:
            data, bounds = buffers(b.column(1))
            out: list[bytes] = []
            for lo, hi, part, edges in slices(data, bounds):
                text, feature = distinct(*features(part, edges))
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                f = feature.astype("<u4")
                out += [f[cuts[k] : cuts[k + 1]].tobytes() for k in range(hi - lo)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["id", "y", "f"])

    def fit(batches):
        rows = sorted((r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), key=lambda r: int(mix(np.array([r[0]]).astype(_U))[0]))
        model = Ftrl(1 << BITS, alpha, beta, l1, l2)
        examples = [(np.append(np.frombuffer(f, "<u4"), np.uint32(1 << BITS)), y) for _, y, f in rows]
        for _ in range(epochs):
            for i, y in examples:
                model.learn(i, y)
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at), pa.array(w[at])], names=["place", "weight"])

    rows = own.select(F.col("id").cast("long"), "text", "y").mapInArrow(extract, "id long, y int, f binary")
    one = rows.groupBy("id").agg(F.max("y").alias("y"), F.min("f").alias("f")).coalesce(1)
    found = one.mapInArrow(fit, "place long, weight double").collect()
    return np.array([r.place for r in found], np.int64), np.array([r.weight for r in found])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each document."""
    places, weights = model

    def run(batches):
        w = np.zeros((1 << BITS) + 1)
        w[places] = weights
        for b in batches:
            data, bounds = buffers(b.column(1))
            out = []
            for lo, hi, part, edges in slices(data, bounds):
                text, feature = features(part, edges)
                own = w[feature] != 0
                text, feature = distinct(text[own], feature[own])
                out.append(np.bincount(text, w[feature], hi - lo) + w[-1])
            total = np.concatenate(out) if out else np.zeros(0)
            yield pa.record_batch([b.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from labels whose ids aren't held out."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), **options)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
