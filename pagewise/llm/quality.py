"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  A passage is encoded as hashed character bigrams and a few
measures of its shape; a tanh layer turns that into its representation h.  The attention of a passage is the
softmax over the document of ``w . (tanh(V h) * sigmoid(U h))``; the document's representation is the weighted
sum of its passages', and a logistic unit scores it.  Only document labels are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, unit, written

PASSAGE = 64
BIGRAMS = 128
SHAPE = 8
FEATURES = BIGRAMS + SHAPE
HIDDEN, GATE = 32, 16
#: The classifier is fitted on at most about so many labelled documents.
SAMPLE_ROWS = 3000
THRESHOLD = 0.7

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """0 space, 1 lower-case or caseless letter, 2 upper-case, 3 digit, 4 other; by code point."""
    global _CLASS
    if _CLASS is None:
        _CLASS = np.fromiter((0 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4
                              for c in map(chr, range(0x110000))), np.uint8, 0x110000)
    return _CLASS


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the first passage of each text (one more at the end).
    A text without words has one passage of zeros."""
    texts = [t or "" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    points = np.frombuffer(("\n".join([*texts, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    starts = np.cumsum(sizes) - sizes
    word = kind != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    nth = np.cumsum(first) - first                                   # words before this character
    before = nth[starts]                                             # a text starts behind a line break
    doc = np.repeat(np.arange(len(texts)), sizes)
    inside = np.maximum(np.cumsum(first) - 1 - before[doc], 0) // PASSAGE
    n = np.maximum.reduceat(inside, starts) + 1 if len(texts) else np.zeros(0, np.int64)
    base = np.concatenate(([0], np.cumsum(n)))
    row = base[doc] + inside
    m = int(base[-1])
    out = np.zeros((m, FEATURES), np.float32)
    symbol = np.where(kind == 1, np.uint32(97), np.where(kind == 2, np.uint32(65), np.where(kind == 3, np.uint32(48), points)))
    symbol = np.where(kind == 0, np.uint32(32), symbol).astype(np.uint32)
    pair = ((symbol[:-1] * np.uint32(0x9E3779B1)) ^ (symbol[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    bucket = (pair >> np.uint32(25)).astype(np.int64)                # 7 bits
    counted = np.bincount(row[:-1] * BIGRAMS + bucket, minlength=m * BIGRAMS).reshape(m, BIGRAMS)
    chars = np.maximum(np.bincount(row, weights=word, minlength=m), 1)
    out[:, :BIGRAMS] = np.sqrt(counted / chars[:, None])
    words = np.bincount(row, weights=first, minlength=m)
    shape = [np.bincount(row, weights=kind == k, minlength=m) / chars for k in (1, 2, 3, 4)]
    shape += [chars / np.maximum(words, 1) / 10, words / PASSAGE, np.bincount(row, weights=points == 10, minlength=m) / np.maximum(words, 1)]
    odd = word & np.concatenate(([False], kind[:-1] == 4))
    shape.append(np.bincount(row, weights=odd, minlength=m) / chars)
    out[:, BIGRAMS:] = np.stack(shape, 1)
    out[words == 0] = 0
    return out, base


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Weights of the encoder, the gated attention and the scoring unit."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.w = {"E": r.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "e": np.zeros(HIDDEN),
                  "V": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
                  "a": r.normal(0, GATE ** -0.5, GATE), "o": r.normal(0, HIDDEN ** -0.5, HIDDEN), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, base: np.ndarray):
        w, cuts, n = self.w, base[:-1], np.diff(base)
        h = np.tanh((x - self.mean) / self.scale @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        s = (v * u) @ w["a"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, cuts), n))
        att = s / np.repeat(np.add.reduceat(s, cuts), n)
        doc = np.add.reduceat(att[:, None] * h, cuts, axis=0)
        return h, v, u, att, doc, _sigmoid(doc @ w["o"] + w["b"])

    def score(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        return self.forward(x, base)[-1] if len(base) > 1 else np.zeros(0)

    def gradient(self, x: np.ndarray, base: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, np.diff(base)
        h, v, u, att, doc, p = self.forward(x, base)
        dz = (p - y) / len(y)
        ddoc = np.repeat(dz[:, None] * w["o"], n, axis=0)
        dh = att[:, None] * ddoc
        datt = (ddoc * h).sum(1)
        ds = att * (datt - np.repeat(np.add.reduceat(att * datt, base[:-1]), n))
        dv, du = ds[:, None] * w["a"] * u * (1 - v * v), ds[:, None] * w["a"] * v * u * (1 - u)
        dh += dv @ w["V"].T + du @ w["U"].T
        dpre = dh * (1 - h * h)
        xs = (x - self.mean) / self.scale
        return {"E": xs.T @ dpre, "e": dpre.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ ds,
                "o": doc.T @ dz, "b": np.array([dz.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4,
            batch: int = 64, seed: int = 13) -> AttentionModel:
        """Adam over mini-batches of documents."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        r, t = np.random.default_rng(seed), 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                own, t = order[i:i + batch], t + 1
                base = np.concatenate(([0], np.cumsum([len(bags[j]) for j in own])))
                for k, g in self.gradient(np.concatenate([bags[j] for j in own]), base, y[own]).items():
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
        return self


def _sample_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        x, base = passages(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"),
             pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(base[:-1], base[1:])], pa.binary())],
            names=["doc_id", "label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AttentionModel | None:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, label 0/1)``; None without a labelled text.

    At most about ``sample_rows`` labels are used, the same in every run, picked by a hash of the id; equal
    labels count once, an id with both labels counts as both, and of documents that share an id one text
    counts (the smallest)."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label")
                           ).where("doc_id is not null and label in (0, 1)").distinct()
    n = labels.count()
    chosen = written(labels.where(unit("doc_id") < F.lit(sample_rows / max(n, 1))), "label-sample")
    texts = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
             .where("text is not null"))
    rows = texts.mapInArrow(_sample_bags, "doc_id long, label int, bag binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.label))
    bags = [np.frombuffer(r.bag, "<f4").reshape(-1, FEATURES) for r in rows]
    return AttentionModel().fit(bags, np.array([r.label for r in rows], float))


def score(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """``doc_id, score`` for each row, from the whole text alone.  Null and empty texts are scored as one empty
    passage; without a model every score is 0.5.  Repeated rows give repeated rows, an empty table none."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in by_bytes(batches, "text", 1 << 20):
            if own is None:
                p = np.full(batch.num_rows, 0.5)
            else:
                p = own.score(*passages(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id bigint, score double")


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def op9(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns.  A null id is not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where(fold(F.col("doc_id")) != 2)
    return score(docs, fit(docs, known)).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
