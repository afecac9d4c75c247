"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Text becomes lower-case letters and single spaces; its n-grams of 1 to 3 characters are hashed into ``2**16``
columns.  The value of a column is its share of the text's n-grams times the inverse document frequency, which
is counted over all training documents.  The weights are trained by follow-the-regularised-leader with elastic
net (L1 gives sparse weights), then a temperature is fitted on held-back sample rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, unit, worker_table, written

BITS = 16
COLUMNS = 1 << BITS
ORDERS = (1, 2, 3)
#: Texts are spread over so many columns that shares are tiny; this brings them to the order of 1.
SCALE = 32.0
#: The model is fitted on at most about so many labelled documents of each language.
ROWS_PER_LANGUAGE = 1000


def _letters() -> np.ndarray:
    return worker_table("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def grams(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each order: hashed n-grams of all texts in a row, and the first and last+1 of each text's; and
    the number of letters of each text."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    points = np.frombuffer(("  ".join(["", *lowered, ""])[1:-1]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    letter = _letters()[points]
    code = np.where(letter, points, 32).astype(np.uint32)
    counted = np.concatenate(([0], np.cumsum(letter)))
    n_letters = counted[ends] - counted[starts]
    # runs of non-letters become one space
    keep = letter | np.concatenate(([True], letter[:-1]))
    keep[starts] = True
    code = code[keep]
    place = np.concatenate(([0], np.cumsum(keep)))
    starts, ends = place[starts], place[ends]
    out, mixed = [], np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        shifted = code[n - 1:]
        mixed = (mixed[:len(shifted)] ^ shifted) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        if n in ORDERS:
            h = ((mixed * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - BITS)).astype(np.uint16)
            out.append((h, starts, np.maximum(ends - n + 1, starts)))
    return out, n_letters


def _counts(parts, i: int) -> np.ndarray:
    return np.concatenate([h[s[i]:e[i]] for h, s, e in parts])


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(COLUMNS, np.int64), 0
    seen = np.zeros(COLUMNS, bool)
    for batch in by_bytes(batches, "text"):
        parts, _ = grams(batch.column("text").to_pylist())
        for i in range(batch.num_rows):
            own = _counts(parts, i)
            seen[own] = True
            df += seen
            seen[own] = False
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())],
                                     names=["bucket", "docs"])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        parts, n = grams(batch.column("text").to_pylist())
        at, tf = [], []
        for i in range(batch.num_rows):
            a, c = np.unique(_counts(parts, i), return_counts=True)
            at.append(a.astype("<u2").tobytes())
            tf.append((c / max(c.sum(), 1)).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(at, pa.binary()),
                                          pa.array(tf, pa.binary()), pa.array(n > 0)],
                                         names=["lang", "doc_id", "at", "tf", "letters"])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5,
               beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, seed: int = 7) -> np.ndarray:
    """FTRL-proximal with elastic net over sparse rows ``(columns, values, class)``; the last column is the
    intercept.  Returns the weights, of shape (columns + 1, classes)."""
    z, n = np.zeros((COLUMNS + 1, classes)), np.zeros((COLUMNS + 1, classes))

    def weights(at):
        za, na = z[at], n[at]
        return np.where(np.abs(za) > l1, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2), 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(COLUMNS + 1))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """Languages, the n-gram weights (already times the inverse document frequency), intercept, temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, intercept: np.ndarray, temperature: float):
        self.languages, self.temperature = languages, temperature
        self.weights, self.intercept = np.ascontiguousarray(weights, np.float32), intercept

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parts, n_letters = grams(texts)
        total, sums = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for h, s, e in parts:
            total += e - s
            some = np.flatnonzero(e > s)
            if len(some):
                cuts = np.stack((s[some], e[some]), 1).ravel()
                for c in range(len(self.languages)):        # one class at a time keeps the gathered rows small
                    got = np.append(self.weights[:, c][h].astype(np.float64), 0.0)
                    sums[some, c] += np.add.reduceat(got, cuts)[::2]
        p = softmax((SCALE * sums / np.maximum(total, 1)[:, None] + self.intercept) / self.temperature)
        known = n_letters > 0
        best = p.argmax(1)
        return ([self.languages[b] if k else "und" for b, k in zip(best, known)],
                np.where(known, p[np.arange(len(p)), best], 0.0))


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Learn from ``labelled(doc_id, text, lang)``; None if no row has both a text with letters and a language.

    Document frequencies come from all rows.  The weights come from a sample of about ``rows_per_language``
    rows of each language, the same in every run, picked by a hash of id and text; equal rows count once."""
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    freq = (rows.select("text").mapInArrow(_document_frequency, "bucket int, docs long")
            .groupBy("bucket").agg(F.sum("docs").alias("docs")).collect())        # at most 2**16 + 1 rows
    n = rows.groupBy("lang").agg(F.count("*").alias("n"))
    picked = (rows.join(F.broadcast(n.select("lang", (F.lit(float(rows_per_language)) / F.col("n")).alias("share"))), "lang")
              .where(unit(F.struct("doc_id", "text")) < F.col("share")).select("lang", "doc_id", "text").distinct())
    sample = picked.mapInArrow(_sample_features, "lang string, doc_id long, at binary, tf binary, letters boolean").collect()
    sample = sorted((r for r in sample if r.letters), key=lambda r: (r.lang, -1 if r.doc_id is None else r.doc_id, r.at, r.tf))
    if not sample:
        return None
    docs = {r.bucket: r.docs for r in freq}
    idf = np.zeros(COLUMNS)
    for bucket, k in docs.items():
        if bucket >= 0:
            idf[bucket] = np.log((1 + docs[-1]) / (1 + k)) + 1
    languages = sorted({r.lang for r in sample})
    data = []
    for r in sample:
        at = np.frombuffer(r.at, "<u2").astype(np.int64)
        x = SCALE * np.frombuffer(r.tf, "<f4").astype(np.float64) * idf[at]
        data.append((np.append(at, COLUMNS), np.append(x, 1.0), languages.index(r.lang)))
    held = [d for i, d in enumerate(data) if i % 5 == 4]
    w = train_ftrl([d for i, d in enumerate(data) if i % 5 != 4], len(languages))
    logits = np.array([x @ w[at] for at, x, _ in held]).reshape(len(held), len(languages))
    t = fit_temperature(logits, np.array([y for _, _, y in held], np.int64))
    return Model(languages, idf[:, None] * w[:COLUMNS], w[COLUMNS], t)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs``, from the whole text alone.

    ``und`` with score 0 for a null text, a text without letters, or when no language could be learned."""
    held = docs.sparkSession.sparkContext.broadcast(model)          # 2**16 columns times the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in by_bytes(batches, "text"):
            texts = batch.column("text").to_pylist()
            lang, score = own.predict(texts) if own else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()),
                                              pa.array(np.clip(score, 0.0, 1.0), pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out fold; a null id is in no fold and trains nothing."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang")).where(fold(F.col("doc_id")) != 1)


def _without_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        _, n_letters = grams(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(n_letters == 0))], names=["bad"])


def keep_known(docs: DataFrame, min_score: float = 0.4) -> DataFrame:
    """``docs`` without the rows whose language can't be told: no letters, or the best language's probability
    under ``min_score``.  The model is fitted on the training fold of ``docs`` itself; where that teaches no
    language, only null texts and texts without letters go.  All columns stay.

    The decision depends on the text alone, so rejected texts leave by their hash."""
    model = fit(training_rows(docs))
    keyed = docs.select(F.struct("*").alias("row"))
    texts = keyed.select(F.xxhash64("row.text").alias("doc_id"), F.col("row.text").cast("string").alias("text")).where("text is not null")
    if model:
        scored = predict(texts, model)
        bad = scored.where((F.col("lang_pred") == "und") | (F.col("score") < min_score)).select(F.col("doc_id").alias("bad"))
    else:
        bad = texts.mapInArrow(_without_letters, "bad bigint")
    bad = written(bad.distinct(), "unknown-language")
    return keyed.where("row.text is not null").join(bad, F.xxhash64("row.text") == F.col("bad"), "left_anti").select("row.*")


def op4(spark, docs: DataFrame) -> DataFrame:
    """The contract's columns.  A null id is not held out."""
    found = predict(docs, fit(training_rows(docs)))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
