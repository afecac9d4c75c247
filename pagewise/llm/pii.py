"""Personal data: candidate spans, scored by gradient-boosted trees.

Base rules (e-mail, IP address, card, phone) state spans that always count.  Wider generators propose further,
overlapping spans: addresses written out ("name at host dot org"), numbers without their plus sign, grouped
digits.  Boosted trees score a candidate by its format and the text around it; a span is redacted if its
probability, calibrated on held-back documents, passes the threshold of its kind.

The labels are the base rules' own verdicts, and each base span is also shown in a disguise that the rules miss
(without its plus sign, with its @ spelt out), in its own context.  Candidates that fail a rule's test, such as a
16-digit number with a wrong check digit, are the negatives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, unit

KINDS = ("email", "ip", "card", "phone")
#: The trees are fitted on candidates of at most about so many documents that have any.
SAMPLE_DOCUMENTS = 4000
#: Redaction asks for this precision on held-back documents.
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs are taken whole (possessive), which finds what the plain patterns find, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# High-recall generators.
_SPELT = re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|(?<= )at(?= )|@) ?[A-Za-z0-9-]{1,63}"
                    r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}|(?<= )dot(?= )|\.) ?[A-Za-z0-9-]{2,63})+", re.I)
_DIGITS = re.compile(r"(?<![0-9])\(?[0-9](?:[ ().\-]{0,2}[0-9]){6,}+")
_HINT = re.compile(r"(?i) at |[(\[{]at[)\]}]")
_CONTEXT = (("mail", "contact", "write", "correo", "courriel", "schreib"), ("phone", "tel", "call", "fax", "mobil", "anruf", "llam"),
            ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta"), ("ip", "host", "server", "addr", "login"),
            ("order", "version", "isbn", "serial", "id", "no.", "nr", "page"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The rules' spans as (start, kind number, end), sorted; code points, end exclusive."""
    out = []
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            out.append((start, 0, host.end()))
            free = host.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _only_digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_only_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Every proposed span as (start, kind number, end), sorted: what the rules' patterns match before their
    tests, and the wider generators' spans."""
    out = set(base_spans(text))
    for m in _IP.finditer(text):
        out.add((m.start(), 1, m.end()))
    for m in _DIGITS.finditer(text):
        n = len(_only_digits(m.group()))
        if 7 <= n <= 15:
            out.add((m.start(), 3, m.end()))
        if 12 <= n <= 19:
            out.add((m.start(), 2, m.end()))
    if "@" in text or _HINT.search(text):
        for m in _SPELT.finditer(text):
            out.add((m.start(), 0, m.end()))
    return sorted(out)


def features(span: str, kind: int, before: str, after: str) -> list[float]:
    """Format of the span and its context (up to 24 characters on either side)."""
    d = _only_digits(span)
    groups = re.findall(r"[0-9]+", span)
    lens = [len(g) for g in groups] or [0]
    low = before.lower()
    plain = re.sub(r" ?[(\[{](?:at)[)\]}] ?| at ", "@", re.sub(r" ?[(\[{]dot[)\]}] ?| dot ", ".", span, flags=re.I), flags=re.I)
    host = plain.rpartition("@")[2]
    ends = host.rpartition(".")[2]
    f = [float(kind == k) for k in range(4)]
    f += [len(span), len(d), len(groups), max(lens), min(lens), len(d) / max(len(span), 1)]
    f += [span.count(c) for c in "+().- @"]
    f += [float(luhn(d)) if len(d) > 1 else 0.0, float(all(len(g) < 4 and int(g) < 256 for g in groups)) if groups else 0.0]
    f += [float(len(groups) == 4 and span.count(".") == 3), float(14 <= len(d) <= 19), float(10 <= len(d) <= 15),
          float(len(set(d)))]
    f += [float("@" in plain and "." in host), float(ends.isalpha() and 2 <= len(ends) <= 6), len(plain.partition("@")[0]),
          float(any(c.isdigit() for c in plain.partition("@")[0]))]
    f += [float(before[-1:].isalpha()), float(before[-1:].isdigit()), float(after[:1].isalpha()), float(after[:1].isdigit()),
          float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after))]
    return f + [float(any(w in low for w in words)) for words in _CONTEXT]


N_FEATURES = len(features("a@b.c", 0, "", ""))


def _disguise(span: str, kind: int) -> str | None:
    if kind == 0:
        name, _, host = span.partition("@")
        return f"{name} at {host.replace('.', ' dot ')}"
    if kind == 3 and re.search(r"[ ().-]", span):
        return re.sub(r"^\+[0-9]{1,3}[ .-]?(?=[(0-9])", "", span)
    return None


def examples(text: str) -> list[tuple[list[float], int, int]]:
    """(features, kind, label) of a text's candidates.  A candidate that only overlaps a base span is left out."""
    base = base_spans(text)
    known, out = set(base), []
    for start, kind, end in candidates(text):
        around = text[max(start - 24, 0):start], text[end:end + 24]
        if (start, kind, end) in known:
            out.append((features(text[start:end], kind, *around), kind, 1))
            other = _disguise(text[start:end], kind)
            if other:
                out.append((features(other, kind, *around), kind, 1))
        elif not any(a < end and start < b for a, _, b in base):
            out.append((features(text[start:end], kind, *around), kind, 0))
    return out


# --------------------------------------------------------------------------------------
# Gradient-boosted trees
# --------------------------------------------------------------------------------------

class BoostedTrees:
    """Logistic gradient boosting over trees of depth ``depth``, with a Platt calibration of the margin."""

    def __init__(self):
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start, self.slope, self.shift = 0.0, 1.0, 0.0
        self.limits = np.full(len(KINDS), 2.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for column, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > cut[node])
            z += leaf[node - len(column)]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.3,
            bins: int = 32) -> BoostedTrees:
        self.depth = depth
        rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate_of / (1 - rate_of)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        z = np.full(len(x), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            inner = 2 ** depth - 1
            column, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
            for k in range(inner):
                own = np.flatnonzero(node == k)
                best = 1e-6
                G, H = g[own].sum(), h[own].sum()
                for j, c in enumerate(cuts):
                    if not len(c) or not len(own):
                        continue
                    gs = np.cumsum(np.bincount(binned[own, j], weights=g[own], minlength=len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[own, j], weights=h[own], minlength=len(c) + 1))[:-1]
                    gain = gs ** 2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G ** 2 / (H + 1)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, column[k], cut[k] = gain[i], j, c[i]
                node[own] = 2 * k + 1 + (x[own, column[k]] > cut[k])
            leaf = np.zeros(inner + 1)
            np.add.at(leaf, node - inner, g)
            weight = np.ones(inner + 1)
            np.add.at(weight, node - inner, h)
            leaf = rate * leaf / weight
            self.trees.append((column, cut, leaf))
            z += leaf[node - inner]
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray, precision: float = PRECISION) -> BoostedTrees:
        """Platt scaling, then for each kind the lowest threshold that reaches ``precision``; a kind that can't
        be judged, with fewer than 20 positives, gets no redactions beyond the rules."""
        z = np.clip(self.margin(x), -30, 30)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))
            self.slope -= 0.05 * float(((p - y) * z).mean())
            self.shift -= 0.05 * float((p - y).mean())
        p = self.probability(x)
        for k in range(len(KINDS)):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(-p[own], kind="stable")]
            if y[own].sum() >= 20:
                right = np.cumsum(y[own]) / np.arange(1, len(own) + 1)
                last = np.ones(len(own), bool)
                last[:-1] = p[own][1:] < p[own][:-1]
                good = np.flatnonzero((right >= precision) & last)
                if len(good):
                    self.limits[k] = max(p[own][good[-1]], 0.5)
        return self


def _sample_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        rows = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            own = examples(text)
            if own:
                rows.append((key, np.array([e[0] for e in own], "<f4").tobytes(), [e[1] for e in own], [e[2] for e in own]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["key", "x", "kind", "label"])


def _with_digits_or_at(text: F.Column) -> F.Column:
    return text.rlike("[0-9@]")


def fit(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> BoostedTrees | None:
    """Fit the trees on a sample of the documents with digits or an @, the same in every run (picked by a hash
    of the text; equal texts count once).  None if it has no positives or no negatives."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where(_with_digits_or_at(F.col("text")))
    n = rows.count()
    picked = rows.where(unit("text") < F.lit(sample_documents / max(n, 1))).distinct().select(F.xxhash64("text").alias("key"), "text")
    got = sorted(picked.mapInArrow(_sample_examples, "key long, x binary, kind array<int>, label array<int>").collect(),
                 key=lambda r: (r.key, r.x))
    if not got:
        return None
    parts = []
    for rest in (False, True):                    # every fourth document calibrates
        own = [r for i, r in enumerate(got) if (i % 4 == 3) == rest]
        parts.append((np.concatenate([np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES) for r in own] or [np.zeros((0, N_FEATURES))]),
                      np.array([y for r in own for y in r.label], float), np.array([k for r in own for k in r.kind], int)))
    (x, y, _), (cx, cy, ck) = parts
    if not 0 < y.sum() < len(y) or not len(cy):
        return None
    return BoostedTrees().fit(x.astype(float), y).calibrate(cx.astype(float), cy, ck)


def find(text: str, model: BoostedTrees | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans).  An added span touches no base span; of overlapping ones the likeliest stays."""
    base = base_spans(text)
    if model is None:
        return base, base
    known = set(base)
    rest = [c for c in candidates(text) if c not in known and not any(a < c[2] and c[0] < b for a, _, b in base)]
    if not rest:
        return base, base
    x = np.array([features(text[a:b], k, text[max(a - 24, 0):a], text[b:b + 24]) for a, k, b in rest])
    p = model.probability(x)
    added: list[tuple[int, int, int]] = []
    for i in np.argsort(-p, kind="stable"):
        a, k, b = rest[i]
        if p[i] >= model.limits[k] and not any(s < b and a < e for s, _, e in added):
            added.append(rest[i])
    return base, sorted(base + added)


SPAN = "array<struct<start:int,kind:int,end:int>>"


def find_personal_data(docs: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """``doc_id, base, spans`` for each row of ``docs``: the rules' spans and all spans of the whole text, as
    (start, kind number, end) in code points, end exclusive, sorted.

    Null and empty texts have none.  Repeated rows give repeated rows, an empty table none; other columns are
    not read.  Without a model only the rules speak."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in by_bytes(batches, "text"):
            found = [find(t or "", own) for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            cols = [pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "base", "spans"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, f"doc_id bigint, base {SPAN}, spans {SPAN}")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with ``[KIND]`` in place of each span; of overlapping spans the first counts."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _told(column: str) -> F.Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> F.Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def op3(spark, docs: DataFrame) -> DataFrame:
    """The contract's counts, digest and list of spans."""
    found = find_personal_data(docs, fit(docs))
    counts = [_count(k).cast("bigint").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans"))
