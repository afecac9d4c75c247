"""Benchmark decontamination with training suffix arrays.

The training corpus is cut into shards (slices of a scan task's documents).  Each shard's suffixes are sorted
into a suffix array by their words; every benchmark suffix is binary-searched in every shard's array, which
gives the verbatim matches with their places, and from these the longest match per document and item.

* Words are mapped to ids of the benchmark's vocabulary.  A training suffix that meets a foreign word before
  the shortest window ends can match nothing, so such suffixes are left out of the array: an exact pruning.
* A suffix is compared by its first ``window`` words, packed into 64-bit keys; longer matches come from
  neighbouring windows on the same diagonal.
* The benchmark reaches the tasks in blocks of a bounded number of words, one pass over the documents for each
  block; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_bytes, worker_table, written

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: A-Z become a-z; bytes that belong to no word become a space.  In UTF-8 every byte of a non-ASCII
#: character is a word byte, so words of bytes are words of characters.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

FOUND = ("n_words long, hit array<struct<start:int,end:int>>, items array<struct<item_id:bigint,item_start:int,"
         "doc_start:int,length:int>>")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


class Suffixes:
    """The suffixes of a block of benchmark items: vocabulary, distinct windows and where they stand."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids: list[int | None] = []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not ids:
                continue
            k, m = len(self.item_ids), min(window, len(ids))
            self.item_ids.append(item_id)
            for i in range(len(ids) - m + 1):
                places.setdefault(tuple(ids[i:i + m]), []).append((k, i))
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per_key = 63 // self.bits
        found = sorted(places)
        self.length = np.array([len(w) for w in found], np.int64)
        self.shortest = int(self.length.min()) if found else 0
        padded = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            padded[i, :len(w)] = w
        self.keys = self.pack(padded)
        self.masks = self.pack(np.where(np.arange(window) < self.length[:, None], (1 << self.bits) - 1, 0))
        self.place_start = np.cumsum([0, *(len(places[w]) for w in found)])
        flat = [p for w in found for p in places[w]]
        self.place_item = np.array([p[0] for p in flat], np.int64)
        self.place_at = np.array([p[1] for p in flat], np.int64)

    def pack(self, ids: np.ndarray) -> np.ndarray:
        """Word ids of shape (n, window) as 64-bit keys of shape (n, keys) that sort alike."""
        out = []
        for a in range(0, self.window, self.per_key):
            key = np.zeros(len(ids), np.int64)
            for j in range(a, a + self.per_key):
                key = (key << self.bits) | (ids[:, j] if j < self.window else 0)
            out.append(key)
        return np.stack(out, 1)

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start places of the shard's suffixes that can match, sorted by their words, and their keys."""
        n = len(ids)
        foreign = np.flatnonzero(ids == 0)
        run = np.diff(np.concatenate(([-1], foreign, [n])))            # known words before each foreign one
        ends = np.repeat(np.concatenate((foreign, [n])), run)[:n]
        starts = np.flatnonzero(ends - np.arange(n) >= self.shortest)
        taken = starts[:, None] + np.arange(self.window)
        keys = self.pack(np.where(taken < ends[starts][:, None], ids[np.minimum(taken, n - 1)], 0))
        order = np.lexsort(keys.T[::-1])
        return starts[order], keys[order]

    def search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of every benchmark suffix: its range [lo, hi) in the suffix array."""
        def bound(upper: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.keys), np.int64), np.full(len(self.keys), len(keys), np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                at = keys[np.minimum(mid, len(keys) - 1)] & self.masks
                less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
                for j in range(keys.shape[1]):
                    less |= same & (at[:, j] < self.keys[:, j])
                    same &= at[:, j] == self.keys[:, j]
                go = open_ & (less | (same if upper else False))
                lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
            return lo
        return bound(False), bound(True)


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], lo[i]+1, ... (n[i] of them) for every i, one after the other."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def match_shard(shard: list[list[bytes]], tests: Suffixes) -> tuple[list[list[tuple[int, int]]], list[list[tuple]]]:
    """For each document of a shard: merged hit intervals, and per item its longest match
    (item number, start in the item, start in the document, words)."""
    hits: list = [[] for _ in shard]
    best: list = [[] for _ in shard]
    get = tests.vocabulary.get
    sizes = np.array([len(w) + 1 for w in shard], np.int64)             # one foreign word between documents
    ids = np.zeros(int(sizes.sum()), np.int64)
    base = np.cumsum(sizes) - sizes
    for ws, at in zip(shard, base):
        if ws:
            ids[at:at + len(ws)] = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
    if not len(tests.length) or not ids.any():
        return hits, best
    order, keys = tests.suffix_array(ids)
    if not len(order):
        return hits, best
    lo, hi = tests.search(keys)
    win = np.repeat(np.arange(len(lo)), hi - lo)
    if not len(win):
        return hits, best
    at = order[_expand(lo, hi - lo)]
    # hit words: +1 at the start of an occurrence, -1 at its end
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + tests.length[win], -1)
    inside = np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(inside))
    for a, b in zip(edge[::2], edge[1::2]):
        d = int(np.searchsorted(base, a, "right")) - 1
        hits[d].append((int(a - base[d]), int(b - base[d])))
    # longest matches: runs of neighbouring windows on one diagonal (same item, same shift)
    doc = np.searchsorted(base, at, "right") - 1
    n = np.diff(tests.place_start)[win]
    of = _expand(tests.place_start[win], n)
    item, start, place = tests.place_item[of], tests.place_at[of], np.repeat(at, n)
    doc, size = np.repeat(doc, n), np.repeat(tests.length[win], n)
    rank = np.lexsort((start, place - start, item, doc))
    item, start, place, doc, size = item[rank], start[rank], place[rank], doc[rank], size[rank]
    new = np.ones(len(rank), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(place - start) != 0) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(rank)])) - 1
    length = start[last] - start[first] + size[last]
    keep = np.lexsort((place[first], -length, item[first], doc[first]))
    seen = None
    for f, k in zip(first[keep], length[keep]):
        if (pair := (doc[f], item[f])) != seen:
            seen = pair
            best[doc[f]].append((int(item[f]), int(start[f]), int(place[f] - base[doc[f]]), int(k)))
    return hits, best


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def suffix_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verbatim benchmark matches: one row per row of ``docs`` with ``doc_id``, ``n_words``, ``hit`` (merged word
    intervals inside any occurrence of a window) and ``items`` (per item the longest match and its places).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null and empty texts have no words and no hits.  Items without words match nothing; an item with a null id
    makes hits but is not listed.  Repeated document rows give repeated rows; repeated items count once.
    Empty tables give no rows or no hits.  Other columns of either table are not read."""
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-int(size) // block_bytes) or 1
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null").distinct()
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = found.select("*", F.lit(0).cast("bigint").alias("n_words"),
                         F.array().cast("array<struct<start:int,end:int>>").alias("hit"),
                         F.array().cast("array<struct<item_id:bigint,item_start:int,doc_start:int,length:int>>")
                         .alias("items"))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        held = spark.sparkContext.broadcast(Suffixes(rows, window))    # one block: bounded by block_bytes
        found = found.mapInArrow(_matcher(held), f"doc_id bigint, text string, {FOUND}")
    return found.drop("text")


def _matcher(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table("suffixes", lambda: None)          # what other operators kept goes; Spark keeps the broadcast
        tests: Suffixes = held.value
        for batch in by_bytes(batches, "text", 8 << 20):
            shard = [words(t) for t in batch.column("text").to_pylist()]
            hits, best = match_shard(shard, tests)
            old_hit, old_items = batch.column("hit").to_pylist(), batch.column("items").to_pylist()
            all_hit, all_items = [], []
            for d in range(len(shard)):
                spans = [(x["start"], x["end"]) for x in old_hit[d]] + hits[d]
                all_hit.append([{"start": a, "end": b} for a, b in _merge(spans)])
                mine: dict = {x["item_id"]: x for x in old_items[d]}
                for item, i, p, n in best[d]:
                    item_id = tests.item_ids[item]
                    if item_id is not None and (item_id not in mine or mine[item_id]["length"] < n):
                        mine[item_id] = {"item_id": item_id, "item_start": i, "doc_start": p, "length": n}
                all_items.append(list(mine.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array([len(w) for w in shard], pa.int64()),
                 pa.array(all_hit, batch.schema.field("hit").type), pa.array(all_items, batch.schema.field("items").type)],
                names=["doc_id", "text", "n_words", "hit", "items"])
    return run


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    """At least one hit word, and at least one word in twenty."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def hit_words() -> F.Column:
    return F.aggregate("hit", F.lit(0).cast("bigint"), lambda s, x: s + (x["end"] - x["start"]).cast("bigint"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated documents; all columns and all other rows stay as they are.

    A row goes if the matches of its own text make it contaminated, so equal texts share their fate; null
    texts stay.  The contaminated texts' keys are a small written table; they leave by an anti-join."""
    keyed = docs.select(F.struct("*").alias("row"))
    found = suffix_matches(keyed.select(F.xxhash64("row.text").alias("doc_id"), "row.text"), benchmark, window)
    gone = found.where(contaminated(hit_words(), F.col("n_words"))).select(F.col("doc_id").alias("gone")).distinct()
    gone = broadcast_if_small(written(gone, "contaminated"), 16)
    return keyed.join(gone, F.xxhash64("row.text") == F.col("gone"), "left_anti").select("row.*")


def op1(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of :func:`suffix_matches`."""
    found = suffix_matches(docs, benchmark)
    ids = F.array_sort(F.transform("items", lambda x: x["item_id"].cast("string")))
    longest = F.array_max(F.transform("items", lambda x: x["length"]))
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        contaminated(hit_words(), F.col("n_words")).alias("contaminated"),
        F.coalesce(longest, F.lit(0)).cast("bigint").alias("longest_match"))
