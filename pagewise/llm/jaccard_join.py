"""N-gram Jaccard self-join with signature trees.

A document is its set of distinct word shingles (64-bit hashes).  Two documents link when the size of their
intersection is at least ``num/den`` of that of their union; the result is the linked components.

1. Equal sets are one node.  In any fixed order of all shingles, two sets that link share a shingle among the
   first ``n - ceil(num/den * n) + 1`` of each (exact).  Shingles that one node alone has come first in the order.
   A node with that many lone shingles within one slice of the hash range links with nothing: one cheap pass is
   enough for most.  The others are ordered by the document frequencies among themselves, over all shingles.
2. Nodes connected by shared prefix shingles form clusters.  A task builds a signature tree over a cluster's
   sets: every tree node holds the OR (and AND) of its sets' token bitmaps and the range of their sizes.  A dual
   traversal drops pairs of tree nodes whose largest possible overlap is too small, and pairs that are already one
   component, and verifies the rest exactly.
3. A cluster over ``BLOCK`` nodes is not gathered in one task: all its sets are compared with one leader first,
   and only sets that do not link to it are compared with the cluster, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_bytes, components, mix64, worker_table, written

#: Nodes of a cluster that one task compares with each other.
BLOCK = 1024
LEAF, FANOUT = 16, 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordHashes(dict):
    """64-bit hashes of words, kept between the texts that a Python worker reads."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted 64-bit hashes; with fewer words, the whole sequence as
    one; none without words.  Words are runs of characters other than ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(worker_table("word hashes", WordHashes).__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(31) + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def prefix_length(n: int, num: int, den: int) -> int:
    return n + (-num * n) // den + 1          # n - ceil(num * n / den) + 1


def slices(num: int, den: int) -> int:
    """Slices of the hash range: one slice holds nearly twice a prefix."""
    return max(1, round(den / (1.9 * (den - num)))) if num < den else 8


def _described(k: int, num: int, den: int):
    top = (1 << 64) // slices(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in by_bytes(batches, "text"):
            n, keys, tokens = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                keys.append(key)
                if key is None or key in seen:                 # an equal set of this task has told its tokens
                    tokens.append(None)
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                tokens.append(s[:np.searchsorted(s, np.uint64(min(top, 2**64 - 1)))].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(tokens, pa.list_(pa.int64()))], names=["uid", "doc_id", "n", "set_key", "tokens"])
    return run


def _whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = [shingles(t, k).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"])
    return run


def _prefixes(num: int, den: int):
    """Of a node's shared tokens (with document frequencies), those among the first of its order.  Works on the flat
    Arrow arrays: the tokens of a batch never become Python objects."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shared")
            held = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            df, token = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("df", "token"))
            n, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "node"))
            row = np.repeat(np.arange(len(held)), held)
            order = np.lexsort((token, df, row))                    # rows stay in their places
            rank = np.arange(len(row)) - (np.cumsum(held) - held)[row]
            most = prefix_length(n, num, den) - (n - held)          # the others are lone
            keep = rank < most[row]
            yield pa.RecordBatch.from_arrays([pa.array(node[row][keep], pa.int64()), pa.array(token[order][keep], pa.int64())],
                                             names=["node", "token"])
    return run


# --------------------------------------------------------------------------------------
# Signature trees
# --------------------------------------------------------------------------------------

class Forest:
    """Union-find over positions."""

    def __init__(self, labels: np.ndarray):
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[inverse].tolist()

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


class SignatureTree:
    """Levels of nodes over sets: [first, last) of the ordered sets, OR and AND bitmaps, size range."""

    def __init__(self, sets: list[np.ndarray], places: np.ndarray, words: int):
        self.places = places
        n = len(places)
        self.maps = np.zeros((n, words), np.uint64)
        self.size = np.array([len(sets[p]) for p in places], np.int64)
        for i, p in enumerate(places):
            bit = sets[p] & np.uint64(words * 64 - 1)
            np.bitwise_or.at(self.maps[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        first = np.arange(0, n, LEAF)
        self.levels = [self._level(first, np.append(first[1:], n))]
        while len(self.levels[-1]["first"]) > 1:
            low = self.levels[-1]
            pick = np.arange(0, len(low["first"]), FANOUT)
            self.levels.append(self._level(low["first"][pick], np.append(low["first"][pick[1:]], n)))

    def _level(self, first: np.ndarray, last: np.ndarray) -> dict:
        return {"first": first, "last": last, "or": np.bitwise_or.reduceat(self.maps, first, axis=0),
                "and": np.bitwise_and.reduceat(self.maps, first, axis=0),
                "low": np.minimum.reduceat(self.size, first), "high": np.maximum.reduceat(self.size, first)}

    def children(self, level: int, i: int) -> range:
        return range(i * FANOUT, min((i + 1) * FANOUT, len(self.levels[level - 1]["first"])))


def bitmap_words(sets: list[np.ndarray]) -> int:
    """64-bit words of a bitmap: about four bits for each token of the middle set, within bounds."""
    middle = sorted(map(len, sets))[len(sets) // 2]
    return 1 << int(np.clip(np.ceil(np.log2(max(middle, 1) * 4 / 64)), 3, 10))


def ordered(sets: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    """Positions with sets of like size and like lowest tokens beside each other."""
    return np.array(sorted(of, key=lambda i: (len(sets[i]).bit_length(), int(sets[i][0]), len(sets[i]))), np.int64)


def link(sets: list[np.ndarray], forest: Forest, left: np.ndarray, right: np.ndarray | None, num: int, den: int) -> int:
    """Join in ``forest`` all linked sets, one of ``left`` and one of ``right`` (None: both of ``left``).
    Returns the number of exact verifications."""
    words = bitmap_words(sets)
    x = SignatureTree(sets, ordered(sets, left), words)
    y = x if right is None else SignatureTree(sets, ordered(sets, right), words)
    verified = 0

    def same(t: SignatureTree, a: int, b: int, u: SignatureTree, c: int, d: int) -> bool:
        r = forest.root(int(t.places[a]))
        return all(forest.root(int(p)) == r for p in t.places[a:b]) and all(forest.root(int(p)) == r for p in u.places[c:d])

    def impossible(p: dict, i: int, q: dict, j: int) -> bool:
        need = max(p["low"][i], q["low"][j])
        most = min(p["high"][i] - int(np.bitwise_count(p["and"][i] & ~q["or"][j]).sum()),
                   q["high"][j] - int(np.bitwise_count(q["and"][j] & ~p["or"][i]).sum()))
        return most * den < num * need

    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        a, i, b, j = stack.pop()
        p, q = x.levels[a], y.levels[b]
        if impossible(p, i, q, j) and not (x is y and a == b and i == j):
            continue
        r, s, u, v = p["first"][i], p["last"][i], q["first"][j], q["last"][j]
        if same(x, r, s, y, u, v):
            continue
        if a > b or (a == b and a > 0):
            for c in x.children(a, i):
                if x is y and a == b and i == j:
                    stack += [(a - 1, c, a - 1, d) for d in x.children(a, i) if d >= c]
                else:
                    stack.append((a - 1, c, b, j))
        elif b > 0:
            stack += [(a, i, b - 1, d) for d in y.children(b, j)]
        else:
            for m in range(r, s):
                own, n = sets[x.places[m]], x.size[m]
                low = m + 1 if x is y and i == j else u
                if low >= v:
                    continue
                sizes = y.size[low:v]
                most = np.minimum(n - np.bitwise_count(x.maps[m] & ~y.maps[low:v]).sum(1).astype(np.int64),
                                  sizes - np.bitwise_count(y.maps[low:v] & ~x.maps[m]).sum(1).astype(np.int64))
                for o in np.flatnonzero(most * den >= num * np.maximum(n, sizes)):
                    left_at, right_at = int(x.places[m]), int(y.places[low + o])
                    if forest.root(left_at) == forest.root(right_at):
                        continue
                    verified += 1
                    if linked(own, sets[right_at], num, den):
                        forest.join(left_at, right_at)
    return verified


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _sets(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(s, np.int64).view(np.uint64) for s in frame["tokens"]]


def _set(scalar: pa.ListScalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _edges(nodes: np.ndarray, forest: Forest) -> pd.DataFrame:
    roots = np.array([forest.root(i) for i in range(len(nodes))], np.int64)
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, nodes)
    out = pd.DataFrame({"a": nodes, "b": least[roots]}).drop_duplicates()
    return out[out["a"] != out["b"]]


# --------------------------------------------------------------------------------------
# The join
# --------------------------------------------------------------------------------------

def _whole_clusters(num: int, den: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        sets, nodes = _sets(frame), frame["node"].to_numpy()
        forest = Forest(np.arange(len(nodes)))
        link(sets, forest, np.arange(len(nodes)), None, num, den)
        return _edges(nodes, forest)
    return run


def _large_clusters(large: DataFrame, num: int, den: int) -> DataFrame:
    """Links within clusters of more than ``BLOCK`` nodes: ``large(node, cluster, tokens)``."""
    salts = 32
    leaders = large.where("node = cluster").select(F.col("cluster").alias("of"), F.col("tokens").alias("leader"))
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [linked(_set(batch.column("tokens")[i]), _set(batch.column("leader")[i]), num, den) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("cluster"), pa.array(hit)], names=["node", "cluster", "hit"])
    salted = large.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    seen = written(salted.join(leaders, (salted["cluster"] == leaders["of"]) & (salted["salt"] == leaders["salt"]))
                   .select("node", "cluster", "tokens", "leader").mapInArrow(star, "node long, cluster long, hit boolean"), "leaders")
    edges = seen.where("hit").select(F.col("node").alias("a"), F.col("cluster").alias("b"))
    counts = seen.groupBy("cluster").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.count(F.when(~F.col("hit"), 1)) / (BLOCK // 2)).cast("int").alias("rest")).where("rest > 0")
    rows = large.join(seen.select("node", "hit"), "node").join(counts, "cluster")
    spread = F.xxhash64("node")
    right = rows.withColumn("block", F.pmod(spread, F.col("blocks")).cast("int")).withColumn(
        "own", F.explode(F.sequence(F.lit(0), F.col("rest") - 1))).withColumn("left", F.lit(False))
    left = rows.where("not hit").withColumn("own", F.pmod(spread, F.col("rest")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("left", F.lit(True))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["node", "left"])
        sets, nodes = _sets(frame), frame["node"].to_numpy()
        label = np.where(frame["hit"], frame["cluster"], nodes)          # linked to the leader: one component
        forest = Forest(label)
        is_left = frame["left"].to_numpy()
        if is_left.any() and not is_left.all():
            link(sets, forest, np.flatnonzero(is_left), np.flatnonzero(~is_left), num, den)
        return _edges(nodes, forest)
    cols = ["cluster", "own", "block", "node", "hit", "left", "tokens"]
    blocks = left.select(*cols).unionByName(right.select(*cols)).groupBy("cluster", "own", "block").applyInPandas(compare, "a long, b long")
    return edges.unionByName(blocks)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents whose k-word shingle sets have a Jaccard similarity of at least ``num/den``.

    One row per row of ``docs``: ``uid`` (the row's number in this reading), ``doc_id``, ``n_shingles`` (the
    set's size) and ``component_id``, the smallest ``doc_id`` reachable by links, itself included; ids that
    are null are passed over, and a component without ids has a null one.  A document without words or text
    has 0 shingles and links with nothing, not even its like.  Repeated rows are linked copies.  An empty
    table gives no rows; other columns are not read.  ``docs`` must be a plain reading of files, so that its
    rows have the same numbers each time they are read."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    told = written(rows.mapInArrow(_described(k, num, den), "uid long, doc_id long, n long, set_key binary, tokens array<long>"), "sets")
    # one node for equal sets
    node = written(told.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.when(F.col("tokens").isNotNull(), F.col("uid"))).alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    copies = node.where("copies > 1").select("set_key", F.col("node").alias("kept"))
    teller = told.where("tokens is not null").join(broadcast_if_small(written(copies, "copies"), 48), "set_key", "left").where(
        "kept is null or kept = uid").select(F.col("uid").alias("node"), "n", "tokens")
    # nodes with a prefix full of lone tokens link with nothing
    need = F.col("n") - F.ceil(F.col("n") * num / F.lit(float(den)) - 1e-9) + 1
    token = teller.select("node", F.explode("tokens").alias("token"))
    met = token.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1").groupBy("node").agg(F.count("*").alias("met"))
    open_ = teller.select("node", "n", F.size("tokens").alias("told")).join(met, "node", "left").where(
        F.col("told") - F.coalesce("met", F.lit(0)) < need).select("node", "n")
    open_ = broadcast_if_small(written(open_, "open-nodes"), 24)
    texts = rows.join(open_, F.col("uid") == F.col("node")).select("node", "text")
    whole = written(texts.mapInArrow(_whole_sets(k), "node long, tokens array<long>"), "open-sets")
    shared = whole.select("node", F.explode("tokens").alias("token")).withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    per_node = shared.groupBy("node").agg(F.collect_list(F.struct("token", "df")).alias("shared"))
    prefix = per_node.join(open_, "node").select("node", "n", "shared").mapInArrow(_prefixes(num, den), "node long, token long")
    least = F.min("node").over(Window.partitionBy("token"))
    pairs = prefix.select("node", least.alias("other")).where("node != other")
    clusters = written(components(pairs, "clusters").select("node", F.col("root").alias("cluster")), "clusters")
    sets = whole.join(broadcast_if_small(clusters, 32), "node").select("node", "cluster", "tokens")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    big = written(sizes.where(F.col("members") > BLOCK).select("cluster"), "large-clusters")
    small = sets.join(broadcast_if_small(big, 16), "cluster", "left_anti")
    roots = small.groupBy("cluster").applyInPandas(_whole_clusters(num, den), "a long, b long").select(
        F.col("a").alias("node"), F.col("b").alias("root"))
    if not big.isEmpty():
        large = sets.join(broadcast_if_small(big, 16), "cluster", "left_semi").select("node", "cluster", "tokens")
        found = components(_large_clusters(large, num, den), "large")
        roots = roots.unionByName(found.where("node != root"))
    roots = written(roots, "roots")
    # smallest doc_id of each component, then of each set
    joined = node.join(broadcast_if_small(roots, 32), "node", "left").select("set_key", "least", "copies", F.coalesce("root", "node").alias("root"))
    joined = joined.withColumn("known", F.col("least"))
    comp = joined.groupBy("root").agg(F.min("known").alias("component_id"), F.sum("copies").alias("members"))
    answer = written(joined.select("set_key", "root").join(comp, "root").where("members > 1").select("set_key", "component_id"), "component-ids")
    with_set = told.where("set_key is not null").join(broadcast_if_small(answer, 48), "set_key", "left")
    one = with_set.unionByName(told.where("set_key is null"), allowMissingColumns=True)
    return one.select("uid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id (of repeated rows, the first in
    reading order).  Documents without words stay, as all columns do."""
    found = jaccard_components(docs, k, num, den).where("n_shingles > 0")
    # doc_id null: a component of its copies only, told apart by the row itself
    group = F.coalesce("component_id", -1 - F.col("uid"))
    kept = found.groupBy(group.alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("best"))
    gone = found.withColumn("group", group).join(kept, "group").where("best.uid != uid").select(F.col("uid").alias("gone"))
    gone = broadcast_if_small(written(gone, "near-copies"), 16)
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")).join(
        gone, F.col("uid") == F.col("gone"), "left_anti").select("row.*")


def op10(spark, docs: DataFrame) -> DataFrame:
    """The contract's columns: three-word shingles, 90 of 100."""
    return jaccard_components(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id")
