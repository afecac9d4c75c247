"""Phrase collocation mining by a multikey three-way quicksort of suffix pointers.

Words are counted per language first.  That gives the text length and the leading words that can begin a phrase at
all: a phrase is no more frequent than any word of it.  Every occurrence of a frequent word is then the start of a
suffix of at most ``words`` words, which ends at its piece's end or before the first infrequent word.  Equal
suffixes of a batch are one weighted suffix.

Suffixes are routed by their leading word, and those of a hot leading word by the words behind it too, so that no route
holds more than a share of the table.  In each partition the suffix pointers are sorted by a three-way quicksort on
one word after the other: the pointers equal to the pivot agree in one word more, so their weight is that phrase's
count.  Partitions of less weight than a candidate needs are abandoned at once.  Only what a route holds in part
(prefixes of hot words) is handed on whatever its weight and summed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_bytes, written

WORDS, LEAST, TOP = 3, 10, 2000
#: Numerator and denominator of the share at which a longer phrase takes its parts' place.
PART = (50, 100)
#: Word occurrences that one partition of the sort gets on average.
PARTITION_WORDS = 1_000_000
#: The frequent words go to the workers only if they take so many bytes at most; else no suffix is cut by them.
FREQUENT_BYTES = 16 << 20
UNKNOWN = "und"
_WORD, _SPACE, _END = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_LINES = np.zeros(256, np.uint8)
_LINES[0x20], _LINES[0x0A] = _SPACE, _END


def split_words(data: bytes, classes: np.ndarray = _CLASS) -> tuple[pa.Array, np.ndarray]:
    """The words of a byte string, and for each the number of its piece."""
    raw = np.frombuffer(data, np.uint8)
    kind = classes[raw]
    word = kind == _WORD
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[word]))])
    return words, np.searchsorted(np.flatnonzero(kind == _END), starts)


def multikey_quicksort(keys: np.ndarray, weight: np.ndarray, least: int, partial: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Three-way quicksort of pointers to the rows of ``keys`` (-1: the suffix has ended), all partitions of a round at
    once.  Yields ``(depth, pointers, weights)``: one pointer for each set of suffixes that agree in their first
    ``depth`` words, with their whole weight.  Sets of less weight than ``least`` are abandoned, but for those whose
    prefix has at most ``partial`` words (of which only a part is here)."""
    depth_max = keys.shape[1]
    live = keys[:, 0] >= 0
    pointer = np.flatnonzero(live)
    starts, depth = np.zeros(min(1, len(pointer)), np.int64), np.zeros(min(1, len(pointer)), np.int64)
    while len(pointer):
        sizes = np.diff(starts, append=len(pointer))
        of = np.repeat(np.arange(len(starts)), sizes)
        key = keys[pointer, depth[of]]
        a, b, c = key[starts], key[starts + sizes // 2], key[starts + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        side = of * 3 + 1 + (key > pivot[of]) - (key < pivot[of])
        counts = np.bincount(side, minlength=3 * len(starts))
        first = np.cumsum(counts) - counts
        place = np.empty(len(pointer), np.int64)
        for s in range(3):                                   # a stable move to the less, equal and greater part
            mask = side % 3 == s
            place[mask] = (np.cumsum(mask) - 1)[mask] - (np.cumsum(counts[s::3]) - counts[s::3])[of[mask]] + first[side[mask]]
        moved = np.empty_like(pointer)
        moved[place] = pointer
        held = counts > 0
        begin, size = first[held], counts[held]
        now = np.repeat(depth, 3)[held]
        equal = (np.arange(3 * len(starts)) % 3 == 1)[held]
        total = np.add.reduceat(weight[moved], begin)
        inner = np.maximum.reduceat(partial[moved], begin)
        now = now + equal
        out = equal & (keys[moved[begin], now - 1] >= 0) if len(begin) else equal
        for d in range(1, depth_max + 1):
            told = out & (now == d) & ((total >= least) | (inner >= d))
            if told.any():
                yield d, moved[begin[told]], total[told]
        ended = equal & ((now == depth_max) | ~out)
        going = ~ended & ((total >= least) | (inner > now))
        keep = np.repeat(going, size)
        pointer, depth = moved[keep], now[going]
        starts = np.cumsum(size[going]) - size[going]


# --------------------------------------------------------------------------------------
# Words, suffixes, routes
# --------------------------------------------------------------------------------------

def _language(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _by_language(batches: Iterator[pa.RecordBatch], limit: int = 6 << 20) -> Iterator[tuple[str, bytes]]:
    """The texts of a language in a batch as one byte string, in lower case, a piece's end between them."""
    for batch in by_bytes(batches, "text", limit):
        lang = batch.column("lang").dictionary_encode()
        codes = lang.indices.to_numpy(zero_copy_only=False)
        text = batch.column("text").cast(pa.binary())
        for i, name in enumerate(lang.dictionary.to_pylist()):
            own = text.take(pa.array(np.flatnonzero(codes == i)))
            yield name, b"\n".join(own.to_pylist()).translate(_LOWER)


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` for every word of the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _by_language(batches):
            found = split_words(data)[0].value_counts()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found.field(0).cast(pa.string()),
                                              found.field(1).cast(pa.int64())], names=["lang", "word", "f"])
    return (_language(docs).mapInArrow(run, "lang string, word string, f bigint")
            .groupBy("lang", "word").agg(F.sum("f").alias("f")))


def _unique_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of small integers from -1, with their counts."""
    width = int(rows.max(initial=0)) + 2
    if width ** rows.shape[1] < 2 ** 63:
        packed = np.zeros(len(rows), np.int64)
        for c in rows.T:
            packed = packed * width + (c + 1)
        packed, n = np.unique(packed, return_counts=True)
        out = np.empty((len(packed), rows.shape[1]), np.int64)
        for i in range(rows.shape[1] - 1, -1, -1):
            packed, out[:, i] = np.divmod(packed, width)
        return out - 1, n
    return np.unique(rows, axis=0, return_counts=True)


def suffixes(codes: np.ndarray, piece: np.ndarray, words: int) -> np.ndarray:
    """For each word with a code of 0 or more: the codes from there on, -1 from the piece's end or a word without code."""
    out = np.full((len(codes), words), -1, np.int64)
    out[:, 0] = codes
    for i in range(1, words):
        n = len(codes) - i
        if n <= 0:
            break
        on = (out[:n, i - 1] >= 0) & (piece[i:] == piece[:n])
        out[:n, i] = np.where(on, codes[i:], -1)
    return out[codes >= 0]


def _hash_words(words: pa.Array) -> np.ndarray:
    import zlib
    return np.fromiter(map(zlib.crc32, words.to_pylist()), np.uint64, len(words))


def _depth_routed(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """How many words of a suffix are spread over routes: its hot leading words, but for the last word."""
    lead = np.zeros(len(keys), np.int64)
    going = np.ones(len(keys), bool)
    for i in range(keys.shape[1] - 1):
        going &= (keys[:, i] >= 0) & hot[np.maximum(keys[:, i], 0)]
        lead += going
    return lead


def routed(docs: DataFrame, words: int, routes: int, frequent, hot) -> DataFrame:
    """``route, lang, block``: weighted suffixes as lines ``weight word ...``, a block for each route and batch.
    ``frequent`` and ``hot`` are broadcast sets of ``lang`` TAB ``word`` (``frequent``: None for no cut)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, heavy = (None if s is None else pa.array(s.value, pa.binary()) for s in (frequent, hot))
        for lang, data in _by_language(batches):
            tokens, piece = split_words(data)
            if not len(tokens):
                continue
            coded = tokens.dictionary_encode()
            known, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            named = pc.binary_join_element_wise(pa.scalar(lang.encode(), pa.binary()), known, b"\t")
            if allowed is not None:
                kept = pc.is_in(named, value_set=allowed).to_numpy(zero_copy_only=False)
                codes = np.where(kept, np.cumsum(kept) - 1, -1)[codes]
                known, named = known.filter(pa.array(kept)), named.filter(pa.array(kept))
            if not len(known):
                continue
            keys, n = _unique_rows(suffixes(codes, piece, words))
            lead = _depth_routed(keys, pc.is_in(named, value_set=heavy).to_numpy(zero_copy_only=False))
            hashed = _hash_words(named)
            route = hashed[keys[:, 0]]
            for i in range(1, words):
                more = (lead >= i) & (keys[:, i] >= 0)
                route = np.where(more, route * np.uint64(0x9E3779B1) + hashed[np.maximum(keys[:, i], 0)], route)
            route = ((route ^ (route >> np.uint64(17))) % np.uint64(routes)).astype(np.int64)
            order = np.argsort(route, kind="stable")
            keys, n, route = keys[order], n[order], route[order]
            parts = [pa.array(n).cast(pa.string()).cast(pa.binary())]
            parts += [known.take(pa.array(c, mask=c < 0)) for c in keys.T]
            lines = pc.binary_join_element_wise(*parts, pa.scalar(b"\n", pa.binary()), b" ", null_handling="skip")
            ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset:lines.offset + len(lines) + 1]
            body = memoryview(lines.buffers()[2])
            cut = np.flatnonzero(np.diff(route, prepend=-1))
            to = [*cut[1:], len(route)]
            blocks = [bytes(body[ends[a]:ends[b]]) for a, b in zip(cut, to)]
            yield pa.RecordBatch.from_arrays([pa.array(route[cut], pa.int64()), pa.array([lang] * len(cut), pa.string()),
                                              pa.array(blocks, pa.binary())], names=["route", "lang", "block"])
    return _language(docs).mapInArrow(run, "route bigint, lang string, block binary")


def sorted_counts(blocks: DataFrame, words: int, least: int, hot) -> DataFrame:
    """``lang, phrase, words, f``: the quicksort in each partition of ``blocks``; prefixes of hot words in parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, block in zip(batch.column("lang").to_pylist(), batch.column("block").to_pylist()):
                held.setdefault(lang, []).append(block)
        heavy = pa.array(hot.value, pa.binary())
        while held:
            lang, own = held.popitem()
            tokens, line = split_words(b"".join(own), _LINES)
            del own
            head = np.flatnonzero(np.diff(line, prepend=-1))
            weight = tokens.take(pa.array(head)).cast(pa.string()).cast(pa.int64()).to_numpy()
            is_word = np.ones(len(tokens), bool)
            is_word[head] = False
            coded = tokens.filter(pa.array(is_word)).dictionary_encode()
            row = line[is_word]
            column = np.arange(len(tokens))[is_word] - head[row] - 1
            keys = np.full((len(head), words), -1, np.int32)
            keys[row, column] = coded.indices.to_numpy()
            known = coded.dictionary
            named = pc.binary_join_element_wise(pa.scalar(lang.encode(), pa.binary()), known, b"\t")
            partial = _depth_routed(keys, pc.is_in(named, value_set=heavy).to_numpy(zero_copy_only=False))
            for depth, pointers, total in multikey_quicksort(keys, weight, least, partial):
                for i in range(0, len(pointers), 1 << 16):
                    rows = keys[pointers[i:i + (1 << 16)], :depth]
                    phrase = pc.binary_join_element_wise(*(known.take(pa.array(c)) for c in rows.T), b" ") if depth > 1 else known.take(pa.array(rows[:, 0]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(rows), pa.string()), phrase.cast(pa.string()), pa.array([depth] * len(rows), pa.int32()),
                         pa.array(total[i:i + (1 << 16)], pa.int64())], names=["lang", "phrase", "words", "f"])
    return blocks.mapInArrow(run, "lang string, phrase string, words int, f bigint")


def phrase_counts(spark: SparkSession, docs: DataFrame, words: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of every phrase of at most ``words`` words that occurs ``least`` times or more, and
    ``lang, n``, the word occurrences of each language."""
    single = written(count_words(docs), "phrase-words")
    lengths = single.groupBy("lang").agg(F.sum("f").alias("n"))
    often = single.where(F.col("f") >= least)
    size = F.octet_length("lang") + F.octet_length("word") + 1
    total, most = single.agg(F.coalesce(F.sum("f"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("f") >= least, size + 8)), F.lit(0))).first()
    partitions = max(-(-total // PARTITION_WORDS), spark.sparkContext.defaultParallelism if total > PARTITION_WORDS else 1)
    # A leading word is hot beyond a quarter of a partition: at most four times as many words as partitions.
    name = F.concat_ws("\t", "lang", "word").cast("binary").alias("w")
    context = spark.sparkContext
    hot = context.broadcast([bytes(r.w) for r in single.where(F.col("f") * 4 * partitions > total + 4 * partitions * least).select(name).collect()])
    frequent = context.broadcast([bytes(r.w) for r in often.select(name).collect()]) if most <= FREQUENT_BYTES else None
    blocks = routed(docs, words, 4 * partitions, frequent, hot).repartition(partitions, "route")
    found = sorted_counts(blocks, words, least, hot).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return written(found.where(F.col("f") >= least), "phrase-counts"), lengths


# --------------------------------------------------------------------------------------
# Candidates
# --------------------------------------------------------------------------------------

def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)), exact: 15 digits each, at most 38 in a product.  It is at most 1000000."""
    a, left, right = (f"cast({c} as decimal(15,0))" for c in (a, left, right))
    return F.expr(f"cast((cast(1000000 as decimal(7,0)) * ({a} * {a})) div ({left} * {right}) as bigint)")


def collocations(spark: SparkSession, docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A null language is ``und``; null and empty texts have no words; texts are read whole; a phrase never reaches over a
    piece's end or a row's.  Repeated rows count as often as they are there; an empty table gives no rows; only
    ``lang`` and ``text`` are read.  Ties in score and count go by the phrase's UTF-8 bytes."""
    counts, lengths = phrase_counts(spark, docs, words, least)
    known = broadcast_if_small(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f")), 120)
    candidates = counts.where("words > 1")
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("w", F.split("phrase", " "))
    for side, span in (("l", "slice(w, 1, k)"), ("r", "slice(w, k + 1, words - k)")):
        cuts = (cuts.withColumn("part", F.array_join(F.expr(span), " ")).join(known, ["lang", "part"])
                .withColumnRenamed("part_f", side).drop("part"))
    cuts = cuts.withColumn("score", _score("a", "l", "r"))
    best = (cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
            .select("lang", "phrase", "b.a", "b.l", "b.r", "b.score"))
    inner = (candidates.where("words > 2").withColumn("w", F.split("phrase", " "))
             .withColumn("m", F.explode(F.expr("sequence(2, words - 1)")))
             .select("lang", "f", F.explode(F.expr("transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))")).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    best = best.join(inner, ["lang", "phrase"], "left").where(f"longer is null or {PART[1]} * longer < {PART[0]} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the filter is on the bare row number, so that a task hands on the first rows of a language only
    first = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(lengths, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return collocations(spark, docs)
