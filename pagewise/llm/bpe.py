"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last token of that prefix's encoding: the token
that ends there and is compatible with the last token of the prefix before it.  :class:`PrefixEncoder` stores
that token for each prefix.  An append therefore only adds entries, and an edit keeps all entries before it.
Two tokens are compatible if merging their bytes gives them back; a token is its own encoding, or it can occur
only as a whole piece.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, worker_table

#: Pieces kept with their encodings in a Python worker (beyond that, the half of them that was asked for longest ago goes), and token
#: pairs known to be compatible or not (beyond that, the table starts anew).  About 60 and 30 MB.
CACHE_PIECES = 300_000
CACHE_PAIRS = 300_000
CACHE_PIECE_CHARS = 64


class Vocabulary:
    """Ranks of a byte-level vocabulary, with what the prefix encoder needs to know of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self._pair: dict[int, bool] = {}
        self.longest = max(map(len, ranks), default=1)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    @cached_property
    def flat(self) -> pa.Array:
        """The tokens by id in one array; an id without a token is null."""
        return pa.array(map(self.token.get, range(max(self.token, default=-1) + 1)), pa.large_binary())

    @cached_property
    def usable(self) -> dict[bytes, int]:
        """Tokens that merging gives back; others occur only as whole pieces.  Only encoding needs them."""
        return {t: i for t, i in self.ranks.items() if self.merged(t) == [i]}

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        get, none = self.ranks.get, 1 << 62
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while pairs and (rank := min(pairs)) != none:
            i = pairs.index(rank)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        known = self._pair.get(pair)
        if known is None:
            if len(self._pair) >= CACHE_PAIRS:
                self._pair.clear()
            known = self._pair[pair] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known


class PrefixEncoder:
    """The encoding of one piece, open to appends and edits.  ``last[i]`` is the last token of ``data[:i + 1]``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, n = self.vocabulary, len(self.data)
        self.data = data = self.data + more
        last, usable, pairs, longest = self.last, v.usable.get, v._pair, v.longest
        for end in range(n + 1, len(data) + 1):
            # shortest first: the one that fits is found before those longer than it are looked at
            for start in range(end - 1, max(end - longest, 0) - 1, -1):
                t = usable(data[start:end])
                if t is None:
                    continue
                if start:
                    before = last[start - 1]
                    fits = pairs.get(before << 32 | t)
                    if not (v.compatible(before, t) if fits is None else fits):
                        continue
                last.append(t)
                break
            else:
                raise ValueError("a byte of the piece has no token")

    def turn_to(self, data: bytes) -> None:
        """Encode another piece: the entries of the bytes that both begin with stay."""
        same, most = 0, min(len(data), len(self.data))
        while same < most and self.data[same] == data[same]:
            same += 1
        self.data = data[:same]
        del self.last[same:]
        self.append(data[same:])

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of the bytes ``[start, end)``; entries before ``start`` stay as they are.
        Behind the edit, entries are made again only until they agree with the old ones for as many bytes as
        the longest token has; from there on they are the old ones.  Returns how many were made again."""
        tail, old = self.data[end:], self.last[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(data)
        longest, same, made = self.vocabulary.longest, 0, len(data)
        for i in range(len(tail)):
            self.append(tail[i:i + 1])
            made += 1
            same = same + 1 if self.last[-1] == old[i] else 0
            if same >= longest:
                self.last += old[i + 1:]
                self.data += tail[i + 1:]
                break
        return made

    def tokens(self) -> list[int]:
        out, end, last, token = [], len(self.data), self.last, self.vocabulary.token
        while end:
            out.append(t := last[end - 1])
            end -= len(token[t])
        return out[::-1]


def joined(values: pa.Array, at: pa.Array, ends: np.ndarray) -> pa.Array:
    """Rows of ``values[at]`` put together, row after row: the row i up to ``ends[i]``.  The parts lie one behind the
    other already, so a row is no more than where it ends."""
    parts = values.take(at)
    if parts.null_count:
        raise ValueError("an id has no token")
    offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset:parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets[np.append(0, ends)]), parts.buffers()[2]])
    return whole.cast(pa.binary())


class Tokenizer:
    """Text to ids and back: pieces of ``pattern`` encoded separately; a piece that is a token is that token."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        return [whole] if whole is not None else PrefixEncoder(self.vocabulary, data).tokens()

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids as little-endian unsigned 32-bit integers, kept for the next time.  New pieces are encoded in
        the order of their bytes, so that each goes on from what it has in common with the one before."""
        known, ranks, encoder = self._known, self.vocabulary.ranks, PrefixEncoder(self.vocabulary)
        out = list(map(known.get, pieces))
        missing = {pieces[i] for i, ids in enumerate(out) if ids is None}
        made = {p: ids for p in missing if (ids := self._older.get(p)) is not None}
        for data, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in missing if p not in made):
            whole = ranks.get(data)
            if whole is None:
                encoder.turn_to(data)
            tokens = encoder.tokens() if whole is None else [whole]
            made[piece] = struct.pack(f"<{len(tokens)}I", *tokens)
        for piece, ids in made.items():
            if len(piece) <= CACHE_PIECE_CHARS:
                if len(known) >= CACHE_PIECES // 2:
                    # those not asked for since the last time go
                    self._older, known = known, {}
                    self._known = known
                known[piece] = ids
        return [made[p] if ids is None else ids for p, ids in zip(pieces, out)]

    def encode(self, text: str) -> bytes:
        return b"".join(self.ids(self.pieces(text)))

    def encode_pieces(self, pieces: pa.ListArray) -> pa.Array:
        """The ids of texts that are cut already: each distinct piece of the batch is looked up once."""
        coded = pieces.flatten().dictionary_encode()
        each = pa.array(self.ids(coded.dictionary.to_pylist()), pa.large_binary())
        return joined(each, coded.indices, np.cumsum(_lengths(pieces)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, memoryview(ids).cast("I")))

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """:meth:`decode` of each row of a binary array; null ids: none."""
        ids = pa.concat_arrays([ids.fill_null(b"")])
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
        if len(ends) < 2 or ends[0] == ends[-1]:
            return pa.array([b""] * len(ids), pa.binary())
        if (ends % 4).any():
            raise ValueError("ids are 32-bit integers")
        flat = np.frombuffer(ids.buffers()[2], "<u4", count=(ends[-1] - ends[0]) // 4, offset=ends[0])
        return joined(self.vocabulary.flat, pa.array(flat), (ends[1:] - ends[0]) // 4)


def tokenizer(path: str, pattern: str) -> Tokenizer:
    return worker_table((path, pattern), lambda: Tokenizer(Vocabulary.load(path), pattern))


#: Code points that Java's Unicode version may not know; all others are of the same kind for the tokenizer's engine.
DOUBTFUL = r"\p{Cn}"
#: Pieces of a text in one row on the way to a worker.  Spark counts the rows of an Arrow batch (10,000), and the JVM and
#: the worker each hold one whole.
ROW_PIECES = 64
#: Pieces that a worker takes from a batch at a time.
SLICE_PIECES = 200_000


def cut(docs: DataFrame, pattern: str) -> DataFrame:
    """``doc_id, part, text, pieces``: texts cut by ``pattern`` in the JVM, in rows of at most ``ROW_PIECES`` pieces, one
    behind the other; ``part`` counts the rows of a text from 0.  A text with a doubtful code point is left whole."""
    java = pattern.replace(r"\S", r"\P{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    whole = F.rlike("text", F.lit(DOUBTFUL))
    pieces = base.select("doc_id", F.when(whole, F.col("text")).alias("text"),
                         F.when(~whole, F.regexp_extract_all("text", F.lit(java), F.lit(0))).alias("pieces"))
    last = F.greatest(F.lit(0), F.floor((F.coalesce(F.size("pieces"), F.lit(0)) - 1) / ROW_PIECES)).cast("int")
    rows = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("pieces", i * ROW_PIECES + 1, ROW_PIECES))
    return pieces.select("doc_id", "text", F.posexplode(rows).alias("part", "pieces")).select("doc_id", "part", "text", "pieces")


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _encoded(batches: Iterator[pa.RecordBatch], own: Tokenizer) -> Iterator[tuple[pa.Array, pa.Array]]:
    """``doc_id`` and ids of the cut texts.  The last text of what came so far is held until it is known to be whole."""
    held, begun = None, []
    for part, doc_id, ids in _encoded_rows(batches, own):
        starts = np.flatnonzero(part.to_numpy() == 0)
        begun += ids[:starts[0] if len(starts) else len(ids)].to_pylist()
        if not len(starts):
            continue
        if held is not None:
            yield held, pa.array([b"".join(begun)], pa.binary())
        if len(starts) > 1:
            offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1][starts]
            yield (doc_id.take(pa.array(starts[:-1])),
                   pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), ids.buffers()[2]]))
        held, begun = doc_id.take(pa.array(starts[-1:])), ids[starts[-1]:].to_pylist()
    if held is not None:
        yield held, pa.array([b"".join(begun)], pa.binary())


def _encoded_rows(batches: Iterator[pa.RecordBatch], own: Tokenizer) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """``part``, ``doc_id`` and ids of each row, a bounded number of pieces (or eight bytes for each) at a time."""
    for batch in by_bytes(batches, "text"):
        pieces = batch.column("pieces")
        n = _lengths(pieces)
        size = np.append(0, np.cumsum(pc.binary_length(pieces.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)))
        size = np.diff(size[np.append(0, np.cumsum(n))])
        part = np.cumsum(np.maximum(n, size // 8)) // SLICE_PIECES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            rows = batch.slice(a, b - a)
            ids = own.encode_pieces(rows.column("pieces"))
            texts = rows.column("text")
            if texts.null_count < len(texts):
                told = ids.to_pylist()
                for i, text in enumerate(texts.to_pylist()):
                    if text is not None:
                        told[i] = own.encode(text)
                ids = pa.array(told, pa.binary())
            yield rows.column("part"), rows.column("doc_id"), ids
        del batch, pieces, rows, texts, ids          # a worker holds one batch, not the next one as well


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text: ``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) per row of ``docs``.

    Null and empty texts give no ids.  A text is encoded whole, whatever its length; a piece without a break is
    encoded in time proportional to its length.  Repeated rows give repeated rows, an empty table none; other
    columns are not read.  ``path`` names the vocabulary file, which every worker must be able to open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in _encoded(batches, tokenizer(path, pattern)):
            yield pa.RecordBatch.from_arrays([doc_id, ids], names=["doc_id", "ids"])
    return cut(docs, pattern).mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the bytes that ``ids`` stand for (null ids: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in by_bytes(batches, "ids"):
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, own.decode_all(ids)], names=["doc_id", "ids", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """:func:`encode`, then :func:`decode` of those ids, in one worker: ``doc_id, ids, decoded`` per row of ``docs``.
    Two steps in a row would hold two workers, each with its own vocabulary, for every running task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for doc_id, ids in _encoded(batches, own):
            yield pa.RecordBatch.from_arrays([doc_id, ids, own.decode_all(ids)], names=["doc_id", "ids", "decoded"])
    return cut(docs, pattern).mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def op6(spark, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's digest of the encoded and decoded texts."""
    return encode_and_decode(docs, path, pattern).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
