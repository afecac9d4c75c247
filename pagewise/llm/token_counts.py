"""Token counts of whole texts, without their ids.

A byte-level vocabulary encodes each pre-token by itself, so a text's token count is the sum over its pre-tokens of
a number that depends on the pre-token alone.  Each distinct pre-token of the table is encoded once, by the library
that the vocabulary belongs to; documents only bring their pre-token frequencies, which are joined to those numbers
and summed.  No id is ever kept.

Pre-tokens are cut in the JVM.  Which characters are letters, numbers or spaces depends on the Unicode version, and the
library's is not Java's; so the library is asked for all code points, and texts with one that Java takes for
something else are cut by an expression that names those.

The frequent pre-tokens (a bounded number, by a histogram of their frequencies) are broadcast, so that no common word
becomes a hot key; the frequencies of all others are shuffled by pre-token.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, worker_table, written

#: At most so many pre-tokens of at most so many bytes are broadcast (under 32 MB with Spark's overhead a row).
HEAD_ROWS = 150_000
HEAD_BYTES = 64
LIMIT = 1024
_ASSIGNED = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def _load(path: str):
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def _class_text(points: frozenset[int]) -> str:
    """Code points as ranges of a character class."""
    runs = [[p for _, p in run] for _, run in groupby(enumerate(sorted(points)), lambda e: e[1] - e[0])]
    return "".join(f"\\x{{{r[0]:X}}}" + (f"-\\x{{{r[-1]:X}}}" if len(r) > 1 else "") for r in runs)


@lru_cache(maxsize=4)
def _library_classes(path: str) -> dict[str, frozenset[int]]:
    """The library's letters, numbers and spaces, told by how it cuts strings with each code point in them: first
    ``a...1`` around 256 in a row, then, where those are not of one kind, ``a?1?!`` around each."""
    cut = _load(path).pre_tokenizer.pre_tokenize_str
    kinds = {"L": set(), "N": set(), "S": set()}

    def spans(text):
        return [s for _, s in cut(text)]
    for start in range(0, 0x110000, 256):
        row = [c for c in range(start, start + 256) if not 0xD800 <= c < 0xE000]
        n = len(row)
        found = spans(f"a{''.join(map(chr, row))}1") if n else None
        if found is None or found == [(0, 1), (1, n + 1), (n + 1, n + 2)]:
            continue
        if found == [(0, n + 1), (n + 1, n + 2)]:
            kinds["L"].update(row)
            continue
        for c in row:
            ch = chr(c)
            one = spans(f"a{ch}1{ch}!")
            if (0, 2) in one:
                kinds["L"].add(c)
            elif (1, 4) in one:
                kinds["N"].add(c)
            elif (3, 5) not in one or (2, 3) not in one or (1, 3) in one:
                kinds["S"].add(c)
    return {k: frozenset(v) for k, v in kinds.items()}


class Pattern(NamedTuple):
    """Java's expression for pre-tokens (``plain``), and where it is not the library's: texts that match ``doubtful`` are
    cut by ``exact``, which names every code point that the two take for different things."""
    plain: str
    doubtful: str
    exact: str


def _expression(letter: str, number: str, space: str, other: str, blank: str) -> str:
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|{space}+{blank}|{space}+"


def pretoken_pattern(spark: SparkSession, path: str) -> Pattern:
    """The library's byte-level pre-token expression for Java's engine."""
    probe = spark.createDataFrame(pa.table({"s": ["".join(map(chr, _ASSIGNED))]}))
    names = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\p{IsWhite_Space}"}
    java = probe.select(*(F.regexp_replace("s", f"[^{v}]", "").alias(k) for k, v in (names | {"Cn": r"\p{Cn}"}).items())).first()
    own = _library_classes(path)
    held = {k: frozenset(map(ord, java[k])) for k in names}
    body = {k: names[k] + _class_text(own[k] - held[k]) for k in names}
    less = {k: _class_text(held[k] - own[k]) for k in names}
    letter, number, space = (f"[{body[k]}&&[^{less[k]}]]" if less[k] else f"[{body[k]}]" for k in "LNS")
    beyond = _class_text(frozenset().union(*(held[k] - own[k] for k in names)) - frozenset().union(*own.values()))
    other = f"[^{''.join(body.values())}]" if not beyond else f"(?:[^{''.join(body.values())}]|[{beyond}])"
    # nearly all of them are code points that Java's Unicode version does not know
    unlike = frozenset().union(*(held[k] ^ own[k] for k in names))
    every = "".join(names.values())
    return Pattern(_expression(names["L"], names["N"], names["S"], f"[^{every}]", f"(?![^{names['S']}])"),
                   f"[\\p{{Cn}}{_class_text(unlike - frozenset(map(ord, java['Cn'])))}]",
                   _expression(letter, number, space, other, f"(?!{other}|{letter}|{number})"))


def _special(path: str) -> list[str]:
    """Strings inside texts that the library takes for special tokens."""
    return sorted((t.content for t in _load(path).get_added_tokens_decoder().values()), key=len, reverse=True)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):X}}}" for c in text)


def pretokens(docs: DataFrame, pattern: Pattern, special: list[str]) -> DataFrame:
    """``docs`` with a row for each pre-token, in ``piece``; null stands for a special string and for an empty text."""
    split = "|".join(map(_quoted, special)) or "(?!)"
    segments = F.split(F.coalesce("text", F.lit("")), split, -1)
    plain, exact = (F.regexp_extract_all("segment", F.lit(p), F.lit(0)) for p in (pattern.plain, pattern.exact))
    pieces = F.when(F.rlike("segment", F.lit(pattern.doubtful)), exact).otherwise(plain)
    return (docs.withColumn("n_special", (F.size(segments) - 1).cast("bigint"))
            .withColumn("segment", F.explode(segments)).drop("text")
            .withColumn("piece", F.explode_outer(pieces)).drop("segment"))


def piece_counts(pieces: DataFrame, path: str) -> DataFrame:
    """``piece, n`` (and ``docs`` as given): the library's number of tokens for each of the distinct ``piece``s."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_table(("tokenizers", path), lambda: _load(path))
        encode = getattr(own, "encode_batch_fast", own.encode_batch)
        for batch in by_bytes(batches, "piece", 1 << 20):
            n = [len(e) for e in encode(batch.column("piece").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("uses"), pa.array(n, pa.int64())],
                                             names=["piece", "uses", "n"])
    return pieces.select("piece", "uses").mapInArrow(run, "piece string, uses bigint, n bigint")


def _head_floor(counted: DataFrame) -> tuple[int, bool]:
    """The least power of two so that at most ``HEAD_ROWS`` short pre-tokens are used as often; whether others are left."""
    short = F.octet_length("piece") <= HEAD_BYTES
    bins = (counted.groupBy(short.alias("short"), F.floor(F.log2("uses")).cast("int").alias("power"))
            .agg(F.count("*").alias("rows")).collect())          # at most 2 x 64 rows
    floor, rows = 62, 0
    for b in sorted((b for b in bins if b.short), key=lambda b: -b.power):
        rows += b.rows
        if rows > HEAD_ROWS:
            return floor, True
        floor = b.power
    return 0, any(not b.short for b in bins)


def count_tokens(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` per row of ``docs(doc_id, text)``, as the library's default encoding gives them
    without added special tokens: special strings inside a text count as one token.

    Null and empty texts have no tokens.  Repeated rows give repeated rows, an empty table none; other columns are not
    read.  ``docs`` is read three times, and its rows are numbered on the way: a table that Spark reads, not a result whose
    row order may change.  A text is cut whole; a pre-token of any length is encoded whole."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pattern, special = pretoken_pattern(spark, path), _special(path)
    distinct = pretokens(base.select("text"), pattern, special).where("piece is not null").groupBy("piece").agg(F.count("*").alias("uses"))
    counted = written(piece_counts(distinct, path), "token-counts")
    power, rest = _head_floor(counted)
    is_head = (F.octet_length("piece") <= HEAD_BYTES) & (F.col("uses") >= 2 ** power)
    head = F.broadcast(counted.where(is_head).select("piece", "n"))

    rows = base.select(F.monotonically_increasing_id().alias("uid"), "doc_id",
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    known = [c for c in rows.columns if c != "text"] + ["n_special"]
    pieces = pretokens(rows, pattern, special).join(head, "piece", "left").select(*known, "n")
    if rest:
        # all other pre-tokens, from a second pass: no text or known pre-token is shuffled with them
        tail = pretokens(rows.select("uid", "text"), pattern, special).where("piece is not null").select("uid", "piece")
        tail = tail.join(head, "piece", "left_anti").join(counted.where(~is_head).select("piece", "n"), "piece")
        none = [F.lit(None).cast("bigint").alias(c) for c in known[1:]]
        pieces = pieces.unionByName(tail.select("uid", *none, "n"))
    return (pieces.groupBy("uid").agg(*(F.max(c).alias(c) for c in known[1:]), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            .select("doc_id", "n_bytes", (F.col("n") + F.col("n_special")).alias("n_tokens")))


def op12(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return count_tokens(spark, docs, path).withColumn("over_limit", F.col("n_tokens") > LIMIT)
