"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain.  One
pass over the texts writes the inverted index: postings (trigram, text key) of the trigrams that some query
names.  The postings of a text meet in one aggregate, where every rule's query is answered; the texts that pass
are that rule's candidates.  Only candidates are searched with the expression itself.  A rule without a mandatory
trigram is searched in every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, or the match is dropped (without a retry inside it)."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed rules.  ``[...]{n,}`` takes the same maximal runs as ``[...]+`` with shorter matches dropped.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abposr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"://[^\s/:@]+:[^\s/:@]{3,}@"),
)
RULES = BASE + ADDED

#: At most so many alternatives of a literal are spelt out before they are cut at that place.
SPELT_OUT = 64


# --------------------------------------------------------------------------------------
# Boolean trigram queries.  A query is a set of alternatives, each a set of trigrams that must all occur;
# no alternative that asks for nothing means that the rule has mandatory trigrams.
# --------------------------------------------------------------------------------------

Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])


def _minimal(query) -> Query:
    """Without alternatives that ask for more than another does."""
    query = frozenset(query)
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(p: Query, q: Query) -> Query:
    return _minimal(a | b for a in p for b in q)


def _literal(strings: set[str]) -> Query:
    return _minimal(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of every match must contain."""
    return _query(re._parser.parse(pattern))[1]


def _query(parts) -> tuple[set[str] | None, Query]:
    """(the strings matched, if they are few; the query) of a sequence of parsed parts."""
    spelt, query, whole = {""}, ALL, True

    def cut():
        nonlocal spelt, query, whole
        query, spelt, whole = _both(query, _literal(spelt)), {""}, False

    for op, arg in parts:
        strings, inner = _part(str(op), arg)
        if strings is not None and len(spelt) * len(strings) <= SPELT_OUT:
            spelt = {a + b for a in spelt for b in strings}
        else:
            cut()
            query = _both(query, inner if strings is None else _literal(strings))
            if strings is not None and len(strings) <= SPELT_OUT:
                spelt = strings
    return (spelt, _literal(spelt)) if whole else (None, _both(query, _literal(spelt)))


def _part(op: str, arg) -> tuple[set[str] | None, Query]:
    if op == "LITERAL":
        return {chr(arg).lower()}, ALL
    if op == "IN":
        chars = {chr(a).lower() for k, a in arg if str(k) == "LITERAL"}
        return (chars, ALL) if len(chars) and all(str(k) == "LITERAL" for k, _ in arg) and len(chars) <= 8 else (None, ALL)
    if op == "SUBPATTERN":
        return _query(arg[-1])
    if op == "BRANCH":
        found = [_query(b) for b in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= SPELT_OUT:
            return set().union(*(s for s, _ in found)), ALL
        return None, _minimal(a for s, q in found for a in q)
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        strings, query = _query(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALL
        if low == high and strings is not None and len(strings) == 1:
            return {next(iter(strings)) * int(low)}, ALL
        return None, query if low else ALL
    return None, ALL          # classes, places, look-around: nothing is known


# --------------------------------------------------------------------------------------
# Index, candidates, verification
# --------------------------------------------------------------------------------------

def text_key(text: F.Column) -> F.Column:
    return F.unhex(F.md5(text.cast("binary")))


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Written postings ``(trigram, key)``: one row for each of ``trigrams`` that a text contains in lower
    case; sorted by trigram within each file, so that a reader of few trigrams skips most of it."""
    low = docs.select("text").where("text is not null").select("text", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    # explode_outer: for explode, the optimiser would compute the array a second time to skip empty ones
    rows = low.select(held.alias("held"), text_key(F.col("text")).alias("key")).select(F.explode_outer("held").alias("trigram"), "key")
    return written(rows.where("trigram is not null").sortWithinPartitions("trigram"), "trigrams")


def candidate_texts(index: DataFrame, queries: list[tuple[int, Query]]) -> DataFrame:
    """Intersect and unite postings: ``key, rules`` with the numbers of the rules whose query the text passes.
    A text's postings are at most the named trigrams; equal texts share them."""
    named = sorted({t for _, q in queries for a in q for t in a})
    per_text = index.where(F.col("trigram").isin(named)).groupBy("key").agg(
        *(F.max(F.col("trigram") == t).alias(f"t{i}") for i, t in enumerate(named)))
    place = {t: F.col(f"t{i}") for i, t in enumerate(named)}

    def passes(query: Query) -> F.Column:
        return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (place[t] for t in sorted(alt)))
                                           for alt in sorted(query, key=sorted)))
    rules = F.array_compact(F.array(*(F.when(passes(q), F.lit(i)) for i, q in queries)))
    return per_text.select("key", rules.alias("rules")).where(F.size("rules") > 0)


def _spans(number: int, rule: Rule) -> F.Column:
    """All matches of a rule in ``text`` as (start, rule number, end) in code points, leftmost and
    non-overlapping.  ``\\G`` ties each search to the end of the last match, so the text before a match is
    taken with it and its length tells where the match starts."""
    tied = rf"\G(?s:(.*?))({rule.pattern})"

    def group(n: int) -> F.Column:
        return F.regexp_extract_all("text", F.lit(tied), n)
    pieces = F.arrays_zip(group(1).alias("gap"), group(2).alias("all"), group(2 + rule.group).alias("told"))
    empty = F.array().cast("array<struct<start:int,rule:int,end:int>>")

    def step(state, piece):
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["all"])
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(piece["told"]) >= rule.least, F.concat(state["out"], one))
                        .otherwise(state["out"]).alias("out"))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (which must have ``text``) with a column ``_secrets``: the spans (start, rule number, end) of all
    rules in the whole text, code points, end exclusive, sorted by start and rule.

    Null and empty texts have none.  Repeated rows give repeated rows, an empty table none; all other columns
    stay as they are, whatever their names."""
    queries = [(i, trigram_query(r.pattern)) for i, r in enumerate(rules)]
    indexed = [(i, q) for i, q in queries if frozenset() not in q]
    row = docs.select(F.struct("*").alias("row"))
    text = row.select("row", F.col("row.text").cast("string").alias("text"))
    joined = text.withColumn("rules", F.array().cast("array<int>"))
    if indexed:
        index = trigram_index(text, sorted({t for _, q in indexed for a in q for t in a}))
        passed = written(candidate_texts(index, indexed), "candidates")
        joined = text.join(broadcast_if_small(passed, 80), text_key(F.col("text")) == F.col("key"), "left").drop("key")
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    own = dict(indexed)
    parts = [F.when(F.array_contains("rules", i) if i in own else F.col("text").rlike(r.pattern), _spans(i, r)).otherwise(none)
             for i, r in enumerate(rules)]
    parts = [F.coalesce(p, none) for p in parts]
    return joined.select("row", "text", F.array_sort(F.concat(*parts)).alias("_secrets"))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping spans are replaced together.
    All rows and columns stay; ``n_chars``, where there is one, tells the new length of a changed text."""
    found = find_secrets(docs, rules)

    def step(state, span):
        new = span["start"] >= state["at"]
        gap = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"),
                        F.when(new, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_secrets", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    found = found.select("row", F.when(F.size("_secrets") > 0, clean).alias("clean"))
    out = []
    for f in docs.schema.fields:
        own = F.col("row")[f.name]
        if f.name == "text":
            own = F.coalesce(F.col("clean"), own)
        elif f.name == "n_chars":
            own = F.coalesce(F.length("clean").cast(f.dataType), own)
        out.append(own.alias(f.name))
    return found.select(*out)


def _count(rule: int) -> F.Column:
    return F.size(F.filter("_secrets", lambda s: s["rule"] == rule))


def op5(spark, docs: DataFrame) -> DataFrame:
    """The contract's counts, digest and list of spans."""
    found = find_secrets(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    names = F.array(*(F.lit(r.kind) for r in RULES))

    def told(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("_secrets", lambda s: s["rule"] < len(BASE))
    counts = [_count(i).cast("bigint").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(told(base), 256).alias("base_sha256"),
                        told(F.col("_secrets")).alias("spans"))
