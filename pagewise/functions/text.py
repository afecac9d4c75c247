"""Text column functions: word splitting, Jaccard, cosine, escaping, fingerprints.

Whitespace words use one explicit character class so Spark (Java regex) and
DuckDB (RE2) split identically; ``\\s`` differs between the two engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.split() treats as whitespace.
WS_CLASS = ("[ \\t\\n\\r\\f\\u000b\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a"
            "\\u2028\\u2029\\u202f\\u205f\\u3000]")
WS_RUN = WS_CLASS + "+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Python ``str.split()``: whitespace runs, no empty words."""
    t = F.regexp_replace(_c(text), "^" + WS_RUN + "|" + WS_RUN + "$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RUN))


def word_count(text) -> Column:
    return F.size(words(F.coalesce(_c(text), F.lit(""))))


def space_tokens(text) -> Column:
    """Python ``str.split(" ")``: single-space split, empty tokens kept."""
    return F.split(F.coalesce(_c(text), F.lit("")), " ", -1)


def cache_key(query) -> Column:
    """P12 ``_normalize_query``: lower, split on whitespace, sort words, join by one space."""
    return F.array_join(F.array_sort(words(F.lower(_c(query)))), " ")


def jaccard(a, b) -> Column:
    """Jaccard of lower-cased whitespace word sets; empty union gives 0."""
    sa = F.array_distinct(words(F.lower(F.coalesce(_c(a), F.lit("")))))
    sb = F.array_distinct(words(F.lower(F.coalesce(_c(b), F.lit("")))))
    union = F.size(F.array_union(sa, sb))
    inter = F.size(F.array_intersect(sa, sb))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def dot(a, b) -> Column:
    """The dot product of two equal-length vectors."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def html_escape(s) -> Column:
    """P20: escape ``& < > " '`` (ampersand first)."""
    out = F.replace(_c(s), F.lit("&"), F.lit("&amp;"))
    for ch, ent in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out


def py_str_repr(s) -> Column:
    """Python ``repr`` of a str (ASCII-printable content; the shapes links take).

    Single quotes unless the text holds ``'`` and no ``"``; backslashes doubled;
    the chosen quote escaped; newline, tab and carriage return escaped.
    """
    x = F.replace(_c(s), F.lit("\\"), F.lit("\\\\"))
    x = F.replace(F.replace(F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")),
                  F.lit("\t"), F.lit("\\t"))
    use_double = (F.instr(x, "'") > 0) & (F.instr(x, '"') == 0)
    return F.when(use_double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))


def py_list_repr(arr) -> Column:
    """``str(list_of_str)`` as Python prints it: ``['a', 'b']``; ``[]`` when empty."""
    a = F.coalesce(_c(arr), F.array().cast("array<string>"))
    return F.concat(F.lit("["), F.array_join(F.transform(a, py_str_repr), ", "), F.lit("]"))


def link_fingerprint(links) -> Column:
    """sha256 hex of ``str(links)``."""
    return F.sha2(py_list_repr(links), 256)


def snippet(text, n: int = 100) -> Column:
    """P10: first ``n`` characters."""
    return F.substring(_c(text), 1, n)


def py_fixed(x, digits: int) -> Column:
    """``f"{x:.<digits>f}"`` exactly as Python prints it (round-half-even on the
    binary value).  Java's ``%.nf`` rounds the shortest decimal form half-up and
    differs on values that print as exact ties, so the few formatted report
    values go through one Arrow-batched pandas UDF."""
    import pandas as pd

    from ..session import ship_package
    ship_package()
    fmt = "{:.%df}" % digits

    def _fmt(s):
        return s.map(lambda v: None if v is None or v != v else fmt.format(v))

    _fmt.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(_fmt, "string")(_c(x).cast("double"))


def _run_starts(s: Column) -> Column:
    n = F.size(s)
    return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, i - 1)))


def term_counts(sorted_tokens, starts=None) -> Column:
    """Distinct tokens of one row with their counts, ``array<struct<term, tf>>``,
    from an already sorted token array and (optionally) its run starts.
    Counting happens inside the row, so counting terms per document needs no
    shuffle."""
    s = _c(sorted_tokens)
    n = F.size(s)
    st = _c(starts) if starts is not None else _run_starts(s)
    ends = F.concat(F.slice(st, 2, F.greatest(n, F.lit(1))), F.array(n + 1))
    runs = F.transform(F.arrays_zip(st.alias("b"), ends.alias("e")),
                       lambda r: F.struct(F.element_at(s, r["b"]).alias("term"), (r["e"] - r["b"]).alias("tf")))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def with_term_counts(df, cols: list[str], tokens: Column, keep_len: str | None = None):
    """``df`` -> rows ``(*cols, [keep_len], term, tf)``.  The sorted tokens and
    their run starts are materialised in their own projections so the lambdas
    read columns instead of re-evaluating the sort."""
    extra = [F.size("_sorted").alias(keep_len)] if keep_len else []
    sorted_df = df.select(*cols, F.sort_array(tokens).alias("_sorted"))
    with_starts = sorted_df.select(*cols, "_sorted", _run_starts(F.col("_sorted")).alias("_starts"))
    return with_starts.select(*cols, *extra, F.inline(term_counts("_sorted", "_starts")))
