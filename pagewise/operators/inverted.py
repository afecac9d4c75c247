"""A written index over stored result lists, and the relevance scores of many queries read from it.

``corpus`` is a result list (the group that BM25 and TF-IDF statistics hold for), and any number of searches may ask
the same one.  Three fields share the tables, one for each way the scores split a text:

* ``space``: single-space tokens, for BM25;   * ``word``: lower-case runs of two or more word characters, for TF-IDF;
* ``set``: lower-case white-space words, for Jaccard.

``postings(corpus, doc, field, term, tf, len)`` stay in the order of the documents, a document's side by side: the terms of
the searches are broadcast to them, and a document's score of a search is summed in the task that reads it.  Query terms
too many to broadcast are joined by a shuffle; a term with many postings is then split into blocks by document, and
a query's row of that term is copied to each block, so that a common word is spread over as many tasks as it needs.
``terms`` has for each term its document frequency.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import session
from ..functions import scores as S
from ..functions import text as T
from ..session import broadcast_if_small, written
from .rank import top_n_per_group
from .relevance import BM25_B, BM25_EPSILON, BM25_K1, TFIDF_TOKEN

FIELDS = ("space", "word", "set")
POSTINGS_PER_BLOCK = 1 << 16
SCORE_DIGITS = 9
#: Bytes of a query term, or of a term's weight, that is broadcast.
TERM_BYTES = 128
_BY_TERM = ["corpus", "field", "term"]


@dataclass
class TextIndex:
    docs: DataFrame        # corpus, doc, seq, len, n_words (0 without the field set), norm (0 without word)
    corpora: DataFrame     # corpus, n, avg_len, mean_idf
    terms: DataFrame       # corpus, field, term, df; none of the field set, whose scores need no frequency
    postings: DataFrame    # corpus, doc, field, term, tf, len
    fields: tuple[str, ...] = FIELDS


def _tokens(text: Column) -> dict[str, tuple[Column, Column]]:
    """Each field's tokens, or the text that :func:`_counted` splits at white space as ``functions.text.words`` does."""
    t = F.coalesce(text, F.lit(""))
    whole, cut = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    return {"space": (T.space_tokens(t), whole), "word": (F.regexp_extract_all(F.lower(t), F.lit(TFIDF_TOKEN), 0), whole), "set": (cut, F.lower(t))}


def _counted(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows that end in their ``tokens`` and ``text`` -> a row for each distinct token, with its count ``tf`` and all tokens'
    ``len``; texts and tokens of about ``limit`` bytes at a time."""
    for batch in batches:
        weight = 8 * pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy().astype(np.int64)
        part = np.cumsum(weight + pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy() + 16) // limit
        for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]):
            rows = batch.slice(a, b - a)
            texts, tokens = rows.column("text").to_pylist(), rows.column("tokens")
            given = np.array([t is None for t in texts], bool)
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
            words = [() if t is None else t.split() for t in texts]
            lengths = np.where(given, lengths, list(map(len, words)))
            at = np.arange(b - a)
            row = np.concatenate([np.repeat(at[given], lengths[given]), np.repeat(at[~given], lengths[~given])])
            coded = pa.concat_arrays([tokens.flatten().cast(pa.string()), pa.array(itertools.chain.from_iterable(words), pa.string())]).dictionary_encode()
            kinds = max(len(coded.dictionary), 1)
            pairs, tf = np.unique(row * kinds + coded.indices.to_numpy(), return_counts=True)
            row = pairs // kinds
            own = [c.take(pa.array(row)) for c in rows.columns[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*own, coded.dictionary.take(pa.array(pairs % kinds)), pa.array(tf, pa.int32()), pa.array(lengths[row], pa.int32())],
                names=[*batch.schema.names[:-2], "term", "tf", "len"])


def _term_rows(df: DataFrame, cols: list[str], text: Column, names: tuple[str, ...]) -> DataFrame:
    """``cols, field, term, tf, len`` of every text, read once for all fields; a text's rows stay together in its task."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), t.alias("tokens"), w.alias("text")) for f, (t, w) in _tokens(text).items() if f in names))
    split = df.select(*cols, F.inline(fields))
    more = [ST.StructField("term", ST.StringType()), ST.StructField("tf", ST.IntegerType()), ST.StructField("len", ST.IntegerType())]
    return split.mapInArrow(_counted, ST.StructType([*split.schema.fields[:-2], *more]))


def _distinct_words(text: Column) -> Column:
    """How many different words ``functions.text.words`` would give."""
    def count(s):
        return s.map(lambda t: len(set(t.split()))).astype("int32")
    count.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(count, "int")(text)


def build_index(items: DataFrame, corpus: str, doc: str, text: str, seq: str, fields: tuple[str, ...] = FIELDS) -> TextIndex:
    """The index of ``items``; ``doc`` names an item within its ``corpus`` and ``seq`` is its place in the result list.
    Null texts are empty.  All tables are written to the shared folder.  Only the ``fields`` asked for are indexed."""
    base = items.select(F.col(corpus).alias("corpus"), F.col(doc).alias("doc"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("_text"))
    whole = F.coalesce("_text", F.lit(""))
    length = F.length(whole) - F.length(F.replace(whole, F.lit(" "), F.lit(""))) + 1
    words = _distinct_words(F.lower(whole)) if "set" in fields else F.lit(0)
    docs = written(base.select("corpus", "doc", "seq", length.alias("len"), words.alias("n_words")), "index-docs")
    sizes = written(docs.groupBy("corpus").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")), "index-sizes")

    postings = written(_term_rows(base, ["corpus", "doc"], F.col("_text"), fields), "index-postings")
    terms = postings.where("corpus is not null and field != 'set'").groupBy(*_BY_TERM).agg(F.count("*").alias("df"))
    terms = written(terms, "index-terms")

    mean = terms.where("field = 'space'").join(broadcast_if_small(sizes, 100), "corpus").groupBy("corpus").agg(F.avg(_bm25_idf()).alias("mean_idf"))
    corpora = written(sizes.join(mean, "corpus", "left"), "index-corpora")
    if "word" in fields:
        weights = (terms.where("field = 'word'").join(broadcast_if_small(sizes, 100), "corpus")
                   .select("corpus", "term", "df", _smooth_idf(F.col("n"), F.col("df")).alias("w")))
        norms = _norms(postings.where("field = 'word'").select("corpus", "doc", "term", "tf"), weights)
        docs = written(docs.join(norms, ["corpus", "doc"], "left").withColumn("norm", F.coalesce("norm", F.lit(0.0))), "index-docs")
    else:
        docs = docs.withColumn("norm", F.lit(0.0))
    return TextIndex(docs, corpora, terms, postings, tuple(fields))


def _norms(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """``corpus, doc, norm``: the squared TF-IDF length of each document.  As many of the most frequent terms as a broadcast
    holds meet their postings where those are; only postings of rarer terms are shuffled."""
    bits = F.length(F.bin("df"))
    room, least = session.BROADCAST_BYTES // TERM_BYTES, 65
    for row in weights.groupBy(bits.alias("bits")).count().orderBy(F.desc("bits")).collect():       # 64 rows at most
        room -= row["count"]
        if room < 0:
            break
        least = row["bits"]
    known = postings.join(F.broadcast(weights.where(bits >= least).drop("df")), ["corpus", "term"], "left")
    rare = known.where("w is null").drop("w").join(weights.where(bits < least).drop("df"), ["corpus", "term"])
    weight = F.col("tf") * F.col("w")
    parts = [x.select("corpus", "doc", (weight * weight).alias("part")) for x in (known.where("w is not null"), rare)]
    return parts[0].unionByName(parts[1]).groupBy("corpus", "doc").agg(F.sum("part").alias("norm"))


def _bm25_idf() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _share() -> Column:
    """A posting's share of its term's weight in BM25."""
    return F.col("tf") / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len")))


def _smooth_idf(n: Column, df: Column) -> Column:
    """TF-IDF of a space fitted on the ``n`` items and the query."""
    return F.log((2 + n) / (1 + df)) + 1


def query_terms(index: TextIndex, queries: DataFrame) -> DataFrame:
    """``search, corpus, field, term, qtf, df, n, avg_len, mean_idf`` of ``queries(search, corpus, query)``; ``df`` is 0
    for a term that no item has, and in the field ``set``."""
    q = _term_rows(queries.select("search", "corpus", F.col("query").alias("_q")), ["search", "corpus"], F.col("_q"), index.fields)
    q = written(q.withColumnRenamed("tf", "qtf").drop("len"), "search-words")
    asked = index.terms.join(broadcast_if_small(q.select(*_BY_TERM).distinct(), TERM_BYTES), _BY_TERM, "left_semi")
    return q.join(index.corpora, "corpus").join(asked, _BY_TERM, "left").fillna(0, ["df"])


def _matched(index: TextIndex, terms: DataFrame) -> DataFrame:
    """The written query ``terms`` with each posting of theirs, document by document if the terms can be broadcast."""
    if terms.count() * TERM_BYTES <= session.BROADCAST_BYTES:
        return index.postings.join(F.broadcast(terms), _BY_TERM)
    often = index.postings.groupBy(*_BY_TERM).count().where(F.col("count") > POSTINGS_PER_BLOCK)
    often = written(often.select(*_BY_TERM, F.ceil(F.col("count") / POSTINGS_PER_BLOCK).cast("int").alias("blocks")), "index-often")
    often = broadcast_if_small(often, TERM_BYTES)
    blocks = F.coalesce("blocks", F.lit(1))
    postings = index.postings.join(often, _BY_TERM, "left").withColumn("block", F.pmod(F.xxhash64("doc"), blocks).cast("int")).drop("blocks")
    spread = terms.join(often, _BY_TERM, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    return postings.join(spread, [*_BY_TERM, "block"])


# ---- BM25 (A8a, T3) ------------------------------------------------------------------------------------

def _bm25_terms(index: TextIndex, queries: DataFrame) -> DataFrame:
    """Query terms with their weight ``w``."""
    idf = F.when(_bm25_idf() < 0, BM25_EPSILON * F.col("mean_idf")).otherwise(_bm25_idf())
    t = query_terms(index, queries).where("field = 'space' and df > 0")
    return written(t.select("search", *_BY_TERM, (F.col("qtf") * idf * (BM25_K1 + 1)).alias("w"), "avg_len"), "search-terms")


def bm25_top(index: TextIndex, queries: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` documents of each search by BM25 (rounded at 1e-9), then by ``seq``: ``search, corpus, doc, seq,
    bm25_score, rank``.  Documents that share no term with the query score 0 and fill a list up."""
    met = _matched(index, _bm25_terms(index, queries))
    scored = met.groupBy("search", "corpus", "doc").agg(F.sum(F.col("w") * _share()).alias("bm25_score"))
    return _filled(index, queries, written(scored, "search-scores"), n)


def bm25_of(index: TextIndex, queries: DataFrame, found: DataFrame) -> DataFrame:
    """``search, doc, bm25_score`` of given documents; one that shares no term with its query has no row."""
    terms = _bm25_terms(index, queries)
    own = index.postings.where("field = 'space'").join(broadcast_if_small(found.select("search", "corpus", "doc"), TERM_BYTES), ["corpus", "doc"])
    met = own.join(broadcast_if_small(terms, TERM_BYTES), ["search", *_BY_TERM])
    return met.groupBy("search", "doc").agg(F.sum(F.col("w") * _share()).alias("bm25_score"))


def _filled(index: TextIndex, queries: DataFrame, scored: DataFrame, n: int) -> DataFrame:
    """The best ``n`` of each search, unmatched documents (score 0) included where the list has room for them."""
    order = [F.round("bm25_score", SCORE_DIGITS).desc(), F.col("seq").asc()]
    # a document behind n better ones can't be in the list: the places are looked up for the others, equal ones all
    ahead = F.rank().over(Window.partitionBy("search").orderBy(order[0]))
    best = scored.withColumn("_ahead", ahead).where(F.col("_ahead") <= n).drop("_ahead")
    placed = index.docs.select("corpus", "doc", "seq").join(best, ["corpus", "doc"])
    counts = scored.groupBy("search").agg(F.count("*").alias("all"), F.count_if(F.expr("bm25_score > 0")).alias("above"))
    short = queries.select("search", "corpus").join(counts, "search", "left").fillna(0, ["all", "above"]).where(F.col("above") < n)
    short = written(short, "search-short")
    room = short.agg(F.max("all")).first()[0]
    if room is not None:
        # of the first n + all documents of a list, at least n were not matched
        heads = top_n_per_group(index.docs.join(short.select("corpus").distinct(), "corpus", "left_semi").select("corpus", "doc", "seq"),
                                ["corpus"], [F.col("seq").asc()], n + room)
        fill = (heads.join(short, "corpus").where(F.col("rank") < n + F.col("all")).drop("rank")
                .join(scored.select("search", "doc"), ["search", "doc"], "left_anti").withColumn("bm25_score", F.lit(0.0)))
        placed = placed.unionByName(fill.select(placed.columns))
    return top_n_per_group(placed, ["search"], order, n).select("search", "corpus", "doc", "seq", "bm25_score", "rank")


# ---- Jaccard, TF-IDF cosine, hybrid (P21, A8b, C8, A6) --------------------------------------------------

def relevance(index: TextIndex, queries: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """C8 of every document that shares a word with its search's query: ``search, corpus, doc, jaccard_score,
    tfidf_score, semantic_score, relevance_score``.  Documents without a shared word score 0 by the first two;
    ``semantic(search, doc, semantic_score)`` adds a model's score, and the documents it names."""
    terms = query_terms(index, queries).where("field != 'space'")
    now, alone = _smooth_idf(F.col("n"), F.col("df") + 1), _smooth_idf(F.col("n"), F.col("df"))
    terms = written(terms.withColumn("w", F.when(F.col("field") == "word", now)).withColumn("w0", F.when(F.col("field") == "word", alone)), "search-terms")
    asked = terms.groupBy("search").agg(F.count_if(F.expr("field = 'set'")).alias("q_words"),
                                        F.sqrt(F.coalesce(F.sum((F.col("qtf") * F.col("w")) ** 2), F.lit(0.0))).alias("q_norm"))
    m = _matched(index, terms)
    met = m.groupBy("search", "corpus", "doc").agg(
        F.count_if(F.expr("field = 'set'")).alias("both"),
        F.coalesce(F.sum(F.col("tf") * F.col("w") * F.col("qtf") * F.col("w")), F.lit(0.0)).alias("dot"),
        # the query's own terms are one document more frequent in the space it is compared in
        F.coalesce(F.sum(F.col("tf") * F.col("tf") * (F.col("w") * F.col("w") - F.col("w0") * F.col("w0"))), F.lit(0.0)).alias("shift"))
    if semantic is not None:
        met = met.join(semantic.join(queries.select("search", "corpus"), "search"), ["search", "corpus", "doc"], "full").fillna(0)
    else:
        met = met.withColumn("semantic_score", F.lit(0.0))
    met = met.join(index.docs, ["corpus", "doc"]).join(broadcast_if_small(written(asked, "search-asked"), 100), "search")
    either = F.col("n_words") + F.col("q_words") - F.col("both")
    length = F.sqrt(F.greatest(F.col("norm") + F.col("shift"), F.lit(0.0))) * F.col("q_norm")
    out = met.select("search", "corpus", "doc", "seq", F.when(either > 0, F.col("both") / either).otherwise(0.0).alias("jaccard_score"),
                     F.when(length > 0, F.col("dot") / length).otherwise(0.0).alias("tfidf_score"), "semantic_score")
    return out.withColumn("relevance_score", S.hybrid("jaccard_score", "tfidf_score", "semantic_score"))


def relevance_stats(index: TextIndex, queries: DataFrame, scored: DataFrame) -> DataFrame:
    """A6 + P15 over all documents of each search's corpus, those without a row in ``scored`` as zeros."""
    sums = scored.groupBy("search").agg(F.count("*").alias("rows"), F.sum("relevance_score").alias("sum"),
                                        F.sum(F.col("relevance_score") ** 2).alias("squares"), F.max("relevance_score").alias("max"))
    s = (queries.select("search", "corpus").join(index.corpora.select("corpus", "n"), "corpus").join(sums, "search", "left")
         .fillna(0, ["rows", "sum", "squares"]))
    mean = F.col("sum") / F.col("n")
    s = s.select("search", "corpus", F.col("n").alias("result_count"), mean.alias("avg_relevance"),
                 F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)).alias("relevance_variance"),
                 F.greatest(F.col("max"), F.when(F.col("rows") < F.col("n"), F.lit(0.0))).alias("max_relevance"))
    sqs = S.sqs("result_count", "avg_relevance", "relevance_variance", "max_relevance")
    return s.withColumn("sqs_score", sqs).withColumn("quality_category", S.sqs_category("result_count", F.col("sqs_score")))
