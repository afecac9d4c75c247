"""Relevance scoring of items against a query, per group.

A *group* is one corpus: the hits of one search, or the result items of one
results page.  ``queries`` holds one query text per group.  All statistics are
grouped aggregates over exploded terms, so a large group is spread over many
tasks (partial aggregation before the shuffle) and never handled whole by one.
Query-term tables are small and joined on (group, term); Spark broadcasts them
when AQE measures them under the broadcast threshold and sort-merges otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import scores as S
from ..functions import text as T
from ..session import written
from .rank import positions, top_n_per_group

#: Bytes of query vectors that are broadcast at a time.
QUERY_BLOCK_BYTES = 4 << 20
#: Vectors that go through one matrix product.
PACK_ROWS = 4096

# Okapi BM25 defaults of the library the reference calls.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
# Fixed value: the default TF-IDF token pattern (maximal runs of >= 2 word characters).
TFIDF_TOKEN = "[\\p{L}\\p{N}_]{2,}"


def bm25_scores(items: DataFrame, queries: DataFrame, group: str, key: str, text: str,
                query: str = "query", k1: float = BM25_K1, b: float = BM25_B,
                epsilon: float = BM25_EPSILON) -> DataFrame:
    """A8a + T3 scores: one row per item ``(group, key, bm25_score)``.

    Tokens are the text split on single spaces (empty tokens kept, case kept).
    idf = ln(N - df + .5) - ln(df + .5); negative idf values are replaced by
    ``epsilon`` times the mean idf of all corpus terms; unknown terms score 0;
    repeated query tokens count each time.
    """
    # distinct terms per document with their counts are computed inside each row
    # (no shuffle of (document, term) pairs); the only large shuffle is the
    # document-frequency aggregate, which combines map-side by term
    doc_terms = T.with_term_counts(items, [group, key], T.space_tokens(text), keep_len="_dl") \
                 .withColumnRenamed("tf", "_tf")
    docs = items.select(group, key, F.size(T.space_tokens(text)).cast("double").alias("_dl"))
    corpus = docs.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avgdl"))

    dfreq = doc_terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("_df"))
    raw = (dfreq.join(corpus.select(group, "_n"), group)
                .withColumn("_idf", F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5)))
    mean_idf = raw.groupBy(group).agg(F.avg("_idf").alias("_mean_idf"))

    qterms = (queries.select(group, F.explode(T.space_tokens(query)).alias("term"))
                     .groupBy(group, "term").agg(F.count(F.lit(1)).alias("_qtf")))
    qidf = (qterms.join(raw.select(group, "term", "_idf"), [group, "term"])
                  .join(mean_idf, group)
                  .withColumn("_idf", F.when(F.col("_idf") < 0, F.lit(epsilon) * F.col("_mean_idf"))
                                       .otherwise(F.col("_idf")))
                  .select(group, "term", "_qtf", "_idf"))

    contrib = (doc_terms.join(qidf, [group, "term"])
                        .join(corpus.select(group, "_avgdl"), group)
                        .withColumn("_c", F.col("_qtf") * F.col("_idf") * (F.col("_tf") * (k1 + 1))
                                    / (F.col("_tf") + k1 * (1 - b + b * F.col("_dl") / F.col("_avgdl"))))
                        .groupBy(group, key).agg(F.sum("_c").alias("_s")))
    return (docs.select(group, key)
                .join(contrib, [group, key], "left")
                .select(group, key, F.coalesce("_s", F.lit(0.0)).alias("bm25_score")))


def tfidf_cosine(items: DataFrame, queries: DataFrame, group: str, key: str, text: str,
                 query: str = "query") -> DataFrame:
    """Cosine of each item with the query in a TF-IDF space fitted on the
    group's items plus the query (smooth idf, raw tf, L2 norm)."""
    def terms(df: DataFrame, cols: list[str], col: str) -> DataFrame:
        toks = F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(TFIDF_TOKEN), 0)
        return T.with_term_counts(df, cols, toks).withColumnRenamed("tf", "_tf")

    it = terms(items, [group, key], text)
    qt = terms(queries, [group], query)
    n_items = items.groupBy(group).agg((F.count(F.lit(1)) + 1).alias("_n"))
    dfreq = (it.groupBy(group, "term").agg(F.count(F.lit(1)).alias("_dfi"))
               .join(qt.select(group, "term", F.lit(1).alias("_dfq")), [group, "term"], "full")
               .select(group, "term", (F.coalesce("_dfi", F.lit(0)) + F.coalesce("_dfq", F.lit(0))).alias("_df")))
    idf = (dfreq.join(n_items, group)
                .select(group, "term", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("_idf")))
    qw = qt.join(idf, [group, "term"]).withColumn("_wq", F.col("_tf") * F.col("_idf"))
    qnorm = qw.groupBy(group).agg(F.sqrt(F.sum(F.col("_wq") * F.col("_wq"))).alias("_nq"))
    # one pass over the item terms gives both the item norm and the dot product
    idf_q = idf.join(qw.select(group, "term", "_wq"), [group, "term"], "left")
    per_item = (it.join(idf_q, [group, "term"])
                  .withColumn("_w", F.col("_tf") * F.col("_idf"))
                  .groupBy(group, key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_ni"),
                                           F.sum(F.col("_w") * F.col("_wq")).alias("_dot")))
    cos = (items.select(group, key)
                .join(per_item, [group, key], "left")
                .join(qnorm, group, "left")
                .select(group, key,
                        F.when((F.col("_ni") > 0) & (F.col("_nq") > 0) & F.col("_dot").isNotNull(),
                               F.col("_dot") / (F.col("_ni") * F.col("_nq"))).otherwise(F.lit(0.0))
                        .alias("tfidf_score")))
    return cos


def jaccard_scores(items: DataFrame, queries: DataFrame, group: str, key: str, text: str,
                   query: str = "query") -> DataFrame:
    """P21 per item; the query is joined on the group key (one query row per group)."""
    return (items.select(group, key, text)
                 .join(queries.select(group, F.col(query).alias("_q")), group, "left")
                 .select(group, key, T.jaccard("_q", text).alias("jaccard_score")))


def _counts(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, token, count)`` of each distinct token (a code) of each row."""
    kinds = int(tokens.max(initial=-1)) + 1 or 1
    pairs, count = np.unique(np.repeat(np.arange(len(lengths)), lengths) * kinds + tokens, return_counts=True)
    return pairs // kinds, pairs % kinds, count


def _whole_group(items: pa.Table, asked: pa.Table) -> pa.Table:
    """The scores of one group's items ``(group, key, text, tokens)`` against its query ``(group, text, tokens)``."""
    n = items.num_rows
    given = set(asked.column(1)[0].as_py().split()) if asked.num_rows else set()
    words = [set(t.split()) for t in items.column(2).to_pylist()]
    jaccard = [len(w & given) / len(w | given) if w or given else 0.0 for w in words]
    chunks = [chunk for c in (items.column(3), asked.column(2)) for chunk in c.chunks if len(chunk)]
    lengths = np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy(zero_copy_only=False) for c in chunks)]).astype(np.int64)
    coded = pa.concat_arrays([pa.array([], pa.string()), *(c.flatten().cast(pa.string()) for c in chunks)]).dictionary_encode()
    codes, of_items = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), int(lengths[:n].sum())
    row, term, tf = _counts(codes[:of_items], lengths[:n])
    wanted = np.bincount(codes[of_items:], minlength=len(coded.dictionary))
    df = np.bincount(term, minlength=len(wanted)) + (wanted > 0)
    idf = np.log((2 + n) / (1 + df)) + 1
    w, wq = tf * idf[term], wanted * idf
    own, asked_norm = np.sqrt(np.bincount(row, w * w, minlength=n)), np.sqrt((wq * wq).sum())
    dot = np.bincount(row, w * wq[term], minlength=n)
    length = own * asked_norm
    tfidf = np.divide(dot, length, out=np.zeros(n), where=length > 0)
    return pa.table([items.column(0), items.column(1), pa.array(jaccard, pa.float64()), pa.array(tfidf)],
                    names=[*items.column_names[:2], "jaccard_score", "tfidf_score"])


def whole_group_scores(items: DataFrame, queries: DataFrame, group: str, key: str, text: str, query: str = "query") -> DataFrame:
    """:func:`jaccard_scores` and :func:`tfidf_cosine` of groups that a task can hold, such as the items of one page: each
    is scored whole in one task, so that its terms are never shuffled.  ``queries`` has one row a group."""
    def read(df: DataFrame, cols: list[str], col: str) -> DataFrame:
        low = df.select(*cols, F.lower(F.coalesce(F.col(col), F.lit(""))).alias("_t"))
        return low.select("*", F.regexp_extract_all("_t", F.lit(TFIDF_TOKEN), 0).alias("_tokens"))

    schema = ST.StructType([items.schema[group], items.schema[key], ST.StructField("jaccard_score", ST.DoubleType()),
                            ST.StructField("tfidf_score", ST.DoubleType())])
    known = F.col(group).isNotNull()
    return read(items.where(known), [group, key], text).groupBy(group).cogroup(
        read(queries.where(known), [group], query).groupBy(group)).applyInArrow(_whole_group, schema)


def score_relevance(items: DataFrame, queries: DataFrame, group: str, key: str, text: str, query: str = "query",
                    semantic: DataFrame | None = None, model: Callable | None = None, whole_groups: bool = False) -> DataFrame:
    """Jaccard, tf-idf cosine, semantic score and their hybrid per item.  ``whole_groups`` scores each group in one
    task (:func:`whole_group_scores`).

    ``semantic`` is an optional ``(group, key, semantic_score)`` table; ``model``
    (see :func:`model_score`) scores query and text itself; without either the
    semantic term is 0.
    """
    if whole_groups:
        out = whole_group_scores(items, queries, group, key, text, query)
    else:
        out = (jaccard_scores(items, queries, group, key, text, query)
               .join(tfidf_cosine(items, queries, group, key, text, query), [group, key]))
    if model is not None:
        pairs = items.select(group, key, F.coalesce(text, F.lit("")).alias("_t")).join(
            queries.select(group, F.coalesce(query, F.lit("")).alias("_q")), group)
        semantic = pairs.select(group, key, model_score(model)(F.col("_q"), F.col("_t")).alias("semantic_score"))
    if semantic is not None:
        out = out.join(semantic.select(group, key, "semantic_score"), [group, key], "left")
    else:
        out = out.withColumn("semantic_score", F.lit(None).cast("double"))
    out = out.withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
    return out.withColumn("relevance_score", S.hybrid("jaccard_score", "tfidf_score", "semantic_score"))


def relevance_stats(scored: DataFrame, group: str, score: str = "relevance_score",
                    count_col: str | None = None) -> DataFrame:
    """A6 + P15: mean, population variance and max relevance, then SQS and category."""
    agg = scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("result_count"),
        F.avg(score).alias("avg_relevance"),
        F.var_pop(score).alias("relevance_variance"),
        F.max(score).alias("max_relevance"))
    if count_col is not None:
        agg = agg.drop("result_count").join(scored.select(group, count_col).distinct(), group)
        agg = agg.withColumnRenamed(count_col, "result_count")
    sqs = S.sqs("result_count", "avg_relevance", "relevance_variance", "max_relevance")
    return (agg.withColumn("sqs_score", sqs)
               .withColumn("quality_category", S.sqs_category("result_count", "sqs_score")))


def _packed(keys: ST.DataType) -> ST.StructType:
    return ST.StructType([ST.StructField("keys", ST.ArrayType(keys)), ST.StructField("flat", ST.ArrayType(ST.DoubleType())),
                         ST.StructField("norms", ST.ArrayType(ST.DoubleType()))])


def _pack(batches: Iterator[pa.RecordBatch], rows: int = PACK_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, vector, norm)`` -> one row for up to ``rows`` of them: the keys, all components, the norms."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                for x in (part.column(0), part.column(1).flatten(), part.column(2))], names=["keys", "flat", "norms"])


def _first_of_each(q: np.ndarray, s: np.ndarray, k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scored pairs, those that can be among the first ``n`` of their query ``q`` by the score rounded at 1e-9, then
    by key; in the order of query, score (falling) and key."""
    order = np.lexsort((k, -s, q))
    q, s, k = q[order], s[order], k[order]
    at = np.arange(len(q))
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    start = np.maximum.accumulate(np.where(new, at, 0))
    nth = np.minimum(start + n - 1, len(q) - 1)
    floor = np.where(q[nth] == q, s[nth], -np.inf)
    new[1:] |= s[1:] != s[:-1]
    of_equal = at - np.maximum.accumulate(np.where(new, at, 0))
    keep = (s >= floor - 2e-9) & (of_equal < n)
    return q[keep], s[keep], k[keep]


def _nearest(n: int, query_rows: int = 256) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's packs of vectors against the one block of queries that every row brings along.  A matrix product finds the
    pairs that may count, these are scored by the sums in the order that the column expression has, and of each query
    only what can be among its first ``n`` is kept from pack to pack."""
    def run(batches):
        asked = best = floor = None
        for batch in batches:
            for i in range(batch.num_rows):
                if asked is None:
                    names = batch.column("q_keys")[i].values
                    qn = batch.column("q_norms")[i].values.to_numpy()
                    asked = batch.column("q_flat")[i].values.to_numpy().reshape(len(names), -1)
                    best = (np.empty(0, np.int64), np.empty(0), None)
                    floor = np.full(len(names), -np.inf)
                keys = batch.column("keys")[i].values
                key = keys.to_numpy(zero_copy_only=False)
                norm = batch.column("norms")[i].values.to_numpy()
                vectors = batch.column("flat")[i].values.to_numpy().reshape(len(key), -1)
                found = [best]
                for a in range(0, len(asked), query_rows):
                    length = qn[a:a + query_rows, None] * norm[None, :]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        near = np.where(length > 0, (asked[a:a + query_rows] @ vectors.T) / length, 0.0)
                    least = floor[a:a + query_rows]
                    if len(key) > n and np.isinf(least).any():
                        least = np.maximum(least, np.partition(near, len(key) - n, axis=1)[:, len(key) - n])
                    q, x = np.nonzero(near >= least[:, None] - 1e-8)
                    length, q, total = length[q, x], q + a, np.zeros(len(q))
                    for d in range(asked.shape[1]):
                        total += asked[q, d] * vectors[x, d]
                    score = np.divide(total, length, out=np.zeros(len(q)), where=length > 0)
                    found.append(_first_of_each(q, score, key[x], n))
                found = [f for f in found if len(f[0])]
                if found:
                    best = _first_of_each(*(np.concatenate(c) for c in zip(*found)), n)
                    counts = np.bincount(best[0], minlength=len(floor))
                    full = np.flatnonzero(counts >= n)
                    floor[full] = best[1][(np.cumsum(counts) - counts)[full] + n - 1]
        if asked is not None and len(best[0]):
            for a in range(0, len(best[0]), 100_000):
                q, s, k = (c[a:a + 100_000] for c in best)
                yield pa.RecordBatch.from_arrays([pa.array(k, keys.type), names.take(pa.array(q)), pa.array(s)],
                                                 names=["key", "query", "score"])
    return run


def embedding_cosine(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vec: str = "embedding", query: str = "query_id",
                     query_vec: str = "qvec", top_n: int = 25) -> DataFrame:
    """P22 + T4 for many query vectors: the ``top_n`` vectors of each by cosine, ``query, key, semantic_score, rank``.

    Queries go in blocks of bounded bytes, each broadcast as one row with all its vectors.  Every vector meets every
    query: vectors of the queries' length with a usual norm (and those without length, which score 0) in packs by matrix
    products (:func:`_nearest`), the others by column expressions.  A task keeps little more than ``top_n`` rows of
    a query before anything is shuffled.
    A vector without length has a cosine of 0, like a null one; ties go to the smaller key."""
    size = queries.agg(F.max(F.size(query_vec))).first()[0] or 1
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query).alias("_key"), F.col(query_vec).cast("array<double>").alias("_v"))
    asked = positions(asked.withColumn("_n", F.sqrt(T.dot("_v", "_v"))), ["_key"], "_number")
    block = F.floor(F.col("_number") / max(1, QUERY_BLOCK_BYTES // (8 * size + 24))).cast("int")
    items = vectors.where(F.col(vec).isNotNull()).select(F.col(key).alias("_key"), F.col(vec).cast("array<double>").alias("_v"))
    items = items.withColumn("_n", F.sqrt(T.dot("_v", "_v")))
    none = F.coalesce(F.col("_n") == 0, F.lit(True))
    usual = none | ((F.size("_v") == size) & F.col("_n").between(1e-100, 1e100))
    flat = F.when(none, F.array_repeat(F.lit(0.0), size)).otherwise(F.col("_v"))
    norm = F.when(none, 0.0).otherwise(F.col("_n"))
    blocks = written(asked.groupBy(block.alias("_block"), usual.alias("_usual")).agg(F.collect_list(F.struct(
        F.col("_key").alias("q"), F.col("_v").alias("v"), F.col("_n").alias("n"), flat.alias("flat"), norm.alias("norm"))).alias("_queries")), "query-blocks")
    types = (vectors.schema[key].dataType, queries.schema[query].dataType)
    out_schema = ST.StructType([ST.StructField("key", types[0]), ST.StructField("query", types[1]), ST.StructField("score", ST.DoubleType())])
    named = usual & F.col("_key").isNotNull()
    packs = items.where(named).select("_key", flat.alias("_v"), norm.alias("_n")).mapInArrow(_pack, _packed(types[0]))
    others = items.where(~named)
    any_other = not others.isEmpty()
    out = None
    for row in blocks.select("_block", "_usual").orderBy("_block", "_usual").collect():       # a few numbers
        one = blocks.where((F.col("_block") == row["_block"]) & (F.col("_usual") == row["_usual"]))
        met = None
        if row["_usual"]:
            with_all = one.select(F.transform("_queries", lambda q: q["q"]).alias("q_keys"), F.flatten(F.transform("_queries", lambda q: q["flat"])).alias("q_flat"),
                                  F.transform("_queries", lambda q: q["norm"]).alias("q_norms"))
            met = (packs.crossJoin(F.broadcast(with_all)).mapInArrow(_nearest(top_n), out_schema)
                   .select(F.col("key").alias(key), F.col("query").alias(query), F.col("score").alias("semantic_score")))
        if any_other or not row["_usual"]:
            plain = (others if row["_usual"] else items).crossJoin(F.broadcast(one.select("_queries"))).select("_key", "_v", "_n", F.explode("_queries").alias("_q"))
            length = F.col("_n") * F.col("_q.n")
            plain = plain.select(F.col("_key").alias(key), F.col("_q.q").alias(query),
                                 F.when(length > 0, T.dot(F.col("_q.v"), "_v") / length).otherwise(0.0).alias("semantic_score"))
            met = plain if met is None else met.unionByName(plain)
        order = [F.round("semantic_score", 9).desc(), F.col(key).asc()]
        best = written(top_n_per_group(met, [query], order, top_n), "query-best")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return items.select(F.col("_key").alias(key), F.lit(None).cast(types[1]).alias(query), F.lit(0.0).alias("semantic_score"),
                            F.lit(0).alias("rank")).limit(0)
    return out


def model_score(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[..., Column]:
    """T4's model as an iterator pandas UDF of (query, text).  ``load`` returns a function from pairs to scores; it runs
    once in each Python worker that scores anything, and the worker keeps what it returns."""
    name = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def score(batches):
        predict = _loaded(name, load)
        for queries, texts in batches:
            yield pd.Series(predict(list(zip(queries, texts))), dtype="float64")
    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


_MODELS: dict = {}


def _loaded(name: str, load: Callable) -> Callable:
    """The model that this worker holds under ``name``."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def semantic_rerank(ranked: DataFrame, group: str, order_key: str, score: str | None,
                    top_n: int = 25) -> DataFrame:
    """T4: order by the model score (desc, stable on ``order_key``) and keep ``top_n``.

    With no model score the input list is returned unchanged and untruncated,
    keeping its existing ``rank``.
    """
    if score is None:
        return ranked
    return top_n_per_group(ranked.drop("rank"), [group],
                           [F.col(score).desc(), F.col(order_key).asc()], top_n)
