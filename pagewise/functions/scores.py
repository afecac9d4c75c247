"""Score formulas as column expressions: credibility (P14), SQS (P15), hybrid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Fixed values (credibility weights of the reference).
TLD_WEIGHTS = {"gov": 0.3, "edu": 0.3, "org": 0.1}
AUTHOR_WEIGHT = 0.15
DATE_WEIGHT = 0.15
HTTPS_WEIGHT = 0.1
CREDIBILITY_TOTAL = 0.3 + 0.3 + 0.1 + 0.15 + 0.15 + 0.1   # 1.1

# Fixed values (search-quality score weights and thresholds).
SQS_WEIGHTS = {"result_count": 0.2, "avg_relevance": 0.4, "relevance_variance": 0.2, "max_relevance": 0.2}
SQS_VALID = 60.0
SQS_LOW_QUALITY = 20.0

# Fixed values (hybrid relevance weights).
HYBRID_WEIGHTS = (0.2, 0.3, 0.5)   # jaccard, tf-idf cosine, semantic


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _truthy(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & (c.cast("string") != ""), F.lit(False))


def credibility(url, author=None, date=None) -> Column:
    """(TLD + author + date + https) / 1.1, capped at 1."""
    u = _c(url)
    label = urls.host_last_label(u)
    tld = F.lit(0.0)
    for name, wt in TLD_WEIGHTS.items():
        tld = F.when(label == name, F.lit(wt)).otherwise(tld)
    score = F.coalesce(tld, F.lit(0.0))
    if author is not None:
        score = score + F.when(_truthy(_c(author)), AUTHOR_WEIGHT).otherwise(0.0)
    if date is not None:
        score = score + F.when(_truthy(_c(date)), DATE_WEIGHT).otherwise(0.0)
    score = score + F.when(urls.scheme(u) == "https", HTTPS_WEIGHT).otherwise(0.0)
    return F.least(score / F.lit(CREDIBILITY_TOTAL), F.lit(1.0))


def sqs(result_count, avg_rel, var_rel, max_rel) -> Column:
    """P15 search-quality score; 0 when there are no results."""
    n = _c(result_count)
    raw = (F.log(n.cast("double") + F.lit(1.0)) * SQS_WEIGHTS["result_count"]
           + _c(avg_rel) * SQS_WEIGHTS["avg_relevance"]
           - _c(var_rel) * SQS_WEIGHTS["relevance_variance"]
           + _c(max_rel) * SQS_WEIGHTS["max_relevance"]) * 100.0
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), raw))


def sqs_category(result_count, sqs_score) -> Column:
    s = _c(sqs_score)
    return (F.when(F.coalesce(_c(result_count), F.lit(0)) == 0, F.lit("Invalid/Empty"))
            .when(s >= SQS_VALID, F.lit("Valid"))
            .when(s >= SQS_LOW_QUALITY, F.lit("Low Quality"))
            .otherwise(F.lit("Invalid/Empty")))


def hybrid(jaccard, tfidf, semantic) -> Column:
    """0.2 jaccard + 0.3 tf-idf + 0.5 semantic."""
    wj, wt, ws = HYBRID_WEIGHTS
    return wj * _c(jaccard) + wt * _c(tfidf) + ws * _c(semantic)
