"""Every registered query with oracle SQL matches DuckDB on the smallest tables;
the others run and return rows."""

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare

SF = "/root/testdata/sf0.001"


def test_registered_queries_match_oracle(spark):
    res = compare(spark, SF, verbose=False)
    assert set(res) == set(E.queries())
    bad = {k: v for k, v in res.items() if v[0] not in ("MATCH", "ROWS_ONLY")}
    assert not bad, bad


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["search_id", "final_rank", "doc_id", "final_score", "bm25_score", "credibility_score"]
    assert df.count() > 0
