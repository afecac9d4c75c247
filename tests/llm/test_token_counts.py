"""Token counts against the library that the vocabulary belongs to."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewise.llm import token_counts
from pagewise.llm.catalog import COUNTED

PATH = public_tokenizers.path(COUNTED)
SCHEMA = "doc_id long, text string, uid int, piece string, n int, uses int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _rows(texts):
    return [(i, t, 1, "p", 2, 3) for i, t in enumerate(texts)]


def _table(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "t"))
    return spark.read.schema(SCHEMA).parquet(str(tmp_path / "t"))


def _want(library, rows):
    return sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)


def _got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in df.collect())


ODD = [None, "", " ", "   \n\t ", "a", "It's we'll I'd 'S don''t", "one  two   three\n\n four  five 　six ​  end  ",
       "x<|endoftext|>y  <|endoftext|><|endoftext|>  z", "<|endoftext|>", "<|endoftext", "<| endoftext|>", "漢字🙂 ñandú ١٢٣ Ⅷ ½ é́",
       "w" * 30_000, " ".join(f"wort{i % 977}{i}" for i in range(20_000)), "\x00\x01\r\n\x85\x1c\x1f tabs\t\tand\x0bmore"]


@pytest.mark.parametrize("head", [150_000, 5, 0])
def test_as_the_library(spark, tmp_path, library, monkeypatch, head):
    monkeypatch.setattr(token_counts, "HEAD_ROWS", head)
    rows = _rows(ODD) + [(3, ODD[5], 1, "p", 2, 3)] * 2 + [(3, "other text", 1, "p", 2, 3), (None, "no id", 1, "p", 2, 3), (None,) * 6]
    assert _got(token_counts.count_tokens(spark, _table(spark, tmp_path, rows), PATH)) == _want(library, rows)


def test_every_code_point(spark, tmp_path, library):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = _rows(["".join(f"a{c}1{c}! {c}" for c in points[i:i + 4000]) for i in range(0, len(points), 4000)])
    assert _got(token_counts.count_tokens(spark, _table(spark, tmp_path, rows), PATH)) == _want(library, rows)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = token_counts.op12(spark, docs, PATH)
    assert _got(out) == _want(library, [(r.doc_id, r.text) for r in docs.collect()])
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert out.where(F.col("over_limit") != (F.col("n_tokens") > 1024)).count() == 0 and out.where("over_limit").count() > 0


def test_nothing(spark, tmp_path):
    assert token_counts.count_tokens(spark, _table(spark, tmp_path, []), PATH).count() == 0
