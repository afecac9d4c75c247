"""Phrase collocations against counting by hand."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewise.llm import phrases

SCHEMA = "doc_id long, text string, lang string, word string, f int, route int, phrase string"


def _brute(docs, words=3, least=10, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, words + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        kept = []
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            score, k = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def _texts(seed, rows, vocabulary):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["The", "of", "É", "漢字", "of", "the", "the", "a-b", "'s"]
    for _ in range(rows):
        text = "".join(pick.choice(words) + pick.choice([" "] * 9 + ["\t", "  ", ". ", ",", "\n", "!", "\r\n"]) for _ in range(pick.randrange(60)))
        yield text, pick.choice(["en", "en", "en", "de", None, "und"])


def _run(spark, docs, **more):
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2, "y") for i, (t, lang) in enumerate(docs)], SCHEMA)
    return sorted(tuple(r) for r in phrases.collocations(spark, df, **more).collect())


@pytest.mark.parametrize("partition,frequent", [(1_500_000, 16 << 20), (300, 16 << 20), (300, 0)])
def test_against_counting(spark, monkeypatch, partition, frequent):
    """One partition; many, so that common words are hot and split over routes; and no cut by frequent words."""
    monkeypatch.setattr(phrases, "PARTITION_WORDS", partition)
    monkeypatch.setattr(phrases, "FREQUENT_BYTES", frequent)
    docs = [*_texts(1, 500, 9), (None, "en"), ("", None), (None, None), ("same words here " * 3000, "fr"), ("same words here " * 3000, "fr"),
            ("x" * 100_000 + " y", "fr")]
    got = _run(spark, docs)
    assert got == _brute(docs) and len(got) > 50


def test_top_and_longer_phrases(spark):
    docs = [*_texts(2, 300, 15)] + [("one two three four five six", "en")] * 12
    assert _run(spark, docs, words=4, least=5, top=7) == _brute(docs, 4, 5, 7)


def test_nothing(spark):
    assert _run(spark, [(None, None)]) == [] and _run(spark, [("a b", "en")] * 9) == []
    assert phrases.collocations(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 10 ** 12
    row = spark.createDataFrame([(big, big + 7, 3 * big)], "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s")).first()
    assert row.s == 1000000 * big * big // ((big + 7) * 3 * big)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-1, 3), st.integers(-1, 3), st.integers(1, 4)), max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_quicksort_counts(rows, least):
    keys = np.array([(a, b, c if b >= 0 else -1) for a, b, c, _ in rows], np.int64).reshape(-1, 3)
    weight = np.array([r[3] for r in rows], np.int64)
    partial = np.where((keys[:, 0] == 0) & (keys[:, 1] == 0), 2, (keys[:, 0] == 0).astype(np.int64))
    want = collections.Counter()
    for k, w in zip(keys.tolist(), weight.tolist()):
        for d in range(1, 4):
            if -1 not in k[:d]:
                want[tuple(k[:d])] += w
    split = {p for p in want if p[0] == 0 and (len(p) == 1 or (len(p) == 2 and p[1] == 0))}
    got = {}
    for d, pointers, total in phrases.multikey_quicksort(keys, weight, least, partial):
        got |= {tuple(keys[p, :d].tolist()): int(t) for p, t in zip(pointers, total)}
    assert got == {p: c for p, c in want.items() if c >= least or p in split}
