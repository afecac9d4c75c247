"""The Merkle manifest against a tree built by hand, its edge cases and the levels of its directory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagewise.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, skey int, place int"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def _path(levels, i):
    for nodes in levels[:-1]:
        run = i // 16 * 16
        yield "".join(nodes[run:i]), "".join(nodes[i + 1:run + 16])
        i //= 16


def _brute(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(doc_id, text, lang, source, n_chars, *_):
        return _h("".join(map(field, (doc_id, source, lang, n_chars, text))))
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r, leaf(*r)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = _levels([x[1] for x in sources[s]])
    crown = _levels([trees[s][-1][0] for s in order])
    for j, s in enumerate(order):
        for i, (r, own) in enumerate(sources[s]):
            path = [*_path(trees[s], i), *_path(crown, j)]
            given = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                given = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in path:
                given = _h(left + given + right)
            root = crown[-1][0]
            yield r[0], own, trees[s][-1][0], root, _h("".join(a + b for a, b in path)), given, given == root


def _key(row):
    return [(x is not None, x) for x in row]


def _same(spark, rows):
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=_key) == sorted(_brute(rows), key=_key)
    return got


def _row(i, text, source, lang="de", n=None):
    return (i, text, lang, source, n, 1, 2, 3)


def test_repeated_and_null_ids_and_sources(spark):
    pick = random.Random(3)
    rows = [_row(pick.choice([None, 5, 5, 7, 63, 64, -1, -64, -(2 ** 63), 2 ** 63 - 1, 10 ** 15, i, i]), pick.choice([None, "", "Ab É", "x"]),
                 pick.choice([None, "", "a", "é", "z", "hot", "hot", "hot", f"own{i}"]), n=i % 3 or None) for i in range(2500)]
    got = _same(spark, rows)
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097])
def test_heights(spark, n):
    _same(spark, [_row(7 * i, f"T{i}", "s") for i in range(n)])


def test_more_equal_rows_than_a_generator_makes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 50)
    _same(spark, [_row(1, "same", "s")] * 333 + [_row(1, "other", "s")] * 3 + [_row(2, "B" * 200_000, "s")])


def test_nothing(spark):
    out = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert out.columns == list(merkle.COLUMNS) and out.count() == 0


def test_directory_ranks_are_counts_of_smaller_ids(spark):
    pick = random.Random(5)
    ids = list({pick.randrange(-(1 << 63), 1 << 63) for _ in range(300)} | set(range(100_000, 100_500)) | set(pick.sample(range(1 << 24), 300)))
    docs = spark.createDataFrame([_row(i, "t", "s") for i in ids], SCHEMA)
    rows = merkle.leaves(docs)
    words = merkle.directory(merkle.bitmaps(rows))
    got = {r.doc_id: r.place for r in merkle.placed(rows, words).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}
    assert words.select(F.countDistinct("total")).first()[0] == 1
