"""Merkle manifest of a table of documents, its leaves placed by bitmap ranks.

Every row is a leaf.  Leaves of one source ascend by ``doc_id``, and a leaf's place in its source is the *rank* of its
id in the source's bitmap, so no source is ever sorted.  The bitmap is kept as its non-empty 64-bit words (merged from
all tasks by ``bit_or``) with a popcount directory above them: counts are summed up a radix tree of the word numbers, and
what precedes a node within its parent is a running sum over at most 65,536 siblings, however ids are spread.  With
the places known, nodes of a level meet in slot arrays keyed by ``(source, place / 256)``, which reduce two levels of
16 at once; going down again each slot array gets the siblings above it, and each leaf its proof.

The tree: while a source has more than one node, every 16 consecutive ones (the last run: fewer, even one) become the
hash of their concatenated hexadecimal digests.  What is left is the source's subroot; the subroots, ordered by
source (null first, UTF-8 bytes), are the nodes of one more such tree, whose last node is the root.

Defined results: a null field hashes as ``-``; a null ``doc_id`` stands before all others, a null ``source`` is a source
of its own; rows with one ``doc_id`` are ordered by their leaf digest, and equal rows are leaves of their own; an empty
table gives no rows.  Only the columns ``doc_id, source, lang, n_chars, text`` are read, whatever else there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

FAN = 16
#: Nodes in a slot array: two levels.
BLOCK = FAN * FAN
#: Word number of null ids: below every ``doc_id >> 6``.
NO_ID = -(1 << 62)
#: Bits of the word number that each level of the popcount directory takes away.
DIRECTORY_BITS = (10, 16, 16)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Equal rows that one row of a generator stands for.
COPIES = 4096


def _field(column: Column) -> Column:
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def _digest(doc_id, source, lang, n_chars, text) -> Column:
    return F.sha2(F.concat(*(_field(c) for c in (doc_id, source, lang, n_chars, text))), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``skey, doc_id, word, bit, leaf, tampered`` per row: ``skey`` orders sources by UTF-8 bytes with null first,
    ``tampered`` is the leaf of the row with its text's A-Z in lower case where 5 divides crc32 of the id, else null."""
    d = docs.select(*(F.col(c).alias(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return d.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("skey"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.shiftright(F.col("doc_id").cast("bigint"), 6), F.lit(NO_ID)).alias("word"),
        F.col("doc_id").cast("bigint").bitwiseAND(F.lit(63)).cast("int").alias("bit"),
        _digest(*own, F.col("text")).alias("leaf"),
        F.when(chosen, _digest(*own, F.translate("text", UPPER, LOWER))).alias("tampered"))


def bitmaps(rows: DataFrame) -> DataFrame:
    """The sources' bitmaps as their non-empty words: ``skey, word, bits, n``.  ``n`` counts rows, so that words in
    which ids repeat (or are null) are those with ``n`` unlike the popcount."""
    return rows.groupBy("skey", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """The popcount directory: ``skey, word, bits, repeats, first, total`` for each word, with ``first`` the rows of
    the source before it and ``total`` those in it."""
    node = words.select("skey", F.col("word").alias("key"), "n")
    levels = []
    for bits in (*DIRECTORY_BITS, None):
        node = node.withColumn("up", F.lit(0).cast("bigint") if bits is None else F.shiftright("key", bits))
        siblings = Window.partitionBy("skey", "up").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        node = node.withColumn("before", F.coalesce(F.sum("n").over(siblings), F.lit(0)))
        levels.append(node)
        node = node.groupBy("skey", F.col("up").alias("key")).agg(F.sum("n").alias("n"))
    first = node.select("skey", F.col("key").alias("up"), F.lit(0).cast("bigint").alias("base"), F.col("n").alias("total"))
    for level in reversed(levels):
        first = (level.join(first, ["skey", "up"])
                 .select("skey", F.col("key").alias("up"), (F.col("base") + F.col("before")).alias("base"), "total"))
    return (words.join(first.withColumnRenamed("up", "word"), ["skey", "word"])
            .select("skey", "word", "bits", (~F.col("n").eqNullSafe(F.bit_count("bits"))).alias("repeats"),
                    F.col("base").alias("first"), "total"))


def _repeats(rows: DataFrame) -> DataFrame:
    """Places of rows in words where ids repeat.  Equal rows are counted first and come back as runs of places; the
    digests of one id are ordered within their first three hexadecimal digits, so no group grows with its id."""
    def before(*keys, order):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))
    run = (rows.withColumn("head", F.substring("leaf", 1, 3))
           .groupBy("skey", "word", "bit", "doc_id", "head", "leaf", "tampered", "first", "total").agg(F.count("*").alias("n")))
    heads = run.groupBy("skey", "word", "bit", "head").agg(F.sum("n").alias("n"))
    ids = heads.groupBy("skey", "word", "bit").agg(F.sum("n").alias("n"))
    ids = ids.select("skey", "word", "bit", before("skey", "word", order="bit").alias("b1"))
    heads = heads.select("skey", "word", "bit", "head", before("skey", "word", "bit", order="head").alias("b2"))

    def same(other, *more):
        keys = [F.col(f"r.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in ("skey", "word", "bit", *more)]
        return keys[0] & keys[1] & keys[2] & (keys[3] if more else F.lit(True))
    run = run.withColumn("b3", before("skey", "word", "bit", "head", order="leaf")).alias("r")
    run = (run.join(ids.alias("i"), same("i")).join(heads.alias("h"), same("h", "head"))
           .select("r.skey", "r.doc_id", "r.leaf", "r.tampered", "r.total", "r.n",
                   F.expr("r.first + i.b1 + h.b2 + r.b3").alias("start")))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {COPIES}"))).alias("part")
    run = run.select("*", part).withColumn("last", F.least(F.col("n") - 1, F.col("part") * COPIES + COPIES - 1))
    copy = F.explode(F.sequence(F.col("part") * COPIES, F.col("last"))).alias("copy")
    return run.select("*", copy).select("skey", (F.col("start") + F.col("copy")).alias("place"), "total", "doc_id",
                                        "leaf", "tampered")


def placed(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """``skey, place, total, doc_id, leaf, tampered``: every leaf with its rank in its source."""
    known = rows.join(broadcast_if_small(ranks, 100), ["skey", "word"])
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    single = known.where("not repeats").select("skey", (F.col("first") + below).alias("place"), "total", "doc_id",
                                               "leaf", "tampered")
    if ranks.where("repeats").isEmpty():
        return single
    return single.unionByName(_repeats(known.where("repeats")))


# --------------------------------------------------------------------------------------
# Levels
# --------------------------------------------------------------------------------------

def _hash_slots(nodes: str) -> str:
    return f"sha2(array_join({nodes}, ''), 256)"


def _reduced(kids: DataFrame) -> DataFrame:
    """Slot arrays ``kids`` (``slot`` first, then ``hash``) of ``total`` nodes a source: adds ``mids``, the nodes one level
    up, and ``hash``, the node two levels up.  A level that has one node already stays as it is."""
    return (kids.withColumn("low", F.expr("transform(kids, k -> k.hash)"))
            .withColumn("mids", F.expr(f"""if(total = 1, low, transform(sequence(0, (size(low) - 1) div {FAN}),
                                              i -> {_hash_slots(f'slice(low, i * {FAN} + 1, {FAN})')}))"""))
            .withColumn("hash", F.expr(f"if(total <= {FAN}, mids[0], {_hash_slots('mids')})")))


def _slots(nodes: DataFrame, *payload: str) -> DataFrame:
    entry = F.struct((F.col("place") % BLOCK).cast("int").alias("slot"), "hash", *payload)
    return (nodes.groupBy("skey", F.expr(f"place div {BLOCK}").alias("place"))
            .agg(F.array_sort(F.collect_list(entry)).alias("kids"), F.first("total").alias("total")))


def _tree(nodes: DataFrame, largest: int, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """Reduce ``nodes(skey, place, total, hash)`` until every ``skey`` has one.  Returns the written slot arrays level by
    level (``payload`` columns in the lowest) and the tops ``skey, hash``."""
    levels = []
    while True:
        levels.append(written(_reduced(_slots(nodes, *payload)), "merkle-level"))
        up = F.ceil(F.col("total") / BLOCK).cast("bigint")
        nodes, payload, largest = levels[-1].select("skey", "place", up.alias("total"), "hash"), (), -(-largest // BLOCK)
        if largest <= 1:
            return levels, nodes.select("skey", "hash")


def _siblings(at: str) -> str:
    """The two levels' siblings of slot ``at``, left and right, of the levels that were reduced."""
    group, own = f"({at} div {FAN})", f"({at} % {FAN})"
    low = f"slice(low, {group} * {FAN} + 1, {FAN})"
    step = "struct(array_join(slice({0}, 1, {1}), '') as l, array_join(slice({0}, {1} + 2, {2}), '') as r)"
    one, two = step.format(low, own, FAN), step.format("mids", group, FAN)
    return f"case when total = 1 then array() when total <= {FAN} then array({one}) else array({one}, {two}) end"


def _paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """From the tops down: the lowest slot arrays, each with ``path``, the siblings above it (lowest first) and
    the columns of ``above`` (``skey, path, ...``)."""
    more = [c for c in above.columns if c not in ("skey", "path")]
    down = levels[-1].join(above, "skey")
    for level in levels[-2::-1]:
        kid = f"transform(kids, k -> struct(place * {BLOCK} + k.slot as place, concat({_siblings('k.slot')}, path) as path))"
        down = down.select("skey", *more, F.explode(F.expr(kid)).alias("k")).select("skey", *more, "k.place", "k.path")
        down = level.join(down, ["skey", "place"])
    return down


def _ordered(tops: DataFrame) -> DataFrame:
    """Sources with their place in byte order.  They may be as many as the rows, so they are dealt out by range and
    numbered range by range."""
    ranged = written(tops.repartitionByRange("skey").withColumn("part", F.spark_partition_id()), "merkle-sources")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    offset = sizes.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("skey")) - 1
    return ranged.join(F.broadcast(offset), "part").select("skey", "hash", place.alias("place"))


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, leaf, subroot, root``, ``proof_sha256`` (hash of the siblings up to the root),
    ``folded_root`` (the tampered leaf, where there is one, else the leaf, folded with its siblings) and ``verified``."""
    rows = written(leaves(docs), "merkle-leaves")
    ranks = written(directory(written(bitmaps(rows), "merkle-bitmaps")), "merkle-ranks")
    largest = ranks.agg(F.max("total")).first()[0] or 0
    places = placed(rows, ranks).withColumnRenamed("leaf", "hash")
    levels, tops = _tree(places, largest, "doc_id", "tampered")

    sources = _ordered(tops)
    n = tops.count()
    crown, top = _tree(sources.select(F.lit(0).alias("skey"), "place", F.lit(n).cast("bigint").alias("total"), "hash",
                                      F.col("skey").alias("source")), n, "source")
    root = top.select("skey", F.expr("cast(array() as array<struct<l: string, r: string>>)").alias("path"),
                      F.col("hash").alias("root"))
    each = f"transform(kids, k -> struct(k.source as skey, k.hash as subroot, root, concat({_siblings('k.slot')}, path) as path))"
    above = _paths(crown, root).select(F.inline(F.expr(each)))

    proof = f"concat({_siblings('k.slot')}, path)"
    steps = f"""transform(kids, k -> struct(k.doc_id as doc_id, k.hash as leaf, coalesce(k.tampered, k.hash) as given,
                                            {proof} as proof))"""
    folded = "aggregate(k.proof, k.given, (h, s) -> sha2(concat(s.l, h, s.r), 256))"
    joined = "sha2(array_join(transform(k.proof, s -> concat(s.l, s.r)), ''), 256)"
    made = (_paths(levels, above).withColumn("steps", F.expr(steps))
            .select("subroot", "root", F.expr(f"transform(steps, k -> struct(k.doc_id as doc_id, k.leaf as leaf, "
                                              f"{joined} as proof_sha256, {folded} as folded_root))").alias("out"))
            .select("subroot", "root", F.inline("out")))
    return made.withColumn("verified", F.col("folded_root") == F.col("root")).select(*COLUMNS)


def op11(spark, docs: DataFrame) -> DataFrame:
    return manifest(docs)
