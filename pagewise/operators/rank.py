"""Rankings that stay distributed even when one group holds a large share of rows.

* ``top_n_per_group`` - ``row_number() <= n``; Spark plans it with
  ``WindowGroupLimit`` so each map task keeps at most ``n`` rows per group
  before the shuffle, so a hot group never reaches one task whole.
* ``blocked_rank`` - exact 0-based rank of *every* row inside a group when the
  sort key has few distinct values (e.g. credibility).  Rows are counted per
  (group, key, seq block); a small window over those counts gives each block
  its offset, and ``row_number`` runs only inside one block (bounded by
  ``block_size`` seq values).  No window ever sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def top_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order)
    # the filter must sit on the row_number column itself for Catalyst to plan a
    # WindowGroupLimit (per-task top-n before the shuffle)
    return (df.withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= n)
              .withColumn(rank_col, F.col("_rn") - 1)
              .drop("_rn"))


def blocked_rank(df: DataFrame, group_cols: list[str], key_col: str, seq_col: str,
                 rank_col: str = "rank", descending: bool = True,
                 rows_per_block: int = 1 << 16) -> DataFrame:
    """0-based stable rank by ``key_col`` (desc by default), ties by ``seq_col`` asc.

    ``seq_col`` must be unique inside each group (any long; sparse ids are fine).
    Each group's seq range is cut into blocks sized so that a block holds about
    ``rows_per_block`` rows on average; counts per (group, key, block) and a
    window over those counts give every block its offset, and ``row_number``
    runs inside one block only.
    """
    stats = df.groupBy(*group_cols).agg(F.min(seq_col).alias("_lo"), F.max(seq_col).alias("_hi"),
                                        F.count(F.lit(1)).alias("_cnt"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) * F.lit(rows_per_block) / F.col("_cnt")))
    keyed = (df.join(stats, group_cols)
               .withColumn("_blk", F.floor((F.col(seq_col) - F.col("_lo")) / width).cast("long"))
               .drop("_lo", "_hi", "_cnt"))
    key_order = F.col(key_col).desc() if descending else F.col(key_col).asc()
    counts = keyed.groupBy(*group_cols, key_col, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    w_off = (Window.partitionBy(*group_cols).orderBy(key_order, F.col("_blk").asc())
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))).drop("_n")
    w_in = Window.partitionBy(*group_cols, key_col, "_blk").orderBy(F.col(seq_col).asc())
    inner = keyed.withColumn("_rn", F.row_number().over(w_in) - 1)
    return (inner.join(offsets, on=[*group_cols, key_col, "_blk"], how="inner")
                 .withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("long"))
                 .drop("_blk", "_off", "_rn"))


def positions(df: DataFrame, order: list[str], pos: str) -> DataFrame:
    """``df`` with the 0-based position of each row in the order of ``order``, over all rows.  Rows are dealt out by
    range and numbered range by range; one small row per range gives the offsets."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)       # as many rows as ranges
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(offsets, "_part").withColumn(pos, (F.col("_offset") + own).cast("long")).drop("_part", "_offset")
