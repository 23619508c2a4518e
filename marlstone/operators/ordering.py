"""Places in a global order without a single task.

Rows fall into blocks of the order; counts per block give each block its first
place, and rows are numbered inside blocks only.  The table of blocks is the one
thing that a window without keys ever sees, and its size is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Hexadecimal digits of a hash that make a block: 65,536 blocks.
DIGITS = 4
#: Rows of a block of names, unless more share all of their text.
BLOCK_ROWS = 200_000


def placed(rows: DataFrame, block: Column, *order: Column | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``place`` (from 0) in the order of (block, order), within
    each combination of ``keys``."""
    b = rows.withColumn("block_", block)
    counts = b.groupBy(*keys, "block_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.partitionBy(*keys).orderBy("block_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("block_").alias("of_"), before.alias("first_"))
    nth = F.row_number().over(W.partitionBy(*keys, "block_").orderBy(*order)) - 1
    same = F.col("block_").eqNullSafe(F.col("of_"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    j = b.withColumn("nth_", nth).join(firsts, same)
    return j.withColumn("place", (F.col("first_") + F.col("nth_")).cast("long")).drop("block_", "nth_", "of_", "first_", *[f"{k}_" for k in keys])


def shuffled(rows: DataFrame, digest: Column, key: str) -> DataFrame:
    """``rows`` with ``place`` in the order of a hexadecimal hash, then key."""
    h = rows.withColumn("h_", digest)
    return placed(h, F.substring("h_", 1, DIGITS), "h_", key).drop("h_")


def lowest(rows: DataFrame, n: Column, digest: Column, key: str) -> DataFrame:
    """The ``n`` (a column; the same for all rows) rows first in the order of a
    hash.  Blocks before the one with the cut are taken whole; only that one is
    sorted."""
    h = rows.withColumns({"h_": digest, "n_": n}).withColumn("block_", F.substring("h_", 1, DIGITS))
    counts = h.groupBy("block_").agg(F.count(F.lit(1)).alias("k_"), F.first("n_").alias("n_"))
    upto = counts.withColumn("upto_", F.sum("k_").over(W.orderBy("block_")))
    cut = upto.where("upto_ >= n_").agg(F.min(F.struct(F.col("block_").alias("b"), (F.col("n_") - F.col("upto_") + F.col("k_")).alias("left"))).alias("cut_"))
    j = h.join(F.broadcast(cut), F.lit(True))  # one row
    whole = j.where(F.col("cut_").isNull() | (F.col("block_") < F.col("cut_.b")))
    part = j.where(F.col("block_") == F.col("cut_.b")).withColumn("i_", F.row_number().over(W.partitionBy("block_").orderBy("h_", key))).where("i_ <= cut_.left").drop("i_")
    return whole.unionByName(part).drop("h_", "n_", "block_", "cut_")


def ranked_by(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``place`` in the order of a text column.  Blocks are common
    beginnings, as long as it takes to keep them small."""
    longest = rows.agg(F.max(F.length(name))).first()[0] or 0
    width = 4
    while width < longest and (rows.groupBy(F.substring(name, 1, width).alias("b")).count().agg(F.max("count")).first()[0] or 0) > BLOCK_ROWS:
        width += 4
    return placed(rows, F.substring(name, 1, width), name)


def trailing(rows: DataFrame, n: int, run: str, time: str, *order: str) -> tuple[DataFrame, W]:
    """Rows for a window of the last ``n`` rows of each run, and that window.

    A run is numbered by days and cut into chunks of 8 * ``n`` rows; the last
    n - 1 rows of a chunk are carried to the next.  Keep the rows where ``own``.
    """
    p = placed(rows, F.date_trunc("day", time), time, *order, keys=(run,))
    size = 8 * n
    chunk = F.floor(F.col("place") / size)
    both = F.when(F.col("place") % size >= size - (n - 1), F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    cut = p.withColumn("chunk", F.explode(both)).withColumn("own", F.col("chunk") == chunk)
    return cut, W.partitionBy(run, "chunk").orderBy("place").rowsBetween(-(n - 1), 0)
