"""Ordered work over keys of any size: pieces of equal row count.

Rows are sorted by (key, order) across the whole table with one range exchange,
whose boundaries come from a sample of the rows themselves. So pieces hold about
the same number of rows however the rows lie: a key with a third of the table,
or one whose rows all fall into one second or one instant, is cut into many
pieces, and a piece holds many small keys. Rows that are equal in all order
columns are told apart by a running number, so they are cut as well; which of
them comes first makes no difference to any result.

The sorted rows are stored once; ``_piece`` and ``_seq`` give each its place. A
key that goes on from the piece before is *open* at the start of a piece; at most
one key is, so what has to be carried between pieces is one small row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import store

PIECE_ROWS = 200_000


def sorted_pieces(df: DataFrame, key: str, order_cols: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``df`` with ``_piece`` and ``_seq``, sorted by key and order inside and across pieces (nulls first).

    Counts the rows when it is called.
    """
    pieces = max(1, -(-df.count() // piece_rows))
    order = [F.col(c).asc_nulls_first() for c in (key, *order_cols, "_any")]
    return (df.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(pieces, *order)
            .sortWithinPartitions(*order).drop("_any")
            .withColumn("_piece", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))


def row_position(df: DataFrame, key: str, order_cols: Sequence[str], pos_col: str = "Position",
                 piece_rows: int = PIECE_ROWS) -> DataFrame:
    """0..n-1 position of each row within its key's series (W8), exact for any key size.

    Two levels of prefix sums: a row's place among its key's rows in its piece,
    and the rows of that key in the pieces before. The window that adds these up
    sees one row per key and piece. Rows without a key are a series of their own.
    """
    rows = store(sorted_pieces(df, key, order_cols, piece_rows), "positions")
    parts = rows.groupBy(F.col(key).alias("_key"), F.col("_piece").alias("_of")).agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    same = (F.col("_piece") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key"))
    position = F.col("_before") + F.col("_seq") - F.col("_first")
    return rows.join(parts, same).withColumn(pos_col, position).select(*df.columns, pos_col)
