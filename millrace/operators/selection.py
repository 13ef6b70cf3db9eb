"""The first n rows of an order, by histograms of the order's digits.

An order key is written as digits of a bounded number of values (a time in
microseconds as two, a hash as groups of 16 bits). One aggregate counts the rows
by the first digit and finds the value in which the n-th row lies; the next one
counts the rows of that value by the second digit; and so on. Rows of earlier
values are taken whole, and only those that agree with the n-th row in every
digit are left to be ranked. Each digit costs one pass over the rows and one
table of at most the digit's values, which is what gets broadcast; nothing runs
before the result is used, and no task holds n rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DIGIT_VALUES = 1 << 21  # of one digit: what a broadcast table of counts may hold


def cut(counts: DataFrame, digits: Sequence[str], goal: Column, descending: bool = False) -> DataFrame:
    """(digits, _wanted, _whole) of the values with rows among the first ``goal``.

    ``counts`` has one row per value of the last digit (the others are one value
    each) with its number of rows ``_c``. At most one value is not ``_whole``.
    """
    last = F.col(digits[-1])
    upto = Window.orderBy(last.desc() if descending else last.asc()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    return before.where(F.col("_before") < goal).select(
        *digits, F.least("_c", goal - F.col("_before")).alias("_wanted"), (F.col("_before") + F.col("_c") <= goal).alias("_whole"))


def first_rows(rows: DataFrame, digits: Sequence[str], first: DataFrame, descending: bool = False) -> DataFrame:
    """Rows among the first ones, with ``_wanted``.

    ``first`` is the cut by the first digit. ``_wanted`` is null for a row that
    is taken whatever its rank; rows that hold a number agree in all digits, and
    as many of them as it says are still to be picked.
    """
    cuts = [first]
    for i in range(1, len(digits)):
        open_value = cuts[-1].where(~F.col("_whole")).select(*digits[:i], F.col("_wanted").alias("_goal"))
        inside = rows.join(F.broadcast(open_value), list(digits[:i])).groupBy(*digits[: i + 1], "_goal").agg(
            F.count(F.lit(1)).alias("_c"))
        cuts.append(cut(inside, digits[: i + 1], F.col("_goal"), descending))
    out = rows
    for i, c in enumerate(cuts):
        c = c.select(*digits[: i + 1], F.col("_whole").alias(f"_whole{i}"), F.col("_wanted").alias(f"_wanted{i}"))
        out = out.join(F.broadcast(c), list(digits[: i + 1]), "inner" if i == 0 else "left")
    last = len(cuts) - 1
    taken = F.col(f"_whole{last}").isNotNull()
    for i in range(last):
        taken = taken | F.coalesce(F.col(f"_whole{i}"), F.lit(False))
    wanted = F.when(~F.col(f"_whole{last}"), F.col(f"_wanted{last}"))
    return out.where(taken).withColumn("_wanted", wanted).drop(
        *[f"_whole{i}" for i in range(len(cuts))], *[f"_wanted{i}" for i in range(len(cuts))])


def time_digits(ts: Column) -> tuple[Column, Column]:
    """Two digits of a time in microseconds, of 19 hours and of 66 milliseconds; no time comes before all times."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return (F.coalesce(F.shiftright(micros, 36), F.lit(-(1 << 30))).cast("long"),
            F.coalesce(F.shiftright(micros.bitwiseAND(F.lit((1 << 36) - 1)), 16), F.lit(0)).cast("long"))


def spread(whole: Column, *by: Column | str, parts: int = 4096) -> Column:
    """Group number for a window that ranks the rows left open in one group; whole rows lie anywhere."""
    return F.when(whole, F.pmod(F.xxhash64(*by), F.lit(parts))).otherwise(F.lit(-1))


def copies(rows: DataFrame, count: str) -> DataFrame:
    """Every row as often as its column ``count`` says; no array grows with the count."""
    block = 4096
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / F.lit(block)))))
    n = F.least(F.lit(block).cast("long"), F.col(count) - F.col("_block") * block)
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).drop("_block", "_copy", count)
