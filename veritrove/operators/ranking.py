"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped_rank(df: DataFrame, groups: list[str], order: list, block, out: str) -> DataFrame:
    """Number the rows of each group from 0 without holding a group in one task.

    ``block`` is an expression that splits a group into parts of bounded size
    and rises with ``order`` (or is arbitrary where any numbering will do).
    Rows are numbered inside their part; the parts' sizes, one row each, are
    summed up over the group and added. Null group keys form a group.
    """
    cut = df.withColumn("__block", block)
    parts = cut.groupBy(*groups, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*groups, "__block").orderBy(*order)
    rows = cut.withColumn("__row", F.row_number().over(inside) - 1)
    same = F.col("__block").eqNullSafe(F.col("__b"))
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = rows.join(starts, same, "inner")
    return joined.select(*df.columns, (F.col("__start") + F.col("__row")).cast("long").alias(out))


#: Rows that are numbered in one task, about.
NUMBERED = 100_000


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """``df``, whose values of ``key`` are distinct, with dense numbers from 0 in blocks of about ``NUMBERED`` rows; it should be stored."""
    blocks = max(1, -(-df.count() // NUMBERED))
    return grouped_rank(df, [], [F.col(key)], F.pmod(F.xxhash64(key), F.lit(blocks)), out)
