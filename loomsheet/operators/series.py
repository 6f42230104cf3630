"""Series operators: moving windows, bands, ranges, buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _frame(order: list[str], by: list[str], n: int):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)


def _from(n: int, order: list[str], by: list[str], value: Column) -> Column:
    return F.when(F.row_number().over(Window.partitionBy(*by).orderBy(*order)) >= n, value)


def moving_average(df: DataFrame, x: str, n: int, order: list[str], by: list[str], out: str = "moving_average", standard: bool = False) -> DataFrame:
    """Mean of the last ``n`` values; the first one stands at place n (from 0), with ``standard`` at n - 1."""
    return df.withColumn(out, _from(n if standard else n + 1, order, by, F.avg(x).over(_frame(order, by, n))))


def moving_deviation(df: DataFrame, x: str, n: int, order: list[str], by: list[str], out: str = "moving_deviation", standard: bool = False) -> DataFrame:
    return df.withColumn(out, _from(n if standard else n + 1, order, by, F.stddev_samp(x).over(_frame(order, by, n))))


def bollinger(df: DataFrame, x: str, n: int, order: list[str], by: list[str], width: float = 2.0) -> DataFrame:
    """Mean and mean plus and minus ``width`` deviations of the last ``n`` values."""
    both = moving_deviation(moving_average(df, x, n, order, by, "band_mean"), x, n, order, by, "_sd")
    return both.withColumn("band_low", F.col("band_mean") - width * F.col("_sd")).withColumn("band_high", F.col("band_mean") + width * F.col("_sd")).drop("_sd")


def block_extremes(df: DataFrame, index: str, x: str, by: list[str] | None = None, block: int = 1_000) -> DataFrame:
    """(block, lo, hi): least and greatest value of each block of places, the cache for range queries."""
    return df.groupBy(*(by or []), F.floor(F.col(index) / block).alias("block")).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))


def range_extremes(df: DataFrame, index: str, x: str, ranges: DataFrame, block: int = 1_000) -> DataFrame:
    """(range_id, lo, hi) for ranges (range_id, first, last), ends included.

    Whole blocks inside a range come from the block cache, the rest from the values of its two edge
    blocks; both are equi-joins on the block, so a long range costs its blocks, not its values.
    """
    spanned = ranges.withColumn("b0", F.floor(F.col("first") / block)).withColumn("b1", F.floor(F.col("last") / block))
    blocks = block_extremes(df, index, x, block=block)
    inner = spanned.filter("b1 - b0 > 1").select("range_id", F.explode(F.sequence(F.col("b0") + 1, F.col("b1") - 1)).alias("block")).join(blocks, "block").select("range_id", "lo", "hi")
    edges = spanned.select("range_id", "first", "last", F.explode(F.array_distinct(F.array("b0", "b1"))).alias("block"))
    values = df.select(F.col(index).alias("_i"), F.col(x).alias("_x"), F.floor(F.col(index) / block).alias("block"))
    outer = edges.join(values, "block").filter("_i between first and last").groupBy("range_id").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    return inner.unionByName(outer).groupBy("range_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def ring_buffer(df: DataFrame, x: str, n: int, order: list[str], by: list[str]) -> DataFrame:
    """State of a buffer of the last ``n`` values after each row: size, least and greatest now, and of all time."""
    w, past = _frame(order, by, n), Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", F.count(x).over(w).alias("held"), F.min(x).over(w).alias("lo"), F.max(x).over(w).alias("hi"), F.min(x).over(past).alias("all_lo"), F.max(x).over(past).alias("all_hi"))


def within_budget(df: DataFrame, text: str, order: list, budget: int, k: int) -> DataFrame:
    """The first rows in an order, at most ``k``, until their texts exceed a number of characters."""
    top = df.orderBy(*order).limit(k)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over at most k rows
    return top.withColumn("_used", F.sum(F.length(text)).over(w)).filter(F.col("_used") <= budget).drop("_used")
