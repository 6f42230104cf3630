"""Ranks and running sums within groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: parts a group is cut into, per million rows of the table; each part is one window partition
PARTS = 64


def parts_for(rows: int) -> int:
    """Parts so that one holds at most some ten thousand rows of the largest possible group."""
    return max(8, PARTS * rows // 1_000_000)


def running(df: DataFrame, group: list[str], order: list[str], part: Column, value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each, within ``group``.

    Rows are ordered by ``part`` (a small number computed from a hash or range of the row), then by
    ``order``.  Sums within a part are a window over (group, part); sums of whole parts are a small
    aggregate, combined map-side, whose prefix sums are joined back on (group, part).
    """
    marked = df.withColumn("_part", part).withColumn("_value", value)
    key = [*group, "_part"]
    sizes = marked.groupBy(*key).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return local.join(offsets, key).withColumn(out, F.col("_offset") + F.col("_local")).drop("_part", "_value", "_offset", "_local")
