"""Running sums in a global order without a single task for all rows.

Split points of the order column are taken from a hash sample of its values, so a row's range is a function of its value alone.
Ranges are summed, the range totals (one row each) are summed in turn, and only rows of one range meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_EACH = 250_000
MOST_RANGES = 4096


def split_points(df: DataFrame, order: str, rows_each: int = ROWS_EACH) -> list:
    """Values that cut the order into ranges of about rows_each rows; at most MOST_RANGES."""
    n = df.count()
    ranges = min(MOST_RANGES, n // rows_each + 1)
    if ranges == 1:
        return []
    keep = max(1, n // (ranges * 20))  # about twenty sampled values a range
    got = df.select(order).filter(F.pmod(F.xxhash64(order), F.lit(keep)) == 0).distinct().orderBy(order).collect()
    step = max(1, len(got) // ranges)
    return [r[0] for r in got[step::step]]


def running_ordered(df: DataFrame, order: str, weight: Column, name: str, by: list[str] | None = None, *, before: bool = True, rows_each: int = ROWS_EACH) -> DataFrame:
    """df with the running sum of weight in the order of column `order` (unique within `by`), of the rows before each or up to it."""
    by = by or []
    points = split_points(df, order, rows_each)
    place = F.lit(0)
    for lo in range(0, len(points), 64):  # a range's number: how many split points lie at or below the value
        place = place + sum((F.when(F.col(order) >= F.lit(p), 1).otherwise(0) for p in points[lo : lo + 64]), F.lit(0))
    d = df.withColumn("_w", weight.cast("long")).withColumn("_r", place)
    frame = Window.partitionBy(*by, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    d = d.withColumn("_own", F.coalesce(F.sum("_w").over(frame), F.lit(0)))
    if points:
        keys = [*by, "_r"]
        total = d.groupBy(*keys).agg(F.sum("_w").alias("_s"))
        up = Window.partitionBy(*by).orderBy("_r") if by else Window.partitionBy(F.lit(0)).orderBy("_r")
        total = total.withColumn("_b", F.coalesce(F.sum("_s").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
        d = d.join(total, keys).withColumn("_own", F.col("_own") + F.col("_b"))
    return d.withColumn(name, F.col("_own")).select(*df.columns, name)
