"""De-duplication, placement on the stream, slices and cells, and checks of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.ordered import running_ordered


def file_dedup(entries: DataFrame, max_refs: int = 0) -> DataFrame:
    """entries with canonical_ord: the first entry of equal content and length; with max_refs, every max_refs-th copy is stored anew.

    Copies meet only as a minimum (partially aggregated), or as running counts when max_refs is set. Empty entries aren't shared.
    """
    keys = ["content_hash", "length"]
    if not max_refs:
        first = entries.groupBy(*keys).agg(F.min("ord").alias("canonical_ord"))
        d = entries.join(first, keys)
        return d.withColumn("canonical_ord", F.when(F.col("length") == 0, F.col("ord")).otherwise(F.col("canonical_ord")))
    d = running_ordered(entries, "ord", F.lit(1), "_rank", keys).withColumn("_group", F.floor(F.col("_rank") / max_refs))
    first = d.groupBy(*keys, "_group").agg(F.min("ord").alias("canonical_ord"))
    d = d.join(first, [*keys, "_group"]).drop("_rank", "_group")
    return d.withColumn("canonical_ord", F.when(F.col("length") == 0, F.col("ord")).otherwise(F.col("canonical_ord")))


def place(deduped: DataFrame, align: int = 1) -> DataFrame:
    """deduped entries with is_canonical and stream_offset; what is stored begins at multiples of align, aliases share their canonical's place."""
    own = F.col("ord") == F.col("canonical_ord")
    room = F.ceil(F.col("length") / align) * align if align > 1 else F.col("length")
    d = running_ordered(deduped.withColumn("is_canonical", own), "ord", F.when(own, room).otherwise(0), "_at")
    at = d.filter("is_canonical").select(F.col("ord").alias("canonical_ord"), F.col("_at").alias("stream_offset"))
    return d.drop("_at").join(at, "canonical_ord")


def totals(placed: DataFrame) -> DataFrame:
    canonical = F.col("is_canonical")
    return placed.agg(
        F.count("*").alias("entries"), F.sum("length").alias("entry_bytes"), F.sum(F.when(~canonical, F.col("length")).otherwise(0)).alias("shared_bytes"),
        F.sum(F.when(canonical, F.col("length")).otherwise(0)).alias("stream_length"), F.sum(F.when(~canonical & (F.col("length") > 0), 1).otherwise(0)).alias("alias_extents"),
    )


def slices(spark: SparkSession, length: int, slice_size: int) -> DataFrame:
    """(slice, begin, bytes): the stream cut every slice_size bytes."""
    s = spark.range(0, -(-length // slice_size)).withColumnRenamed("id", "slice")
    return s.withColumn("begin", F.col("slice") * slice_size).withColumn("bytes", F.least(F.lit(slice_size), F.lit(length) - F.col("begin")).cast("long"))


def cells(sliced: DataFrame, slice_size: int, cell_size: int) -> DataFrame:
    """(slice, col, begin, size, real): cells of cell_size bytes; the last column is short, real counts bytes of the stream."""
    c = sliced.select("slice", F.col("begin").alias("_b"), "bytes", F.explode(F.sequence(F.lit(0), F.lit(-(-slice_size // cell_size) - 1))).alias("col"))
    size = F.least(F.lit(cell_size), F.lit(slice_size) - F.col("col") * cell_size)
    real = F.greatest(F.lit(0), F.least(size, F.col("bytes") - F.col("col") * cell_size))
    return c.select("slice", F.col("col").cast("long").alias("col"), (F.col("_b") + F.col("col") * cell_size).alias("begin"), size.cast("long").alias("size"), real.cast("long").alias("real"))


def spans(extents: DataFrame, slice_size: int, offset: str = "stream_offset", length: str = "length") -> DataFrame:
    """extents exploded to the slices that they overlap, clipped: slice, span_begin, span_end. An equi-joinable form of the interval join."""
    some = extents.filter(F.col(length) > 0)
    end = F.col(offset) + F.col(length)
    s = some.withColumn("slice", F.explode(F.sequence(F.floor(F.col(offset) / slice_size), F.floor((end - 1) / slice_size))))
    return s.withColumn("span_begin", F.greatest(F.col(offset), F.col("slice") * slice_size)).withColumn("span_end", F.least(end, (F.col("slice") + 1) * slice_size))


def overlap_join(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """Pairs of (l_begin, l_end, ...) and (r_begin, r_end, ...) rows that overlap, by the blocks of `size` that both touch; each pair once."""
    blocks = lambda b, e: F.explode(F.sequence(F.floor(F.col(b) / size), F.floor((F.col(e) - 1) / size)))
    a, b = left.withColumn("_block", blocks("l_begin", "l_end")), right.withColumn("_block", blocks("r_begin", "r_end"))
    j = a.join(b, "_block").filter((F.col("l_begin") < F.col("r_end")) & (F.col("r_begin") < F.col("l_end")))
    # the block in which the overlap begins tells for the pair
    return j.filter(F.col("_block") == F.floor(F.greatest("l_begin", "r_begin") / size)).drop("_block")


def islands(intervals: DataFrame, by: list[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """Intervals that overlap or touch as one: by, begin, end, n."""
    w = Window.partitionBy(*by).orderBy(begin, end)
    d = intervals.withColumn("_top", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_new", F.when(F.col("_top").isNull() | (F.col(begin) > F.col("_top")), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_island").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def coalesced(extents: DataFrame, by: list[str], order: str, offset: str, length: str) -> DataFrame:
    """Extents of an entry that abut in order, as one: by, offset, length, n."""
    w = Window.partitionBy(*by).orderBy(order)
    d = extents.withColumn("_new", F.when(F.lag(F.col(offset) + F.col(length)).over(w) == F.col(offset), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_run").agg(F.min(offset).alias(offset), F.sum(length).alias(length), F.count("*").alias("n")).drop("_run")


def tiling(volumes: DataFrame, length: int, by: list[str], begin: str = "begin", size: str = "bytes") -> DataFrame:
    """volumes with status: ok, gap or overlap against the one before; `short` where the last ends before length, `long` beyond."""
    w = Window.partitionBy(*by).orderBy(begin)
    due, last = F.coalesce(F.lag(F.col(begin) + F.col(size)).over(w), F.lit(0)), F.lead(begin).over(w).isNull()
    end = F.col(begin) + F.col(size)
    return volumes.withColumn("status", F.when(F.col(begin) > due, "gap").when(F.col(begin) < due, "overlap").when(last & (end < length), "short").when(last & (end > length), "long").otherwise("ok"))


def highwater(extents: DataFrame, order: str, offset: str, length: str, align: int, by: list[str]) -> DataFrame:
    """extents with kind: canonical (starts at the high-water mark), pad (after padding below align), shared (ends below), split or forward (violations)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max(F.col(offset) + F.col(length)).over(w), F.lit(0))
    end = F.col(offset) + F.col(length)
    kind = F.when(F.col(offset) == top, "canonical").when(end <= top, "shared").when(F.col(offset) < top, "split").when(F.col(offset) - top < align, "pad").otherwise("forward")
    return extents.withColumn("high_water", top).withColumn("kind", kind)


def erasure_depth(erasures: DataFrame) -> DataFrame:
    return erasures.groupBy("col").agg(F.count("*").alias("erased"))


def column_groups(erasures: DataFrame) -> DataFrame:
    """Columns that share one set of erased slices: depth, columns, first_col, and the two 64-bit sums that stand for the set.

    Count, XOR and sum of hashes are merged in part before the shuffle, so no column's slices meet in a task.
    """
    h = F.xxhash64("slice")
    p = erasures.groupBy("col").agg(F.count("*").alias("depth"), F.bit_xor(h).alias("pattern_xor"), F.sum(h.cast("decimal(20,0)")).alias("pattern_sum"))
    return p.groupBy("depth", "pattern_xor", "pattern_sum").agg(F.count("*").alias("columns"), F.min("col").alias("first_col"))


def verdict(bad: Column, depth: Column, recovery: Column) -> tuple[Column, Column]:
    """(exit, status): clean, repairable, or beyond repair."""
    code = F.when(bad == 0, 0).when(depth <= recovery, 1).otherwise(2)
    return code, F.when(code == 0, "clean").when(code == 1, "repairable").otherwise("unrepairable")
