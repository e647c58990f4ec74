"""Verify by stored digests, repair by decoding, and what a repair writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import coding, layout


def split_cells(slices: DataFrame, size: int, cell: int) -> DataFrame:
    """(slice, col, data): slices of `size` bytes cut every `cell` bytes."""
    c = slices.select("slice", "data", F.explode(F.sequence(F.lit(0), F.lit(-(-size // cell) - 1))).alias("col"))
    return c.select("slice", F.col("col").cast("long").alias("col"), F.expr(f"substring(data, int(col * {cell} + 1), {cell})").alias("data"))


def tag(data: Column, key: bytes | None = None) -> Column:
    """A cell's digest: SHA-256, of the key twice around the data if there is one."""
    return F.sha2(F.concat(F.lit(key), data, F.lit(key)) if key else data, 256)


def tags(cells: DataFrame, key: bytes | None = None) -> DataFrame:
    """(slice, col, tag) to be stored; contents stay where they are."""
    return cells.select("slice", "col", tag(F.col("data"), key).alias("tag"))


def verify(cells: DataFrame, stored: DataFrame, key: bytes | None = None) -> DataFrame:
    """(slice, col, status) of each stored tag: ok, damaged or missing. Only tags are shuffled."""
    now = tags(cells, key).withColumnRenamed("tag", "now")
    j = stored.join(now, ["slice", "col"], "left")
    return j.select("slice", "col", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("tag"), "ok").otherwise("damaged").alias("status"))


def decode(cells: DataFrame, recovery: DataFrame, bad: DataFrame, size: int, cell: int, bits: int = 8) -> DataFrame:
    """(slice, col, data) of the bad cells (slice, col) of one set, by each column's own code, the intact cells and recovery (exponent, data)."""
    # a column can lose as many slices as there are recovery slices, so these are columns * recovery rows at most, or the repair fails
    most = recovery.select("exponent").distinct().count() * -(-size // cell)
    got = bad.select("slice", "col").distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} damaged cells")
    erased: dict[int, list[int]] = {}
    for r in sorted(got):
        erased.setdefault(r["col"], []).append(r["slice"])
    intact = cells.join(F.broadcast(bad.select("slice", "col").distinct()), ["slice", "col"], "left_anti")
    parts = split_cells(recovery.withColumnRenamed("exponent", "slice"), size, cell).select(F.col("slice").alias("exponent"), "col", "data")
    wide = min(size, cell)
    out = coding.decode_columns(intact, parts, erased, wide, bits)
    return out.withColumn("data", F.expr(f"substring(data, 1, int(least({cell}, {size} - col * {cell})))"))  # the last column may be short


def fan_out(placed: DataFrame, bad: DataFrame, size: int, cell: int) -> DataFrame:
    """(ord, begin, end): for every entry that holds a repaired cell, canonical or alias, the bytes of its own file that are written, touching ones as one."""
    at = bad.select(F.col("slice").alias("_slice"), (F.col("slice") * size + F.col("col") * cell).alias("c0"), (F.col("slice") * size + F.least(F.lit(size), (F.col("col") + 1) * cell)).alias("c1"))
    s = layout.spans(placed, size).join(at, F.col("slice") == F.col("_slice")).filter((F.col("span_begin") < F.col("c1")) & (F.col("span_end") > F.col("c0")))
    w = s.select("ord", (F.greatest("span_begin", "c0") - F.col("stream_offset")).alias("begin"), (F.least("span_end", "c1") - F.col("stream_offset")).alias("end"))
    return layout.islands(w, ["ord"]).select("ord", "begin", "end")


def counters(writes: DataFrame, placed: DataFrame, bad: DataFrame) -> DataFrame:
    """One row: cells_damaged, cells_decoded, writes, bytes_written, entries_repaired, aliases_repaired."""
    w = writes.join(placed.select("ord", "is_canonical"), "ord")
    one = w.agg(F.count("*").alias("writes"), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0)).alias("bytes_written"), F.countDistinct("ord").alias("entries_repaired"), F.countDistinct(F.when(~F.col("is_canonical"), F.col("ord"))).alias("aliases_repaired"))
    n = bad.agg(F.count("*").alias("cells_damaged"))
    return n.crossJoin(one).select("cells_damaged", F.col("cells_damaged").alias("cells_decoded"), "writes", "bytes_written", "entries_repaired", "aliases_repaired")


def assemble(spans: DataFrame, slices: DataFrame, size: int) -> DataFrame:
    """(ord, content) of entries from the stream's slices: spans (ord, slice, span_begin, span_end) say which bytes are whose."""
    piece = F.expr(f"hex(substring(data, int(span_begin - slice * {size} + 1), int(span_end - span_begin)))")
    p = spans.select("ord", "slice", "span_begin", "span_end").join(slices, "slice").select("ord", F.struct("span_begin", piece.alias("h")).alias("p"))
    g = p.groupBy("ord").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # an entry's own bytes
    return g.select("ord", F.unhex(F.array_join(F.transform("ps", lambda x: x["h"]), "")).alias("content"))
