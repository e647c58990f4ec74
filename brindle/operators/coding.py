"""Cauchy Reed-Solomon over slices: encode, decode, and the XOR of partial results.

A stream longer than one set of slices is coded in sets: slice s is number s % per_set of set s // per_set, so neither the field nor a
slice grows with the stream. A task holds the recovery slices of a few sets at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import gf

#: Partial results that meet in one task before their sums meet.
FAN_IN = 64
#: Bytes of sums that a task keeps, or those of one set if they are more.
HELD = 128 << 20


def _partial(exponents: Callable[[int], list[int]], size: int, bits: int, per_set: int):
    """(slice, part, data) to (part, exponent, data): sums by part, each of its own exponents. HELD bytes of sums are kept, the oldest part's go first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, gf.Sums] = {}

        def out(part: int) -> pa.RecordBatch:
            rows = list(zip(exponents(part), held.pop(part).rows()))
            return pa.record_batch([pa.array([part] * len(rows), pa.int64()), pa.array([e for e, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "exponent", "data"])

        for b in batches:
            for number, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                of = exponents(part)
                if part not in held:
                    while held and (len(held) + 1) * len(of) * size > HELD:
                        yield out(next(iter(held)))
                    held[part] = gf.Sums(len(of), size, bits)
                held[part].add(gf.coefficient(np.array(of, np.int64), number % per_set, bits), np.frombuffer(data.as_buffer(), np.uint8))
        for part in list(held):
            yield out(part)

    return run


def _xor(keys: list[str]):
    """Rows of keys and data, sorted by keys, to one row for each with the XOR of data; one result is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, acc = None, None
        names = [*keys, "data"]

        def out() -> pa.RecordBatch:
            return pa.record_batch([*[pa.array([k], pa.int64()) for k in now], pa.array([acc.tobytes()], pa.binary())], names)

        for b in batches:
            ids = list(zip(*(b.column(i).to_pylist() for i in range(len(keys)))))
            for key, data in zip(ids, b.column(len(keys))):
                x = np.frombuffer(data.as_buffer(), np.uint8)
                if key != now:
                    if now is not None:
                        yield out()
                    now, acc = key, x.copy()
                else:
                    if len(x) > len(acc):
                        acc = np.concatenate([acc, np.zeros(len(x) - len(acc), np.uint8)])
                    acc[: len(x)] ^= x  # what is missing counts as zeros
        if now is not None:
            yield out()

    return run


def merge(partials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """XOR of partial recovery slices; any order and grouping gives the same. Partials of FAN_IN tasks meet first, then their sums."""
    keys = keys or ["exponent"]

    def level(df: DataFrame, by: list[str]) -> DataFrame:
        return df.select(*by, "data").repartition(*by).sortWithinPartitions(*by).mapInArrow(_xor(by), ", ".join(f"{k} long" for k in by) + ", data binary")

    some = partials.withColumn("_from", F.floor(F.spark_partition_id() / FAN_IN).cast("long"))
    return level(level(some, [*keys, "_from"]), keys)


def encode_sets(slices: DataFrame, per_set: int, recovery: int, size: int, bits: int = 8, first: int = 0) -> DataFrame:
    """(set_no, exponent, data): recovery slices first to first + recovery - 1 of each set of (slice, data).

    Each task holds recovery * size bytes and sends as much for each set that it reads from. A row doesn't depend on the number of
    slices, so more recovery slices, or more data, can be added later.
    """
    exponents = list(range(first, first + recovery))
    if per_set + first + recovery > 1 << bits:
        raise ValueError(f"{per_set} slices and recovery up to {first + recovery} don't fit in a field of {bits} bits")
    rows = slices.select("slice", F.floor(F.col("slice") / per_set).cast("long").alias("part"), "data")
    partials = rows.mapInArrow(_partial(lambda _: exponents, size, bits, per_set), "part long, exponent long, data binary")
    return merge(partials, ["part", "exponent"]).withColumnRenamed("part", "set_no")


def encode(slices: DataFrame, recovery: int, size: int, bits: int = 8, first: int = 0) -> DataFrame:
    """encode_sets() of a stream that is one set: (exponent, data)."""
    return encode_sets(slices, (1 << bits) - first - recovery, recovery, size, bits, first).select("exponent", "data")


def decode(slices: DataFrame, recovery: DataFrame, erased: list[int], size: int, bits: int = 8) -> DataFrame:
    """(slice, data) of the erased slices of one set, from the others and as many of the lowest recovery slices. Too few raise ValueError."""
    cells = slices.filter(~F.col("slice").isin(erased)).select("slice", F.lit(0).cast("long").alias("col"), "data")
    rows = recovery.select("exponent", F.lit(0).cast("long").alias("col"), "data")
    return decode_columns(cells, rows, {0: erased} if erased else {}, size, bits).select("slice", "data")


def decode_columns(cells: DataFrame, recovery: DataFrame, erased: dict[int, list[int]], size: int, bits: int = 8) -> DataFrame:
    """(slice, col, data) of erased cells: cells (slice, col, data) are the intact ones, recovery is (exponent, col, data).

    Each column is a code of its own with its own erasures, at most as many as there are recovery slices; `erased` has columns *
    recovery numbers at most. Too many raise ValueError.
    """
    spark = cells.sparkSession
    schema = "slice long, col long, data binary"
    present = sorted(r["exponent"] for r in recovery.select("exponent").distinct().collect())  # one number for each recovery slice
    for col, lost in erased.items():
        if len(lost) > len(present):
            raise ValueError(f"{len(lost)} erased slices in column {col} and {len(present)} recovery slices")
    if not erased:
        return spark.createDataFrame([], schema)
    use = {c: present[: len(lost)] for c, lost in erased.items()}
    told = spark.createDataFrame([(c, e) for c, es in use.items() for e in es], "part long, exponent long")
    rows = cells.filter(F.col("col").isin(list(erased))).select("slice", F.col("col").alias("part"), "data").sortWithinPartitions("part")
    sums = rows.mapInArrow(_partial(use.__getitem__, size, bits, 1 << bits), "part long, exponent long, data binary")
    own = recovery.select(F.col("col").alias("part"), "exponent", "data").join(F.broadcast(told), ["part", "exponent"]).select("part", "exponent", "data")
    syndromes = merge(sums.union(own), ["part", "exponent"])
    inverse = {c: gf.solve(gf.coefficient(np.array(use[c])[:, None], np.array(lost)[None, :], bits), bits) for c, lost in erased.items()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, e, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = gf.Sums(len(erased[c]), size, bits)
                s.add(inverse[c][:, use[c].index(e)], np.frombuffer(data.as_buffer(), np.uint8))
                yield pa.record_batch([pa.array([c] * len(erased[c]), pa.int64()), pa.array(erased[c], pa.int64()), pa.array(list(s.rows()), pa.binary())], ["part", "exponent", "data"])

    out = merge(syndromes.mapInArrow(spread, "part long, exponent long, data binary"), ["part", "exponent"])
    return out.select(F.col("exponent").alias("slice"), F.col("part").alias("col"), "data")
