"""Content-defined chunks by a gear hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.digests import blake3_many


def gear() -> np.ndarray:
    """256 64-bit numbers from a public mixing function of the byte."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(data: bytes, average: int) -> list[int]:
    """Ends of chunks: from a quarter to four times the average, where the low bits of the hash are zero; more bits are asked below the average."""
    bits = max(2, (average - 1).bit_length())
    least, most, n = max(1, average // 4), 4 * average, len(data)
    g, b = gear(), np.frombuffer(data, np.uint8)
    # h = sum of gear[b[i - k]] << k: its low bits depend on the last few bytes only
    need = bits + 1
    mask_strong, mask_weak = np.uint64((1 << (bits + 1)) - 1), np.uint64((1 << (bits - 1)) - 1)
    h = np.zeros(n, np.uint64)
    terms = g[b]
    for k in range(min(need, n)):
        h[k:] += terms[: n - k] << np.uint64(k)
    strong, weak = np.flatnonzero((h & mask_strong) == 0) + 1, np.flatnonzero((h & mask_weak) == 0) + 1
    out, start = [], 0
    while start < n:
        end = min(start + most, n)
        i = np.searchsorted(strong, start + least)
        if i < len(strong) and strong[i] < start + average:
            end = min(end, int(strong[i]))
        else:
            i = np.searchsorted(weak, max(start + least, start + average))
            if i < len(weak):
                end = min(end, int(weak[i]))
        out.append(end)
        start = end
    return out


def chunks(entries: DataFrame, average: int = 1 << 20, id_col: str = "ord", data_col: str = "content") -> DataFrame:
    """(ord, chunk, offset, length, chunk_hash): the hash is 128 bits of BLAKE3 in hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(number, i, s, e, data) for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if data for ends in [cuts(data, average)] for i, (s, e) in enumerate(zip([0, *ends[:-1]], ends))]
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                hashes = [x[:16].hex() for x in blake3_many([data[s:e] for _, _, s, e, data in part])]
                number, chunk, start, end, _ = zip(*part)
                yield pa.record_batch([pa.array(number, pa.int64()), pa.array(chunk, pa.int64()), pa.array(start, pa.int64()), pa.array(np.subtract(end, start), pa.int64()), pa.array(hashes, pa.string())], ["ord", "chunk", "offset", "length", "chunk_hash"])

    return entries.select(F.col(id_col).cast("long"), data_col).mapInArrow(run, "ord long, chunk long, offset long, length long, chunk_hash string")


def dedup(chunked: DataFrame) -> DataFrame:
    """chunks with canonical: whether it is the first of its hash and length by (ord, chunk)."""
    first = chunked.groupBy("chunk_hash", "length").agg(F.min(F.struct("ord", "chunk")).alias("_first"))
    return chunked.join(first, ["chunk_hash", "length"]).withColumn("canonical", F.col("_first") == F.struct("ord", "chunk")).drop("_first")
