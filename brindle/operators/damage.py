"""Seeded faults over a binary column: the six modes of a fault injector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def scatter(data: bytes, count: int, seed: int) -> bytes:
    """One byte in each of `count` different blocks of 255 flipped."""
    out, rng = bytearray(data), np.random.default_rng(seed)
    blocks = -(-len(data) // 255)
    for b in rng.permutation(blocks)[:count]:
        at = int(b) * 255 + int(rng.integers(0, min(255, len(data) - int(b) * 255)))
        out[at] ^= 0xA5
    return bytes(out)


def burst(data: bytes, count: int, start: int) -> bytes:
    return data[:start] + bytes(x ^ 0xFF for x in data[start : start + count]) + data[start + count :]


def bursts(words: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """burst() of each of many words (words, n)."""
    out, hurt = words.copy(), np.flatnonzero(counts)
    at = np.arange(words.shape[1])
    start = starts[hurt, None]
    out[hurt] ^= np.where((at >= start) & (at < start + counts[hurt, None]), 0xFF, 0).astype(np.uint8)
    return out


def truncate(data: bytes, delta: int) -> bytes:
    return data[: max(0, len(data) - delta)]


def insert(data: bytes, offset: int, length: int, seed: int) -> bytes:
    return data[:offset] + np.random.default_rng(seed).integers(0, 256, length, dtype=np.uint8).tobytes() + data[offset:]


def swap(data: bytes, a: int, b: int, length: int) -> bytes:
    out = bytearray(data)
    out[a : a + length], out[b : b + length] = data[b : b + length], data[a : a + length]
    return bytes(out)


def swap_between(one: bytes, two: bytes, offset: int, length: int) -> tuple[bytes, bytes]:
    end = offset + length
    return one[:offset] + two[offset:end] + one[end:], two[:offset] + one[offset:end] + two[end:]


MODES = {"scatter": scatter, "burst": burst, "truncate": truncate, "insert": insert, "swap": swap}


def inject(df: DataFrame, mode: str, args: tuple, data_col: str = "content") -> DataFrame:
    """df with every value of the binary column damaged by one of MODES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(data_col)
            new = pa.array([None if x is None else MODES[mode](x, *args) for x in b.column(i).to_pylist()], b.schema.field(i).type)
            yield b.set_column(i, b.schema.field(i), new)

    return df.mapInArrow(run, df.schema)
