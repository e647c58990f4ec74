"""Geometry, redundancy, volumes and codec choice: scalar planning that needs only the stream's length."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
#: fixed bounds of the format
SLICE_LEAST, SLICE_MOST, CELL_DEFAULT, CELL_LEAST, SLICES_WANTED = 4096, 4 * MIB, 65536, 4096, 4000
UNITS = {"": 1, "b": 1} | {u: 1024 ** (i + 1) for i, u in enumerate("kmgt")} | {u + "b": 1000 ** (i + 1) for i, u in enumerate("kmgt")}
#: calibrated planner rates in MB/s by working set (fixed values; they order candidates and nothing else)
RATES = {("matrix", 8): (62400, 46500, 40400), ("matrix", 16): (22900, 22900, 20500), ("fft", 8): (44000, 22600, 7500), ("fft", 16): (22000, 10400, 3550)}
DECODE = {("fft", 8): (22600, 0), ("fft", 16): (16850, 0), ("matrix", 8): (46500, 250), ("matrix", 16): (29000, 7500)}
SEEK_US = {"rotational": 10_000, "ssd": 50}


def round64(n: int) -> int:
    return -(-n // 64) * 64


def cap(bits: int, recovery: int) -> int:
    return min((1 << bits) - max(recovery, 1), (1 << bits) - 1)


def slice_size(length: int, bits: int = 16, recovery: int = 1, wanted: int | None = None) -> int:
    if not length:
        return SLICE_LEAST
    if wanted:
        if wanted > length:
            raise ValueError("more slices than bytes")
        return max(64, round64(-(-length // wanted)))
    z = min(max(round64(length // SLICES_WANTED), SLICE_LEAST), SLICE_MOST)
    return round64(-(-length // cap(bits, recovery))) if -(-length // z) > cap(bits, recovery) else z


def cell_size(z: int, asked: int = CELL_DEFAULT, frame: int = 0) -> int:
    if z < CELL_LEAST:
        return 0
    y = asked
    if frame and frame <= z:
        y = -(-y // frame) * frame
    return max(CELL_LEAST, min(round64(y), z // 64 * 64))


def parse_size(text: str) -> int | None:
    m = re.fullmatch(r"(\d+)(\.\d+)?([kmgt]?b?)", text.strip().lower())
    if not m or (m[2] and not m[3].strip("b")):
        return None
    return int(float(m[1] + (m[2] or "")) * UNITS[m[3]]) if m[2] else int(m[1]) * UNITS[m[3]]


def recovery_slices(spec: str | None, slices: int, z: int, least: int = 0, most: int | None = None) -> int:
    """none: a twentieth; N; N%; Nx; or a size such as 10M."""
    if not slices:
        return 0
    if spec is None:
        r = -(-slices // 20)
    elif spec.endswith("%"):
        r = math.floor(slices * float(spec[:-1]) / 100 + 0.5)
    elif spec.endswith("x"):
        r = math.floor(slices * float(spec[:-1]) + 0.5)
    elif spec.isdigit():
        r = int(spec)
    else:
        r = -(-parse_size(spec) // z)
    r = max(r, least, 1)
    return min(r, most) if most else r


def ladder(recovery: int) -> list[int]:
    """Recovery slices of each volume: 1, 2, 4, ...; the last takes what is left."""
    out, at, step = [], 0, 1
    while at < recovery:
        n = recovery - at if at + 2 * step > recovery else step
        out.append(n)
        at, step = at + n, step * 2
    return out


def replicate(volume: Column, last: Column, critical: Column, payload: Column) -> Column:
    """Whether a volume carries a copy of the critical packets."""
    small = critical <= F.greatest(F.lit(MIB), F.floor(payload / 20))
    return small | (volume == 0) | (volume == last) | ((volume > 0) & (volume.bitwiseAND(volume - 1) == 0))


def volume_name(base: str, first: int, count: int, total: int) -> str:
    w, v = len(str(total)), len(str(max(ladder(total), default=0)))
    return f"{base}.v{first:0{w}d}+{count:0{v}d}"


@dataclass(frozen=True)
class Candidate:
    codec: str
    bits: int
    score_us: float
    passes: int
    why: str


def next_pow2(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def supported(codec: str, bits: int, slices: int, recovery: int) -> bool:
    n = next_pow2(recovery) + slices if codec == "fft" else slices + recovery
    return n <= 1 << bits


def fft_worthwhile(slices: int, recovery: int) -> bool:
    m = next_pow2(recovery)
    return slices * recovery >= 20 * ((slices + m) / 2 * max(1, math.log2(m)))


def candidates(slices: int, recovery: int, z: int, memory: int = 1 << 30, streaming: bool = False, disk: str = "ssd") -> list[Candidate]:
    """Codecs that can do it, cheapest first; ties keep the order tried."""
    out = []
    for codec, bits in (("matrix", 8), ("fft", 8), ("matrix", 16), ("fft", 16)):
        if not supported(codec, bits, slices, recovery) or codec == "fft" and (streaming or not fft_worthwhile(slices, recovery)):
            continue
        per = max(1, recovery)
        while codec == "matrix" and per > 1 and per * z > memory:
            per = -(-per // 2)
        passes = -(-recovery // per) if recovery else 1
        m = next_pow2(max(1, recovery))
        work = slices * recovery * z if codec == "matrix" else (slices + m) / 2 * max(1, math.log2(m)) * z
        held = per * z if codec == "matrix" else (slices + m) * z
        rate = RATES[codec, bits][0 if held <= 16 * MIB else 1 if held <= 128 * MIB else 2]
        repair, setup = DECODE[codec, bits]
        score = work / rate + (slices * z / repair + setup) + passes * SEEK_US[disk]
        out.append(Candidate(codec, bits, score, passes, f"{work / 1e6:.1f} MB of work at {rate} MB/s, {passes} passes"))
    return sorted(out, key=lambda c: c.score_us)


def repair_crossover(slices: int, z: int) -> int:
    """The least number of erased slices from which FFT decoding is cheaper than the matrix."""
    for e in range(1, slices + 1):
        m = next_pow2(e)
        if slices * e * z / DECODE["matrix", 8][0] + DECODE["matrix", 8][1] > (slices + m) / 2 * max(1, math.log2(m)) * z / DECODE["fft", 8][0]:
            return e
    return slices + 1


def explain(length: int, z: int, recovery: int, bits: int = 8) -> dict:
    s = -(-length // z)
    y = cell_size(z)
    return {"slices": s, "cells": -(-z // y) if y else 1, "recovery": recovery, "work_bytes": recovery * z, "redundancy_pct": 100 * recovery / s if s else 0.0}
