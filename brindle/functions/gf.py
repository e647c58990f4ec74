"""Arithmetic in GF(2^8) and GF(2^16), and Cauchy Reed-Solomon coefficients."""

from __future__ import annotations

from functools import cache

import numpy as np

#: field polynomials (fixed values); the generator is 2
POLYNOMIALS = {8: 0x11D, 16: 0x1002D}


@cache
def tables(bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(exp, log): exp is repeated so that the sum of two logarithms is a place in it."""
    q = 1 << bits
    exp, log, x = np.zeros(2 * q, np.int64), np.zeros(q, np.int64), 1
    for i in range(q - 1):
        exp[i], log[x] = x, i
        x <<= 1
        if x & q:
            x ^= POLYNOMIALS[bits]
    exp[q - 1 : 2 * (q - 1)] = exp[: q - 1]
    return exp, log


def mul(a, b, bits: int = 8):
    exp, log = tables(bits)
    a, b = np.asarray(a), np.asarray(b)
    return np.where((a == 0) | (b == 0), 0, exp[log[a] + log[b]])


def inv(a, bits: int = 8):
    exp, log = tables(bits)
    return exp[((1 << bits) - 1 - log[np.asarray(a)]) % ((1 << bits) - 1)]


def power(a: int, n: int, bits: int = 8) -> int:
    exp, log = tables(bits)
    return 0 if a == 0 and n else int(exp[log[a] * n % ((1 << bits) - 1)]) if a else 1


def coefficient(exponent, data, bits: int = 8):
    """Of a data slice in a recovery slice: 1 / ((q - 1 - exponent) xor data)."""
    return inv(((1 << bits) - 1 - np.asarray(exponent)) ^ np.asarray(data), bits)


@cache
def _rows(bits: int) -> np.ndarray | None:
    """GF(2^8) has a table of all products."""
    return mul(np.arange(256)[:, None], np.arange(256)[None, :]).astype(np.uint8) if bits == 8 else None


def scale(c: int, data: np.ndarray, bits: int = 8) -> np.ndarray:
    """c times every symbol (uint8 or uint16)."""
    if bits == 8:
        return _rows(8)[c][data]
    exp, log = tables(bits)
    return np.where(data == 0, 0, exp[log[c] + log[data]]).astype(np.uint16) if c else np.zeros_like(data)


def _lanes(coefficients: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each byte of a symbol, a table from its 256 values to all products, side by side in a 64-bit word."""
    kind, lanes = (np.uint8, 8) if bits == 8 else (np.uint16, 4)
    c = np.asarray(coefficients, np.int64)
    out = []
    for shift in range(0, bits, 8):
        words = np.zeros((256, lanes), kind)
        words[:, : len(c)] = _rows(8)[c].T if bits == 8 else mul(c[None, :], np.arange(256)[:, None] << shift, bits)
        out.append(words.view(np.uint64).ravel())
    return out


class Sums:
    """Sums of products of several coefficients with slices; add() does 8 (GF(2^8)) or 4 of them with each look into a table."""

    BLOCK = 1 << 15

    def __init__(self, n: int, size: int, bits: int = 8) -> None:
        self.n, self.size, self.bits, self.lanes = n, size, bits, 64 // bits
        self.sums = [np.zeros(-(-size * 8 // bits), np.uint64) for _ in range(-(-n // self.lanes))]
        self.held = np.empty(self.BLOCK, np.uint64)

    def add(self, coefficients: np.ndarray, data: np.ndarray) -> None:
        """data: bytes, at most `size`; what is missing counts as zeros."""
        step = self.bits // 8
        if len(data) % step:
            data = np.concatenate([data, np.zeros(1, np.uint8)])
        symbols = data.reshape(-1, step)
        for k, total in enumerate(self.sums):
            tables = _lanes(coefficients[k * self.lanes : (k + 1) * self.lanes], self.bits)
            for at in range(0, len(symbols), self.BLOCK):
                part = symbols[at : at + self.BLOCK]
                out, held = total[at : at + len(part)], self.held[: len(part)]
                for byte, t in enumerate(tables):
                    np.take(t, part[:, byte], out=held, mode="clip")
                    np.bitwise_xor(out, held, out=out)

    def rows(self):
        """The sums' bytes, one for each coefficient."""
        kind = np.uint8 if self.bits == 8 else np.uint16
        for i in range(self.n):
            yield self.sums[i // self.lanes].view(kind).reshape(-1, self.lanes)[:, i % self.lanes].tobytes()[: self.size]


def solve(matrix: np.ndarray, bits: int = 8) -> np.ndarray:
    """The inverse of a square matrix by elimination."""
    n = len(matrix)
    m = np.concatenate([matrix.astype(np.int64), np.eye(n, dtype=np.int64)], axis=1)
    for c in range(n):
        p = c + int(np.flatnonzero(m[c:, c])[0])
        m[[c, p]] = m[[p, c]]
        m[c] = mul(m[c], inv(m[c, c], bits), bits)
        for r in range(n):
            if r != c and m[r, c]:
                m[r] ^= mul(m[c], m[r, c], bits)
    return m[:, n:]
