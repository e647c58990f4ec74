"""CRC-32C and BLAKE3 over many byte strings at once, with numpy across strings and chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- CRC-32C: reflected polynomial of Castagnoli (fixed value)
POLYNOMIAL = 0x82F63B78


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


_TABLE = _crc_table()


#: Long strings are taken in blocks, whose CRCs are combined; blocks that advance together take GRID bytes at most.
BLOCK = 1 << 14
GRID = 32 << 20


#: Bytes of several strings that are worked on side by side.
TOGETHER = 2 << 20


def together(blobs: list[bytes], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of strings that have `most` bytes together, or one longer string; a string counts 64 bytes at least."""
    lo = size = 0
    for i, b in enumerate(blobs):
        if i > lo and size + len(b) > most:
            yield lo, i
            lo, size = i, 0
        size += max(64, len(b))
    if lo < len(blobs):
        yield lo, len(blobs)


def crc32c_many(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of each string. Their blocks advance together, byte by byte, the longest first."""
    pieces = [b[at : at + BLOCK] for b in blobs for at in range(0, max(1, len(b)), BLOCK)]
    crc = _crc_of_blocks(pieces)
    if len(pieces) == len(blobs):
        return crc
    out, at = np.zeros(len(blobs), np.uint32), 0
    for i, b in enumerate(blobs):
        n = max(1, -(-len(b) // BLOCK))
        value = int(crc[at])
        for k in range(1, n):
            value = int(_moved(np.array([value], np.uint32), len(pieces[at + k]))[0]) ^ int(crc[at + k])
        out[i] = value
        at += n
    return out


def _crc_of_blocks(blobs: list[bytes]) -> np.ndarray:
    out = np.full(len(blobs), 0xFFFFFFFF, np.uint32)
    if not blobs:
        return out
    lengths = np.array([len(b) for b in blobs])
    order = np.argsort(-lengths, kind="stable")
    lo = 0
    while lo < len(blobs):
        longest = int(lengths[order[lo]])
        part = order[lo : lo + max(1, min(4096, GRID // max(1, longest)))]
        grid = np.zeros((longest, len(part)), np.uint8)
        for j, i in enumerate(part):
            grid[: lengths[i], j] = np.frombuffer(blobs[i], np.uint8)
        live = np.searchsorted(-lengths[part], -np.arange(longest), "left")  # strings that are longer than each position
        crc = out[part]
        for at in range(longest):
            n = live[at]
            crc[:n] = _TABLE[(crc[:n] ^ grid[at, :n]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
        out[part] = crc
        lo += len(part)
    return out ^ np.uint32(0xFFFFFFFF)


@cache
def _shift_tables(n: int) -> list[np.ndarray]:
    """For each byte of a state, a table of what it becomes `n` zero bytes later."""
    ones = np.array([1 << i for i in range(32)], np.uint64)
    image = np.array([crc32c_combine(int(x), 0, n) if n else int(x) for x in ones], np.uint32)
    out = []
    for byte in range(4):
        t = np.zeros(256, np.uint32)
        for bit in range(8):
            t[(np.arange(256) >> bit & 1) == 1] ^= image[8 * byte + bit]
        out.append(t)
    return out


def _moved(states: np.ndarray, n: int) -> np.ndarray:
    """Linear states (without preset and inversion) after n zero bytes."""
    t = _shift_tables(n)
    return t[0][states & 0xFF] ^ t[1][states >> 8 & 0xFF] ^ t[2][states >> 16 & 0xFF] ^ t[3][states >> 24]


def crc32c(data: bytes) -> int:
    return int(crc32c_many([data])[0])


def _gf2_times(matrix: np.ndarray, vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= int(matrix[i])
        vector, i = vector >> 1, i + 1
    return out


def crc32c_combine(first: int, second: int, second_length: int) -> int:
    """CRC of two strings joined, from their CRCs: the first is moved on by second_length zero bytes."""
    matrix = np.array([POLYNOMIAL, *(1 << i for i in range(31))], np.uint64)  # by one zero bit
    for _ in range(3):
        matrix = np.array([_gf2_times(matrix, int(x)) for x in matrix], np.uint64)
    while second_length:
        if second_length & 1:
            first = _gf2_times(matrix, first)
        second_length >>= 1
        if second_length:
            matrix = np.array([_gf2_times(matrix, int(x)) for x in matrix], np.uint64)
    return first ^ second


def _prefix_states(data: np.ndarray, stride: int = 1024) -> np.ndarray:
    """The linear state after each prefix, 0 to len(data) bytes. Segments advance together: first for their ends, then from their starts."""
    n = len(data)
    m = -(-n // stride)
    grid = np.zeros((m, stride), np.uint8)
    grid.ravel()[:n] = data
    grid = np.ascontiguousarray(grid.T)
    state = np.zeros(m, np.uint32)
    for row in grid:
        state = _TABLE[(state ^ row) & 0xFF] ^ (state >> np.uint32(8))
    start, now = np.zeros(m, np.uint32), np.zeros(1, np.uint32)
    for i in range(m):
        start[i] = now[0]
        now = _moved(now, stride) ^ state[i]
    out = np.empty((stride, m), np.uint32)
    for k, row in enumerate(grid):
        out[k] = start
        start = _TABLE[(start ^ row) & 0xFF] ^ (start >> np.uint32(8))
    # the state after the last byte, where it begins a segment of its own
    flat = out.T.ravel()
    return flat[: n + 1] if n < m * stride else np.append(flat, start[-1])


def rolling_crc32c(data: bytes, window: int) -> np.ndarray:
    """CRC-32C of every window of `window` bytes, one step apart: the state after it less the state before it, moved on by the window."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    return _rolling(_prefix_states(np.frombuffer(data, np.uint8)), np.arange(n), window)


def _rolling(states: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    # preset and final inversion add what zeros of the same length have
    return states[at + window] ^ _moved(states[at], window) ^ np.uint32(crc32c(bytes(window)))


def rolling_crc32c_many(blobs: list[bytes], window: int, step: int = 1, near: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, CRC-32C) of the windows of several strings at multiples of step. near (period, reach): only places at most `reach` from a multiple of `period`.

    The strings' states go on from one to the next, as a window's CRC follows from its own bytes alone.
    """
    lengths = np.array([len(b) for b in blobs], np.int64)
    counts = np.maximum(0, lengths - window + 1)
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    use = np.ones(len(place), bool)
    if step > 1:
        use &= place % step == 0
    if near:
        rest = place % near[0]
        use &= (rest <= near[1]) | (near[0] - rest <= near[1])
    owner, place = np.repeat(np.arange(len(blobs)), counts)[use], place[use]
    at = (np.cumsum(lengths) - lengths)[owner] + place
    if step < window:
        return owner, place, _rolling(_prefix_states(np.frombuffer(b"".join(blobs), np.uint8)), at, window)
    data = b"".join(blobs)  # windows that share no byte are taken as blocks
    return owner, place, crc32c_many([data[i : i + window] for i in at.tolist()])


# ---- BLAKE3 (published specification; fixed values)
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED_HASH, DERIVE_CONTEXT, DERIVE_MATERIAL = 1, 2, 4, 8, 16, 32, 64


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """cv (8, n), block (16, n): the 16 words of output for each column."""
    n = cv.shape[1]
    v = [cv[i].copy() for i in range(8)] + [np.full(n, IV[i], np.uint32) for i in range(4)]
    v += [(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = list(np.ascontiguousarray(block))

    def g(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        v[a] = v[a] + v[b] + x
        v[d] = _rotate(v[d] ^ v[a], 16)
        v[c] = v[c] + v[d]
        v[b] = _rotate(v[b] ^ v[c], 12)
        v[a] = v[a] + v[b] + y
        v[d] = _rotate(v[d] ^ v[a], 8)
        v[c] = v[c] + v[d]
        v[b] = _rotate(v[b] ^ v[c], 7)

    for r in range(7):
        for i in range(4):
            g(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            g(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if r < 6:
            m = [m[p] for p in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ cv[i] for i in range(8)])


def blake3_many(blobs: list[bytes], key: bytes | None = None, mode: int = 0) -> list[bytes]:
    """32-byte BLAKE3 of each string; all chunks of all strings are compressed side by side, then their trees level by level."""
    start = np.frombuffer(key, "<u4") if key else np.array(IV, np.uint32)
    base = KEYED_HASH if key and not mode else mode
    n_chunks = np.array([max(1, -(-len(b) // 1024)) for b in blobs], np.int64)
    total = int(n_chunks.sum())
    if not total:
        return []
    out: list[bytes] = [b""] * len(blobs)
    owner = np.repeat(np.arange(len(blobs)), n_chunks)
    number = np.arange(total) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    sizes = np.minimum(np.array([len(b) for b in blobs])[owner] - number * 1024, 1024)
    data = np.frombuffer(b"".join(b.ljust(int(c) * 1024, b"\0") for b, c in zip(blobs, n_chunks)), "<u4").reshape(total, 16, 16)
    cv = np.repeat(start[:, None], total, axis=1).astype(np.uint32)
    blocks = np.maximum(1, -(-sizes // 64))
    for i in range(int(blocks.max())):
        live = np.flatnonzero(blocks > i)
        last = blocks[live] == i + 1
        flags = base | np.where(i == 0, CHUNK_START, 0) | np.where(last, CHUNK_END, 0) | np.where(last & (n_chunks[owner[live]] == 1), ROOT, 0)
        length = np.where(last, sizes[live] - 64 * i, 64)
        cv[:, live] = _compress(cv[:, live], data[live, i].T, number[live].astype(np.int64), length, flags)[:8]
    left = n_chunks.copy()
    while True:
        one = np.flatnonzero(left == 1)
        single = left[owner] == 1
        for col in np.flatnonzero(single):
            out[owner[col]] = cv[:, col].astype("<u4").tobytes()
        cv, owner = cv[:, ~single], owner[~single]
        left[one] = 0
        if not len(owner):
            return out
        counts = left[left > 1]
        ids = np.flatnonzero(left > 1)
        first = np.cumsum(counts) - counts
        pairs = counts // 2
        a = np.concatenate([f + 2 * np.arange(p) for f, p in zip(first, pairs)])
        of = np.repeat(ids, pairs)
        root = np.repeat(counts == 2, pairs)
        merged = _compress(np.repeat(start[:, None], len(a), axis=1).astype(np.uint32), np.concatenate([cv[:, a], cv[:, a + 1]]), np.zeros(len(a), np.int64), np.full(len(a), 64), base | PARENT | np.where(root, ROOT, 0))[:8]
        odd = np.flatnonzero(counts % 2)
        tail, tail_of = cv[:, first[odd] + counts[odd] - 1], ids[odd]
        cv, owner = np.concatenate([merged, tail], axis=1), np.concatenate([of, tail_of])
        order = np.argsort(owner, kind="stable")  # a tail stands after its string's pairs
        cv, owner = cv[:, order], owner[order]
        left[ids] = (counts + 1) // 2


def blake3(data: bytes, key: bytes | None = None) -> bytes:
    return blake3_many([data], key)[0]


def derive_key(context: str, material: bytes) -> bytes:
    return blake3_many([material], blake3_many([context.encode()], None, DERIVE_CONTEXT)[0], DERIVE_MATERIAL)[0]


def with_digest(df: DataFrame, data_col: str, name: str, kind: str = "crc32c", key: bytes | None = None) -> DataFrame:
    """df with the digest of a binary column: crc32c as long, blake3 as lower-case hex. Null data gives null."""
    cols = [c for c in df.columns if c != name]
    field = "long" if kind == "crc32c" else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(b.schema.get_field_index(data_col)).to_pylist()
            some = [x for x in data if x is not None]
            got = iter(crc32c_many(some).tolist() if kind == "crc32c" else [x.hex() for x in blake3_many(some, key)])
            yield pa.record_batch([*b.columns, pa.array([None if x is None else next(got) for x in data], pa.int64() if kind == "crc32c" else pa.string())], [*b.schema.names, name])

    src = df.select(*cols)
    return src.mapInArrow(run, src.withColumn(name, F.lit(None).cast(field)).schema)
