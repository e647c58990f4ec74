"""Self-describing packets: header, checksum and body, their scan and their writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.functions.digests import blake3_many, together

#: the header: magic, length, checksum, set id, type, flags (own layout; 48 bytes)
MAGIC = b"BRNDL\x02\r\n"
HEADER = "<8sQ16s4sI8s"
HEADER_BYTES = struct.calcsize(HEADER)
ALIGN = 8
MOST = 1 << 48
SCHEMA = "volume string, offset long, type string, set_id string, flags long, length long, ok boolean, body binary"


def encode(kind: str, set_id: bytes, body: bytes, flags: int = 0, key: bytes | None = None) -> bytes:
    return encode_many(kind, set_id, [body], flags, key)[0]


def encode_many(kind: str, set_id: bytes, bodies: list[bytes], flags: int = 0, key: bytes | None = None) -> list[bytes]:
    """A packet of each body; their checksums are computed side by side."""
    bodies = [b.ljust(-(-len(b) // ALIGN) * ALIGN, b"\0") for b in bodies]
    heads = [struct.pack(HEADER, MAGIC, HEADER_BYTES + len(b), set_id, kind.encode().ljust(4), flags, bytes(8))[:-8] for b in bodies]
    tags = blake3_many([h + b for h, b in zip(heads, bodies)], key)
    return [h + t[:8] + b for h, t, b in zip(heads, tags, bodies)]


def scan(data: bytes, step: int = ALIGN, key: bytes | None = None) -> Iterator[tuple[int, str, str, int, int, bool, bytes]]:
    """(offset, type, set_id, flags, length, ok, body) of what looks like a packet; after a bad one the scan goes on by `step`."""
    yield from scan_many([data], step, key)[0]


def _candidates(data: bytes, at: int, step: int, most: int) -> Iterator[tuple[int, int, bytes, bytes, int, bytes, bool]]:
    """(offset, length, set_id, type, flags, tag, fits) of the next `most` packets, each looked for behind the one before as if that was right."""
    while most and (at := data.find(MAGIC, at)) >= 0:
        if at % step or at + HEADER_BYTES > len(data):
            at += 1
            continue
        _, length, set_id, kind, flags, tag = struct.unpack_from(HEADER, data, at)
        fits = HEADER_BYTES <= length <= MOST and length % ALIGN == 0 and at + length <= len(data)
        yield at, length, set_id, kind, flags, tag, fits
        at += length if fits else step
        most -= 1


def scan_many(volumes: list[bytes], step: int = ALIGN, key: bytes | None = None) -> list[list[tuple[int, str, str, int, int, bool, bytes]]]:
    """scan() of each volume. A round takes the next packets of all volumes, twice as many after a round without a bad one, and computes their checksums side by side."""
    out: list[list] = [[] for _ in volumes]
    live = [(v, 0, 1) for v in range(len(volumes))]
    while live:
        tried = [(v, most, list(_candidates(volumes[v], at, step, most))) for v, at, most in live]
        fitting = [(v, at, length) for v, _, found in tried for at, length, *_, fits in found if fits]
        tags = iter(blake3_many([volumes[v][at : at + HEADER_BYTES - 8] + volumes[v][at + HEADER_BYTES : at + length] for v, at, length in fitting], key))
        live = []
        for v, most, found in tried:
            after, right = 0, True
            for at, length, set_id, kind, flags, tag, fits in found:
                ok = fits and next(tags)[:8] == tag
                if not right:  # begins behind a packet that was none
                    continue
                body = volumes[v][at + HEADER_BYTES : at + length] if fits else b""
                out[v].append((at, kind.decode("ascii", "replace").strip(), set_id.hex(), flags, length, ok, body))
                after, right = at + (length if ok else step), ok or not fits
            if found:
                live.append((v, after, 2 * most if right else 1))
    return out


def read(volumes: DataFrame, step: int = ALIGN, key: bytes | None = None) -> DataFrame:
    """Packets of volumes (volume, content), with ok telling whether the checksum holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for b in batches:
            names, blobs = b.column(0).to_pylist(), [x or b"" for x in b.column(1).to_pylist()]
            for lo, hi in together(blobs):
                rows = [(name, *p) for name, found in zip(names[lo:hi], scan_many(blobs[lo:hi], step, key)) for p in found]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["volume", "offset", "type", "set_id", "flags", "length", "ok", "body"])

    return volumes.select("volume", "content").mapInArrow(run, SCHEMA)
