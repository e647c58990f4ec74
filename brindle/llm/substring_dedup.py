"""Substring dedup: prefix-partitioned suffix trees over words.

A suffix starts at each word. A counting pass picks variable-length prefixes: a suffix belongs to the shortest of its prefixes
(LEVELS words) whose bucket is small enough, and buckets are put together to groups that fit into memory. Only suffixes of at
least `window` words matter, so each group's tree is cut at that depth: its deep internal nodes are the runs of equal suffixes
among the group's suffixes sorted by the fingerprint of their first `window` words. A node's smallest doc_id decides which
suffixes repeat an earlier document. Words are never compared across groups: equal windows have equal prefixes.

Documents are packed to compressed batches written to the shared folder. Each batch sends a node at most once, with its own
smallest doc_id (so a passage in a third of all documents costs one entry a batch), and gets back only nodes that another
batch has from a smaller document. A window fingerprint has 64 bits over 64-bit word hashes and meets only those of its group: of n windows in
groups of g, n * g / 2^65 are expected to meet a false equal, which is below one over 100 TB, as g doesn't grow with the input.

Nulls: a null text has no words. A null id counts as larger than any other; rows with equal ids don't repeat one another.
Repeated rows each give a row. Texts of any length are handled whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, table

#: Prefix lengths in words that a suffix's group may be told by.
LEVELS = (1, 2, 3, 5, 8)
#: At most so many entries of each level's bucket table are held by the driver and sent to tasks (1 byte to 4 bytes each).
MAX_BUCKETS = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _pack(batch_bytes: int):
    """Documents to rows (batch, n_words, data): data holds ids and texts, in order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, zip_, made = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=6), 0
        held, size = [], 0

        def row() -> pa.RecordBatch:
            nonlocal held, size, made
            part = pa.Table.from_batches(held)
            part = part.take(pc.sort_indices(part, sort_keys=[("doc_id", "ascending")])).combine_chunks()  # nulls last
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as w:
                w.write_table(part)
            codes, bounds = word_codes(part.column("text"), hashes=False)
            made, out = made + 1, pa.record_batch([pa.array([(task << 32) + made]), pa.array([int(bounds[-1])]), pa.array([zip_.compress(sink.getvalue())], pa.binary())], ["batch", "n_words", "data"])
            held, size = [], 0
            return out

        for b in batches:
            b = pa.record_batch([b.column(0).cast(pa.int64()), pc.fill_null(b.column(1).cast(pa.large_string()), "")], ["doc_id", "text"])
            ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros(0)
            at = 0
            while at < b.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + batch_bytes - size, "right")))
                part = b.slice(at, to - at)
                # a copy of its own, so that the rest of the input batch isn't kept
                held.append(pa.record_batch([pa.concat_arrays([part.column(0)]), part.column(1).take(pa.array(np.arange(part.num_rows)))], b.schema))
                size += int(ends[to - 1] - done)
                at = to
                if size >= batch_bytes:
                    yield row()
        if held:
            yield row()

    return run


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, pa.ChunkedArray]:
    """ids (0 where null), which are null, and texts."""
    t = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()
    return pc.fill_null(t.column(0), 0).to_numpy(), pc.is_null(t.column(0)).to_numpy(), t.column(1)


def word_codes(texts: pa.ChunkedArray, hashes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words end, from 0 on."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    parts = pc.ascii_split_whitespace(texts)
    words, offsets = parts.values, parts.offsets.to_numpy()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    bounds = np.r_[0, np.cumsum(full)][offsets]
    if not hashes:
        return np.zeros(0, np.uint64), bounds
    coded = words.filter(pa.array(full)).dictionary_encode()
    hashed = xxhash.xxh64_intdigest
    of = np.array([hashed(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    return of[coded.indices.to_numpy()] if len(of) else np.zeros(0, np.uint64), bounds


def _suffixes(codes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of all suffixes of `window` words or more: position, document's number, fingerprint, prefix fingerprints by level."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), [np.zeros(0, np.uint64) for x in LEVELS if x < window]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    h, prefixes, power = np.zeros(n, np.uint64), [], 1
    for k in range(window):
        h += codes[k : n + k] * np.uint64(power)
        power = power * _BASE % (1 << 64)
        if k + 1 in LEVELS and k + 1 < window:
            prefixes.append(_mix(h[at]))
    return at, doc[at], _mix(h[at]), prefixes


def _count(window: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in batches:
            for data in b.column(0):
                *_, prefixes = _suffixes(*word_codes(_unpack(data.as_py())[2]), window)
                new = [np.bincount((p >> np.uint64(shift)).astype(np.int64), minlength=1 << (64 - shift)) for p in prefixes]
                counts = new if counts is None else [x + y for x, y in zip(counts, new)]
        for level, c in enumerate(counts or []):
            (bucket,) = np.nonzero(c)
            yield pa.record_batch([pa.array(np.full(len(bucket), level)), pa.array(bucket), pa.array(c[bucket])], ["level", "bucket", "n"])

    return run


def prefix_groups(counts: pd.DataFrame, n_levels: int, n_buckets: int, total: int, limit: int) -> tuple[np.ndarray, int]:
    """Group of each (level, bucket), -1 where the bucket is too large and a longer prefix must tell; the number of groups told so."""
    by = np.zeros((n_levels, n_buckets), np.int64)
    by[counts["level"], counts["bucket"]] = counts["n"]
    groups, share, made = np.full((n_levels, n_buckets), -1, np.int32), 1.0, 0
    for level in range(n_levels):
        small = by[level] <= limit
        groups[level, small] = made + (np.cumsum(by[level][small] * share) // limit).astype(np.int32)
        made = int(groups[level].max(initial=made - 1)) + 1
        share = float(by[level][~small].sum() / max(1, total))
    return groups, max(1, made)


def _group_of(prefixes: list[np.ndarray], h: np.ndarray, groups: np.ndarray, n_groups: int, shift: int, split: int) -> np.ndarray:
    g = np.full(len(h), -1, np.int32)
    for level, p in enumerate(prefixes):
        left = np.flatnonzero(g < 0)
        g[left] = groups[level][(p[left] >> np.uint64(shift)).astype(np.int64)]
    left = np.flatnonzero(g < 0)  # told by the whole window
    g[left] = (h[left] % np.uint64(n_groups)).astype(np.int32)
    # a group that is too large for memory, as the table of prefixes is bounded, is split by the longest prefix: the whole window
    return g.astype(np.int64) * split + ((h >> np.uint64(20)) % np.uint64(split)).astype(np.int64)


class _Nodes:
    """What a batch knows: its suffixes' nodes, sorted by (group, fingerprint), and each node's smallest document."""

    def __init__(self, data: bytes, window: int, groups: np.ndarray, n_groups: int, shift: int, split: int) -> None:
        self.ids, self.no_id, self.texts = _unpack(data)
        codes, self.bounds = word_codes(self.texts)
        self.at, self.doc, h, prefixes = _suffixes(codes, self.bounds, window)
        g = _group_of(prefixes, h, groups, n_groups, shift, split)
        order = np.lexsort((h, g)) if len(h) else np.zeros(0, np.int64)  # stable: documents stay in order of ids
        hs, gs = h[order], g[order]
        first = np.ones(len(hs), bool)
        first[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
        self.node = np.empty(len(h), np.int64)  # of each suffix
        self.node[order] = np.cumsum(first) - 1
        self.h, self.group = hs[first], gs[first]
        self.least, self.no_least = (x[self.doc[order][first]] for x in (self.ids, self.no_id))


def _send(window: int, groups: np.ndarray, n_groups: int, shift: int, split: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for batch, data in zip(b.column(0).to_pylist(), b.column(1)):
                x = _Nodes(data.as_py(), window, groups, n_groups, shift, split)
                starts = np.flatnonzero(np.r_[True, x.group[1:] != x.group[:-1]]) if len(x.group) else np.zeros(0, int)
                out = []
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(x.group)]):
                    least, none = x.least[s:e], x.no_least[s:e]
                    low = int(least[~none].min()) if not none.all() else 0
                    gap = np.where(none, 0, least.view(np.uint64) - np.int64(low).view(np.uint64))  # no gap is too large for 64 bits
                    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if int(gap.max()) <= np.iinfo(k).max)
                    # sorted, so steps are short: by byte planes they compress
                    steps = np.diff(x.h[s:e], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
                    out.append((int(x.group[s]), batch, s, low, zip_.compress(steps.T.tobytes()), gap.astype(kind).tobytes(), np.packbits(none).tobytes() if none.any() else b""))
                cols = list(zip(*out)) if out else [[]] * 7
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["grp", "batch", "first", "low", "h", "gap", "none"])

    return run


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one group: for each batch, its nodes that another batch has from a smaller document, and that document."""
    unzip = zstandard.ZstdDecompressor()
    hs = [np.cumsum(np.ascontiguousarray(np.frombuffer(unzip.decompress(x), np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64) for x in rows["h"]]
    sizes = np.array([len(x) for x in hs])
    least, none = [], []
    for x, bits, n, low in zip(rows["gap"], rows["none"], sizes, rows["low"]):
        gap = np.frombuffer(x, f"<u{len(x) // n}").astype(np.uint64)
        least.append((gap + np.int64(low).view(np.uint64)).view(np.int64))
        none.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) if bits else np.zeros(n, bool))
    h, none = np.concatenate(hs), np.concatenate(none)
    ids, least = np.unique(np.concatenate(least), return_inverse=True)  # as ranks, so that a null id can be beyond the largest
    least = np.where(none, len(ids), least)
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    best = np.empty(len(h), np.int64)
    best[order] = np.repeat(np.minimum.reduceat(least[order], starts), np.diff(np.r_[starts, len(h)]))
    out, at = [], 0
    for n, batch, first in zip(sizes.tolist(), rows["batch"], rows["first"]):
        late = np.flatnonzero(best[at : at + n] < least[at : at + n])
        if len(late):
            out.append((batch, (first + late).astype(np.int64).tobytes(), ids[best[at : at + n][late]].tobytes()))
        at += n
    return pd.DataFrame(out, columns=["batch", "nodes", "least"])


def _apply(window: int, groups: np.ndarray, n_groups: int, shift: int, split: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, told in zip(b.column(0), b.column(1).to_pylist()):
                x = _Nodes(data.as_py(), window, groups, n_groups, shift, split)
                least, none = x.least.copy(), x.no_least.copy()
                for t in told or []:
                    nodes = np.frombuffer(t["nodes"], np.int64)
                    least[nodes], none[nodes] = np.frombuffer(t["least"], np.int64), False
                late = x.at[~none[x.node] & (x.no_id[x.doc] | (x.ids[x.doc] > least[x.node]))]
                step = np.zeros(int(x.bounds[-1]) + 1, np.int32)
                np.add.at(step, late, 1)
                np.add.at(step, late + window, -1)  # a window ends within its document
                gone = np.cumsum(step[:-1]) > 0
                kept, spans, n_gone = [], [], []
                for text, s, e in zip(x.texts.to_pylist(), x.bounds[:-1].tolist(), x.bounds[1:].tolist()):
                    words, mask = text.encode().split(), gone[s:e]
                    n_gone.append(int(mask.sum()))
                    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
                    spans.append([{"first": int(i), "end": int(j)} for i, j in edge.reshape(-1, 2)])
                    kept.append(b" ".join([w for w, m in zip(words, mask.tolist()) if not m] if n_gone[-1] else words).decode())
                ids = pa.array(x.ids, mask=x.no_id)
                for i in range(0, len(kept), 512):
                    j = slice(i, i + 512)
                    yield pa.record_batch([ids[j], pa.array(np.diff(x.bounds)[j]), pa.array(n_gone[j], pa.int64()), pa.array(spans[j], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept[j], pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, group_suffixes: int = 1_500_000, batch_bytes: int = 4 << 20) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, removed, kept_text): every word gone that lies in a `window`-word sequence which also starts in a document with a smaller id.

    removed lists the ranges of gone words; kept_text joins the other words by one space. group_suffixes bounds a group (and so a
    task's memory), batch_bytes the text of one batch.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = cut(src.mapInArrow(_pack(batch_bytes), "batch long, n_words long, data binary"))
    total = packed.agg(F.sum("n_words")).first()[0] or 0
    limit = max(group_suffixes, -(-16 * total // MAX_BUCKETS))
    bits = max(10, min(MAX_BUCKETS.bit_length() - 1, (16 * total // limit).bit_length()))
    shift, n_levels = 64 - bits, sum(x < window for x in LEVELS)
    counts = packed.select("data").mapInArrow(_count(window, shift), "level long, bucket long, n long").groupBy("level", "bucket").agg(F.sum("n").alias("n")).toPandas()  # n_levels * 2^bits rows at most
    groups, n_groups = prefix_groups(counts, n_levels, 1 << bits, total, limit)
    how = (window, groups, n_groups, shift, -(-limit // group_suffixes))
    sent = packed.select("batch", "data").mapInArrow(_send(*how), "grp long, batch long, first long, low long, h binary, gap binary, none binary")
    told = sent.groupBy("grp").applyInPandas(_solve, "batch long, nodes binary, least binary")
    told = told.groupBy("batch").agg(F.collect_list(F.struct("nodes", "least")).alias("told"))  # a batch's own nodes at most
    both = packed.join(told, "batch", "left").select("data", "told")
    return both.mapInArrow(_apply(*how), "doc_id long, n_words long, n_removed long, removed array<struct<first:long,end:long>>, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS h, md5(array_to_string(w[i:i + 12], ' ')) AS m FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
least AS (SELECT h, m, min(doc_id) AS first_doc FROM win GROUP BY h, m),
late AS (SELECT win.doc_id, win.i FROM win JOIN least USING (h, m) WHERE win.doc_id > first_doc),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late, unnest(range(0, 13)) AS t(k)),
gl AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN gl ON d.doc_id IS NOT DISTINCT FROM gl.doc_id
"""
