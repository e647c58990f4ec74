"""Benchmark decontamination: the q-gram lemma on diagonal bands, then banded alignment.

Texts and benchmark items are canonical first: UTF-8 bytes, A-Z in lower case, ASCII white space as single spaces. A document is
contaminated if `window` consecutive bytes of an item (all of an item that is shorter) align with a part of the document at
`rate` edits a byte or fewer. By the q-gram lemma such a part shares at least window - q + 1 - q * edits q-grams with the
item, on diagonals (text position minus item position) at most `edits` apart. So q-gram hits are counted in diagonal bands
twice as wide that overlap by half; a band with enough hits within a window is a candidate, which banded alignment verifies.

The benchmark is a query set: it is taken in blocks of about BLOCK_BYTES, whose items are sent to every task and indexed there once a worker,
and every document meets every block. What a block leaves is written before the next one, so a task holds one index at a time.
Nothing is sampled and no candidate is left out. Short items have blocks of their own, as they need fewer hits.

Nulls: a null text or item counts as empty, and items of fewer than Q bytes, which have
no q-gram, match nothing. Null ids are carried as null.
Repeated rows each give a row; equal items all match. An empty benchmark leaves every document clean. Other columns are ignored.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, parts, table

Q = 8
WINDOW = 64
RATE = 0.1
_READY = 1
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22
_HASH = np.uint64(0x9E3779B97F4A7C15)

MATCHES = "array<struct<item_id:long,start:long,end:long,edits:long>>"


def canonical(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def _grams(data: bytes) -> np.ndarray:
    n = len(data) - Q + 1
    return np.ndarray((max(n, 0),), "<u8", data, strides=(1,)).copy() if n > 0 else np.zeros(0, np.uint64)


def limits(size: int, window: int = WINDOW, rate: float = RATE) -> tuple[int, int, int]:
    """Of an item of `size` bytes: window, edits, shared q-grams at least."""
    w = min(size, window)
    edits = max(0, min(int(w * rate), (w - Q) // Q))
    return w, edits, w - Q + 1 - Q * edits


def banded(patterns: np.ndarray, texts: np.ndarray, edits: int) -> np.ndarray:
    """For each row, the least edits between the whole pattern and any part of the text; edits + 1 if it is more.

    patterns (rows, m), texts (rows, n), n >= m. Cells of the band: the part starts at 0 to n - m and drifts by `edits` at most.
    """
    (rows, m), n = patterns.shape, texts.shape[1]
    width = n - m + 2 * edits + 1
    big, steps = m + n + 1, np.arange(width)
    cols = steps - edits  # column of a cell in row 0; one more in each row
    row = np.broadcast_to(np.where((cols >= 0) & (cols <= n), 0, big), (rows, width)).astype(np.int32)
    edge = np.full((rows, 1), big, np.int32)
    for r in range(1, m + 1):
        col = cols + r
        inside, taken = (col >= 0) & (col <= n), (col >= 1) & (col <= n)
        differ = texts[:, np.clip(col - 1, 0, n - 1)] != patterns[:, r - 1 : r]
        new = np.minimum(np.where(taken, row + differ, big), np.concatenate([row[:, 1:], edge], axis=1) + 1)
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        row = np.where(inside, new, big).astype(np.int32)
    return np.minimum(row.min(axis=1), edits + 1)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW, rate: float = RATE) -> None:
        self.items = [(i, b) for i, b in items if len(b) >= Q]
        self.window, self.limits = window, [limits(len(b), window, rate) for _, b in self.items]
        grams = [_grams(b) for _, b in self.items]
        values = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        values, self.item, self.place = values[order], item[order].astype(np.int64), place[order].astype(np.int64)
        self.values, self.starts, self.counts = np.unique(values, return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.values * _HASH) >> np.uint64(64 - _FILTER_BITS)] = True
        self.least = min((x[2] for x in self.limits), default=1)  # of all items
        self.span = max((x[0] + x[1] for x in self.limits), default=0) - Q  # from the first shared q-gram to the last
        self.wide = max((x[1] for x in self.limits), default=0) + 1

    def candidates(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, text position, item position) of q-gram hits in bands with hits enough, by item, band and position."""
        none = (np.zeros(0, np.int64),) * 3
        v = _grams(data)
        at = np.flatnonzero(self.filter[(v * _HASH) >> np.uint64(64 - _FILTER_BITS)])
        key = np.searchsorted(self.values, v[at])
        real = self.values[np.minimum(key, len(self.values) - 1)] == v[at]
        at, key = at[real], key[real]
        # whatever the item, a window holds `least` hits: fewer within `span` can't do
        at, key = (x[_dense(at, self.least, self.span)] for x in (at, key))
        if not len(at):
            return none
        n = self.counts[key]
        pos = np.repeat(at, n)
        ref = np.repeat(self.starts[key] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item, place = self.item[ref], self.place[ref]
        width = 2 * self.wide
        out = []
        for half in (0, self.wide):  # bands overlap by half
            band = (pos - place + half) // width
            order = np.lexsort((pos, band, item))
            i, b, p = item[order], band[order], pos[order]
            group = np.cumsum(np.r_[0, (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
            # hits of a group lie far from those of the next
            gap = int(p.max()) + self.span + 2
            good = _dense(p + group * gap, self.least, self.span)
            out.append(np.stack([i[good], p[good], place[order][good], group[good] * 2 + (half > 0)]))
        return tuple(np.concatenate(out, axis=1))

    def matches(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(item's number, start, end, edits) of verified parts of data: for each item, parts that overlap as one, with their fewest edits."""
        got = self.candidates(data)
        if not len(got[0]):
            return []
        item, pos, place, group = got
        found: dict[int, list[list[int]]] = {}
        cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > self.span)])
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)]):
            k = int(item[s])
            if e - s >= self.limits[k][2]:
                self._verify(k, data, pos[s:e], place[s:e], found.setdefault(k, []))
        out = []
        for k, spans in found.items():
            spans.sort()
            merged: list[list[int]] = []
            for a, b, d in spans:
                if merged and a <= merged[-1][1]:
                    merged[-1] = [merged[-1][0], max(b, merged[-1][1]), min(d, merged[-1][2])]
                else:
                    merged.append([a, b, d])
            out += [(k, *x) for x in merged]
        return sorted(out)

    def _verify(self, k: int, data: bytes, pos: np.ndarray, place: np.ndarray, spans: list[list[int]]) -> None:
        """Aligns the windows of an item that a run of hits of one band can belong to."""
        item, (window, edits, least) = self.items[k][1], self.limits[k]
        first, last = max(0, int(place.min()) - window + Q), min(int(place.max()), len(item) - window)
        w = np.arange(first, last + 1)
        w = w[_shared(np.unique(place), w, window - Q) >= least]
        if not len(w):
            return
        # windows with few enough substitutions on the run's main diagonal need no alignment, nor do windows that overlap them there
        diagonals, counts = np.unique(pos - place, return_counts=True)
        main = int(diagonals[counts.argmax()])
        lo, hi = max(0, -main), min(len(item), len(data) - main)
        if hi - lo >= window:
            differ = np.r_[0, np.cumsum(np.frombuffer(item[lo:hi], np.uint8) != np.frombuffer(data[lo + main : hi + main], np.uint8))]
            inside = w[(w >= lo) & (w <= hi - window)]
            changed = differ[inside - lo + window] - differ[inside - lo]
            good = inside[changed <= edits]
            if len(good):
                cuts = np.flatnonzero(np.r_[True, np.diff(good) > window])
                for x, y in zip(cuts, np.r_[cuts[1:], len(good)] - 1):
                    spans.append([int(good[x]) + main, int(good[y]) + window + main, int(changed[changed <= edits][x : y + 1].min())])
                near = np.searchsorted(good, w)
                left, right = good[np.maximum(near - 1, 0)], good[np.minimum(near, len(good) - 1)]
                w = w[(np.abs(w - left) >= window) & (np.abs(w - right) >= window)]
        if not len(w):
            return
        # the lemma again with short grams, which far fewer windows pass by chance
        low, high = int((pos - place).min()) - edits, int((pos - place).max()) + edits
        a = max(0, int(w[0]) + low)
        part = _short(data[a : int(w[-1]) + window + high])
        own = _short(item)
        w = w[_shared(np.flatnonzero(np.isin(own, part)), w, window - _SHORT) >= window - _SHORT + 1 - _SHORT * edits]
        n = window + high - low
        for i in range(0, len(w), 512):
            some = w[i : i + 512]
            patterns = np.frombuffer(item, np.uint8)[some[:, None] + np.arange(window)]
            at = some[:, None] + low + np.arange(n)
            text = np.frombuffer(data, np.uint8)
            texts = np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, len(text) - 1)], 0)  # 0 isn't in canonical texts of items
            edited = banded(patterns, texts, edits)
            spans += [[max(0, x + low + edits), min(len(data), x + window + high - edits), int(d)] for x, d in zip(some.tolist(), edited) if d <= edits]


_SHORT = 4


def _short(data: bytes) -> np.ndarray:
    n = len(data) - _SHORT + 1
    return np.ndarray((n,), "<u4", data, strides=(1,)).copy() if n > 0 else np.zeros(0, np.uint32)


def _shared(places: np.ndarray, windows: np.ndarray, span: int) -> np.ndarray:
    """How many of the sorted places lie in [w, w + span] for each w."""
    return np.searchsorted(places, windows + span, "right") - np.searchsorted(places, windows)


def _dense(at: np.ndarray, least: int, span: int) -> np.ndarray:
    """Which of sorted positions lie among `least` of them within `span`."""
    n = len(at)
    if n < least:
        return np.zeros(n, bool)
    start = np.flatnonzero(at[least - 1 :] - at[: n - least + 1] <= span)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + least, -1)
    return np.cumsum(step[:-1]) > 0


def _index(items: list[tuple[int | None, bytes]], window: int, rate: float, name: str) -> Index:
    """The worker process's own, which lasts from task to task; a few are kept."""
    ready = vars(sys).setdefault("_brindle_indexes", {})
    if name not in ready:
        while len(ready) >= _READY:
            del ready[next(iter(ready))]
        ready[name] = Index(items, window, rate)
    return ready[name]


def _scan(items: list[tuple[int | None, bytes]], window: int, rate: float):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, window, rate, name)
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "start", "end", "edits")]))
        for b in parts(batches):
            texts = [canonical(t) for t in b.column(b.num_columns - 1).to_pylist()]
            found: list[list[dict]] = [[] for _ in texts]
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 19):
                    size, to = size + len(texts[to]) + 1, to + 1
                # one look over many texts: a line feed, which canonical texts lack, keeps them apart
                data = b"\n".join(texts[at:to])
                ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
                hit = np.unique(np.searchsorted(ends, index.candidates(data)[1], "right"))
                for i in (hit + at).tolist():
                    found[i] = [{"item_id": index.items[k][0], "start": s, "end": e, "edits": d} for k, s, e, d in index.matches(texts[i])]
                at = to
            # the last columns: matches so far, text
            before = b.column(b.num_columns - 2).to_pylist()
            both = pa.array([(x or []) + y for x, y in zip(before, found)], kind)
            yield pa.record_batch([*b.columns[:-2], both, b.columns[-1]], b.schema.names)

    return run


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in canonical form, in blocks of about block_bytes that the driver holds one at a time."""
    b = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    n = max(1, -(-int(b.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    for k in range(n):
        part = b.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else b
        items = sorted(((r["i"], canonical(r["t"])) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        for some in ([x for x in items if len(x[1]) >= WINDOW], [x for x in items if Q <= len(x[1]) < WINDOW]):
            if some:
                yield some


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, rate: float = RATE, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns (those in keep, if given) and `matches`: for each row the items found in it, with spans in bytes of the canonical text and edits.

    A column of docs that is itself called `matches` is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "matches"]
    out = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.array().cast(MATCHES).alias("matches"), F.col(f"`{text_col}`").cast("string").alias("t"))
    for k, items in enumerate(blocks(benchmark, item_col, item_text_col, block_bytes)):
        out = (cut(out) if k else out).mapInArrow(_scan(items, window, rate), out.schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "matches")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: kept is false where an item was found."""
    out = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", (F.size("matches") == 0).alias("kept"), F.size("matches").cast("long").alias("n_matches"), F.array_sort(F.array_distinct("matches.item_id")).alias("item_ids"))
