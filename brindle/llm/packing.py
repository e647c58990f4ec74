"""Packing by minimum bin slack.

Documents become token ids plus an end id and are cut every `window` ids; only what is left of a document at its end is
shorter. The lengths of these rests, as a histogram of at most window - 1 counts, are packed on the driver: a sequence opens
with the longest rest, a bitset subset-sum over all remaining counts finds the fill closest to the window, and backtracking
through the bitsets gives the multiset. The pattern is used as often as the counts allow, so the number of patterns depends
on the window and not on the number of documents. Executors then map (length, rank within that length) to a sequence and an
offset through the table of patterns; ranks are running counts over hash buckets, so a frequent length never meets in one task.

Tokens: words between single spaces are encoded once and kept, which gives the same ids as encoding whole texts, since the
vocabulary's pattern always splits before a single space between two other characters; anything else stays in one piece.

Nulls: a null text counts as empty, so it gives one piece, the end id. A null id is carried as null. Repeated rows each
give pieces. Texts of any length are encoded whole. Other columns are ignored. No documents: no rows.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import buckets_for, cut, running, table

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_ID = 1
WINDOW = 2048
#: Bytes that a worker's words and their ids may take; beyond, it starts afresh with the next batch.
KEPT_BYTES = 96 << 20
_ENTRY_BYTES = 200


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Places(dict):
    """Place of each word's ids; a word that is new gets the next one, a word that can't stand alone ODD."""

    ODD = -1

    def __init__(self, encoder: Encoder, before: str) -> None:
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> int:
        odd = not word or word[-1].isspace() or (self.before and word[0].isspace())
        place = self.ODD if odd else self.encoder.later(self.before + word)
        self[word] = place
        return place


class _Grown:
    """An array that grows by doubling, so that adding to it copies each entry a few times at most."""

    def __init__(self, kind, first: list[int]) -> None:
        self.array, self.n = np.array(first, kind), len(first)

    def extend(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.array):
            grown = np.empty(max(need, 2 * len(self.array)), self.array.dtype)
            grown[: self.n] = self.array[: self.n]
            self.array = grown
        self.array[self.n : need] = more
        self.n = need


class Encoder:
    """ids of texts, word by word. A byte-level vocabulary whose pattern takes a space with the word after it is needed.

    fast_path names the same vocabulary as ranks, which is quicker for words of Latin letters and ASCII; others, and all words
    if there is none, are left to the tokenizer itself.
    """

    def __init__(self, path: str, fast_path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        if fast_path:
            import public_tokenizers
            import tiktoken

            with open(fast_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._reset()

    def _reset(self) -> None:
        # entry 0 is the end id
        self.at, self.first, self.parts = _Places(self, " "), _Places(self, ""), {}
        self.flat, self.starts, self.lengths, self.pending = _Grown(np.uint32, [END_ID]), _Grown(np.int64, [0]), _Grown(np.int64, [1]), []
        self.kept = 0

    def later(self, text: str) -> int:
        self.pending.append(text)
        self.kept += _ENTRY_BYTES + 4 * len(text)
        return self.lengths.n + len(self.pending) - 1

    def _learn(self) -> None:
        if not self.pending:
            return
        ids: list = [None] * len(self.pending)
        slow = range(len(ids))
        if self.fast:
            quick = self.fast.encode_ordinary
            slow = []
            for i, text in enumerate(self.pending):
                if _LATIN(text) and "<|" not in text:
                    ids[i] = quick(text)
                else:
                    slow.append(i)
        for i, e in zip(slow, self.tokenizer.encode_batch_fast([self.pending[i] for i in slow], add_special_tokens=False)):
            ids[i] = e.ids
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        self.starts.extend(self.flat.n + np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)
        self.flat.extend(flat)
        self.pending, self.kept = [], self.kept + flat.nbytes

    def _whole(self, text: str) -> list[int]:
        """Places of a text with runs of white space or some beside a space: cut only at single spaces between other characters."""
        out, cur = [], None
        for w in [*text.split(" "), None]:
            if cur is None:
                cur = w
            elif w is not None and not (w and cur and not w[0].isspace() and not cur[-1].isspace()):
                cur += " " + w
            else:
                part = " " + cur if out else cur
                if part and part not in self.parts:
                    self.parts[part] = self.later(part)
                out.append(self.parts[part] if part else None)
                cur = w
        return [x for x in out if x is not None]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and where each text's ids end, from 0 on."""
        if self.kept > KEPT_BYTES:
            self._reset()
        place, place_first, all_places = self.at.__getitem__, self.first.__getitem__, []
        for t in texts:
            words = t.split(" ")
            got = list(map(place, words[1:]))
            first = place_first(words[0]) if t else 0
            if first < 0 or (got and min(got) < 0):
                all_places.append([*self._whole(t), 0])
            else:
                all_places.append([first, *got, 0] if t else [0])
        self._learn()
        ends = np.cumsum([len(x) for x in all_places])
        p = np.fromiter(chain.from_iterable(all_places), np.int64, int(ends[-1]) if len(ends) else 0)
        lengths = self.lengths.array[p]
        stop = np.cumsum(lengths)
        flat = self.flat.array[np.repeat(self.starts.array[p] - (stop - lengths), lengths) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return flat, np.r_[0, stop[ends - 1]] if len(ends) else np.zeros(1, np.int64)


_LATIN = re.compile("[ -~\u00c0-\u024f]+").fullmatch


def _encoder(path: str, fast_path: str | None) -> Encoder:
    """The worker process's own, which lasts from task to task."""
    kept = vars(sys).setdefault("_brindle_encoders", {})
    if (path, fast_path) not in kept:
        kept[path, fast_path] = Encoder(path, fast_path)
    return kept[path, fast_path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids, with the end id, cut every `window` ids."""
    fast_path = None if path else tokenizer_path(RANKS)  # the same vocabulary
    path = path or tokenizer_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, fast_path)
        for b in batches:
            all_ids, texts = b.column(0), ["" if t is None else t for t in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 22):
                    size, to = size + len(texts[to]), to + 1
                flat, bounds = encoder.encode(texts[at:to])
                flat = flat.astype("<u4")
                n = np.diff(bounds)
                k = -(-n // window)
                doc = np.repeat(np.arange(len(n)), k)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * window
                length = np.minimum(window, n[doc] - start)
                begin = bounds[:-1][doc] + start
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(begin.tolist(), (begin + length).tolist())]
                cols = [all_ids.slice(at, to - at).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])]
                if with_ids:
                    cols.append(pa.array([flat[s:e].astype(np.int32) for s, e in zip(begin.tolist(), (begin + length).tolist())], pa.list_(pa.int32())))
                yield pa.record_batch(cols, names)
                at = to

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is the largest up to room."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        layers.append((length, reach))
        while left > 0:
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    rest, out = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        while not before >> rest & 1:
            rest -= length
            out[length] = out.get(length, 0) + 1
    return out


def patterns(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, times) in the order of use, until counts are used up."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        seed = max(left)
        take = Counter({seed: 1})
        left[seed] -= 1
        if window > seed:
            take.update(fill({k: v for k, v in left.items() if v}, window - seed))
        left[seed] += 1
        times = min(left[k] // m for k, m in take.items())
        for k, m in take.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        out.append((dict(take), times))
    return out


def placements(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, first_sequence, each, at): ranks of a length, `each` of them to a sequence, from offset `at` on."""
    used, rows, sequence = Counter(), [], 0
    for take, times in patterns(counts, window):
        at = 0
        for length, each in sorted(take.items(), reverse=True):
            rows.append((length, used[length], used[length] + each * times, sequence, each, at))
            used[length] += each * times
            at += each * length
        sequence += times
    return rows


def pack(cut_up: DataFrame, window: int = WINDOW) -> DataFrame:
    """cut_up (from pieces(), written once) with (sequence_id, offset)."""
    spark = cut_up.sparkSession
    counts = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}  # `window` rows at most
    rows = placements(counts, window)
    table_ = spark.createDataFrame(rows, "p_length long, from_rank long, to_rank long, first_sequence long, each long, at long")
    ranked = running(cut_up, "rank", F.lit(1), ["length"], ["doc_id", "start"], buckets_for(sum(counts.values())))
    side = F.broadcast(table_) if len(rows) <= 200_000 else table_  # 48 bytes a row
    joined = ranked.join(side, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    nth = F.col("rank") - F.col("from_rank")
    return joined.select(*cut_up.columns, (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    return pack(cut(pieces(docs, id_col, text_col, path, window, with_ids)), window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
