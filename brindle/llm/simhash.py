"""SimHash near-dedup: fingerprints joined with themselves through a binary trie.

Fingerprint: majority vote of the XXH64 values of all word shingles. Two fingerprints within the budget of differing bits
agree on at least one of `budget + 1` blocks of bits, so the trie is rooted once at each block: a root group holds the
distinct fingerprints with equal block bits. In a group, pairs of trie nodes are walked together; differing bits add up and
a pair of nodes beyond the budget is dropped. Groups emit a spanning forest of their links, never all pairs; a group
beyond HOT fingerprints is first dealt out by pairs of sub-nodes on bits outside its block.

Near copies by the similarity of their shingles are in near_copies, which uses the same trie.

Nulls: a null text counts as an empty one, whose fingerprint is zero. A null id links like any other, and a component's id is
its smallest id that isn't null (null if there is none). Repeated rows each give a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, spread_join, table

SEED = 42
#: Fingerprints in one root group before it is dealt out by sub-node pairs.
HOT = 50_000
SUB_BITS = 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashed = xxhash.xxh64_intdigest
    values = np.array([hashed(g, SEED) for g in grams], np.uint64)
    return int(np.packbits(2 * _ones(values[:, None]) > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str | None, int] = {}
            out = []
            for t in b.column(1).to_pylist():
                if t not in seen:
                    seen[t] = fingerprint(t, shingle)
                out.append(seen[t])
            yield pa.record_batch([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Labels of the fingerprints of one group; join() keeps only links that connect two trees, chosen at random if `rng` is given."""

    def __init__(self, n: int, rng: np.random.Generator | None = None) -> None:
        self.label, self.links, self.rng = np.arange(n), [], rng

    def one_tree(self, a: slice, b: slice) -> bool:
        x = self.label[a.start]
        return bool((self.label[a] == x).all() and (self.label[b] == x).all())

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        if self.rng is not None and len(i) > 1:
            order = self.rng.permutation(len(i))
            i, j = i[order], j[order]
        while len(i):
            differ = self.label[i] != self.label[j]
            i, j = i[differ], j[differ]
            if not len(i):
                return
            x, y = self.label[i[0]], self.label[j[0]]
            self.links.append((i[0], j[0]))
            self.label[self.label == max(x, y)] = min(x, y)


def trie_links(fps: np.ndarray, budget: int, top: int = 63, leaf: int = 4096, near=None, forest: _Forest | None = None) -> list[tuple[int, int]]:
    """Index pairs that connect what lies within `budget` bits among sorted unsigned fingerprints whose highest bit is `top`.

    Pairs of nodes with at most `leaf` pairs are compared at once. near(i, j), if given, tells which pairs are links.
    `forest`, if given, is grown.
    """
    forest = forest or _Forest(len(fps))
    todo = [(slice(0, len(fps)), slice(0, len(fps)), top, 0)]
    while todo:
        a, b, bit, differ = todo.pop()
        n, m = a.stop - a.start, b.stop - b.start
        if n <= 0 or m <= 0 or (a == b and n == 1) or (n * m > 64 and forest.one_tree(a, b)):
            continue
        if n * m <= leaf or bit < 0:
            for at in range(a.start, a.stop, 1024):
                rows = fps[at : min(at + 1024, a.stop)]
                i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ fps[b][None, :]) <= budget)
                i, j = i + at, j + b.start
                if a == b:
                    i, j = i[i < j], j[i < j]
                apart = forest.label[i] != forest.label[j]
                i, j = i[apart], j[apart]
                if near and len(i):
                    linked = near(i, j)
                    i, j = i[linked], j[linked]
                forest.join(i, j)
            continue
        mask = np.uint64(1) << np.uint64(bit)

        def halves(s: slice) -> tuple[slice, slice]:
            # all members agree on the higher bits, so those with this bit set are the upper end
            mid = s.start + int(np.searchsorted((fps[s] & mask) != 0, True))
            return slice(s.start, mid), slice(mid, s.stop)

        a0, a1 = halves(a)
        b0, b1 = (a0, a1) if a == b else halves(b)
        todo += [(a0, b0, bit - 1, differ), (a1, b1, bit - 1, differ)]
        if differ < budget:
            todo.append((a0, b1, bit - 1, differ + 1))
            if a != b:
                todo.append((a1, b0, bit - 1, differ + 1))
    return forest.links


def _ones(values: np.ndarray) -> np.ndarray:
    """How many of the rows of (n, words) unsigned longs have each bit set."""
    n, words = values.shape
    ones = np.zeros(words * 64, np.int64)
    for at in range(0, n, 255 * 64):
        bits = np.unpackbits(values[at : at + 255 * 64].astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # 255 ones fit into a byte
            ones += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return ones


def _links_of_groups(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(keys)]
            a, b = [], []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                group = np.unique(fps[s:e].view(np.uint64))
                for i, j in trie_links(group, budget):
                    a.append(group[i])
                    b.append(group[j])
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            return pa.record_batch(signed, ["a", "b"])

        keep_k, keep_f = [], []
        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))  # where the group begins that may go on
            if last:
                yield links(np.concatenate([*keep_k, k[:last]]), np.concatenate([*keep_f, f[:last]]))
                keep_k, keep_f = [], []
            elif keep_k and keep_k[-1][-1] != k[0]:
                yield links(np.concatenate(keep_k), np.concatenate(keep_f))
                keep_k, keep_f = [], []
            keep_k.append(k[last:])
            keep_f.append(f[last:])
        if keep_k:
            yield links(np.concatenate(keep_k), np.concatenate(keep_f))

    return run


def links(distinct: DataFrame, budget: int = 2, hot: int = HOT) -> DataFrame:
    """Rows (a, b): links that connect all fingerprints of column fp (distinct) within `budget` bits of one another."""
    blocks, at = [], 0
    for i in range(budget + 1):
        width = 64 // (budget + 1) + (i < 64 % (budget + 1))
        blocks.append((at, width))
        at += width

    def bits(lo: int, width: int):
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1))

    roots = F.array(*[F.struct(F.lit(i).alias("block"), bits(*b).alias("value"), bits(blocks[(i + 1) % len(blocks)][0], SUB_BITS).alias("sub")) for i, b in enumerate(blocks)])
    rows = distinct.select("fp", F.explode(roots).alias("r")).select("fp", "r.block", "r.value", "r.sub")
    crowded = rows.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("block", "value", F.lit(True).alias("crowded"))
    masks = [m for m in range(1 << SUB_BITS) if m.bit_count() <= budget]
    pairs = F.when(F.col("crowded"), F.array(*[F.least("sub", F.col("sub").bitwiseXOR(F.lit(m).cast("long"))) * 65536 + F.greatest("sub", F.col("sub").bitwiseXOR(F.lit(m).cast("long"))) for m in masks])).otherwise(F.array(F.lit(-1).cast("long")))
    keyed = rows.join(crowded, ["block", "value"], "left").select(F.explode(pairs).alias("pair"), "fp", "block", "value")
    keyed = keyed.select(F.xxhash64("block", "value", "pair").alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links_of_groups(budget), "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b): large-star and small-star rounds until nothing changes."""

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first())

    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = summary(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        large = spread_join(both.filter("b > a"), least, "a", ["b"], was[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large)
        # small star: a > b in every row; u and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = spread_join(large, low, "a", ["b"], was[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(moved.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = summary(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id, n_links): one for each row of docs. n_links counts the fingerprint's direct tree links."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = cut(links(classes.select("fp"), budget, hot))
    comp = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    rooted = classes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_root"))
    n_classes = classes.count()
    named = spread_join(rooted, least.withColumnRenamed("n_root", "n_of"), "root", ["fp"], n_classes, "n_of")
    named = cut(named.join(degree, F.col("fp") == F.col("node"), "left").select("fp", "n", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    out = spread_join(fps, named, "fp", ["doc_id"], n_classes and fps.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
