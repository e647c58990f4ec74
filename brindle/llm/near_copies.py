"""Near copies by word shingles: SimHash bands, a trie self-join within each, and a check of every candidate's shingle sets.

The similarity of two documents is the Jaccard similarity of their sets of five-word shingles (all words, where there are fewer);
0.8 or more is a link, and groups are what links connect. Texts with equal sets are one class, which a document of it stands for.

A class has a fingerprint of as many bits as its bands need. Texts at the similarity of a link differ in a share p of the bits,
15 % at 0.8. A band is `bits` bits, about GROUP classes having the same ones, so `bits` is log2(classes / GROUP); there are as many
bands as it takes for a pair at p to agree on one but for a chance of MISS. Both grow with the logarithm of the input, so the rows that a
class sends grow as a power of 0.24 of it, and the pairs compared in proportion to it. Classes equal in a band are joined by walking pairs of trie nodes
of the fingerprints' first word, node pairs beyond the error budget being dropped, and what is left is compared in SKETCH_WORDS words.
Budgets lie three standard deviations beyond p.

In a group, the closest candidates are linked first, to a spanning forest of them; pairs with many candidates don't leave the task. The
forests' components hold every candidate pair (of a group of more than HOT rows, all are put into one component, and its parts are
joined on their own). The forests' links are then verified, and what they connect has one root. A component of several roots is
settled as a whole: its members come together with their shingle sets, and candidates of different roots are verified, the closest
first, until what is left is known not to be a link. A component of more than CELL members is cut into parts that hold one root each,
or many small ones, and pairs of parts come together, unless both have the same root. So a group of near copies of any size is dealt
out, and no candidate is left out. What remains quadratic is a component of many texts that aren't near copies of one another.

Nulls: a null text counts as an empty one; empty texts are copies of one another. A null id is larger than any other. Rows are told by
their number in a written table, so that rows equal in any columns are different documents, one of which stays. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import BROADCAST_ROWS, cut, parts
from brindle.llm.simhash import SEED, _Forest, _ones, components, trie_links

#: Jaccard similarity of a link, in 1/10000.
SIMILARITY = 8000
SHINGLE = 5
#: Classes that share a band on average, and the chance that a pair at SIMILARITY shares none.
GROUP = 256
MISS = 0.005
SKETCH_WORDS = 3
#: 64-bit words of a fingerprint at most; bands that need more bits take each bit again, in other company.
WORDS = 8
#: Rows of a band group that one task takes at once, and members of a component, which bring their shingles with them.
HOT = 50_000
CELL = 4_000
#: Shares of the budget in which candidates are looked for, one after the other.
SHELLS = (0.5, 0.75, 1.0)
#: Keys that a worker counts before it sends their counts.
COUNTED = 1 << 21


@dataclass(frozen=True)
class Bands:
    """bits of a band, bands, words of a fingerprint, bits that may differ in its first word and in its first SKETCH_WORDS words."""

    bits: int
    bands: int
    words: int
    first: int
    differ: int


def bands_for(classes: int, similarity: int = SIMILARITY, group: int = GROUP, miss: float = MISS) -> Bands:
    j = similarity / 10_000
    p = math.acos(2 * j / (1 + j)) / math.pi
    bits = max(8, math.ceil(math.log2(max(1, classes) / group)))
    bands = math.ceil(math.log(miss) / math.log1p(-((1 - p) ** bits)))

    def budget(n: int, deviations: float) -> int:
        return min(n, math.floor(n * p + deviations * math.sqrt(n * p * (1 - p))))

    return Bands(bits, bands, min(WORDS, max(SKETCH_WORDS, -(-bits * bands // 64))), budget(64, 3.7), budget(64 * SKETCH_WORDS, 3.1))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles (of all its words, where there are fewer), in order."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(got)] if len(got) < shingle else map(b" ".join, zip(*(got[i:] for i in range(shingle))))
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(g, SEED) for g in grams], np.uint64))


def wide_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """words * 8 bytes: the majority of `words` mixes of each hash; zeros where there is none."""
    h = hashes[:, None]
    ones = np.zeros(words * 64, np.int64)
    for at in range(0, len(h), 1 << 15):
        x = h[at : at + (1 << 15)] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += _ones(x ^ (x >> np.uint64(31)))
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def _fingerprints(words: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str | None, tuple[bytes, bytes]] = {}
            out = []
            for t in b.column(2).to_pylist():
                if t not in seen:
                    h = shingle_hashes(t, shingle)
                    seen[t] = (xxhash.xxh3_128_digest(h.astype("<u8").tobytes()), wide_fingerprint(h, words))
                out.append(seen[t])
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["row", "doc_id", "set_key", "wide"])

    return run


def _places(how: Bands) -> np.ndarray:
    """(band, bit): the fingerprint's bits that make up each band, dealt from one shuffled pack after the other."""
    rng, n = np.random.default_rng(SEED), how.words * 64
    packs = [rng.permutation(n) for _ in range(-(-how.bands * how.bits // n))]
    return np.concatenate(packs)[: how.bands * how.bits].reshape(how.bands, how.bits)


def _keys(wide: list[bytes], how: Bands) -> Iterator[np.ndarray]:
    """For each band, the classes' keys: the band's number, then its bits."""
    rows = np.frombuffer(b"".join(wide), np.uint8).reshape(len(wide), -1)
    bits = np.ascontiguousarray(np.unpackbits(rows, axis=1, bitorder="little").T)
    for band, places in enumerate(_places(how)):
        key = np.full(len(wide), band, np.int64)
        for at in places:
            key = key << 1 | bits[at]
        yield key


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of short rows, put together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _rows(how: Bands):
    """Classes (cid, wide, root) to (key, cid, root, sketch) for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 4000):
            wide = b.column(1).to_pylist()
            sketch = pa.array([w[: 8 * SKETCH_WORDS] for w in wide], pa.binary())
            for key in _keys(wide, how):
                yield pa.record_batch([pa.array(key), b.column(0), b.column(2), sketch], ["key", "cid", "root", "sketch"])

    return run


def _counts(how: Bands):
    """Classes (wide) to (key, n); each worker counts most of what it has read before it sends anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held))
            u, place = np.unique(keys, return_inverse=True)
            return u, np.bincount(place, n).astype(np.int64)

        for b in parts(batches, 4000):
            held += [np.unique(key, return_counts=True) for key in _keys(b.column(0).to_pylist(), how)]
            if sum(len(u) for u, _ in held) > COUNTED:
                held = [merged()]
                if len(held[0][0]) > COUNTED // 2:
                    yield pa.record_batch([pa.array(x) for x in held.pop()], ["key", "n"])
        if held:
            yield pa.record_batch([pa.array(x) for x in merged()], ["key", "n"])

    return run


class _Candidates:
    """Candidates of a group of fingerprints as a forest of different roots, found in shells: within `differ` bits and beyond `above`."""

    def __init__(self, sketch: np.ndarray, root: np.ndarray, seed: int = 0) -> None:
        self.sketch, self.above, self.differ = sketch, -1, 0
        self.forest = _Forest(len(sketch), np.random.default_rng(seed))
        self.forest.label = np.unique(root, return_inverse=True)[1]

    def bits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(axis=1, dtype=np.int64)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.bits(i, j)
        return (n > self.above) & (n <= self.differ)

    def grow(self, how: Bands) -> _Forest:
        for share in SHELLS:
            self.differ = int(how.differ * share)
            trie_links(self.sketch[:, 0], min(how.first, self.differ), leaf=1 << 16, near=self.near, forest=self.forest)
            self.above = self.differ
        return self.forest


class _Verified(_Candidates):
    """Those candidates that are links by their shingle sets."""

    def __init__(self, sketch: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: int) -> None:
        super().__init__(sketch, root)
        self.sets, self.similarity, self.sizes = sets, similarity, np.array([len(x) for x in sets])

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, x, y = self.bits(i, j), self.sizes[i], self.sizes[j]
        # sets whose sizes differ too much can't be alike
        some = np.flatnonzero((n > self.above) & (n <= self.differ) & (np.minimum(x, y) * 10_000 >= np.maximum(x, y) * self.similarity))
        for k in some[np.argsort(n[some], kind="stable")].tolist():
            a, b = i[k], j[k]
            if self.forest.label[a] != self.forest.label[b] and _alike(self.sets[a], self.sets[b], self.similarity):
                self.forest.join(i[k : k + 1], j[k : k + 1])
        return np.zeros(len(i), bool)


def _alike(s: np.ndarray, t: np.ndarray, similarity: int) -> bool:
    n = len(np.intersect1d(s, t, assume_unique=True))
    return n * 10_000 >= (len(s) + len(t) - n) * similarity


def _grouped(batches: Iterator[pa.RecordBatch], solve, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """solve(batch) of whole groups of rows that are sorted by their first column."""
    held: list[pa.RecordBatch] = []

    def table(*more: pa.RecordBatch) -> pa.Table:
        return pa.Table.from_batches([*held, *more]).combine_chunks()

    for batch in _larger(batches, rows):
        k = batch.column(0).to_numpy()
        last = int(np.searchsorted(k, k[-1]))  # where the group begins that may go on
        if last:
            yield solve(table(batch.slice(0, last)))
            held = []
        elif held and held[-1].column(0)[-1].as_py() != k[0]:
            yield solve(table())
            held = []
        held.append(batch.slice(last))
    if held:
        yield solve(table())


def _spans(grp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where groups of two rows and more begin and end."""
    starts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
    yield from ((s, e) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(grp)]) if e - s > 1)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (a, b))
    return pa.record_batch([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])


def _forests(how: Bands):
    """Rows (grp, cid, root, sketch), sorted by grp, to the groups' forests (a, b)."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        grp, cid, root = (t.column(i).to_numpy() for i in range(3))
        sketch = np.frombuffer(b"".join(t.column(3).to_pylist()), "<u8").reshape(len(t), SKETCH_WORDS)
        a, b = [], []
        for s, e in _spans(grp):
            order = s + np.lexsort((cid[s:e], sketch[s:e, 0]))
            links = np.array(_Candidates(sketch[order], root[order], int(grp[s]) & 0xFFFFFFFF).grow(how).links, np.int64).reshape(-1, 2)
            a.append(cid[order][links[:, 0]])
            b.append(cid[order][links[:, 1]])
        return _pairs(a, b)

    return lambda batches: _grouped(batches, solve)


def _settled(how: Bands, similarity: int):
    """Rows (grp, cid, root, sketch, grams), sorted by grp, to verified links (a, b) of different roots."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        grp, cid, root = (t.column(i).to_numpy() for i in range(3))
        sketch = np.frombuffer(b"".join(t.column(3).to_pylist()), "<u8").reshape(len(t), SKETCH_WORDS)
        lists = t.column(4).combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        a, b = [], []
        for s, e in _spans(grp):
            order = s + np.lexsort((cid[s:e], sketch[s:e, 0]))
            links = np.array(_Verified(sketch[order], root[order], [flat[ends[i] : ends[i + 1]] for i in order], similarity).grow(how).links, np.int64).reshape(-1, 2)
            a.append(cid[order][links[:, 0]])
            b.append(cid[order][links[:, 1]])
        return _pairs(a, b)

    return lambda batches: _grouped(batches, solve, 500)


def _small(df: DataFrame) -> DataFrame:
    """A written table of keys, marked for a broadcast while it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


_ROWS = "key long, cid long, root long, sketch binary"


def forest(classes: DataFrame, how: Bands, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Of classes (cid, wide): (a, b), the forests of all band groups; and (a, b) that put the members of a group of more than `hot` rows together."""
    crowded = classes.select("wide").mapInArrow(_counts(how), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > hot)
    crowded = cut(crowded.select("key", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    rows = classes.select("cid", "wide", F.col("cid").alias("root")).mapInArrow(_rows(how), _ROWS)
    part = F.pmod(F.xxhash64("cid", "key"), F.col("parts"))
    dealt = rows.join(_small(crowded), "key", "left").withColumn("grp", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", part)))
    links = dealt.select("grp", "cid", "root", "sketch").repartition("grp").sortWithinPartitions("grp").mapInArrow(_forests(how), "a long, b long").distinct()
    if crowded.isEmpty():
        return links, links.limit(0)
    members = cut(rows.select("key", "cid").join(_small(crowded.select("key")), "key"))
    first = members.groupBy("key").agg(F.min("cid").alias("b"))
    return links, members.join(_small(cut(first)), "key").select(F.col("cid").alias("a"), "b").filter("a <> b").distinct()


def cells(members: DataFrame, cell: int = CELL) -> DataFrame:
    """members (comp, cid, root) of components of several roots, with grp: what is verified together. A large component's members are in several."""
    trees = cut(members.groupBy("comp", "root").agg(F.count("*").alias("n")))
    comps = cut(trees.groupBy("comp").agg(F.sum("n").alias("total"), F.count("*").alias("roots")).filter("roots > 1").drop("roots"))
    plain = members.join(_small(comps.filter(F.col("total") <= cell).select("comp")), "comp").withColumn("grp", F.col("comp"))
    large = comps.filter(F.col("total") > cell)
    if large.isEmpty():
        return plain
    # parts of half the size: a large tree has its own, small ones share some
    half = max(1, cell // 2)
    told = trees.join(large, "comp").withColumn("pure", F.when(F.col("n") > half, F.col("root")))
    told = cut(told.withColumn("parts", F.ceil(F.when(F.col("pure").isNull(), F.col("total")).otherwise(F.col("n")) / half).cast("int")).select("comp", "root", "pure", "parts"))
    own = told.filter("pure is not null").select("comp", "pure", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    shared = told.filter("pure is null").select("comp", "pure", F.pmod(F.xxhash64("root"), F.col("parts")).cast("int").alias("i")).distinct()
    part = F.xxhash64("comp", F.coalesce("pure", F.lit(-1)), "i")
    parts_ = cut(own.union(shared).select("comp", "pure", part.alias("part")))
    x, y = (parts_.select("comp", F.col("pure").alias(f"{n}_pure"), F.col("part").alias(n)) for n in "xy")
    both = x.join(y, "comp").filter((F.col("x") <= F.col("y")) & F.coalesce(F.col("x_pure") != F.col("y_pure"), F.lit(True)))
    both = cut(both.withColumn("grp", F.xxhash64("comp", "x", "y")).select(F.explode(F.array_distinct(F.array("x", "y"))).alias("part"), "grp"))
    i = F.when(F.col("pure").isNull(), F.pmod(F.xxhash64("root"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("parts"))).cast("int")
    dealt = members.join(_small(told), ["comp", "root"]).withColumn("i", i).withColumn("part", part)
    return plain.union(dealt.join(_small(both), "part").select("comp", "cid", "root", "grp"))


def _grams(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(cid, grams): the shingle hashes of the texts (cid, text) of nodes (cid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.record_batch([b.column(0), pa.array([shingle_hashes(t, shingle).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["cid", "grams"])

    return texts.join(_small(nodes), "cid", "left_semi").select("cid", "text").mapInArrow(run, "cid long, grams array<long>")


def alike(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle sets, of (cid, grams), have a Jaccard similarity of `similarity` / 10000 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            keep = [_alike(x.values.to_numpy(), y.values.to_numpy(), similarity) for x, y in zip(b.column(2), b.column(3))]
            yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("cid").alias(c), F.col("grams").alias(f"of_{c}")) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def groups(rows: DataFrame, how: Bands, shingle: int = SHINGLE, similarity: int = SIMILARITY, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """(cid, root, best) of each class of rows (row, doc_id, text): best = (no_id, doc_id, row) of the class's first document, cid = best.row."""
    fps = rows.select("row", "doc_id", "text").mapInArrow(_fingerprints(how.words, shingle), "row long, doc_id long, set_key binary, wide binary")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    classes = cut(fps.groupBy("set_key").agg(best.alias("best"), F.max("wide").alias("wide")).select("best.row", "best", "wide").withColumnRenamed("row", "cid"))
    texts = rows.select(F.col("row").alias("cid"), "text")
    links, together = forest(classes, how, hot)
    links = cut(links)
    comp = cut(components(links.union(together)))  # (node, root): all candidates of a class are in its component
    sets = cut(_grams(texts, comp.select(F.col("node").alias("cid")), shingle))
    sure = cut(alike(links, sets, similarity))
    trees = cut(components(sure))
    members = comp.select(F.col("node").alias("cid"), F.col("root").alias("comp")).join(trees.withColumnRenamed("node", "cid"), "cid", "left")
    members = cut(members.select("comp", "cid", F.coalesce("root", "cid").alias("root")))
    dealt = cut(cells(members, cell))
    sketch = F.substring("wide", 1, 8 * SKETCH_WORDS).alias("sketch")
    full = dealt.join(classes.select("cid", sketch), "cid").join(sets, "cid").select("grp", "cid", "root", "sketch", "grams")
    rest = cut(full.repartition("grp").sortWithinPartitions("grp").mapInArrow(_settled(how, similarity), "a long, b long"))
    comp = components(sure.union(rest))
    return classes.join(comp, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("root", "cid").alias("root"), "best")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """docs with one row of each group of near copies: the one of the smallest id (nulls last). Rows and columns stay as they are."""
    names = [f"k{i}" for i in range(len(docs.columns))]
    keyed = cut(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    of = dict(zip(docs.columns, names))
    rows = keyed.select("row", F.col(of[id_col]).cast("long").alias("doc_id"), F.col(of[text_col]).cast("string").alias("text"))
    n = keyed.count()
    stay = groups(rows, bands_for(n, similarity), shingle, similarity, hot, cell).groupBy("root").agg(F.min("best").alias("best")).select("best.row")
    stay = cut(stay)
    if n - stay.count() <= BROADCAST_ROWS:
        gone = cut(keyed.select("row").join(stay, "row", "left_anti"))
        kept = keyed.join(F.broadcast(gone), "row", "left_anti")
    else:
        kept = keyed.join(stay, "row", "left_semi")
    return kept.select(*[F.col(k).alias(c) for k, c in zip(names, docs.columns)])
