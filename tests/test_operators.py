"""Operators at small sizes, with several ranges, and damage beyond repair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import gf
from brindle.operators import chain, coding, layout, repair, resync
from brindle.operators.ordered import running_ordered, split_points
from brindle.plans import planner
from brindle.sources import catalog, sets
from brindle.streaming.encode import encode_stream


def test_running_sums_over_many_ranges(spark):
    df = spark.range(3000).select(F.format_string("%08d", F.col("id") * 7919 % 3001).alias("name"), (F.col("id") % 11).alias("w"), (F.col("id") % 3).alias("g"))
    assert len(split_points(df, "name", 200)) > 5
    for by in ([], ["g"]):
        got = running_ordered(df, "name", F.col("w"), "s", by, rows_each=200).toPandas().sort_values("name")
        want = (got.groupby("g").w if by else got.w).cumsum() - got.w
        assert (got.s == want).all()


@pytest.mark.parametrize(("bits", "lost"), [(8, [0]), (8, [1, 4, 9]), (16, [2, 7, 8])])
def test_erasures_decode(spark, bits, lost):
    rng = np.random.default_rng(5)
    data = [rng.integers(0, 256, 96, dtype=np.uint8).tobytes() for _ in range(10)]
    s = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "slice long, data binary")
    r = coding.encode(s, 4, 96, bits).filter("exponent <> 1")
    got = {x["slice"]: bytes(x["data"]) for x in coding.decode(s, r, lost, 96, bits).collect()}
    assert got == {i: data[i] for i in lost}


def test_too_many_erasures(spark):
    s = spark.createDataFrame([(i, bytearray(b"abcd")) for i in range(4)], "slice long, data binary")
    with pytest.raises(ValueError):
        coding.decode(s, coding.encode(s, 1, 4), [0, 1], 4)


def test_stream_is_as_the_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    s = spark.createDataFrame([(i, bytearray(rng.integers(0, 256, 32, dtype=np.uint8).tobytes())) for i in range(20)], "slice long, data binary")
    s.repartition(5).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "s"))
    assert sorted(encode_stream(spark, stream, 3, 32).collect()) == sorted(coding.encode(s, 3, 32).collect())


def test_overlap_join_gives_each_pair_once(spark):
    rng = np.random.default_rng(7)
    make = lambda n: [(i, int(b), int(b) + int(w)) for i, (b, w) in enumerate(zip(rng.integers(0, 1000, n), rng.integers(1, 200, n)))]
    a, b = make(40), make(40)
    got = layout.overlap_join(spark.createDataFrame(a, "l long, l_begin long, l_end long"), spark.createDataFrame(b, "r long, r_begin long, r_end long"), 16)
    assert sorted((x["l"], x["r"]) for x in got.collect()) == sorted((i, j) for i, s, e in a for j, t, f in b if s < f and t < e)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "ord long, name string, length long, content_hash string")
    assert layout.place(layout.file_dedup(e)).count() == 0 and layout.place(layout.file_dedup(e, 2)).count() == 0
    assert layout.slices(spark, 0, 4096).count() == 0
    assert resync.dominant(spark.createDataFrame([], "delta long, votes long")).count() == 0


def test_aliases_and_empty_entries(spark):
    rows = [(0, "a", 5, "x"), (1, "b", 0, "e"), (2, "c", 5, "x"), (3, "d", 0, "e"), (4, "f", 5, "x"), (5, "g", 3, "y")]
    e = spark.createDataFrame(rows, "ord long, name string, length long, content_hash string")
    p = {r["ord"]: (r["canonical_ord"], r["stream_offset"]) for r in layout.place(layout.file_dedup(e)).collect()}
    assert p == {0: (0, 0), 1: (1, 5), 2: (0, 0), 3: (3, 5), 4: (0, 0), 5: (5, 5)}
    m = {r["ord"]: r["canonical_ord"] for r in layout.file_dedup(e, 2).collect()}
    assert (m[0], m[2], m[4]) == (0, 0, 4)


def test_long_lineage_and_cycles(spark):
    gens = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "generation int, parent int")
    got = chain.lineage(gens)
    assert got.count() == 150 * 151 // 2 and got.filter("generation - ancestor <> depth").count() == 0
    for rows in ([(0, 1), (1, 0), (2, None)], [(0, None), (1, 9)]):
        with pytest.raises(ValueError):
            chain.lineage(spark.createDataFrame(rows, "generation int, parent int"))


def test_copies_are_one_source(spark):
    """4,000 equal entries: damaged ones meet one source, not every intact copy."""
    from brindle import queries

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    was, queries._docs = queries._docs, lambda spark, sf: docs
    try:
        got = queries.copy_sources(spark, "")
        assert got.count() == 800 and got.filter("source_ord <> 1").count() == 0
    finally:
        queries._docs = was


def test_columns_with_equal_erasures_are_a_group(spark):
    e = spark.createDataFrame([(s, c) for c, lost in enumerate([[1, 5], [5, 1], [2], [1, 6], []]) for s in lost], "slice long, col long")
    assert sorted((r["depth"], r["columns"], r["first_col"]) for r in layout.column_groups(e).collect()) == [(1, 1, 2), (2, 1, 3), (2, 2, 0)]


def test_sets_are_coded_on_their_own(spark):
    rng = np.random.default_rng(9)
    data = [rng.integers(0, 256, 64, dtype=np.uint8).tobytes() for _ in range(25)]
    s = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "slice long, data binary").repartition(7)
    got = {(r["set_no"], r["exponent"]): bytes(r["data"]) for r in coding.encode_sets(s, 10, 3, 64).collect()}
    assert len(got) == 9
    for k in range(3):
        part = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data[10 * k : 10 * k + 10])], "slice long, data binary")
        assert {e: bytes(d) for e, d in coding.encode(part, 3, 64).collect()} == {e: x for (g, e), x in got.items() if g == k}
    with pytest.raises(ValueError):
        coding.encode_sets(s, 250, 10, 64)


@pytest.mark.parametrize("bits", [8, 16])
def test_sums_are_products(bits):
    rng = np.random.default_rng(bits)
    c, x = rng.integers(0, 1 << bits, 11), rng.integers(0, 256, 4002, dtype=np.uint8)
    sums = gf.Sums(11, 4002, bits)
    sums.add(c, x)
    sums.add(c[::-1].copy(), x[:101])
    y = np.r_[x[:101], np.zeros(4002 - 101, np.uint8)]
    for i, row in enumerate(sums.rows()):
        kind = np.uint8 if bits == 8 else np.dtype("<u2")
        want = gf.scale(int(c[i]), x.view(kind), bits) ^ gf.scale(int(c[::-1][i]), y.view(kind), bits)
        assert row == want.astype(kind).tobytes()


def test_repair_needs_enough_recovery(spark):
    s = spark.createDataFrame([(i, bytearray(bytes([i]) * 130)) for i in range(9)], "slice long, data binary")
    cells = repair.split_cells(s, 130, 64)
    assert cells.count() == 27 and {len(r["data"]) for r in cells.filter("col = 2").collect()} == {2}
    recovery = coding.encode(s, 2, 130)
    bad = spark.createDataFrame([(1, 0), (3, 0), (3, 2)], "slice long, col long")
    got = {(r["slice"], r["col"]): bytes(r["data"]) for r in repair.decode(cells, recovery, bad, 130, 64).collect()}
    assert got == {(1, 0): b"\1" * 64, (3, 0): b"\3" * 64, (3, 2): b"\3" * 2}
    with pytest.raises(ValueError):
        repair.decode(cells, recovery, spark.createDataFrame([(1, 0), (3, 0), (5, 0)], "slice long, col long"), 130, 64)
    assert repair.decode(cells, recovery, bad.limit(0), 130, 64).count() == 0


def test_missing_and_damaged_cells_are_told(spark):
    s = spark.createDataFrame([(i, bytearray(bytes([i]) * 128)) for i in range(4)], "slice long, data binary")
    cells = repair.split_cells(s, 128, 64)
    stored = repair.tags(cells)
    seen = cells.filter("slice <> 2").withColumn("data", F.when((F.col("slice") == 1) & (F.col("col") == 1), F.lit(b"x")).otherwise(F.col("data")))
    got = {(r["slice"], r["col"]): r["status"] for r in repair.verify(seen, stored).collect()}
    assert got[2, 0] == got[2, 1] == "missing" and got[1, 1] == "damaged" and sum(x == "ok" for x in got.values()) == 5


def test_a_file_tree_is_a_catalogue(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.bin").write_bytes(b"BRNDL\1 old")
    (tmp_path / "a" / "y").write_bytes(b"")
    got = {r["name"]: r for r in catalog.files(spark, f"{tmp_path}/a").withColumn("old", catalog.has_magic("content", b"BRNDL\1")).collect()}
    assert set(got) == {"b/x.bin", "y"} and got["b/x.bin"]["old"] and not got["y"]["old"] and got["y"]["length"] == 0 and got["b/x.bin"]["ord"] == 0


def test_planner_words():
    assert planner.explain(10_000, 4096, 2)["slices"] == 3 and planner.volume_name("s", 3, 4, 37).startswith("s.v03+")
    assert 1 <= planner.repair_crossover(200, 1 << 20) <= 201 and planner.repair_crossover(2, 64) >= planner.repair_crossover(2000, 64)


def test_stale_rules(spark):
    d = spark.createDataFrame([(1, 1, True), (1, 2, False), (None, None, False)], "old int, new int, differs boolean")
    for policy, want in (("none", [False] * 3), ("hash", [True, False, False]), ("stat", [False, True, False])):
        assert [r[0] for r in d.select(chain.stale(F.col("old"), F.col("new"), policy, F.col("differs"))).collect()] == want


def test_a_third_generation_inherits_from_the_first(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = [("a", 3, "ha"), ("b", 5, "hb"), ("c", 0, "hc")]
    for more in ([], [("d", 2, "hd")], [("e", 4, "he")]):
        rows = rows + more
        sets.add_generation(spark, path, spark.createDataFrame(rows, "name string, length long, content_hash string"), 64)
    got = {r["name"]: r["owner"] for r in sets.effective(spark, path, 2).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 2}
    g = {r["generation"]: (r["stream_base"], r["stream_length"], r["linked"]) for r in sets.generations(spark, path).collect()}
    assert g == {0: (0, 8, True), 1: (8, 2, True), 2: (10, 4, True)}
    assert sets.lineage_of(spark, path).count() == 6


def test_undo(spark, tmp_path):
    from brindle.operators import undo

    before = spark.createDataFrame([("a", bytearray(b"old bytes")), ("b", bytearray(b"xy")), ("n", None)], "name string, content binary")
    writes = spark.createDataFrame([("a", 0, 3), ("a", 4, 9), ("b", 1, 5), ("new", 0, 2)], "name string, begin long, end long")
    after = spark.createDataFrame([("a", bytearray(b"NEW BYTES")), ("b", bytearray(b"xYYYY")), ("n", None), ("new", bytearray(b"zz"))], "name string, content binary")
    path = str(tmp_path / "j")
    assert undo.status(spark, path) == "not-found"
    rows = undo.records(before, writes)
    undo.write(spark, path, "s", rows)
    got = undo.replay(after, undo.scan(spark, path, "s", after))
    assert {r["name"]: r["content"] and bytes(r["content"]) for r in got.collect()} == {"a": b"old bytes", "b": b"xy", "n": None}
    with pytest.raises(ValueError, match="another set"):
        undo.scan(spark, path, "t", after)
    with pytest.raises(ValueError, match="outside"):
        undo.scan(spark, path, "s", before)
    # a torn journal, and one whose bytes changed after their checksum
    rows.write.parquet(str(tmp_path / "torn" / "records"))
    assert undo.status(spark, str(tmp_path / "torn")) == "incomplete"
    undo.write(spark, str(tmp_path / "bad"), "s", rows.withColumn("old", F.overlay("old", F.lit(b"?"), F.lit(1), F.lit(1))))
    with pytest.raises(ValueError, match="verify"):
        undo.scan(spark, str(tmp_path / "bad"), "s", after)
    undo.write(spark, str(tmp_path / "empty"), "s", rows.limit(0))
    assert undo.replay(after, undo.scan(spark, str(tmp_path / "empty"), "s", after)).count() == 4


def test_contents_are_numbered_as_entries(spark):
    docs = spark.createDataFrame([(i % 40, f"t{i}", "en", f"s{i % 3}") for i in range(120)] + [(7, "t7", "en", "s1"), (7, None, "en", "s1")], "doc_id long, text string, lang string, source string")
    key = lambda d: sorted((r["ord"], bytes(r["content"] or b"")) for r in d.select("ord", "content").collect())
    got, want = key(catalog.contents(docs)), key(catalog.entries(docs))
    assert [x for x, _ in got] == list(range(122)) and sorted(x for _, x in got) == sorted(x for _, x in want)
    some = docs.limit(40)
    assert key(catalog.contents(some)) == key(catalog.entries(some))


def test_votes_are_those_of_all_windows(spark):
    """Windows far from a probe's place or without its CRC are left out beforehand: the votes stay those of a plain comparison."""
    from brindle.functions import digests
    from brindle.operators import damage

    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 4 if i % 3 else 256, int(n), dtype=np.uint8).tobytes() for i, n in enumerate(rng.integers(0, 400, 40))] + [b"", b"x" * 300, b"x" * 200]
    e = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)] + [(99, None)], "ord long, content binary")
    probes = resync.rolling(e, 16, 16).select(F.col("pos").alias("expected"), "crc")
    hits = resync.rolling(damage.inject(e, "insert", (0, 5, 1)), 16, near=(16, 6), known=resync.known_crcs(probes))
    blocks = [(at, digests.crc32c(t[at : at + 16])) for t in texts for at in range(0, len(t) - 15, 16)]
    assert sorted((r["expected"], r["crc"]) for r in probes.collect()) == sorted(blocks)
    own = {}
    for at, crc in blocks:
        own.setdefault(crc, []).append(at)
    want = {}
    for t in texts:
        t = damage.insert(t, 0, 5, 1)
        for pos in range(len(t) - 15):
            at = own.get(digests.crc32c(t[pos : pos + 16]), [])
            if len(at) == 1 and abs(pos - at[0]) <= 6:
                want[pos - at[0]] = want.get(pos - at[0], 0) + 1
    assert {r["delta"]: r["votes"] for r in resync.votes(hits, probes, 6).collect()} == want and want[5] > 50
    assert hits.count() < 2 * len(blocks)
    alone = resync.unique(probes)
    fewer = resync.rolling(damage.inject(e, "insert", (0, 5, 1)), 16, near=(16, 6), known=resync.known_crcs(alone))
    assert {r["delta"]: r["votes"] for r in resync.votes(fewer, alone, 6).collect()} == want and fewer.count() < hits.count()


def test_windows_of_many_strings_take_little_time():
    """1,000 strings of 1,000 bytes: 20 ms each would be 20 seconds."""
    import time

    from brindle.functions import digests

    blobs = [np.random.default_rng(i).bytes(1000) for i in range(1000)]
    began = time.process_time()
    owner, place, crc = digests.rolling_crc32c_many(blobs, 256)
    assert time.process_time() - began < 5 and len(crc) == 745 * 1000
    assert all(digests.crc32c(blobs[owner[i]][place[i] : place[i] + 256]) == crc[i] for i in range(0, len(crc), 9973))
