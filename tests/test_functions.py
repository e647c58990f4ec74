"""Known answers and properties of the byte functions."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.functions import digests, gf, rs, text
from brindle.operators import chunking, damage, packets
from brindle.plans import planner

DATA = bytes((29 * i + 7) % 256 for i in range(20_000))


def test_crc32c_known_answers():
    assert digests.crc32c(b"123456789") == 0xE3069283
    assert digests.crc32c(DATA[:4096]) == 0x752B349C
    assert digests.crc32c(b"") == 0
    many = [DATA[:n] for n in (0, 1, 5, 100, 4097, 3)]
    assert digests.crc32c_many(many).tolist() == [digests.crc32c(x) for x in many]


@settings(max_examples=20, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_crc32c_combines(a, b):
    assert digests.crc32c_combine(digests.crc32c(a), digests.crc32c(b), len(b)) == digests.crc32c(a + b)


def test_rolling_crc():
    got = digests.rolling_crc32c(DATA[:300], 64)
    assert [hex(x) for x in got[:2]] == ["0xcf762298", "0x96fce802"] and hex(got[16]) == "0xbf835fab"
    assert all(int(x) == digests.crc32c(DATA[i : i + 64]) for i, x in enumerate(got))


def test_blake3_known_answers():
    assert digests.blake3(b"").hex().startswith("af1349b9f5f9a1a6")
    assert digests.blake3(b"abc").hex().startswith("6437b3ac38465133")
    assert digests.blake3(DATA).hex().startswith("f9d16147")
    assert digests.blake3(DATA[:16384]).hex().startswith("a2403235")
    sizes = (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 20000)
    assert digests.blake3_many([DATA[:n] for n in sizes]) == [digests.blake3(DATA[:n]) for n in sizes]


@pytest.mark.parametrize("bits", [8, 16])
def test_field(bits):
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(1, 1 << bits, 200) for _ in range(3))
    assert (gf.mul(a, gf.inv(a, bits), bits) == 1).all()
    assert (gf.mul(a, b ^ c, bits) == gf.mul(a, b, bits) ^ gf.mul(a, c, bits)).all()
    m = gf.coefficient(np.arange(5)[:, None], np.array([0, 3, 4, 9, 11])[None, :], bits)
    inverse = gf.solve(m, bits)
    unit = np.array([[np.bitwise_xor.reduce(gf.mul(m[i], inverse[:, j], bits)) for j in range(5)] for i in range(5)])
    assert (unit == np.eye(5, dtype=int)).all()


def test_inner_code_known_answers():
    code = rs.Code(255, 253, 212, 11)
    assert rs.generator(code) == (0x96, 0x70, 1)
    assert rs.encode(bytes((11 + 37 * i) % 256 for i in range(253)), code)[-2:].hex() == "03fc"


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 20))
def test_inner_code_corrects_up_to_t(seed, errors):
    rng, code = np.random.default_rng(seed), rs.Code()
    word = rs.encode(rng.integers(0, 256, code.k, dtype=np.uint8).tobytes(), code)
    bad = bytearray(word)
    for p in rng.choice(code.n, errors, replace=False):
        bad[p] ^= int(rng.integers(1, 256))
    got, fixed = rs.correct(bytes(bad), code)
    assert (got == errors and fixed == word) if errors <= code.t else (got == -1 or fixed != bytes(bad))


def test_erasures_and_frames():
    code, rng = rs.Code(), np.random.default_rng(3)
    word = rs.encode(DATA[: code.k], code)
    places = tuple(int(x) for x in rng.choice(code.n, 32, replace=False))
    bad = bytearray(word)
    for p in places:
        bad[p] ^= 0x5A
    assert rs.correct(bytes(bad), code, places) == (32, word) or rs.correct(bytes(bad), code, places)[1] == word
    frame = rs.encode_frames(DATA[: 4 * code.k], code, 4)
    hit = damage.burst(frame, code.burst(4), 100)
    assert rs.decode_frame(hit, code, 4)[1] == DATA[: 4 * code.k]
    assert len(frame) == code.size(4 * code.k, 4)


def test_chunks():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    ends = chunking.cuts(data, 4096)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= 4 * 4096 and sizes[:-1].min() >= 1024
    moved = chunking.cuts(b"x" * 100 + data, 4096)
    assert len({e - 100 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert chunking.cuts(b"", 4096) == []


def test_many_packets_are_scanned_as_one_by_one():
    """Several packets a volume, some damaged, cut off or with a false length; and 2,000 packets in little time."""
    import time

    rng = np.random.default_rng(5)
    bodies = [DATA[: int(n)] for n in rng.integers(0, 3000, 60)]
    made = packets.encode_many("FILE", b"s" * 16, bodies)
    assert made == [packets.encode("FILE", b"s" * 16, b) for b in bodies]
    volumes = [b"", b"junk" * 5, b"".join(made), b"".join(made[:9])[:-5], made[0] + packets.encode("FILE", b"s" * 16, b"".join(made[:5])) + made[1]]
    volumes += [damage.burst(b"".join(made[i : i + 8]), 1, int(rng.integers(0, 8000))) for i in range(0, 50, 2)]
    volumes += [damage.burst(volumes[4], 1, len(made[0]) + at) for at in (8, 15, 30, 60, 5000)]

    def plainly(data, at=0):
        while (at := data.find(packets.MAGIC, at)) >= 0:
            if at % 8 or at + 48 > len(data):
                at += 1
                continue
            n = int.from_bytes(data[at + 8 : at + 16], "little")
            ok = 48 <= n and n % 8 == 0 and at + n <= len(data) and digests.blake3(data[at : at + 40] + data[at + 48 : at + n])[:8] == data[at + 40 : at + 48]
            yield at, n, ok
            at += n if ok else 8

    got = packets.scan_many(volumes)
    assert [[(p[0], p[4], p[5]) for p in v] for v in got] == [list(plainly(v)) for v in volumes]
    assert len(got[2]) == 60 and any(not p[5] for v in got for p in v)
    began = time.process_time()
    many = packets.encode_many("FILE", b"s" * 16, [DATA[:1000]] * 2000)
    assert all(v[0][5] for v in packets.scan_many(many)) and time.process_time() - began < 10


def test_packets_round_trip():
    data = b"junk" * 2 + packets.encode("FILE", b"s" * 16, b"hello") + packets.encode("SETD", b"s" * 16, DATA[:100], key=None)
    got = list(packets.scan(data))
    assert [(p[1], p[5]) for p in got] == [("FILE", True), ("SETD", True)] and got[0][6][:5] == b"hello"
    assert [p[5] for p in packets.scan(damage.burst(data, 1, 58))] == [False, True]
    assert not list(packets.scan(b"x" + data)) and len(list(packets.scan(b"x" + data, step=1))) == 2


def test_damage_modes():
    assert sum(a != b for a, b in zip(damage.scatter(DATA, 9, 1), DATA)) == 9
    assert damage.truncate(DATA, 5) == DATA[:-5] and len(damage.insert(DATA, 3, 7, 1)) == len(DATA) + 7
    assert damage.swap(damage.swap(DATA, 0, 100, 50), 0, 100, 50) == DATA
    a, b = damage.swap_between(DATA[:50], DATA[50:100], 10, 5)
    assert damage.swap_between(a, b, 10, 5) == (DATA[:50], DATA[50:100])


def test_plans():
    assert planner.slice_size(20_000_000) == 5056 and planner.slice_size(0) == 4096
    assert planner.recovery_slices("15%", 245, 4096) == 37 and planner.ladder(37) == [1, 2, 4, 8, 22] and planner.ladder(7) == [1, 2, 4]
    assert planner.recovery_slices("10%", 3956, 5056) == 396 and planner.recovery_slices("10%", 48, 2 << 20) == 5
    assert planner.cell_size(2 << 20) == 65536 and planner.cell_size(2048) == 0
    assert planner.parse_size("1.5M") == 1572864 and planner.parse_size("1.5") is None
    assert planner.candidates(100, 5, 4096)[0].codec == "matrix" and not planner.fft_worthwhile(100, 5)


def test_globs():
    import re

    for glob, name, want in (("*.txt", "a/b.txt", True), ("a?c", "abc", True), ("[!a]x", "ax", False), ("[ab]x", "bx", True), ("a\\*", "a*", True), ("a\\*", "ab", False), ("a", "ab", False)):
        assert bool(re.match(text.glob_regex(glob), name, re.S)) == want, glob


def test_digest_columns(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, None), (3, bytearray(b""))], "k int, data binary")
    got = {r["k"]: (r["c"], r["b"]) for r in digests.with_digest(digests.with_digest(df, "data", "c"), "data", "b", "blake3").collect()}
    assert got[2] == (None, None) and got[3][0] == 0 and got[1][0] == digests.crc32c(b"abc") and got[1][1] == digests.blake3(b"abc").hex()
    assert zlib.crc32(b"abc") != got[1][0]


@pytest.mark.parametrize(("n", "window"), [(0, 4), (3, 4), (4, 4), (5, 4), (1023, 7), (1024, 16), (1025, 1024), (5000, 64), (2048, 3)])
def test_rolling_crc_is_that_of_each_window(n, window):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    got = digests.rolling_crc32c(data, window)
    assert len(got) == max(0, n - window + 1)
    for i in range(0, len(got), 37):
        assert got[i] == digests.crc32c(data[i : i + window])


def test_crc_of_long_strings_is_combined():
    rng = np.random.default_rng(3)
    blobs = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, digests.BLOCK - 1, digests.BLOCK, digests.BLOCK + 1, 3 * digests.BLOCK + 77)]
    for b, c in zip(blobs, digests.crc32c_many(blobs)):
        state = 0xFFFFFFFF
        for x in b:
            state = int(digests._TABLE[(state ^ x) & 0xFF]) ^ (state >> 8)
        assert c == state ^ 0xFFFFFFFF
    assert digests.crc32c(b"123456789") == 0xE3069283


def test_paths_by_component(spark):
    from pyspark.sql import functions as F

    from brindle.functions import text

    known = {"a<b/./c": "reserved_char", "./a<b": "dot", "a\x01<": "control", "a<\x01": "reserved_char", "con.": "trailing_dot_space", "x/LPT1.c": "device",
             "1:x": "drive", "com0": "ok", "a//con": "empty_component", "": "empty", "a/": "trailing_slash", "é:x": "reserved_char"}
    rows = spark.createDataFrame([(k,) for k in known], "n string").select("n", text.path_status(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in rows.collect()} == known
    parts = {"a/b": ("a", "b"), "b": (".", "b"), "/b": ("/", "b"), "a\\b/c": ("a\\b", "c"), "a/": ("a", "")}
    got = spark.createDataFrame([(k,) for k in parts], "n string").select("n", *[c.alias(x) for c, x in zip(text.path_parts(F.col("n")), "db")], text.path_join(F.col("n"), F.lit("z")).alias("j"))
    assert {r["n"]: (r["d"], r["b"]) for r in got.collect()} == parts
    assert {r["n"]: r["j"] for r in got.collect()}["a/"] == "a/z"


def test_forms_of_large_numbers(spark):
    from pyspark.sql import functions as F

    from brindle.functions import text

    rows = spark.createDataFrame([(0,), (99,), (100,), (1023,), (1536,), ((1 << 63) - 1,)], "n long")
    got = rows.select(text.human_size(F.col("n")).alias("h"), text.grouped(F.col("n")).alias("g"), text.exponent_form(F.col("n")).alias("e")).collect()
    assert [r["h"] for r in got] == ["0 B", "99 B", "100 B", "1023 B", "1.5 KiB", "8191.9 PiB"]
    assert [r["g"] for r in got][-1] == "9,223,372,036,854,775,807" and [r["e"] for r in got] == ["0", "99", "1.00e2", "1.02e3", "1.53e3", "9.22e18"]


@pytest.mark.parametrize(("n", "k"), [(255, 223), (60, 40), (255, 253)])
def test_many_words_are_corrected_as_one_by_one(n, k):
    from brindle.functions import rs

    rng, code = np.random.default_rng(n + k), rs.Code(n, k)
    words = rs.encode_many(rng.integers(0, 256, (120, k), dtype=np.uint8), code)
    assert all(w.tobytes() == rs.encode(w[:k].tobytes(), code) for w in words)
    assert not rs.syndromes(words, code).any()
    bad = words.copy()
    for i, w in enumerate(bad):
        w[rng.permutation(n)[: i % (code.t + 6)]] ^= rng.integers(1, 256, dtype=np.uint8)
    errors, fixed = rs.correct_many(bad, code)
    assert [(int(e), f.tobytes()) for e, f in zip(errors, fixed)] == [rs.correct(w.tobytes(), code) for w in bad]
    assert rs.correct_many(bad[:0], code)[1].shape == (0, n)


def test_scrub_of_many_words_takes_little_time():
    """2,000 words with 9 errors: 20 ms each would be 40 seconds."""
    import time

    from brindle.functions import rs
    from brindle.operators import damage

    code = rs.Code()
    words = rs.encode_many(np.random.default_rng(1).integers(0, 256, (2000, code.k), dtype=np.uint8), code)
    starts = np.arange(2000) % 200
    seen = damage.bursts(words, np.full(2000, 9), starts)
    assert all(s.tobytes() == damage.burst(w.tobytes(), 9, int(a)) for w, s, a in zip(words, seen, starts))
    began = time.process_time()
    errors, fixed = rs.correct_many(seen, code)
    assert time.process_time() - began < 10 and (errors == 9).all() and (fixed == words).all()


def test_inner_code_parameters():
    from brindle.functions import rs

    for size in (1, 40, 300, 10**6):
        n, k = rs.solve(size, percent=10)
        assert n <= 255 and (n - k) % 2 == 0 and n - k >= 2 and rs.problem(rs.Code(n, k)) is None
    assert rs.solve(10**6, t=16) == (255, 223) and rs.solve(100, t=4) == (108, 100)
    code = rs.Code()
    depth = rs.depth_for(code, 1 << 30, burst=1000)
    assert code.burst(depth) >= 1000 > code.burst(depth - 1)
    assert rs.depth_for(code, 4096, burst=10**6) == 1 or 2 * rs.depth_for(code, 4096, burst=10**6) * code.n <= 1024
    assert [rs.problem(rs.Code(256, 200)), rs.problem(rs.Code(255, 222)), rs.problem(rs.Code(255, 223, 1, 5)), rs.problem(code, 0)] == ["n", "odd parity", "step", "depth"]
    data = bytes(range(256)) * 5
    assert rs.plain(rs.encode_frames(data, code, 2), len(data), code, 2) == data
