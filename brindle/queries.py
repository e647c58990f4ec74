"""The catalogue of queries over the test tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import gf, rs, text
from brindle.functions.digests import together, with_digest
from brindle.operators import chain, chunking, coding, damage, layout, packets, resync
from brindle.operators.ordered import running_ordered
from brindle.plans import planner
from brindle.sources.catalog import contents, entries, named, shared_dir, staged, table
from brindle.streaming.encode import encode_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: slice and cell bytes of the geometry queries, and the alignment of the aligned layout
Z, Y, ALIGN = 4096, 1024, 1024
RECOVERY = 8

E_SQL = """e0 AS (SELECT doc_id, source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') AS name, strlen(text)::BIGINT AS length, sha256(text) AS content_hash, text FROM documents),
E AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS ord FROM e0)"""
P_SQL = f"""{E_SQL},
D AS (SELECT *, CASE WHEN length = 0 THEN ord ELSE min(ord) OVER (PARTITION BY content_hash, length) END AS canonical_ord FROM E),
P0 AS (SELECT *, ord = canonical_ord AS is_canonical, sum(CASE WHEN ord = canonical_ord THEN length ELSE 0 END) OVER (ORDER BY ord) - CASE WHEN ord = canonical_ord THEN length ELSE 0 END AS pos0 FROM D),
P AS (SELECT a.* EXCLUDE (pos0), b.pos0::BIGINT AS stream_offset FROM P0 a JOIN P0 b ON a.canonical_ord = b.ord),
L AS (SELECT sum(length)::BIGINT AS len FROM P WHERE is_canonical)"""
S_SQL = f"""{P_SQL},
S AS (SELECT i AS slice, i * {Z} AS "begin", least({Z}, len - i * {Z}) AS bytes FROM L, unnest(range(0, (len + {Z - 1}) // {Z})) AS t(i))"""
SPAN_SQL = f"""{S_SQL},
X AS (SELECT S.slice, P.ord, P.stream_offset, greatest(P.stream_offset, S."begin") AS span_begin, least(P.stream_offset + P.length, S."begin" + {Z}) AS span_end, P.text FROM P JOIN S ON P.stream_offset < S."begin" + {Z} AND P.stream_offset + P.length > S."begin" WHERE P.is_canonical AND P.length > 0)"""
#: which cells count as damaged
DAMAGED = "(slice * 31 + col * 17) % 97 = 0"
K = -(-Z // Y)
C_SQL = f"""{S_SQL},
C AS (SELECT slice, c AS col, "begin" + c * {Y} AS "begin", {Y} AS size, greatest(0, least({Y}, bytes - c * {Y})) AS "real" FROM S, unnest(range(0, {K})) AS u(c)),
B AS (SELECT slice, col FROM C WHERE {DAMAGED})"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(_docs(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str, align: int = 1, content: bool = False) -> DataFrame:
    e = _entries(spark, sf_dir)
    return layout.place(layout.file_dedup(e if content else e.drop("content")), align)


def _length(placed: DataFrame) -> int:
    return placed.filter("is_canonical").agg(F.sum("length")).first()[0] or 0


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.slices(spark, _length(_placed(spark, sf_dir)), Z)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cells(_slices(spark, sf_dir), Z, Y)


def _slice_data(spark: SparkSession, sf_dir: str, z: int = Z) -> DataFrame:
    """(slice, data): slice bytes, zero-padded; the pieces of a slice are z bytes in all."""
    # placed without contents, which join once, by the row that they belong to
    s = layout.spans(_placed(spark, sf_dir).filter("is_canonical"), z).select("doc_id", "slice", "stream_offset", "span_begin", "span_end")
    s = s.join(_docs(spark, sf_dir).select("doc_id", F.encode("text", "utf-8").alias("content")), "doc_id")
    piece = F.expr("hex(substring(content, int(span_begin - stream_offset + 1), int(span_end - span_begin)))")
    one = s.select("slice", F.struct("span_begin", piece.alias("h")).alias("p")).groupBy("slice").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return one.select("slice", F.unhex(F.rpad(F.array_join(F.transform("ps", lambda p: p["h"]), ""), 2 * z, "0")).alias("data"))


# ---- catalogue, names, duplicates


@query("entries_manifest", f"WITH {E_SQL} SELECT ord, name, length, content_hash FROM E")
def entries_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("ord", "name", "length", "content_hash")


@query("entries_filtered_glob", f"WITH {E_SQL} SELECT name, (name LIKE 'src1%/en/%' OR name LIKE 'src2/%') AS by_include, NOT (name LIKE '%/es/%' OR regexp_matches(name, '[13579]$')) AS by_exclude FROM E")
def entries_filtered_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return named(_docs(spark, sf_dir)).select("name", text.selected(n, ["src1*/en/*", "src2/*"], ["*/es/*"]).alias("by_include"), text.selected(n, [], ["*/es/*", "*[13579]"]).alias("by_exclude"))


_PATHS = """CASE page_id % 13 WHEN 0 THEN tail WHEN 1 THEN '' WHEN 2 THEN concat('/', tail) WHEN 3 THEN concat('C:', tail) WHEN 4 THEN concat(tail, '/') WHEN 5 THEN concat('a//', tail)
 WHEN 6 THEN concat('a/../', tail) WHEN 7 THEN concat('a/./', tail) WHEN 8 THEN 'x/con' WHEN 9 THEN 'Aux.txt' WHEN 10 THEN 'x./y' WHEN 11 THEN 'a|b' ELSE replace(tail, '?', '-') END"""


@query("path_status", rf"""WITH t AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS tail FROM pages), n AS (SELECT page_id, {_PATHS} AS name FROM t), s AS (SELECT *, string_split(name, '/') AS p FROM n)
SELECT page_id, name, CASE WHEN strlen(name) = 0 THEN 'empty' WHEN strlen(name) > 65535 THEN 'too_long' WHEN name LIKE '/%' THEN 'absolute' WHEN regexp_matches(name, '^[\x00-\x7f]:') THEN 'drive' WHEN starts_with(name, '\\') THEN 'unc' WHEN name LIKE '%/' THEN 'trailing_slash'
 ELSE coalesce(list_filter(list_transform(p, lambda x: CASE WHEN x = '' THEN 'empty_component' WHEN x = '.' THEN 'dot' WHEN x = '..' THEN 'dot_dot' WHEN regexp_matches(x, '^[^\x00-\x1f<>:"|?*\\]*[\x00-\x1f]') THEN 'control' WHEN regexp_matches(x, '[<>:"|?*\\]') THEN 'reserved_char'
 WHEN regexp_matches(x, '[. ]$') THEN 'trailing_dot_space' WHEN regexp_matches(x, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])([.]|$)') THEN 'device' END), lambda y: y IS NOT NULL)[1], 'ok') END AS status FROM s""")  # fmt: skip
def path_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("tail"))
    return p.select("page_id", F.expr(_PATHS).alias("name")).select("page_id", "name", text.path_status(F.col("name")).alias("status"))


@query("hardlink_groups", f"WITH {E_SQL}, f AS (SELECT name, length, content_hash, min(name) OVER (PARTITION BY content_hash) AS first_name FROM E) SELECT name, CASE WHEN name = first_name THEN 'regular' ELSE 'hardlink' END AS entry_type, CASE WHEN name <> first_name THEN first_name END AS target, length FROM f")
def hardlink_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name of an inode (content stands for it) is regular, later ones link to it and take its fields."""
    e = named(_docs(spark, sf_dir)).drop("content")
    first = e.groupBy("content_hash").agg(F.min(F.struct("name", "length")).alias("f"))
    own = F.col("name") == F.col("f.name")
    return e.join(first, "content_hash").select("name", F.when(own, "regular").otherwise("hardlink").alias("entry_type"), F.when(~own, F.col("f.name")).alias("target"), F.col("f.length").alias("length"))


@query("link_counts", f"WITH {E_SQL}, f AS (SELECT name, min(name) OVER (PARTITION BY content_hash) AS first_name FROM E) SELECT first_name AS target, count(*) AS links, string_agg(name, ',' ORDER BY name) AS names FROM f GROUP BY first_name HAVING count(*) > 1")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hardlink_groups(spark, sf_dir).select("name", F.coalesce("target", "name").alias("target"))
    return h.groupBy("target").agg(F.count("*").alias("links"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names")).filter("links > 1")


@query("file_dedup", f"WITH {P_SQL} SELECT ord, name, canonical_ord, is_canonical FROM P")
def file_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = layout.file_dedup(_entries(spark, sf_dir).drop("content"))
    return d.select("ord", "name", "canonical_ord", (F.col("ord") == F.col("canonical_ord")).alias("is_canonical"))


@query("file_dedup_max_refs", f"WITH {E_SQL}, r AS (SELECT *, (row_number() OVER (PARTITION BY content_hash, length ORDER BY ord) - 1) // 3 AS j FROM E) SELECT ord, min(ord) OVER (PARTITION BY content_hash, length, j) AS canonical_ord FROM r")
def file_dedup_max_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.file_dedup(_entries(spark, sf_dir).drop("content"), 3).select("ord", "canonical_ord")


@query("stream_layout", f"WITH {P_SQL} SELECT ord, name, length, stream_offset, is_canonical FROM P")
def stream_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("ord", "name", "length", "stream_offset", "is_canonical")


@query("stream_layout_aligned", f"WITH {P_SQL.replace('THEN length ELSE 0 END', f'THEN (length + {ALIGN - 1}) // {ALIGN} * {ALIGN} ELSE 0 END')} SELECT ord, stream_offset, is_canonical FROM P")
def stream_layout_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, ALIGN).select("ord", "stream_offset", "is_canonical")


@query("manifest_totals", f"WITH {P_SQL} SELECT count(*) AS entries, sum(length)::BIGINT AS entry_bytes, sum(CASE WHEN NOT is_canonical THEN length ELSE 0 END)::BIGINT AS shared_bytes, sum(CASE WHEN is_canonical THEN length ELSE 0 END)::BIGINT AS stream_length, count(*) FILTER (NOT is_canonical AND length > 0) AS alias_extents FROM P")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.totals(_placed(spark, sf_dir))


@query("extent_refs", f"WITH {P_SQL} SELECT ord, stream_offset, length, count(*) OVER (PARTITION BY stream_offset, length) AS refs FROM P WHERE length > 0")
def extent_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _placed(spark, sf_dir).filter("length > 0").select("ord", "stream_offset", "length")
    return p.join(p.groupBy("stream_offset", "length").agg(F.count("*").alias("refs")), ["stream_offset", "length"])


@query("set_identity", f"WITH {E_SQL} SELECT name, sha256('file id' || length || content_hash || name) AS file_id FROM E")
def set_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(_docs(spark, sf_dir)).select("name", F.sha2(F.concat(F.lit("file id"), F.col("length").cast("string"), "content_hash", "name"), 256).alias("file_id"))


@query("name_collisions", f"WITH {E_SQL}, n AS (SELECT lower(regexp_replace(name, '[0-9]{{6}}', '')) AS folded, name FROM E) SELECT folded, count(*) AS n, min(name) AS first_name FROM n GROUP BY folded HAVING count(*) > 1")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = named(_docs(spark, sf_dir)).select(F.lower(F.regexp_replace("name", "[0-9]{6}", "")).alias("folded"), "name")
    return n.groupBy("folded").agg(F.count("*").alias("n"), F.min("name").alias("first_name")).filter("n > 1")


# ---- geometry and planning


@query("geometry_plan", f"""WITH {P_SQL}, z AS (SELECT len, least(greatest((len // 4000 + 63) // 64 * 64, 4096), 4194304) AS z FROM L), g AS (SELECT *, (len + z - 1) // z AS s FROM z)
SELECT len AS stream_length, z AS slice_size, s AS slices, greatest(4096, least(65536, z // 64 * 64)) AS cell_size, (z + greatest(4096, least(65536, z // 64 * 64)) - 1) // greatest(4096, least(65536, z // 64 * 64)) AS cells, greatest(1, (s + 19) // 20) AS recovery FROM g""")  # fmt: skip
def geometry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _length(_placed(spark, sf_dir))
    z = planner.slice_size(n)
    s, y = -(-n // z), planner.cell_size(z)
    return spark.createDataFrame([(n, z, s, y, -(-z // y), planner.recovery_slices(None, s, z))], "stream_length long, slice_size long, slices long, cell_size long, cells long, recovery long")


_SPECS = (None, "12", "15%", "10%", "0.3%", "1.5x", "10M", "64K", "100KB")


@query("redundancy_specs", """WITH s(slices, z) AS (VALUES (245, 4096), (3956, 5056), (48, 2097152)),
p(spec, kind, n) AS (VALUES (NULL, 'none', 0), ('12', 'count', 12), ('15%', 'pct', 15), ('10%', 'pct', 10), ('0.3%', 'pct', 0.3), ('1.5x', 'times', 1.5), ('10M', 'bytes', 10485760), ('64K', 'bytes', 65536), ('100KB', 'bytes', 100000))
SELECT slices, z AS slice_size, coalesce(spec, '-') AS spec, greatest(1, CASE kind WHEN 'none' THEN ceil(slices / 20.0) WHEN 'count' THEN n WHEN 'pct' THEN floor(slices * n / 100 + 0.5) WHEN 'times' THEN floor(slices * n + 0.5) ELSE ceil(n / z::DOUBLE) END)::BIGINT AS recovery FROM s, p""")  # fmt: skip
def redundancy_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, z, x or "-", planner.recovery_slices(x, s, z)) for s, z in ((245, 4096), (3956, 5056), (48, 2097152)) for x in _SPECS]
    return spark.createDataFrame(rows, "slices long, slice_size long, spec string, recovery long")


_LADDERS = (1, 5, 7, 37, 64, 396)


@query("volume_ladder", f"""WITH RECURSIVE r(recovery) AS (VALUES {", ".join(f"({x})" for x in _LADDERS)}),
w(recovery, volume, first, step, n) AS (SELECT recovery, 0, 0, 1, CASE WHEN 2 > recovery THEN recovery ELSE 1 END FROM r
 UNION ALL SELECT recovery, volume + 1, first + n, step * 2, CASE WHEN first + n + 4 * step > recovery THEN recovery - first - n ELSE 2 * step END FROM w WHERE first + n < recovery)
SELECT recovery, volume, first, n AS count FROM w""")  # fmt: skip
def volume_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r, i, sum(x[:i]), n) for r in _LADDERS for x in [planner.ladder(r)] for i, n in enumerate(x)]
    return spark.createDataFrame(rows, "recovery int, volume int, first int, count int")


@query("replication_schedule", "SELECT v AS volume, c AS critical, (c <= greatest(1048576, (40 * 4194304) // 20) OR v = 0 OR v = 39 OR (v > 0 AND v & (v - 1) = 0)) AS replicated FROM unnest(range(0, 40)) AS t(v), unnest([1000, 9000000]) AS u(c)")
def replication_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.range(40).select(F.col("id").alias("volume"), F.explode(F.array(F.lit(1000).cast("long"), F.lit(9_000_000).cast("long"))).alias("critical"))
    return d.select("volume", "critical", planner.replicate(F.col("volume"), F.lit(39), F.col("critical"), F.lit(40 * 4 * planner.MIB)).alias("replicated"))


def _rate(codec: str, i: int | None = None, of: dict = planner.RATES) -> str:
    return f"CASE bits WHEN 8 THEN {of[codec, 8][i]} ELSE {of[codec, 16][i]} END"


@query("planner_candidates", f"""WITH s(slices, recovery) AS (VALUES (48, 5), (245, 37), (3956, 396), (20000, 4000)), c(n, codec, bits) AS (VALUES (0, 'matrix', 8), (1, 'fft', 8), (2, 'matrix', 16), (3, 'fft', 16)),
x AS (SELECT *, pow(2, ceil(log2(recovery)))::BIGINT AS m, CASE WHEN recovery <= 1024 THEN recovery WHEN (recovery + 1) // 2 <= 1024 THEN (recovery + 1) // 2 ELSE ((recovery + 1) // 2 + 1) // 2 END AS per FROM s, c),
y AS (SELECT *, (slices + m) / 2 * greatest(1, log2(m)) AS half, 1048576::DOUBLE AS z FROM x), w AS (SELECT *, CASE codec WHEN 'matrix' THEN slices::DOUBLE * recovery * z ELSE half * z END AS work, CASE codec WHEN 'matrix' THEN per * z ELSE (slices + m) * z END AS held, CASE codec WHEN 'matrix' THEN (recovery + per - 1) // per ELSE 1 END AS passes FROM y
 WHERE CASE codec WHEN 'matrix' THEN slices + recovery <= pow(2, bits) ELSE m + slices <= pow(2, bits) AND slices * recovery >= 20 * half END),
r AS (SELECT *, CASE WHEN codec = 'matrix' THEN CASE WHEN held <= 16777216 THEN {_rate('matrix', 0)} WHEN held <= 134217728 THEN {_rate('matrix', 1)} ELSE {_rate('matrix', 2)} END ELSE CASE WHEN held <= 16777216 THEN {_rate('fft', 0)} WHEN held <= 134217728 THEN {_rate('fft', 1)} ELSE {_rate('fft', 2)} END END AS rate,
 CASE codec WHEN 'matrix' THEN {_rate('matrix', 0, planner.DECODE)} ELSE {_rate('fft', 0, planner.DECODE)} END AS repair, CASE codec WHEN 'matrix' THEN {_rate('matrix', 1, planner.DECODE)} ELSE 0 END AS setup FROM w), t AS (SELECT *, work / rate + (slices * z / repair + setup) + passes * {planner.SEEK_US['ssd']} AS score_us FROM r)
SELECT slices, recovery, (row_number() OVER (PARTITION BY slices, recovery ORDER BY score_us, n) - 1)::INT AS rank, codec, bits AS field, score_us, passes::INT AS passes, printf('%.1f MB of work at %d MB/s, %d passes', work / 1e6, rate::BIGINT, passes::BIGINT) AS why FROM t""")  # fmt: skip
def planner_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, r, i, c.codec, c.bits, c.score_us, c.passes, c.why) for s, r in ((48, 5), (245, 37), (3956, 396), (20000, 4000)) for i, c in enumerate(planner.candidates(s, r, 1 << 20))]
    return spark.createDataFrame(rows, "slices int, recovery int, rank int, codec string, field int, score_us double, passes int, why string")


@query("size_parse", """WITH v(t) AS (VALUES ('10'), ('4K'), ('1.5M'), ('4KB'), ('2g'), ('1.5'), ('x'), ('3TB'), (' 7 ')), m AS (SELECT t, regexp_extract(lower(trim(t)), '^(\\d+)(\\.\\d+)?([kmgt]?)(b?)$', ['a', 'f', 'u', 'b']) AS g FROM v)
SELECT t AS spec, CASE WHEN g.a <> '' AND NOT (g.f <> '' AND g.u = '') THEN floor((g.a || g.f)::DOUBLE * pow(CASE WHEN g.b = 'b' THEN 1000 ELSE 1024 END, CASE g.u WHEN 'k' THEN 1 WHEN 'm' THEN 2 WHEN 'g' THEN 3 WHEN 't' THEN 4 ELSE 0 END))::BIGINT END AS bytes FROM m""".replace("\\\\", "\\"))
def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(x,) for x in ("10", "4K", "1.5M", "4KB", "2g", "1.5", "x", "3TB", " 7 ")], "spec string")
    return d.select("spec", text.size_bytes(F.col("spec")).alias("bytes"))


# ---- slices, cells, spans


@query("slice_table", f"WITH {S_SQL} SELECT * FROM S")
def slice_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir)


@query("cell_table", f'WITH {C_SQL} SELECT slice, col, "begin", size, "real" FROM C')
def cell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query("slice_spans", f"WITH {SPAN_SQL} SELECT slice, ord, span_begin, span_end FROM X")
def slice_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spans(_placed(spark, sf_dir).filter("is_canonical"), Z).select("slice", "ord", "span_begin", "span_end")


@query("entry_fanout_per_slice", f"WITH {SPAN_SQL} SELECT slice, count(DISTINCT ord) AS entries, sum(span_end - span_begin)::BIGINT AS bytes FROM X GROUP BY slice")
def entry_fanout_per_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_spans(spark, sf_dir).groupBy("slice").agg(F.countDistinct("ord").alias("entries"), F.sum(F.col("span_end") - F.col("span_begin")).alias("bytes"))


@query("stream_read", f"WITH {SPAN_SQL} SELECT slice, ord, sha256(encode(text)[(span_begin - stream_offset + 1):(span_end - stream_offset)]) AS piece_sha256 FROM X")
def stream_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout.spans(_placed(spark, sf_dir, content=True).filter("is_canonical"), Z)
    return s.select("slice", "ord", F.sha2(F.expr("substring(content, int(span_begin - stream_offset + 1), int(span_end - span_begin))"), 256).alias("piece_sha256"))


@query("slice_digest", f"WITH {SPAN_SQL}, H AS (SELECT slice, string_agg(hex(encode(text)[(span_begin - stream_offset + 1):(span_end - stream_offset)]), '' ORDER BY span_begin) AS h FROM X GROUP BY slice) SELECT slice, sha256(unhex(rpad(h, {2 * Z}, '0'))) AS digest FROM H")
def slice_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slice_data(spark, sf_dir).select("slice", F.sha2("data", 256).alias("digest"))


CRC_SQL = """RECURSIVE tb(i, k, c) AS (SELECT i, 0, i FROM unnest(range(0, 256)) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END FROM tb WHERE k < 8),
tt AS (SELECT list(c ORDER BY i) AS t FROM tb WHERE k = 8)"""


@query("slice_crc32c", f"""WITH {CRC_SQL}, {SPAN_SQL}, H AS (SELECT slice, rpad(string_agg(hex(encode(text)[(span_begin - stream_offset + 1):(span_end - stream_offset)]), '' ORDER BY span_begin), {2 * Z}, '0') AS h FROM X GROUP BY slice),
v AS (SELECT slice, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS bs FROM H)
SELECT slice, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS crc32c FROM v, tt""")
def slice_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(_slice_data(spark, sf_dir), "data", "crc32c").select("slice", "crc32c")


@query("blake3_entries")
def blake3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(named(_docs(spark, sf_dir)).select("name", "content"), "content", "blake3", "blake3").select("name", "blake3")


_VOLUMES = "SELECT s_suppkey // 10 AS set_no, s_suppkey AS volume, (s_suppkey % 10) * 100 + CASE WHEN s_suppkey % 13 = 0 THEN 5 ELSE 0 END AS \"begin\", 100 + CASE WHEN s_suppkey % 7 = 0 THEN 4 ELSE 0 END AS bytes FROM supplier"


@query("layout_tiles", f"""WITH v AS ({_VOLUMES}), w AS (SELECT *, coalesce(lag("begin" + bytes) OVER (PARTITION BY set_no ORDER BY "begin"), 0) AS due, lead("begin") OVER (PARTITION BY set_no ORDER BY "begin") IS NULL AS last FROM v)
SELECT set_no, volume, "begin", bytes, CASE WHEN "begin" > due THEN 'gap' WHEN "begin" < due THEN 'overlap' WHEN last AND "begin" + bytes < 1000 THEN 'short' WHEN last AND "begin" + bytes > 1000 THEN 'long' ELSE 'ok' END AS status FROM w""")
def layout_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(F.floor(s / 10).alias("set_no"), s.alias("volume"), (s % 10 * 100 + F.when(s % 13 == 0, 5).otherwise(0)).alias("begin"), (F.lit(100) + F.when(s % 7 == 0, 4).otherwise(0)).cast("long").alias("bytes"))
    return layout.tiling(v, 1000, ["set_no"])


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", (F.col("l_partkey") % 300).alias("begin"), (F.col("l_partkey") % 300 + F.col("l_quantity").cast("long")).alias("end"))


_EDITS = 'SELECT l_orderkey, l_partkey % 300 AS "begin", l_partkey % 300 + l_quantity::BIGINT AS "end" FROM lineitem'


@query("write_coalesce", f"""WITH e AS ({_EDITS}), t AS (SELECT *, max("end") OVER (PARTITION BY l_orderkey ORDER BY "begin", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR "begin" > top THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY "begin", "end" ROWS UNBOUNDED PRECEDING) AS k FROM t)
SELECT l_orderkey, min("begin") AS "begin", max("end") AS "end", count(*) AS n FROM i GROUP BY l_orderkey, k""")
def write_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.islands(_edits(spark, sf_dir), ["l_orderkey"])


_EXTENTS = "SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber * 10 + CASE WHEN l_linenumber % 3 = 0 THEN 5 ELSE 0 END AS off, CASE WHEN l_linenumber % 3 = 2 THEN 15 ELSE 10 END AS len FROM lineitem"


@query("extent_coalesce", f"""WITH e AS ({_EXTENTS}), g AS (SELECT *, CASE WHEN lag(off + len) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = off THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM g) SELECT l_orderkey, min(off)::BIGINT AS off, sum(len)::BIGINT AS len, count(*) AS n FROM r GROUP BY l_orderkey, k""")
def extent_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", n, (n * 10 + F.when(n % 3 == 0, 5).otherwise(0)).cast("long").alias("off"), F.when(n % 3 == 2, 15).otherwise(10).cast("long").alias("len")).distinct()
    return layout.coalesced(e, ["l_orderkey"], "l_linenumber", "off", "len")


@query("highwater_validate", """WITH e AS (SELECT l_orderkey, l_linenumber, min(l_partkey % 40) AS off, min(l_quantity)::BIGINT AS len FROM lineitem GROUP BY l_orderkey, l_linenumber),
h AS (SELECT *, coalesce(max(off + len) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS high_water FROM e)
SELECT *, CASE WHEN off = high_water THEN 'canonical' WHEN off + len <= high_water THEN 'shared' WHEN off < high_water THEN 'split' WHEN off - high_water < 8 THEN 'pad' ELSE 'forward' END AS kind FROM h""")
def highwater_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey") % 40).alias("off"), F.min("l_quantity").cast("long").alias("len"))
    return layout.highwater(e, "l_linenumber", "off", "len", 8, ["l_orderkey"])


@query("extent_overlaps", f"""WITH e AS (SELECT l_orderkey // 2 * 400 AS o, * FROM ({_EDITS}) WHERE "end" > "begin"), a AS (SELECT l_orderkey AS l_key, "begin" + o AS l_begin, "end" + o AS l_end FROM e WHERE l_orderkey % 2 = 0), b AS (SELECT l_orderkey AS r_key, o AS ro, "begin" + o AS r_begin, "end" + o AS r_end FROM e WHERE l_orderkey % 2 = 1)
SELECT l_key, l_begin, l_end, r_key, r_begin, r_end FROM a JOIN b ON l_key // 2 = r_key // 2 AND l_begin < r_end AND r_begin < l_end""")
def extent_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of an even order against those of the next odd one, all on one line (400 apart, so other orders never meet)."""
    e = _edits(spark, sf_dir).filter(F.col("end") > F.col("begin")).withColumn("o", F.floor(F.col("l_orderkey") / 2) * 400)
    a = e.filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("l_key"), (F.col("begin") + F.col("o")).alias("l_begin"), (F.col("end") + F.col("o")).alias("l_end"))
    b = e.filter("l_orderkey % 2 = 1").select(F.col("l_orderkey").alias("r_key"), (F.col("begin") + F.col("o")).alias("r_begin"), (F.col("end") + F.col("o")).alias("r_end"))
    return layout.overlap_join(a, b, 64)


# ---- damage and verdicts


def _bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).filter(DAMAGED).select("slice", "col")


@query("damage_erasures", f"WITH {C_SQL} SELECT slice, col FROM B")
def damage_erasures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bad(spark, sf_dir)


@query("column_depth", f"WITH {C_SQL} SELECT col, count(*) AS erased FROM B GROUP BY col")
def column_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.erasure_depth(_bad(spark, sf_dir))


@query("column_groups", f"WITH {C_SQL}, g AS (SELECT col, string_agg(slice::VARCHAR, ',' ORDER BY slice) AS pattern, count(*) AS depth FROM B GROUP BY col) SELECT depth, count(*) AS columns, min(col) AS first_col FROM g GROUP BY pattern, depth")
def column_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_groups(_bad(spark, sf_dir)).select("depth", "columns", "first_col")


@query("verify_verdict", f"""WITH {C_SQL}, dm AS (SELECT coalesce(max(n), 0) AS depth, coalesce(sum(n), 0)::BIGINT AS cells_bad FROM (SELECT count(*) AS n FROM B GROUP BY col)), b2 AS (SELECT count(DISTINCT slice) AS slices_bad FROM B)
SELECT cells_bad, slices_bad, depth AS column_depth, {RECOVERY} AS recovery, CASE WHEN cells_bad = 0 THEN 0 WHEN depth <= {RECOVERY} THEN 1 ELSE 2 END AS exit, CASE WHEN cells_bad = 0 THEN 'clean' WHEN depth <= {RECOVERY} THEN 'repairable' ELSE 'unrepairable' END AS status FROM dm, b2""")  # fmt: skip
def verify_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _bad(spark, sf_dir)
    # one row each
    d = layout.erasure_depth(bad).agg(F.coalesce(F.max("erased"), F.lit(0)).alias("column_depth"), F.coalesce(F.sum("erased"), F.lit(0)).alias("cells_bad"), F.lit(0).alias("one"))
    s = bad.agg(F.countDistinct("slice").alias("slices_bad"), F.lit(0).alias("one"))
    code, status = layout.verdict(F.col("cells_bad"), F.col("column_depth"), F.lit(RECOVERY))
    return d.join(s, "one").select("cells_bad", "slices_bad", "column_depth", F.lit(RECOVERY).alias("recovery"), code.alias("exit"), status.alias("status"))


@query("chain_verdict", "WITH v AS (SELECT n_regionkey AS set_no, n_nationkey AS generation, (n_nationkey * 7) % 5 AS bad, n_nationkey % 4 AS depth FROM nation) SELECT set_no, max(CASE WHEN bad = 0 THEN 0 WHEN depth <= 2 THEN 1 ELSE 2 END) AS exit, count(*) AS generations FROM v GROUP BY set_no")
def chain_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    code, _ = layout.verdict(n * 7 % 5, n % 4, F.lit(2))
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("set_no")).agg(F.max(code).alias("exit"), F.count("*").alias("generations"))


@query("verify_entries", f"""WITH {SPAN_SQL}, B AS (SELECT slice, c AS col FROM S, unnest(range(0, {K})) AS u(c) WHERE (slice * 31 + c * 17) % 97 = 0),
h AS (SELECT DISTINCT X.ord FROM X JOIN B ON B.slice = X.slice AND X.span_begin < B.slice * {Z} + (B.col + 1) * {Y} AND X.span_end > B.slice * {Z} + B.col * {Y})
SELECT P.ord, P.name, CASE WHEN h.ord IS NULL THEN 'ok' WHEN P.is_canonical THEN 'damaged' ELSE 'damaged_alias' END AS status FROM P LEFT JOIN h ON P.canonical_ord = h.ord""")
def verify_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _placed(spark, sf_dir)
    cells = _bad(spark, sf_dir).select("slice", (F.col("slice") * Z + F.col("col") * Y).alias("c0"))
    x = layout.spans(p.filter("is_canonical"), Z).join(cells, "slice").filter((F.col("span_begin") < F.col("c0") + Y) & (F.col("span_end") > F.col("c0")))
    hit = x.select(F.col("ord").alias("canonical_ord"), F.lit(True).alias("hit")).distinct()
    status = F.when(F.col("hit").isNull(), "ok").when(F.col("is_canonical"), "damaged").otherwise("damaged_alias")
    return p.join(hit, "canonical_ord", "left").select("ord", "name", status.alias("status"))


@query("copy_sources", f"""WITH {P_SQL}, r AS (SELECT ord, stream_offset AS a, stream_offset + length AS b FROM P WHERE ord % 5 = 0 AND length > 0), o AS (SELECT ord AS src, stream_offset AS c, stream_offset + length AS d FROM P WHERE ord % 5 <> 0 AND length > 0)
SELECT ord, min(src) AS source_ord FROM r JOIN o ON c <= a AND b <= d GROUP BY ord""")
def copy_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged entries whose bytes an intact entry holds as well, with the first such."""
    p = _placed(spark, sf_dir).filter("length > 0").withColumn("end", F.col("stream_offset") + F.col("length"))
    bad = p.filter("ord % 5 = 0").select("ord", F.col("stream_offset").alias("l_begin"), F.col("end").alias("l_end"))
    # copies are one source, so a text that many entries share meets each of its damaged copies once
    good = p.filter("ord % 5 <> 0").groupBy(F.col("stream_offset").alias("r_begin"), F.col("end").alias("r_end")).agg(F.min("ord").alias("src"))
    j = layout.overlap_join(bad, good, 1 << 16).filter((F.col("r_begin") <= F.col("l_begin")) & (F.col("l_end") <= F.col("r_end")))
    return j.groupBy("ord").agg(F.min("src").alias("source_ord"))


# ---- coding

GF_SQL = """RECURSIVE g(i, x) AS (SELECT 0, 1 UNION ALL SELECT i + 1, CASE WHEN x * 2 >= 256 THEN xor(x * 2, 285) ELSE x * 2 END FROM g WHERE i < 254)"""
#: the stream is coded in sets of so many slices (of a multiple of 64 bytes each, at most Z_MOST) with so many recovery slices each
S_CODE, R_CODE, Z_MOST = 200, 4, 4 << 20
LOST = (3, 17, 20, 31)


@query("gf8_tables", f"WITH {GF_SQL} SELECT i AS exponent, x AS value FROM g")
def gf8_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, int(gf.tables(8)[0][i])) for i in range(255)], "exponent int, value int")


@query("cauchy_coefficients", f"WITH {GF_SQL} SELECT e AS exponent, d AS data, q.x AS coefficient FROM unnest(range(0, {R_CODE})) AS a(e), unnest(range(0, {S_CODE})) AS b(d) JOIN g p ON p.x = xor((255 - e)::INT, d::INT) JOIN g q ON q.i = (255 - p.i) % 255")
def cauchy_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e, d, int(gf.coefficient(e, d))) for e in range(R_CODE) for d in range(S_CODE)]
    return spark.createDataFrame(rows, "exponent long, data long, coefficient int")


def _code_size(spark: SparkSession, sf_dir: str) -> int:
    return min(Z_MOST, planner.slice_size(_length(_placed(spark, sf_dir)), wanted=S_CODE))


def _code_slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The whole stream in slices, S_CODE to a set."""
    z = _code_size(spark, sf_dir)
    return staged(_slice_data(spark, sf_dir, z)), z


CODE_SQL = f"""{P_SQL}, zz AS (SELECT len, least({Z_MOST}, ((len + {S_CODE - 1}) // {S_CODE} + 63) // 64 * 64) AS z FROM L), w0 AS (SELECT string_agg(hex(encode(text)), '' ORDER BY stream_offset) AS h FROM P WHERE is_canonical AND length > 0),
cd AS (SELECT i AS slice, z, rpad(substr(h, (2 * i * z + 1)::BIGINT, (2 * z)::BIGINT), (2 * z)::INT, '0') AS h FROM w0, zz, unnest(range(0, (len + z - 1) // z)) AS t(i))"""


@query("gf8_encode", f"""WITH {GF_SQL}, {CODE_SQL}, hx AS (SELECT slice, regexp_extract_all(h, '..') AS hs FROM cd), b AS (SELECT slice, p - 1 AS p, ('0x' || x2)::INT AS v FROM (SELECT slice, unnest(hs) AS x2, generate_subscripts(hs, 1) AS p FROM hx)),
c AS (SELECT e, s, (255 - q.i) % 255 AS lg FROM unnest(range(0, {R_CODE})) AS a(e), unnest(range(0, {S_CODE})) AS z(s) JOIN g q ON q.x = xor((255 - e)::INT, s::INT)),
m AS (SELECT b.slice // {S_CODE} AS set_no, e, p, bit_xor(coalesce(y.x, 0)) AS v FROM b JOIN c ON c.s = b.slice % {S_CODE} LEFT JOIN g w ON w.x = b.v LEFT JOIN g y ON y.i = (w.i + c.lg) % 255 GROUP BY b.slice // {S_CODE}, e, p)
SELECT set_no, e AS exponent, sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY p))) AS digest FROM m GROUP BY set_no, e""")
def gf8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, z = _code_slices(spark, sf_dir)
    return coding.encode_sets(s, S_CODE, R_CODE, z).select("set_no", "exponent", F.sha2("data", 256).alias("digest"))


def _roundtrip(spark: SparkSession, sf_dir: str, lost: tuple[int, ...], bits: int) -> DataFrame:
    s, z = _code_slices(spark, sf_dir)
    s = s.filter(F.col("slice") < S_CODE)  # the first set
    recovery = staged(coding.encode(s, len(lost), z, bits))
    return coding.decode(s, recovery, list(lost), z, bits).select("slice", F.sha2("data", 256).alias("digest"))


@query("gf8_decode_roundtrip", f"WITH {CODE_SQL} SELECT slice, sha256(unhex(h)) AS digest FROM cd WHERE slice IN {LOST}")
def gf8_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, LOST, 8)


@query("gf16_decode_roundtrip", f"WITH {CODE_SQL} SELECT slice, sha256(unhex(h)) AS digest FROM cd WHERE slice IN {LOST[:2]}")
def gf16_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, LOST[:2], 16)


@query("recovery_added", ORACLES["gf8_encode"])
def recovery_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More recovery slices for a set that has some: rows don't depend on one another."""
    s, z = _code_slices(spark, sf_dir)
    return coding.encode_sets(s, S_CODE, 2, z).union(coding.encode_sets(s, S_CODE, 2, z, first=2)).select("set_no", "exponent", F.sha2("data", 256).alias("digest"))


@query("stream_encode", ORACLES["gf8_encode"])
def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _code_size(spark, sf_dir)
    s = _slice_data(spark, sf_dir, z)
    path = f"{shared_dir(spark)}/slices-{np.random.default_rng().integers(1 << 62):x}"
    s.repartition(4, "slice").write.parquet(path)
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return encode_stream(spark, stream, R_CODE, z, per_set=S_CODE).select("set_no", "exponent", F.sha2("data", 256).alias("digest"))


@query("inner_rs_scrub")
def inner_rs_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries in codewords, an eighth of them damaged by a rule, and what correction finds: errors, status, codewords, wrong."""
    code = rs.Code()

    def run(batches):
        for b in batches:
            numbers, blobs = b.column(0).to_numpy(), [x or b"" for x in b.column(1).to_pylist()]
            for lo, hi in together(blobs):
                frames = np.array([-(-len(x) // code.k) for x in blobs[lo:hi]])
                plain = b"".join(x.ljust(n * code.k, b"\0") for x, n in zip(blobs[lo:hi], frames.tolist()))
                words = rs.encode_many(np.frombuffer(plain, np.uint8).reshape(-1, code.k), code)
                number, frame = np.repeat(numbers[lo:hi], frames), np.arange(len(words)) - np.repeat(np.cumsum(frames) - frames, frames)
                hurt = np.where((number + frame) % 8 == 0, (number * 31 + frame) % 19, 0)
                errors, fixed = rs.correct_many(damage.bursts(words, hurt, (number + frame) % 200), code)
                right = (errors < 0) | (fixed == words).all(axis=1)
                yield pa.record_batch([pa.array(errors, pa.int64()), pa.array(right)], ["errors", "right"])

    r = contents(_docs(spark, sf_dir)).mapInArrow(run, "errors long, right boolean")
    status = F.when(F.col("errors") < 0, "failed").when(F.col("errors") == 0, "clean").otherwise("corrected")
    return r.groupBy("errors").agg(F.count("*").alias("codewords"), F.sum(F.when(~F.col("right"), 1).otherwise(0)).alias("wrong")).withColumn("status", status)


@query("scrub_histogram", "WITH f AS (SELECT (l_partkey * 7 + l_linenumber) % 19 AS errors FROM lineitem) SELECT errors, CASE WHEN errors = 0 THEN 'clean' WHEN errors <= 16 THEN 'corrected' ELSE 'failed' END AS status, count(*) AS codewords, sum(errors)::BIGINT AS symbols FROM f GROUP BY errors")
def scrub_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("errors")
    f = table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 19).alias("errors"))
    return f.groupBy("errors").agg(F.count("*").alias("codewords"), F.sum("errors").alias("symbols")).withColumn("status", F.when(e == 0, "clean").when(e <= 16, "corrected").otherwise("failed"))


@query("cdc_chunks")
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.dedup(chunking.chunks(_entries(spark, sf_dir), 1024))


# ---- generations


LOWER = "abcdefghijklmnopqrstuvwxyz"


def _g0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(_docs(spark, sf_dir).filter("doc_id % 10 <> 0")).select("name", "length", "content_hash")


def _g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("doc_id") % 5 == 0, F.translate("text", LOWER, LOWER.upper())).otherwise(F.col("text"))
    return named(_docs(spark, sf_dir).filter("doc_id % 7 <> 0").withColumn("text", changed)).select("name", "length", "content_hash")


G_SQL = f"""n AS (SELECT doc_id, source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') AS name, text AS t0, CASE WHEN doc_id % 5 = 0 THEN translate(text, '{LOWER}', '{LOWER.upper()}') ELSE text END AS t1 FROM documents),
g0 AS (SELECT name, strlen(t0)::BIGINT AS length, sha256(t0) AS content_hash FROM n WHERE doc_id % 10 <> 0), g1 AS (SELECT name, strlen(t1)::BIGINT AS length, sha256(t1) AS content_hash FROM n WHERE doc_id % 7 <> 0),
df AS (SELECT coalesce(g0.name, g1.name) AS name, CASE WHEN g0.name IS NULL THEN 'added' WHEN g1.name IS NULL THEN 'dropped' WHEN g0.content_hash = g1.content_hash AND g0.length = g1.length THEN 'inherited' ELSE 'changed' END AS change, g0.length AS old_length, g1.length AS new_length FROM g0 FULL OUTER JOIN g1 ON g0.name = g1.name)"""
X_SQL = f"""{G_SQL}, x0 AS (SELECT name, length, (sum(length) OVER (ORDER BY name) - length)::BIGINT AS stream_offset FROM g0), l0 AS (SELECT sum(length)::BIGINT AS l FROM g0),
x1 AS (SELECT name, new_length AS length, (l + sum(new_length) OVER (ORDER BY name) - new_length)::BIGINT AS stream_offset FROM df, l0 WHERE change IN ('added', 'changed')),
head AS (SELECT x0.name, x0.length, x0.stream_offset FROM x0 JOIN df ON df.name = x0.name AND change = 'inherited' UNION ALL SELECT * FROM x1),
own AS (SELECT head.*, CASE WHEN stream_offset + length <= l THEN 0 ELSE 1 END AS owner FROM head, l0)"""


def _head(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(extents of the head with stream offsets, generations): inherited entries stay where the first generation stored them."""
    g0, d = _g0(spark, sf_dir), chain.diff(_g0(spark, sf_dir), _g1(spark, sf_dir))
    x0 = running_ordered(g0.select("name", "length"), "name", F.col("length"), "stream_offset")
    base = g0.agg(F.sum("length")).first()[0] or 0
    new = d.filter(F.col("change").isin("added", "changed")).select("name", F.col("new_length").alias("length"))
    x1 = running_ordered(new, "name", F.col("length"), "stream_offset").withColumn("stream_offset", F.col("stream_offset") + base)
    kept = x0.join(d.filter("change = 'inherited'").select("name"), "name", "left_semi")
    added = new.agg(F.sum("length")).first()[0] or 0
    gens = spark.createDataFrame([(0, 0, base), (1, base, added)], "generation int, stream_base long, stream_length long")
    return kept.select("name", "length", "stream_offset").union(x1.select("name", "length", "stream_offset")), gens


@query("generation_diff", f"WITH {G_SQL} SELECT name, change, old_length, new_length FROM df")
def generation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.diff(_g0(spark, sf_dir), _g1(spark, sf_dir)).select("name", "change", "old_length", "new_length")


@query("generation_counts", f"WITH {G_SQL} SELECT change, count(*) AS entries FROM df GROUP BY change")
def generation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation_diff(spark, sf_dir).groupBy("change").agg(F.count("*").alias("entries"))


@query("superseded", f"WITH {G_SQL} SELECT g0.name, g0.length FROM g0 WHERE NOT EXISTS (SELECT 1 FROM g1 WHERE g1.name = g0.name AND g1.content_hash = g0.content_hash)")
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.superseded(_g0(spark, sf_dir), _g1(spark, sf_dir), ["name", "content_hash"]).select("name", "length")


@query("ancestor_content", f"WITH {G_SQL}, c AS (SELECT df.name, g1.content_hash, g1.length FROM df JOIN g1 ON g1.name = df.name WHERE change IN ('added', 'changed')) SELECT c.name, min(g0.name) AS found FROM c LEFT JOIN g0 ON g0.content_hash = c.content_hash AND g0.length = c.length GROUP BY c.name")
def ancestor_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chain.diff(_g0(spark, sf_dir), _g1(spark, sf_dir)).filter(F.col("change").isin("added", "changed")).select("name", F.col("new_content_hash").alias("content_hash"), F.col("new_length").alias("length"))
    old = _g0(spark, sf_dir).groupBy("content_hash", "length").agg(F.min("name").alias("found"))
    return d.join(old, ["content_hash", "length"], "left").select("name", "found")


@query("generation_deps", f"WITH {X_SQL} SELECT owner, count(DISTINCT name) AS entries, sum(length)::BIGINT AS bytes FROM own GROUP BY owner")
def generation_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, gens = _head(spark, sf_dir)
    return chain.dependencies(chain.owner_of(x, gens))


@query("prune_orphans", f"WITH {X_SQL} SELECT g1.name, g1.length FROM g1 WHERE name IN (SELECT name FROM own WHERE owner = 0)")
def prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, gens = _head(spark, sf_dir)
    return chain.orphans(_g1(spark, sf_dir), chain.owner_of(x, gens), [0]).select("name", "length")


@query("consolidate_report", f"WITH {X_SQL}, t AS (SELECT (SELECT l FROM l0) + (SELECT sum(length) FROM x1) AS total, (SELECT sum(length) FROM head) AS live) SELECT total::BIGINT AS total_bytes, live::BIGINT AS live_bytes, (total - live)::BIGINT AS reclaim_bytes, floor(100 * (total - live) / total)::BIGINT AS reclaim_pct FROM t")
def consolidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, gens = _head(spark, sf_dir)
    live = x.agg(F.sum("length").alias("live_bytes"), F.lit(0).alias("one"))
    total = gens.agg(F.sum("stream_length").alias("total_bytes"), F.lit(0).alias("one"))
    gone = F.col("total_bytes") - F.col("live_bytes")
    return live.join(total, "one").select("total_bytes", "live_bytes", gone.alias("reclaim_bytes"), F.floor(100 * gone / F.col("total_bytes")).alias("reclaim_pct"))


_TREE = "SELECT n_nationkey AS generation, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS parent FROM nation"
UP_SQL = f"RECURSIVE gen AS ({_TREE}), up(generation, ancestor, parent, depth) AS (SELECT generation, generation, parent, 0 FROM gen UNION ALL SELECT u.generation, gen.generation, gen.parent, u.depth + 1 FROM up u JOIN gen ON gen.generation = u.parent)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("generation"), F.when(n > 0, F.floor((n - 1) / 2).cast("int")).alias("parent"))


@query("lineage", f"WITH {UP_SQL} SELECT generation, ancestor, depth FROM up")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.lineage(_tree(spark, sf_dir))


@query("nearest_ancestor", f"WITH {UP_SQL}, f AS (SELECT DISTINCT (s_suppkey % 25)::INT AS generation, s_nationkey AS file_id FROM supplier) SELECT up.generation, f.file_id, max(up.ancestor) AS owner FROM up JOIN f ON f.generation = up.ancestor GROUP BY up.generation, f.file_id")
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 25).cast("int").alias("generation"), F.col("s_nationkey").alias("file_id")).distinct()
    ids, gens = files.select("file_id").distinct(), _tree(spark, sf_dir).select("generation")
    effective = ids.withColumn("generation", F.explode(F.lit([r[0] for r in gens.collect()])))  # a chain's generations
    return chain.nearest(files, effective, chain.lineage(_tree(spark, sf_dir)))


@query("chain_heads", f"WITH gen AS ({_TREE}) SELECT g.generation, count(c.generation) AS children, count(c.generation) > 1 AS forked, count(c.generation) = 0 AS is_head FROM gen g LEFT JOIN gen c ON c.parent = g.generation GROUP BY g.generation")
def chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _tree(spark, sf_dir)
    c = g.filter("parent is not null").groupBy(F.col("parent").alias("generation")).agg(F.count("*").alias("children"))
    n = F.coalesce("children", F.lit(0).cast("long"))
    return g.join(c, "generation", "left").select("generation", n.alias("children"), (n > 1).alias("forked"), (n == 0).alias("is_head"))


@query("posix_intern", "WITH f AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS first_seen FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT *, row_number() OVER (ORDER BY first_seen) - 1 AS posix_index FROM f")
def posix_intern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.interned(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("packet_conflicts", "SELECT l_returnflag, l_linestatus, l_linenumber, arg_min(q, (k, q)) AS first_body, count(*) AS copies, count(DISTINCT q) - 1 AS conflicts FROM (SELECT *, l_quantity::BIGINT AS q, l_orderkey * 8 + l_linenumber AS k FROM lineitem) GROUP BY l_returnflag, l_linestatus, l_linenumber")
def packet_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long")).withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return chain.conflicts(p, ["l_returnflag", "l_linestatus", "l_linenumber"], "q", "k")


@query("packet_scan")
def packet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as packets, every seventh damaged, read back."""

    def write(batches):
        for b in batches:
            numbers, blobs = b.column(0).to_pylist(), [x or b"" for x in b.column(1).to_pylist()]
            for lo, hi in together(blobs):
                rows = zip(numbers[lo:hi], packets.encode_many("FILE", b"brindle set id 0", blobs[lo:hi]))
                rows = [(f"v{n:08d}", damage.burst(d, 1, 60) if n % 7 == 0 else d) for n, d in rows]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["volume", "content"])

    v = contents(_docs(spark, sf_dir)).mapInArrow(write, "volume string, content binary")
    return packets.read(v).groupBy("type", "ok").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


@query("volume_presence", """WITH l AS (SELECT p_partkey AS volume, p_brand || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'data' ELSE 'recovery' END AS kind, p_size AS bytes, sha256(p_name || p_partkey) AS tag FROM part),
v AS (SELECT CASE WHEN volume % 5 = 0 THEN 'x' || name ELSE name END AS name, bytes, tag FROM l WHERE volume % 3 <> 0)
SELECT volume, kind, CASE WHEN kind = 'data' THEN EXISTS (SELECT 1 FROM v WHERE v.bytes = l.bytes AND v.tag = l.tag) ELSE EXISTS (SELECT 1 FROM v WHERE v.name = l.name) END AS present FROM l""")
def volume_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    lay = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("volume"), F.concat("p_brand", k).alias("name"), F.when(F.col("p_size") % 2 == 0, "data").otherwise("recovery").alias("kind"), F.col("p_size").alias("bytes"), F.sha2(F.concat("p_name", k), 256).alias("tag"))
    there = lay.filter("volume % 3 <> 0").withColumn("name", F.when(F.col("volume") % 5 == 0, F.concat(F.lit("x"), "name")).otherwise(F.col("name")))
    return chain.presence(lay, there).select("volume", "kind", "present")


@query("link_drift", """WITH c AS (SELECT c_custkey AS k, c_nationkey * 1000 + c_custkey % 400 AS ino, CASE WHEN c_custkey % 5 = 0 THEN c_custkey - 400 END AS target FROM customer),
a AS (SELECT c.k, 'broken' AS drift, t.k AS other FROM c JOIN c t ON t.k = c.target WHERE c.ino <> t.ino), f AS (SELECT ino, min(k) AS other FROM c WHERE target IS NULL GROUP BY ino)
SELECT * FROM a UNION ALL SELECT c.k, 'unrecorded', f.other FROM c JOIN f ON f.ino = c.ino WHERE c.target IS NULL AND c.k <> f.other""")
def link_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("k"), (F.col("c_nationkey") * 1000 + k % 400).alias("ino"), F.when(k % 5 == 0, k - 400).alias("target"))
    t = c.select(F.col("k").alias("other"), F.col("ino").alias("t_ino"))
    broken = c.join(t, F.col("target") == F.col("other")).filter("ino <> t_ino").select("k", F.lit("broken").alias("drift"), "other")
    free = c.filter("target is null")
    first = free.groupBy("ino").agg(F.min("k").alias("other"))
    return broken.union(free.join(first, "ino").filter("k <> other").select("k", F.lit("unrecorded"), "other"))


# ---- displaced blocks

_VOTES = """p AS (SELECT p_partkey * 64 AS expected, p_partkey % (SELECT count(*) * 3 // 4 FROM part) AS crc FROM part), u AS (SELECT crc, min(expected) AS expected FROM p GROUP BY crc HAVING count(*) = 1),
h AS (SELECT l_partkey % (SELECT count(*) * 3 // 4 FROM part) AS crc, l_partkey * 64 + (l_suppkey % 3) * 16 + CASE WHEN l_linenumber = 1 THEN 8 ELSE 0 END AS pos FROM lineitem),
v AS (SELECT pos - expected AS delta, count(*) AS votes FROM h JOIN u ON u.crc = h.crc WHERE abs(pos - expected) <= 4096 GROUP BY pos - expected)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    m = part.count() * 3 // 4
    probes = part.select((F.col("p_partkey") * 64).alias("expected"), (F.col("p_partkey") % m).alias("crc"))
    pos = F.col("l_partkey") * 64 + F.col("l_suppkey") % 3 * 16 + F.when(F.col("l_linenumber") == 1, 8).otherwise(0)
    hits = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % m).alias("crc"), pos.alias("pos"))
    return resync.votes(hits, probes, 4096)


@query("resync_votes", f"WITH {_VOTES}, t AS (SELECT * FROM v ORDER BY votes DESC, delta LIMIT 8) SELECT delta, votes, row_number() OVER (ORDER BY votes DESC, delta)::INT AS rank, row_number() OVER (ORDER BY votes DESC, delta) = 1 AND coalesce(lead(votes) OVER (ORDER BY votes DESC, delta) <= votes // 2, true) AS dominant FROM t")
def resync_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resync.dominant(_votes(spark, sf_dir))


@query("resync_nearest", """WITH l AS (SELECT c_nationkey AS n, c_custkey * 7 AS expected, c_custkey % 5 AS shift FROM customer), p AS (SELECT s_nationkey AS n, s_suppkey * 101 AS "at" FROM supplier),
j AS (SELECT p.n, p."at", l.shift, row_number() OVER (PARTITION BY p.n, p."at" ORDER BY abs(l.expected - p."at"), l.expected) AS r FROM p JOIN l ON l.n = p.n) SELECT n, "at", shift FROM j WHERE r = 1""")
def resync_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), (F.col("c_custkey") * 7).alias("expected"), (F.col("c_custkey") % 5).alias("shift"))
    points = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), (F.col("s_suppkey") * 101).alias("at"))
    return resync.nearest(points, located, ["n"]).filter("shift is not null")


@query("resync_rolling")
def resync_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries' blocks of 256 bytes located in the same entries after five bytes were put before them."""
    d = _docs(spark, sf_dir)
    e = named(d).select(F.col("doc_id").alias("ord"), "content").repartition("ord")  # votes don't take the order
    probes = staged(resync.unique(resync.rolling(e, 256, 256).select(F.col("pos").alias("expected"), "crc")))  # so copies' windows don't meet in a task
    # a hit lies within 64 bytes of where its probe is expected, and probes are at multiples of 256
    hits = resync.rolling(damage.inject(e, "insert", (0, 5, 1)), 256, near=(256, 64), known=resync.known_crcs(probes))
    return resync.dominant(resync.votes(hits, probes, 64))


# ---- text forms


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.iso_time(F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("iso"))


@query("human_sizes", """WITH n AS (SELECT p_partkey, p_partkey * p_partkey * p_size * 50 AS n FROM part)
SELECT p_partkey, CASE WHEN n >= 1099511627776 THEN (n * 10 // 1099511627776) // 10 || '.' || (n * 10 // 1099511627776) % 10 || ' TiB' WHEN n >= 1073741824 THEN (n * 10 // 1073741824) // 10 || '.' || (n * 10 // 1073741824) % 10 || ' GiB' WHEN n >= 1048576 THEN (n * 10 // 1048576) // 10 || '.' || (n * 10 // 1048576) % 10 || ' MiB'
 WHEN n >= 1024 THEN (n * 10 // 1024) // 10 || '.' || (n * 10 // 1024) % 10 || ' KiB' ELSE n || ' B' END AS size FROM n""")  # fmt: skip
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", text.human_size(k * k * F.col("p_size") * 50, "TiB").alias("size"))


@query("list_entries", f"WITH {E_SQL} SELECT name, 'f' AS letter, lpad(printf('%o', (doc_id * 37) % 4096), 4, '0') AS mode, CASE WHEN (doc_id * 37) % 4096 & 73 <> 0 THEN 1 ELSE 0 END + CASE WHEN (doc_id * 37) % 4096 & 3072 <> 0 THEN 2 ELSE 0 END AS attrs, string_split(name, '/')[-1] AS base FROM E")
def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.col("doc_id") * 37 % 4096
    return named(_docs(spark, sf_dir)).select("name", text.type_letter(F.lit("regular")).alias("letter"), text.mode_octal(mode).alias("mode"), text.attributes(mode, F.lit(False)).alias("attrs"), F.substring_index("name", "/", -1).alias("base"))


@query("restore_order", f"WITH {E_SQL}, d AS (SELECT DISTINCT regexp_replace(name, '/[^/]*$', '') AS dir FROM E UNION SELECT DISTINCT split_part(name, '/', 1) FROM E) SELECT dir, len(string_split(dir, '/')) AS depth, row_number() OVER (ORDER BY len(string_split(dir, '/')) DESC, dir) AS place FROM d")
def restore_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories in the order in which their metadata is set: the deepest first."""
    n = named(_docs(spark, sf_dir)).select("name")
    d = n.select(F.regexp_replace("name", "/[^/]*$", "").alias("dir")).union(n.select(F.substring_index("name", "/", 1))).distinct()
    d = d.withColumn("depth", F.size(F.split("dir", "/"))).withColumn("_key", F.concat(F.lpad((F.lit(10000) - F.col("depth")).cast("string"), 5, "0"), "dir"))
    return running_ordered(d, "_key", F.lit(1), "place", before=False).drop("_key")


@query("ndjson_summary", """SELECT source, to_json({'type': 'summary', 'source': source, 'entries': count(*), 'bytes': sum(strlen(text))::BIGINT})::VARCHAR AS line FROM documents GROUP BY source""")
def ndjson_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("entries"), F.sum(F.octet_length("text")).alias("bytes"))
    return d.select("source", F.to_json(F.struct(F.lit("summary").alias("type"), "source", "entries", "bytes")).alias("line"))


@query("table_coverage", f"""WITH {S_SQL}, t AS (SELECT slice // 100 AS part, min(slice) AS first_slice, count(*) AS n FROM S WHERE slice % 250 <> 120 GROUP BY slice // 100), c AS (SELECT *, coalesce(lag(first_slice + n) OVER (ORDER BY first_slice), 0) AS due FROM t)
SELECT part, first_slice, n, CASE WHEN first_slice > due THEN 'gap' WHEN first_slice < due THEN 'overlap' ELSE 'ok' END AS status FROM c""")
def table_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _slices(spark, sf_dir).filter("slice % 250 <> 120").groupBy(F.floor(F.col("slice") / 100).alias("part")).agg(F.min("slice").alias("first_slice"), F.count("*").alias("n"))
    t = layout.tiling(s.withColumn("one", F.lit(0)), 1 << 60, ["one"], "first_slice", "n")
    return t.select("part", "first_slice", "n", F.when(F.col("status") == "short", "ok").otherwise(F.col("status")).alias("status"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's layout with each entry's canonical: de-duplication, order and placement together."""
    return _placed(spark, sf_dir).select("ord", "name", "length", "canonical_ord", "is_canonical", "stream_offset")
