"""Queries over stored sets: tags, repair, extraction, generations on disk, and the rules of manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import chain, coding, layout, manifest, repair, resync, undo
from brindle.operators.ordered import running_ordered
from brindle.plans import planner
from brindle.queries import C_SQL, CODE_SQL, DAMAGED, E_SQL, K, P_SQL, S_CODE, S_SQL, SPAN_SQL, X_SQL, Y, Z, _TREE, _bad, _code_slices, _docs, _g0, _g1, _placed, _slice_data, _slices, _tree, query
from brindle.sources import sets
from brindle.sources.catalog import named, shared_dir, staged, table
from brindle.streaming.append import append_stream

# ---- verify and repair


def _inverted(data: str) -> F.Column:
    return F.unhex(F.translate(F.hex(data), "0123456789ABCDEF", "FEDCBA9876543210"))


def _hurt(cells: DataFrame) -> DataFrame:
    """Cells as a disk might give them: every bit of those that count as damaged is wrong."""
    return cells.select("slice", "col", F.when(F.expr(DAMAGED), _inverted("data")).otherwise(F.col("data")).alias("data"))


@query("verify_tags", f"WITH {C_SQL} SELECT slice, col, CASE WHEN {DAMAGED} THEN 'damaged' ELSE 'ok' END AS status FROM C")
def verify_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored digests of all cells against those of what is read."""
    cells = repair.split_cells(_slice_data(spark, sf_dir), Z, Y)
    stored = staged(repair.tags(cells))
    return repair.verify(_hurt(cells), stored)


@query("verify_tags_keyed", f"WITH {C_SQL} SELECT col, count(*) AS cells, count(*) FILTER ({DAMAGED}) AS damaged FROM C GROUP BY col")
def verify_tags_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = repair.split_cells(_slice_data(spark, sf_dir), Z, Y)
    stored = staged(repair.tags(cells, b"a key"))
    v = repair.verify(_hurt(cells), stored, b"a key")
    return v.groupBy("col").agg(F.count("*").alias("cells"), F.sum(F.when(F.col("status") == "damaged", 1).otherwise(0)).alias("damaged"))


R_CELLS = 6


@query("repair_roundtrip", f"""WITH {CODE_SQL}, y AS (SELECT *, greatest(64, z // 4 // 64 * 64) AS y FROM cd WHERE slice < {S_CODE}), ce AS (SELECT slice, col, substr(h, (2 * col * y + 1)::BIGINT, (2 * y)::BIGINT) AS h FROM y, unnest(range(0, (z + y - 1) // y)) AS t(col))
SELECT slice, col, sha256(unhex(h)) AS digest FROM ce WHERE {DAMAGED}""")
def repair_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage found by digests, decoded column by column, and what comes out. No knowledge of where the damage is goes in."""
    s, z = _code_slices(spark, sf_dir)
    s, y = s.filter(F.col("slice") < S_CODE), max(64, z // 4 // 64 * 64)
    recovery = staged(coding.encode(s, R_CELLS, z))
    cells = repair.split_cells(s, z, y)
    stored = staged(repair.tags(cells))
    seen = staged(_hurt(cells))
    bad = staged(repair.verify(seen, stored).filter("status <> 'ok'"))
    return repair.decode(seen, recovery, bad, z, y).select("slice", "col", F.sha2("data", 256).alias("digest"))


_WRITES = f"""{C_SQL}, w AS (SELECT P.ord, P.is_canonical, greatest(P.stream_offset, B.slice * {Z} + B.col * {Y}) - P.stream_offset AS a, least(P.stream_offset + P.length, least(B.slice * {Z} + {Z}, B.slice * {Z} + (B.col + 1) * {Y})) - P.stream_offset AS b
 FROM P JOIN B ON P.stream_offset < B.slice * {Z} + (B.col + 1) * {Y} AND P.stream_offset + P.length > B.slice * {Z} + B.col * {Y} WHERE P.length > 0),
wt AS (SELECT *, max(b) OVER (PARTITION BY ord ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM w), wi AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM wt),
wr AS (SELECT ord, min(a)::BIGINT AS "begin", max(b)::BIGINT AS "end", bool_or(NOT is_canonical) AS alias FROM wi GROUP BY ord, k)"""


@query("write_fanout", f'WITH {_WRITES} SELECT ord, "begin", "end" FROM wr')
def write_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.fan_out(_placed(spark, sf_dir), _bad(spark, sf_dir), Z, Y)


@query("repair_counters", f'WITH {_WRITES} SELECT (SELECT count(*) FROM B) AS cells_damaged, (SELECT count(*) FROM B) AS cells_decoded, count(*) AS writes, sum("end" - "begin")::BIGINT AS bytes_written, count(DISTINCT ord) AS entries_repaired, count(DISTINCT CASE WHEN alias THEN ord END) AS aliases_repaired FROM wr')
def repair_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, bad = staged(_placed(spark, sf_dir).select("ord", "length", "is_canonical", "stream_offset")), _bad(spark, sf_dir)
    return repair.counters(repair.fan_out(p, bad, Z, Y), p, bad)


# ---- extraction


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry that holds bytes, put together from the slices of the stream."""
    p = staged(_placed(spark, sf_dir).select("ord", "name", "length", "content_hash", "is_canonical", "stream_offset"))
    c = repair.assemble(layout.spans(p, Z), _slice_data(spark, sf_dir), Z)
    return p.join(c.select("ord", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("got")), "ord")


@query("extract_entries", f"WITH {E_SQL} SELECT name, length, sha256(text) AS digest FROM E WHERE length > 0")
def extract_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("name", "length", "digest")


@query("extract_counters", f"WITH {P_SQL} SELECT count(*) AS entries, sum(length)::BIGINT AS bytes, count(*) FILTER (NOT is_canonical) AS copies, 0::BIGINT AS mismatches FROM P WHERE length > 0")
def extract_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = (F.col("digest") != F.col("content_hash")) | (F.col("got") != F.col("length"))
    return _extracted(spark, sf_dir).agg(F.count("*").alias("entries"), F.sum("got").alias("bytes"), F.sum(F.when(~F.col("is_canonical"), 1).otherwise(0)).alias("copies"), F.sum(F.when(wrong, 1).otherwise(0)).alias("mismatches"))


# ---- split tables and volumes

PART = 100


@query("slice_tables", f"WITH {S_SQL} SELECT slice // {PART} AS part, min(slice) AS first_slice, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM S GROUP BY slice // {PART}")
def slice_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.split_parts(_slices(spark, sf_dir), part=PART).groupBy("part").agg(F.min("slice").alias("first_slice"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


#: slices in one bare volume
VOLUME = 150


@query("data_volumes", f"""WITH {SPAN_SQL}, H AS (SELECT slice, sha256(unhex(rpad(string_agg(hex(encode(text)[(span_begin - stream_offset + 1):(span_end - stream_offset)]), '' ORDER BY span_begin), {2 * Z}, '0'))) AS t FROM X GROUP BY slice)
SELECT S.slice // {VOLUME} AS volume, min(S."begin") AS "begin", sum(S.bytes)::BIGINT AS bytes, sha256(string_agg(t, '' ORDER BY S.slice)) AS tag FROM S JOIN H ON H.slice = S.slice GROUP BY S.slice // {VOLUME}""")
def data_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream in bare volumes of whole slices, which tile it; a volume's tag is the digest of its slices' digests in order."""
    s = _slices(spark, sf_dir)
    t = _slice_data(spark, sf_dir).select("slice", F.sha2("data", 256).alias("t"))
    v = s.join(t, "slice").groupBy(F.floor(F.col("slice") / VOLUME).alias("volume"))
    return v.agg(F.min("begin").alias("begin"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slice", "t"))), lambda x: x["t"]), ""), 256).alias("tag"))


# ---- generations on disk


def _stored_set(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_dir(spark)}/set-{uuid.uuid4().hex}"
    for entries in (_g0(spark, sf_dir), _g1(spark, sf_dir)):
        sets.add_generation(spark, path, entries, Z)
    return path


@query("set_generations", f"WITH {X_SQL} SELECT 0 AS generation, 0::BIGINT AS stream_base, l AS stream_length, true AS linked FROM l0 UNION ALL SELECT 1, l, (SELECT sum(length)::BIGINT FROM x1), true FROM l0")
def set_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations written to disk and read back, linked by identity and by where their ranges meet."""
    return sets.generations(spark, _stored_set(spark, sf_dir)).select("generation", "stream_base", "stream_length", "linked")


@query("effective_manifest", f"WITH {X_SQL} SELECT g1.name, g1.length, g1.content_hash, CASE WHEN change = 'inherited' THEN 0 ELSE 1 END AS owner FROM g1 JOIN df ON df.name = g1.name")
def effective_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.effective(spark, _stored_set(spark, sf_dir), 1).select("name", "length", "content_hash", "owner")


@query("set_extents", f"WITH {X_SQL} SELECT name, 0 AS generation, stream_offset, length FROM x0 WHERE length > 0 UNION ALL SELECT name, 1, stream_offset, length FROM x1 WHERE length > 0")
def set_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_set(spark, sf_dir)
    f = sets.read(spark, path, "files").select("generation", "file_id", "name")
    return sets.read(spark, path, "extents").join(f, ["generation", "file_id"]).select("name", "generation", "stream_offset", "length")


@query("write_verified", "SELECT 'files' AS written, true AS right UNION ALL SELECT 'files, one row less', false")
def write_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_set(spark, sf_dir)
    meant = _g0(spark, sf_dir).select(sets.file_id().alias("file_id"), "name", "length", "content_hash")
    got = spark.read.parquet(f"{path}/files/generation=0")
    less = got.filter(F.col("name") != got.agg(F.min("name")).first()[0])
    rows = [("files", sets.written_right(got, meant)), ("files, one row less", sets.written_right(less, meant))]
    return spark.createDataFrame(rows, "written string, right boolean")


_GENS = f"gens AS (SELECT generation, sha256('set ' || generation) AS set_id, CASE WHEN parent IS NOT NULL THEN sha256('set ' || parent) END AS parent_id FROM ({_TREE}))"
_WANTED = "(SELECT r_regionkey AS pick, r_regionkey * 7 AS number, NULL::VARCHAR AS id_prefix FROM region UNION ALL SELECT 10 + r_regionkey, NULL, substr(sha256('set ' || (r_regionkey * 3)), 1, CASE WHEN r_regionkey = 1 THEN 0 ELSE 8 END) FROM region UNION ALL SELECT 20, NULL, 'zz' UNION ALL SELECT 21, NULL, NULL)"


def _gens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.sha2(F.concat(F.lit("set "), F.col(c).cast("string")), 256)
    return _tree(spark, sf_dir).select("generation", s("generation").alias("set_id"), F.when(F.col("parent").isNotNull(), s("parent")).alias("parent_id"))


@query("generation_select", f"""WITH {_GENS}, w AS {_WANTED}, f AS (SELECT w.pick, number, id_prefix, count(set_id) AS n, min(set_id) AS one FROM w LEFT JOIN gens ON (number IS NOT NULL AND generation = number) OR (number IS NULL AND id_prefix IS NOT NULL AND starts_with(set_id, id_prefix)) GROUP BY w.pick, number, id_prefix)
SELECT pick, CASE WHEN n = 1 THEN one END AS set_id, CASE WHEN number IS NULL AND id_prefix IS NULL THEN 'forked' WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM f""")
def generation_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r_regionkey")
    reg = table(spark, sf_dir, "region")
    none = F.lit(None).cast("string")
    by_id = F.substring(F.sha2(F.concat(F.lit("set "), (r * 3).cast("string")), 256), F.lit(1), F.when(r == 1, 0).otherwise(8))
    w = reg.select(r.cast("int").alias("pick"), (r * 7).cast("int").alias("number"), none.alias("id_prefix")).union(reg.select((r + 10).cast("int"), F.lit(None).cast("int"), by_id))
    w = w.union(spark.createDataFrame([(20, None, "zz"), (21, None, None)], "pick int, number int, id_prefix string"))
    return manifest.selected(_gens(spark, sf_dir), w)


_CASES = ((None, ()), (4, ()), (99, ()), (None, (24,)), (3, (7, 9)), (None, (0,)))


@query("prune_plan", "WITH c(no, before, listed) AS (VALUES " + ", ".join(f"({i}, {b if b is not None else 'NULL'}, {list(x) if x else '[]::INT[]'})" for i, (b, x) in enumerate(_CASES)) + "), r AS (SELECT no, n_nationkey AS g, coalesce(n_nationkey < before, false) OR list_contains(listed, n_nationkey::INT) AS gone FROM c, nation) SELECT no, count(*) FILTER (gone) AS removed, CASE WHEN NOT bool_or(gone) THEN 'none' WHEN bool_and(gone) THEN 'all' WHEN arg_max(gone, g) THEN 'head' ELSE 'ok' END AS verdict FROM r GROUP BY no")
def prune_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for i, (before, listed) in enumerate(_CASES):
        d, verdict = manifest.prune_plan(_tree(spark, sf_dir).select("generation"), before, list(listed))
        out.append((i, d.filter("removed").count(), verdict))
    return spark.createDataFrame(out, "no int, removed long, verdict string")


@query("prune_reclaim", "SELECT p_size % 5 AS generation, sum(p_partkey)::BIGINT AS bytes, count(*) AS volumes FROM part WHERE p_size % 5 < 3 GROUP BY p_size % 5")
def prune_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the volumes of generations that would go."""
    v = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("generation"), F.col("p_partkey").alias("bytes"))
    return v.filter("generation < 3").groupBy("generation").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("volumes"))


@query("generation_order", "SELECT n_nationkey AS generation, row_number() OVER (ORDER BY n_nationkey) - 1 AS place, 24 - n_nationkey AS newer FROM nation")
def generation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _tree(spark, sf_dir).select("generation")
    last = F.lit(g.agg(F.max("generation")).first()[0])
    return running_ordered(g, "generation", F.lit(1), "place").withColumn("newer", last - F.col("generation"))


@query("lineage_of_set", "SELECT 0 AS generation, 0 AS ancestor, 0 AS depth UNION ALL SELECT 1, 1, 0 UNION ALL SELECT 1, 0, 1")
def lineage_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.lineage_of(spark, _stored_set(spark, sf_dir))


# ---- rules of manifests

_ENTRIES = """SELECT c_custkey, 'd' || c_nationkey || '/' || CASE WHEN c_custkey % 23 = 0 THEN '' ELSE c_custkey::VARCHAR END AS name, CASE c_custkey % 11 WHEN 0 THEN 'directory' WHEN 1 THEN 'symlink' WHEN 2 THEN 'hardlink' WHEN 3 THEN 'hardlink' WHEN 4 THEN 'device' ELSE 'regular' END AS entry_type,
 CASE WHEN c_custkey % 11 IN (0, 1) AND c_custkey % 5 <> 0 THEN 0 ELSE c_custkey % 7 END AS length, CASE WHEN c_custkey % 11 < 4 AND c_custkey % 17 <> 0 THEN 0 ELSE 1 END AS n_extents,
 CASE WHEN c_custkey % 11 IN (1, 2) THEN 'd' || c_nationkey || '/' || c_custkey WHEN c_custkey % 11 = 3 THEN 'd' || c_nationkey || '/' || (c_custkey - c_custkey % 3 * 25) WHEN c_custkey % 29 = 0 THEN 'x' END AS target, c_custkey % 2 AS content_hash FROM customer"""


@query("entry_rules", f"""WITH e AS ({_ENTRIES.replace("c_custkey % 2 AS content_hash", "(c_custkey % 2)::VARCHAR AS content_hash")}), j AS (SELECT e.*, t.name AS t_name, t.entry_type AS t_type, t.content_hash AS t_hash, t.length AS t_length FROM e LEFT JOIN e t ON e.entry_type = 'hardlink' AND e.target = t.name)
SELECT c_custkey, CASE WHEN name LIKE '%/' THEN 'path' WHEN entry_type = 'device' THEN 'type' WHEN entry_type IN ('directory', 'symlink') AND length <> 0 THEN 'type_length' WHEN entry_type IN ('directory', 'symlink', 'hardlink') AND n_extents > 0 THEN 'type_extents'
 WHEN entry_type IN ('regular', 'directory') AND strlen(coalesce(target, '')) > 0 THEN 'type_extra' WHEN entry_type = 'symlink' AND target IS NULL THEN 'path' WHEN entry_type = 'hardlink' AND t_name IS NULL THEN 'link_missing' WHEN entry_type = 'hardlink' AND target = name THEN 'link_self'
 WHEN entry_type = 'hardlink' AND t_type <> 'regular' THEN 'link_chain' WHEN entry_type = 'hardlink' AND NOT (content_hash = t_hash AND length = t_length) THEN 'link_content' ELSE 'ok' END AS status FROM j""")
def entry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    path = lambda x: F.concat(F.lit("d"), n, F.lit("/"), x.cast("string"))
    m = k % 11
    kind = F.when(m == 0, "directory").when(m == 1, "symlink").when(m.isin(2, 3), "hardlink").when(m == 4, "device").otherwise("regular")
    e = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 23 == 0, path(F.lit(""))).otherwise(path(k)).alias("name"), kind.alias("entry_type"), F.when(m.isin(0, 1) & (k % 5 != 0), 0).otherwise(k % 7).alias("length"),
        F.when((m < 4) & (k % 17 != 0), 0).otherwise(1).alias("n_extents"), F.when(m.isin(1, 2), path(k)).when(m == 3, path(k - k % 3 * 25)).when(k % 29 == 0, "x").alias("target"), (k % 2).cast("string").alias("content_hash"),
    )
    return manifest.entry_status(e).select("c_custkey", "status")


@query("ancestor_containment", """WITH r AS (SELECT n_nationkey * 1000 AS base, 600 + n_nationkey * 10 AS length FROM nation), e AS (SELECT l_orderkey, l_linenumber, min(l_partkey * 13 % 30000) AS o, min(l_quantity)::BIGINT * 5 AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey, l_linenumber, o >= 25000 OR EXISTS (SELECT 1 FROM r WHERE o >= base AND o + n <= base + length) AS ok FROM e""")
def ancestor_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 1000).alias("base"), (F.col("n_nationkey") * 10 + 600).alias("length"))
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey") * 13 % 30000).alias("stream_offset"), (F.min("l_quantity").cast("long") * 5).alias("length"))
    return manifest.within_ancestor(e, r, 25000).select("l_orderkey", "l_linenumber", "ok")


@query("utf8_names", "WITH b AS (SELECT doc_id, hex(encode(text)) AS h, doc_id % 97 + 1 AS n FROM documents) SELECT doc_id, 2 * n >= length(h) OR substr(h, (2 * n + 1)::BIGINT, 1) NOT IN ('8', '9', 'A', 'B') AS valid FROM b")
def utf8_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut after some bytes, which may fall inside a character."""
    raw = F.substring(F.encode("text", "utf-8"), F.lit(1), (F.col("doc_id") % 97 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", manifest.valid_utf8(raw).alias("valid"))


_META = "SELECT c_custkey, c_custkey % 512 AS mode, c_custkey * 1000 AS mtime_ns, c_nationkey AS uid, c_mktsegment AS xattr FROM customer"


@query("preserved_metadata", f"WITH m AS ({_META}) SELECT c_custkey, 'default' AS kept, mode, mtime_ns, NULL::INT AS uid, NULL::VARCHAR AS xattr FROM m UNION ALL SELECT c_custkey, 'named', NULL, NULL, uid, xattr FROM m UNION ALL SELECT c_custkey, 'reproducible', mode, NULL, NULL, NULL FROM m UNION ALL SELECT c_custkey, 'reproducible, nothing named', NULL, NULL, NULL, NULL FROM m")
def preserved_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 512).alias("mode"), (F.col("c_custkey") * 1000).alias("mtime_ns"), F.col("c_nationkey").cast("int").alias("uid"), F.col("c_mktsegment").alias("xattr"))
    of = {"mode": ["mode"], "times": ["mtime_ns"], "owner": ["uid"], "xattr": ["xattr"]}
    cases = {"default": manifest.keep_mask(), "named": manifest.keep_mask({"owner", "xattr"}), "reproducible": manifest.keep_mask(explicit={"mode"}, reproducible=True), "reproducible, nothing named": manifest.keep_mask(reproducible=True)}
    out = None
    for name, kept in cases.items():
        d = manifest.preserved(m, kept, of).select("c_custkey", F.lit(name).alias("kept"), "mode", "mtime_ns", "uid", "xattr")
        out = d if out is None else out.union(d)
    return out


@query("write_authorisation", "SELECT s_suppkey, s_suppkey % 3 <> 0 OR s_suppkey % 5 = 0 AS allowed FROM supplier")
def write_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", manifest.may_write(F.when(s % 3 == 0, "none").otherwise("plain"), s % 5 == 0).alias("allowed"))


@query("file_offsets", "WITH e AS (SELECT l_orderkey, l_linenumber, min(l_quantity)::BIGINT AS length FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT *, (sum(length) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - length)::BIGINT AS file_offset FROM e")
def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("long").alias("length"))
    return manifest.file_offsets(e, "l_orderkey", "l_linenumber", "length")


@query("recovery_present", "SELECT l_suppkey AS set_no, count(DISTINCT l_linenumber) AS present, max(l_linenumber) + 1 AS top FROM lineitem GROUP BY l_suppkey")
def recovery_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.recovery_present(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set_no"), F.col("l_linenumber").alias("exponent")), "set_no")


@query("owner_labels", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR ELSE c_name END AS mapped, c_nationkey::VARCHAR AS numeric FROM customer")
def owner_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    user, uid = F.when(k % 3 != 0, F.col("c_name")).when(k % 2 == 0, ""), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", manifest.owner_label(user, uid).alias("mapped"), manifest.owner_label(user, uid, False).alias("numeric"))


_DOS = "SELECT p_partkey, replace(p_name, ' ', '.') || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.' || p_size END AS name FROM part"


@query("short_names", f"""WITH n AS ({_DOS}), b AS (SELECT *, upper(name) AS base FROM n), s AS (SELECT *, substr(regexp_replace(CASE WHEN contains(base, '.') THEN regexp_extract(base, '^(.*)\\.[^.]*$', 1) ELSE base END, '[^A-Z0-9_-]', '', 'g'), 1, 6) AS stem, substr(regexp_replace(CASE WHEN contains(base, '.') THEN regexp_extract(base, '\\.([^.]*)$', 1) ELSE '' END, '[^A-Z0-9_-]', '', 'g'), 1, 3) AS ext, regexp_matches(base, '^[A-Z0-9_-]{{1,8}}(\\.[A-Z0-9_-]{{1,3}})?$') AS fits FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY fits, stem, ext ORDER BY p_partkey) AS r FROM s) SELECT p_partkey, CASE WHEN fits THEN base ELSE stem || '~' || r || CASE WHEN ext <> '' THEN '.' || ext ELSE '' END END AS short FROM r""")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8.3 names; how many before a name need the same form is a running count by form, without a window over all names."""
    k = F.col("p_partkey")
    n = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("."), F.col("p_size").cast("string")))).alias("name"))
    n = n.withColumn("form", manifest.short_name(F.col("name"), F.lit(0)))
    return running_ordered(n, "p_partkey", F.lit(1), "taken", ["form"]).select("p_partkey", manifest.short_name(F.col("name"), F.col("taken")).alias("short"))


@query("le_codes", "WITH h AS (SELECT p_partkey, p_partkey * 7919 % 65536 AS a, p_partkey * 1000003 % 4294967296 AS b, p_partkey * -1000000007 AS c, printf('%04x', p_partkey * 7919 % 65536) AS x, printf('%08x', p_partkey * 1000003 % 4294967296) AS y FROM part) SELECT p_partkey, substr(x, 3, 2) || substr(x, 1, 2) AS u16, substr(y, 7, 2) || substr(y, 5, 2) || substr(y, 3, 2) || substr(y, 1, 2) AS u32, a AS a16, b AS a32, c AS a64 FROM h")
def le_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Little-endian bytes of numbers, and the numbers read from them again."""
    k = F.col("p_partkey")
    a, b, c = k * 7919 % 65536, k * 1000003 % 4294967296, k * -1000000007
    u16, u32, u64 = manifest.le_hex(a, 2), manifest.le_hex(b, 4), manifest.le_hex(c, 8)
    return table(spark, sf_dir, "part").select("p_partkey", u16.alias("u16"), u32.alias("u32"), manifest.le_number(u16, 2).alias("a16"), manifest.le_number(u32, 4).alias("a32"), manifest.le_number(u64, 8).alias("a64"))


@query("hex_forms", "SELECT doc_id, starts_with(sha256(text), 'a') AS by_prefix, length(doc_id::VARCHAR) AS digits, contains(text, chr(0)) AS has_nul, lower(hex(encode(substr(text, 1, 4)))) AS head FROM documents")
def hex_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.encode("text", "utf-8")
    return _docs(spark, sf_dir).select("doc_id", F.startswith(F.sha2(t, 256), F.lit("a")).alias("by_prefix"), F.length(F.col("doc_id").cast("string")).alias("digits"), F.contains("text", F.lit("\x00")).alias("has_nul"), F.lower(F.hex(F.encode(F.substring("text", 1, 4), "utf-8"))).alias("head"))


_VOLS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'set.brd' WHEN 1 THEN 'set.g' || lpad((p_size % 7)::VARCHAR, 3, '0') || '.brd' WHEN 2 THEN 'my.set.v' || lpad(p_size::VARCHAR, 2, '0') || '+' || lpad((p_size + 1)::VARCHAR, 2, '0') || '.brd' ELSE 'set.g' || lpad((p_size % 7)::VARCHAR, 3, '0') || '.d' || lpad(p_size::VARCHAR, 2, '0') || '.brd' END AS name, p_size FROM part"


@query("volume_names", f"WITH v AS ({_VOLS}) SELECT p_partkey, name, CASE WHEN p_partkey % 4 = 2 THEN 'my.set' ELSE 'set' END AS stem, CASE p_partkey % 4 WHEN 2 THEN 'recovery' WHEN 3 THEN 'data' ELSE 'index' END AS kind, CASE WHEN p_partkey % 4 IN (1, 3) THEN p_size % 7 ELSE 0 END AS generation, row_number() OVER (ORDER BY name, p_partkey) - 1 AS place FROM v")
def volume_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of sets told by their file names alone, in the order of names."""
    k, s = F.col("p_partkey"), F.col("p_size")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    gen = F.concat(F.lit("set.g"), F.lpad((s % 7).cast("string"), 3, "0"))
    name = F.when(k % 4 == 0, "set.brd").when(k % 4 == 1, F.concat(gen, F.lit(".brd"))).when(k % 4 == 2, F.concat(F.lit("my.set.v"), two(s), F.lit("+"), two(s + 1), F.lit(".brd"))).otherwise(F.concat(gen, F.lit(".d"), two(s), F.lit(".brd")))
    v = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    stem, kind, number = manifest.volume_name(F.col("name"))
    v = v.withColumn("_key", F.concat_ws("\x00", "name", F.lpad(F.col("p_partkey").cast("string"), 20, "0")))
    return running_ordered(v, "_key", F.lit(1), "place").select("p_partkey", "name", stem.alias("stem"), kind.alias("kind"), number.alias("generation"), "place")


@query("posix_lookup", "WITH f AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS posix_index FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT c_custkey, posix_index FROM customer JOIN f USING (c_nationkey, c_mktsegment)")
def posix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    keys = ["c_nationkey", "c_mktsegment"]
    return c.join(chain.interned(c, keys, "c_custkey"), keys).select("c_custkey", "posix_index")


# ---- displaced blocks

_DELTAS = (3, 5, 7)


@query("resync_confirm", f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS h, '3132333435' || hex(encode(text)) AS m, strlen(text) // 256 AS n FROM documents), b AS (SELECT *, k * 256 AS expected FROM d, unnest(range(0, n)) AS t(k)),
c AS (SELECT doc_id, expected, CASE {" ".join(f"WHEN substr(m, (2 * (expected + {x}) + 1)::BIGINT, 512) = substr(h, (2 * expected + 1)::BIGINT, 512) THEN {x}" for x in _DELTAS)} END AS delta FROM b) SELECT doc_id, expected, delta FROM c WHERE delta IS NOT NULL""")
def resync_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 256 bytes found by their digests in texts that five bytes were put before, at the first of several displacements."""
    e = named(_docs(spark, sf_dir)).select("doc_id", "content")
    probes = resync.blocks(e, 256, "doc_id")
    moved = e.withColumn("content", F.concat(F.lit(b"12345"), "content"))
    return resync.confirm(moved, probes, list(_DELTAS), 256, "doc_id").select(F.col("id").alias("doc_id"), "expected", "delta")


@query("ndjson_events", f"""WITH {E_SQL} SELECT name, to_json({{'type': 'file', 'index': ord, 'name': name, 'length': length, 'content_hash': content_hash}})::VARCHAR AS line FROM E""")
def ndjson_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.queries import _entries

    e = _entries(spark, sf_dir)
    return e.select("name", F.to_json(F.struct(F.lit("file").alias("type"), F.col("ord").alias("index"), "name", "length", "content_hash")).alias("line"))


@query("set_info", f"WITH {P_SQL} SELECT (SELECT count(*) FROM P) AS files, len AS stream_length, (len + {Z - 1}) // {Z} AS slices, {K} AS columns, greatest(1, ((len + {Z - 1}) // {Z} + 19) // 20) AS recovery FROM L")
def set_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _placed(spark, sf_dir)
    files, length = p.agg(F.count("*"), F.sum(F.when(F.col("is_canonical"), F.col("length")).otherwise(0))).first()
    s = -(-length // Z)
    return spark.createDataFrame([(files, length, s, K, planner.recovery_slices(None, s, Z))], "files long, stream_length long, slices long, columns int, recovery long")


# ---- undo

#: bytes of every seventh entry that a disk had wrong, and that a repair then wrote
HURT = 5
_HURT_SQL = f"CASE WHEN doc_id % 7 = 3 THEN repeat('23', least({HURT}, strlen(text))) || substr(hex(encode(text)), 2 * least({HURT}, strlen(text)) + 1) ELSE hex(encode(text)) END"


def _hurt_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = named(_docs(spark, sf_dir))
    n = F.least(F.lit(HURT), F.octet_length("content"))
    return e.withColumn("content", F.when(F.col("doc_id") % 7 == 3, F.overlay("content", F.expr(f"cast(repeat('#', least({HURT}, octet_length(content))) as binary)"), F.lit(1), n)).otherwise(F.col("content")))


def _journal(spark: SparkSession, sf_dir: str) -> str:
    before = _hurt_entries(spark, sf_dir)
    writes = before.filter("doc_id % 7 = 3 and length > 0").select("name", F.lit(0).alias("begin"), F.least(F.lit(HURT), F.col("length")).alias("end"))
    path = f"{shared_dir(spark)}/undo-{uuid.uuid4().hex}"
    undo.write(spark, path, "the set", undo.records(before, writes))
    return path


@query("undo_journal", f"SELECT count(*) AS records, sum(least({HURT}, strlen(text)))::BIGINT AS bytes, 'complete' AS status FROM documents WHERE doc_id % 7 = 3 AND strlen(text) > 0")
def undo_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _journal(spark, sf_dir)
    rows = undo.scan(spark, path, "the set", named(_docs(spark, sf_dir)).select("name"))
    return rows.agg(F.count("*").alias("records"), F.sum("length").alias("bytes"), F.lit(undo.status(spark, path)).alias("status"))


@query("undo_roundtrip", f"WITH {E_SQL} SELECT name, sha256(unhex({_HURT_SQL})) AS digest FROM E")
def undo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries after a repair, taken back to what they were before it."""
    path, after = _journal(spark, sf_dir), named(_docs(spark, sf_dir))
    return undo.replay(after, undo.scan(spark, path, "the set", after)).select("name", F.sha2("content", 256).alias("digest"))


# ---- forms of numbers and paths


@query("number_forms", """WITH n AS (SELECT p_partkey, p_partkey * p_partkey * p_size * 50 AS n FROM part)
SELECT p_partkey, trim(format('{:,}', n)) AS grouped, CASE WHEN n < 100 THEN n::VARCHAR ELSE substr(n::VARCHAR, 1, 1) || '.' || substr(n::VARCHAR, 2, 2) || 'e' || (length(n::VARCHAR) - 1) END AS short FROM n""")
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = table(spark, sf_dir, "part").select(k, (k * k * F.col("p_size") * 50).cast("long").alias("n"))
    return n.select("p_partkey", text.grouped(F.col("n")).alias("grouped"), text.exponent_form(F.col("n")).alias("short"))


@query("path_parts", """SELECT page_id, CASE WHEN len(b) = len(url) THEN '.' ELSE substr(url, 1, greatest(len(url) - len(b) - 1, 1)) END AS folder, b AS base FROM (SELECT page_id, url, string_split(replace(url, chr(92), '/'), '/')[-1] AS b FROM pages) t""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, base = text.path_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", folder.alias("folder"), base.alias("base"))


# ---- generations from a stream


@query("stream_generations", "SELECT (doc_id % 2)::INTEGER AS generation, sum(strlen(text))::BIGINT AS stream_length FROM documents GROUP BY 1")
def stream_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of a stream of entries, each of which becomes a generation."""
    base = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    for k in (0, 1):
        named(_docs(spark, sf_dir).filter(F.col("doc_id") % 2 == k)).select("name", "length", "content_hash").coalesce(1).write.mode("append").parquet(base)
    changes = spark.readStream.schema("name string, length long, content_hash string").option("maxFilesPerTrigger", 1).parquet(base)
    append_stream(spark, f"{base}-set", changes, Z)
    return sets.generations(spark, f"{base}-set").filter("linked").select("generation", "stream_length")
