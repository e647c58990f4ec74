"""A protected set as tables on disk: one folder for each kind of row, one partition for each generation.

Tables: set (generation, set_id, parent_id, stream_base, stream_length, slice_size), files (generation, file_id, name, length,
content_hash), extents (generation, file_id, idx, stream_offset, length), tags (generation, part, slice, tag), recovery (generation,
exponent, data). A generation has rows of its own only for what is new in it: an inherited entry's file is that of the ancestor which
stored it. Tables are appended and never rewritten, so readers of an older generation aren't disturbed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import chain
from brindle.operators.ordered import running_ordered

TABLES = ("set", "files", "extents", "tags", "recovery")
#: Slices in one part of a split table.
PART = 65_536


def file_id(length: str = "length", content_hash: str = "content_hash", name: str = "name") -> F.Column:
    """A file's identity: a digest of its length, content hash and name."""
    return F.sha2(F.concat(F.lit("file id"), F.col(length).cast("string"), F.col(content_hash), F.col(name)), 256)


def split_parts(rows: DataFrame, key: str = "slice", part: int = PART) -> DataFrame:
    """rows with `part`, the number of the split table that each belongs to."""
    return rows.withColumn("part", F.floor(F.col(key) / part).cast("long"))


def append(spark: SparkSession, path: str, name: str, generation: int, rows: DataFrame) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/generation={generation}")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def set_identity(files: DataFrame) -> str:
    """A digest of all files' identities in order, merged in ranges: of each range's digests, and then of those."""
    by = files.groupBy(F.substring("file_id", 1, 2).alias("range")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("file_id")), ""), 256).alias("h"))
    rows = by.orderBy("range").collect()  # 256 at most
    import hashlib

    return hashlib.sha256("".join(r["h"] for r in rows).encode()).hexdigest()


def add_generation(spark: SparkSession, path: str, entries: DataFrame, slice_size: int, number: int | None = None) -> int:
    """Stores entries (name, length, content_hash) as the next generation and gives its number; what the newest one holds already isn't stored again.

    number: of a writer that may run again, its own; the generation before it is the newest then.
    """
    try:
        old = read(spark, path, "set").filter("true" if number is None else f"generation < {number}").orderBy(F.desc("generation")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    number, base = (old["generation"] + 1, old["stream_base"] + old["stream_length"]) if old else (0, 0)
    files = entries.select(file_id().alias("file_id"), "name", "length", "content_hash")
    if old:
        known = effective(spark, path, old["generation"]).select("file_id")
        new, kept = files.join(known, "file_id", "left_anti"), files.join(known, "file_id", "left_semi")
    else:
        new, kept = files, files.limit(0)
    append(spark, path, "files", number, new)
    append(spark, path, "inherited", number, kept.select("file_id"))
    stored = spark.read.parquet(f"{path}/files/generation={number}")
    at = running_ordered(stored.select("file_id", "name", "length"), "name", F.col("length"), "stream_offset")
    append(spark, path, "extents", number, at.filter("length > 0").select("file_id", F.lit(0).alias("idx"), (F.col("stream_offset") + base).alias("stream_offset"), "length"))
    length = int(stored.agg(F.sum("length")).first()[0] or 0)
    row = [(set_identity(files), old["set_id"] if old else None, base, length, slice_size)]
    append(spark, path, "set", number, spark.createDataFrame(row, "set_id string, parent_id string, stream_base long, stream_length long, slice_size long"))
    return number


def effective(spark: SparkSession, path: str, generation: int) -> DataFrame:
    """(file_id, name, length, content_hash, owner): the manifest of a generation; owner is the nearest generation, itself included, that stores the file."""
    files = read(spark, path, "files").filter(F.col("generation") <= generation)
    ids = spark.read.parquet(f"{path}/files/generation={generation}").select("file_id").union(spark.read.parquet(f"{path}/inherited/generation={generation}").select("file_id"))
    own = files.join(ids, "file_id", "left_semi").groupBy("file_id").agg(F.max(F.struct("generation", "name", "length", "content_hash")).alias("f"))
    return own.select("file_id", "f.name", "f.length", "f.content_hash", F.col("f.generation").alias("owner"))


def generations(spark: SparkSession, path: str) -> DataFrame:
    """(generation, set_id, parent_id, stream_base, stream_length, linked): linked where the parent is there and ends where the generation begins."""
    g = read(spark, path, "set")
    p = g.select(F.col("set_id").alias("_id"), (F.col("stream_base") + F.col("stream_length")).alias("_end"))
    ok = F.col("parent_id").isNull() & (F.col("stream_base") == 0) | F.coalesce(F.col("_end") == F.col("stream_base"), F.lit(False))
    return g.join(F.broadcast(p), F.col("parent_id") == F.col("_id"), "left").select("generation", "set_id", "parent_id", "stream_base", "stream_length", ok.alias("linked"))


def lineage_of(spark: SparkSession, path: str) -> DataFrame:
    g = read(spark, path, "set")
    ids = g.select(F.col("set_id").alias("_id"), F.col("generation").alias("parent"))
    return chain.lineage(g.join(F.broadcast(ids), F.col("parent_id") == F.col("_id"), "left").select("generation", "parent"))


def written_right(written: DataFrame, meant: DataFrame) -> bool:
    """Whether a table that was read back has exactly the rows that were meant, by count and two sums of hashes."""

    def told(d: DataFrame) -> tuple:
        h = F.xxhash64(*sorted(d.columns))
        return tuple(d.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())

    return told(written) == told(meant)
