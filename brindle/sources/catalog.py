"""Entries of a catalogue: any table or file tree that holds bytes, with names, lengths and content hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.ordered import running_ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: a temporary one if all runs on this machine, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="brindle-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(docs: DataFrame) -> DataFrame:
    """documents as entries without order: name, length, content, content_hash (SHA-256)."""
    name = F.concat_ws("/", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    content = F.encode("text", "utf-8")
    return docs.select("doc_id", name.alias("name"), F.octet_length("text").cast("long").alias("length"), content.alias("content"), F.sha2(content, 256).alias("content_hash"))


def entries(docs: DataFrame) -> DataFrame:
    """named() with ord, the place in bytewise order of names (strings compare by their UTF-8 bytes)."""
    return running_ordered(named(docs), "name", F.lit(1), "ord")


def contents(docs: DataFrame) -> DataFrame:
    """ord and content of entries(). The order is found on names alone, so that no task holds the contents of a whole range; equal names are numbered on."""
    first = running_ordered(named(docs).select("name"), "name", F.lit(1), "ord").groupBy("name").agg(F.min("ord").alias("ord"))
    again = F.row_number().over(Window.partitionBy("name").orderBy("name")) - 1
    return named(docs).select("name", "content").join(first, "name").select((F.col("ord") + again).alias("ord"), "content")


def files(spark: SparkSession, path: str) -> DataFrame:
    """A file tree as entries: name relative to path, length, content, content_hash, mtime_ns.

    The reader passes over empty files, which come from its list of files, that the driver holds anyway; their mtime_ns is null.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/") + "/"
    name = F.substring_index("path", root, -1)
    out = f.select(name.alias("name"), F.col("length").cast("long").alias("length"), "content", F.sha2("content", 256).alias("content_hash"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    one = lambda p: F.regexp_replace(p, "^([A-Za-z0-9+.-]+):/+", "$1:/")
    every = spark.createDataFrame([(p,) for p in f.inputFiles()], "path string").select(one("path").alias("path"))
    empty = every.join(f.select(one("path").alias("path")), "path", "left_anti")
    none = F.lit(b"")
    out = out.union(empty.select(F.substring_index("path", root, -1), F.lit(0).cast("long"), none, F.sha2(none, 256), F.lit(None).cast("long")))
    return running_ordered(staged(out), "name", F.lit(1), "ord")


def has_magic(content: str, magic: bytes) -> F.Column:
    """Whether bytes begin with a format's magic, such as an older version's that isn't read."""
    return F.substring(F.col(content), 1, len(magic)) == F.lit(magic)
