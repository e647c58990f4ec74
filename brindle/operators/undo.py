"""A journal of the bytes that a repair overwrites, written before anything else, and its replay.

A journal is a folder with the tables `records` (name, created, begin, length, size, old, old_crc, record_crc) and `footer` (set_id, n,
payload, told). The footer is written last: without it, or where it doesn't tell of exactly the records that are there, the journal is
incomplete, so the repair that owns it wrote nothing yet. A record whose own checksums fail, or that names a path outside
the set, is an error, and then nothing is replayed.

Nulls: an entry without content holds no bytes. Writes beyond an entry's end keep what there was, so a replay cuts the entry to its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = ("name", "created", "begin", "length", "size", "old_crc")
RECORD = "name string, created boolean, begin long, length long, size long, old binary, old_crc long, record_crc long"
FOOTER = "set_id string, n long, payload long, told decimal(38,0)"


def _checked(records: DataFrame) -> DataFrame:
    r = records.withColumn("old_crc", F.crc32("old"))
    return r.withColumn("record_crc", F.crc32(F.to_json(F.struct(*_FIELDS)).cast("binary")))


def records(entries: DataFrame, writes: DataFrame) -> DataFrame:
    """What writes (name, begin, end) are about to overwrite in entries (name, content): one record for each; of a new entry, that it was created."""
    e = entries.select("name", F.coalesce("content", F.lit(b"")).alias("content"), F.lit(True).alias("there"))
    j = writes.select("name", "begin", "end").join(e, "name", "left")
    old = F.coalesce(F.expr("substring(content, int(begin + 1), int(end - begin))"), F.lit(b""))
    r = j.select("name", F.col("there").isNull().alias("created"), F.col("begin").cast("long").alias("begin"), old.alias("old"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"))
    return _checked(r.withColumn("length", F.octet_length("old").cast("long"))).select(*[c.split()[0] for c in RECORD.split(", ")])


def _told(rows: DataFrame) -> tuple[int, int, int]:
    r = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum(F.xxhash64("record_crc", "old_crc", "name").cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1]), int(r[2])


def write(spark: SparkSession, path: str, set_id: str, rows: DataFrame) -> None:
    """Writes a journal of records, read back for its footer."""
    rows.write.mode("errorifexists").parquet(f"{path}/records")
    n, payload, told = _told(spark.read.schema(RECORD).parquet(f"{path}/records"))
    spark.createDataFrame([(set_id, n, payload, told)], "set_id string, n long, payload long, told string").selectExpr("set_id", "n", "payload", "cast(told as decimal(38,0)) told").write.parquet(f"{path}/footer")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)
    return spark.read.schema(schema).parquet(path) if there else None


def status(spark: SparkSession, path: str) -> str:
    """complete, incomplete, or not-found."""
    rows, footer = _read(spark, f"{path}/records", RECORD), _read(spark, f"{path}/footer", FOOTER)
    if rows is None:
        return "not-found"
    told = footer.first() if footer is not None else None
    return "complete" if told and (told["n"], told["payload"], int(told["told"])) == _told(rows) else "incomplete"


def scan(spark: SparkSession, path: str, set_id: str, names: DataFrame) -> DataFrame:
    """The records of a complete journal of this set, all of them checked against their checksums and the set's names."""
    if (what := status(spark, path)) != "complete":
        raise ValueError(f"journal is {what}")
    if _read(spark, f"{path}/footer", FOOTER).first()["set_id"] != set_id:
        raise ValueError("the journal belongs to another set")
    rows = _read(spark, f"{path}/records", RECORD)
    again = _checked(rows.withColumnsRenamed({"old_crc": "was_old", "record_crc": "was_record"}))
    framed = (F.col("begin") >= 0) & (F.col("length") == F.octet_length("old")) & (F.col("size") >= 0)
    sound = framed & (F.col("old_crc") == F.col("was_old")) & (F.col("record_crc") == F.col("was_record"))
    if not again.filter(~F.coalesce(sound, F.lit(False))).isEmpty():
        raise ValueError("a record of the journal does not verify")
    if not rows.join(names.select("name").distinct(), "name", "left_anti").isEmpty():
        raise ValueError("a record of the journal names a path outside the set")
    return rows


def replay(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """entries (name, content) as they were before the repair that wrote the records; entries it created go."""
    r = rows.groupBy("name").agg(F.bool_or("created").alias("created"), F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("begin", "old"))).alias("olds"))  # an entry's own bytes
    j = entries.select("name", "content").join(r, "name", "left").filter(~F.coalesce("created", F.lit(False)))
    back = F.aggregate("olds", F.coalesce("content", F.lit(b"")), lambda c, x: F.overlay(c, x["old"], (x["begin"] + 1).cast("int"), F.octet_length(x["old"])))
    return j.select("name", F.when(F.col("olds").isNull(), F.col("content")).otherwise(F.substring(back, F.lit(1), F.col("size").cast("int"))).alias("content"))
