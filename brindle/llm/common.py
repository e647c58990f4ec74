"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: a temporary one if all runs on this machine, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="brindle-"))
    return sc.getCheckpointDir()


#: Rows that go to a Python worker at once, so that few texts are held beside their copies there.
BATCH_ROWS = 1000


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(int(was), BATCH_ROWS) if int(was) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, was)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one or two numbers that are broadcast at most, and rows with a text key of 32 characters or a short list.
BROADCAST_ROWS = 1_000_000
BROADCAST_WIDE_ROWS = 250_000


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, as a worker holds each word of a batch at once."""
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))


def buckets_for(rows: int, rows_each: int = 50_000) -> int:
    return max(64, -(-rows // rows_each))


def running(df: DataFrame, name: str, weight: Column, by: list[str], tie: list[str], buckets: int, *, before: bool = True) -> DataFrame:
    """df with the running sum of weight over the rows of each group of `by`.

    No group meets in one task: rows are dealt by a hash of `tie` to buckets, summed within (group, bucket), and the bucket
    totals, one row for each group and bucket, are summed in turn. The order is (bucket, tie). Rows equal in `tie` stand in
    the order of all remaining columns, so the rows that equal one another entirely may swap without any effect.
    """
    rest = [c for c in df.columns if c not in by and c not in tie]
    order = [*tie, *rest]
    d = df.withColumn("_w", weight.cast("long")).withColumn("_b", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    keys = [*by, "_b"]
    sums = d.groupBy(*keys).agg(F.sum("_w").alias("_s"))
    at = Window.partitionBy(*by).orderBy("_b") if by else Window.partitionBy(F.lit(0)).orderBy("_b")
    sums = sums.withColumn("_before", F.sum("_s").over(at.rowsBetween(Window.unboundedPreceding, -1))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce("_before", F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    d = d.withColumn("_own", F.coalesce(F.sum("_w").over(own), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return d.join(sums, cond, "left").withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def spread_join(left: DataFrame, right: DataFrame, key: str, salt: list[str], rows: int, count: str = "n", each: int = 50_000, how: str = "inner") -> DataFrame:
    """left joined with right (one row for each key, with its rows in left as column `count`); a key of more than `each` rows is dealt out by `salt`.

    rows: how many left has at most; a smaller table has no such key. right should be a written table or cheap. how: inner or left.
    """
    if rows <= each:
        return left.join(right.drop(count), key, how)
    parts = F.ceil(F.col(count) / each).cast("int")
    hot = right.filter(F.col(count) > each).select(key, parts.alias("__parts"))
    n = hot.count()
    if not n:
        return left.join(right.drop(count), key, how)
    side = F.broadcast(hot) if n <= 1_000_000 else hot
    dealt = left.join(side, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    copies = F.when(F.col(count) > each, parts).otherwise(1)
    several = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop(count)
    return dealt.join(several, [key, "__salt"], how).drop("__salt")


def let(value: Column, body) -> Column:
    """body of a value that is computed once for the row: inside a lambda, an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
