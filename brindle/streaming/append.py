"""Generations from a stream: each micro-batch of changed entries is stored as the next generation of a set."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources import sets
from brindle.sources.catalog import shared_dir


def append_stream(spark: SparkSession, path: str, changes: DataFrame, slice_size: int, checkpoint: str | None = None) -> int:
    """Stores a streaming DataFrame (name, length, content_hash) when all that is available has been read, and gives the last generation's number.

    An entry replaces the one of its name; others stay. Of several in a batch, the one of the largest content hash counts. A batch
    that runs again after a failure finds its own generation and stores it anew. -1: there was nothing.
    """
    done = {}

    def add(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("name").agg(F.max_by(F.struct("length", "content_hash"), "content_hash").alias("e")).select("name", "e.*")
        if number:
            old = sets.effective(spark, path, number - 1).select("name", "length", "content_hash")
            new = new.union(old.join(new.select("name"), "name", "left_anti").select(*new.columns))
        done["last"] = sets.add_generation(spark, path, new, slice_size, number)

    query = changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/append-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    return done.get("last", -1)
