"""One-pass encoding of a stream of slices: each micro-batch adds partial recovery slices, which XOR to the whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brindle.operators import coding
from brindle.sources.catalog import shared_dir


def encode_stream(spark: SparkSession, slices: DataFrame, recovery: int, size: int, bits: int = 8, per_set: int | None = None) -> DataFrame:
    """([set_no,] exponent, data) of a streaming DataFrame (slice, data), when all that is available has been read.

    A batch overwrites its own part of the state, so a batch that runs again after a failure doesn't cancel itself; a slice must
    come in one batch only. The state is (batches) * recovery * size bytes on disk and recovery * size in a task.
    """
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def add(batch: DataFrame, number: int) -> None:
        coding.encode_sets(batch, per_set or (1 << bits) - recovery, recovery, size, bits).write.mode("overwrite").parquet(f"{base}/parts/batch={number}")

    query = slices.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    keys = ["set_no", "exponent"] if per_set else ["exponent"]
    return coding.merge(spark.read.parquet(f"{base}/parts").select(*keys, "data"), keys)
