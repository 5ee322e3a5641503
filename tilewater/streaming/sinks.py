"""Running streams to files in the shared checkpoint folder; nothing passes through the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewater.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drain_append(stream: DataFrame, name: str, root: str | None = None, **trigger) -> DataFrame:
    """Run an append-mode stream over what is available now; the result is the written table.

    With `root` the table and the stream's progress live there, so a later call goes on where this one stopped. `trigger` is handed to
    the stream (for example processingTime="1 minute"; such a stream runs until it is stopped).
    """
    spark = stream.sparkSession
    root = root or shared_folder(spark, name)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out") \
        .option("checkpointLocation", f"{root}/state").trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def drain_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int, str], None], mode: str = "append", root: str | None = None,
                  **trigger) -> str:
    """Run `write(batch, batch_id, root)` per micro-batch; returns the folder it wrote under. `root` and `trigger` as in `drain_append`.

    `write` must put its output under a path that depends on the batch id, so that a repeated batch overwrites itself.
    """
    root = root or shared_folder(stream.sparkSession, name)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state") \
        .foreachBatch(lambda df, i: write(df, i, root)).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return root
