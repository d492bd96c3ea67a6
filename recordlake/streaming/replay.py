"""Replay of a changelog, batch by batch, into the current state.

The state is the row with the greatest ``seq`` of each key, so order and repetition of batches do not
matter: replaying a log twice gives the state of replaying it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordlake.operators.state import KEY, SAVE


def read_changes(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(changes: DataFrame, target: str, checkpoint: str, extra: tuple[str, ...] = (), available_now: bool = False):
    """A continuous replay: each batch appends the keys it changed, with the batch's number."""
    columns = ["seq", "op", "data", *extra]

    def put(batch: DataFrame, number: int) -> None:
        # named by its number, so that a batch that runs again replaces itself
        last = batch.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "seq").alias("s")).select(*KEY, "s.*")
        last.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(changes: DataFrame, target: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The live rows of what ``start`` has written to ``target`` so far."""
    columns = ["seq", "op", "data", *extra]
    kind = changes.select(*KEY, *columns).schema
    state = changes.sparkSession.read.schema(kind).parquet(target).groupBy(*KEY).agg(F.max_by(F.struct(*columns), "seq").alias("s"))
    return state.select(*KEY, *(F.col(f"s.{c}").alias(c) for c in columns)).filter(F.col("op") == SAVE)


def replay(changes: DataFrame, target: str, checkpoint: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Run all available changes into ``target``; the live rows at the end. Nothing of the state is held by the driver."""
    kind = changes.select(*KEY, "seq", "op", "data", *extra).schema
    changes.sparkSession.createDataFrame([], kind).write.mode("overwrite").parquet(f"{target}/batch=-1")
    start(changes, target, checkpoint, extra, available_now=True).awaitTermination()
    return current(changes, target, extra)
