"""The run-state fold over a stream. Batch and stream share operators.cases.fold_run_state, so both give the same states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.cases import fold_run_state


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def start_fold(events: DataFrame, keys: list[str], status: str, order: str, name: str, checkpoint: str):
    """Starts a query that keeps the state of every stage in the in-memory table `name`; it ends when the input is read."""
    folded = fold_run_state(events, keys, status, order)
    return folded.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
