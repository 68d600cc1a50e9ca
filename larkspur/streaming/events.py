"""Continuous workload evidence: telemetry events that arrive as files are summed up batch by batch.

Every micro-batch is reduced to partial candidate counters and written under its batch id, so a batch that is
run again replaces itself; evidence() adds the partials up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.workload.analysis import candidates, counter
from larkspur.workload.telemetry import SCHEMA


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow a folder of Parquet events; partial counters go below target."""

    def write(batch: DataFrame, number: int) -> None:
        candidates(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def evidence(spark: SparkSession, target: str) -> DataFrame:
    """The same rows as candidates() over all events so far."""
    parts = spark.read.parquet(target)
    keys = ("collection", "path", "batch")
    return parts.groupBy("collection", "path").agg(*[counter(F.col(c)).alias(c) for c in parts.columns if c not in keys])
