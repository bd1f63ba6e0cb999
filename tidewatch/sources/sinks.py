"""Durable tables by event day, retention, topics and notification sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_day(df: DataFrame, t: str = "t") -> DataFrame:
    """``event_date`` from epoch seconds, in UTC."""
    return df.withColumn("event_date", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(t) / 86400).cast("int")))


def write_daily(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet in a folder for each day; rows of a day are brought together first, so a day gets few files.

    Of a day with far more rows than others, adaptive execution splits the partition.
    """
    with_day(df).hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def expired(days: DataFrame, now: int, keep_days: int = 7) -> DataFrame:
    """Days that the retention of ``keep_days`` days drops at ``now``."""
    return days.filter(F.col("day") < now // 86400 - keep_days)


def to_topic(df: DataFrame, brokers: str, topic: str, checkpoint: str):
    """A stream of rows as JSON to a Kafka topic; needs the Kafka connector on the class path."""
    out = df.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("kafka")
    return out.option("kafka.bootstrap.servers", brokers).option("topic", topic).option("checkpointLocation", checkpoint)


def daily_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A writer for ``fan_out``: rows by day and batch under ``path``; a batch that comes again replaces what it had written."""

    def write(batch: DataFrame, number: int) -> None:
        rows = with_day(batch).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(path)

    return write


def topic_batches(brokers: str, topic: str, key: Callable[[], object]) -> Callable[[DataFrame, int], None]:
    """A writer for ``fan_out``: rows as JSON to a topic under a key that names the row, by which a compacted topic keeps one copy; needs the Kafka connector."""

    def write(batch: DataFrame, number: int) -> None:
        out = batch.select(key().alias("key"), F.to_json(F.struct("*")).alias("value")).write.format("kafka")
        out.option("kafka.bootstrap.servers", brokers).option("topic", topic).save()

    return write


def fan_out(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that computes a batch once and hands it with its number to all writers.

    If one of them fails the batch comes again with the same number, to those that had written it too: with writers that
    replace what a number has written, as ``daily_batches`` does, every row is there once.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for write in writers:
                write(batch, number)
        finally:
            batch.unpersist()

    return run


def csv(df: DataFrame, path: str) -> None:
    """Flat rows as CSV with a header, one file for each partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def state_path(spark: SparkSession) -> str:
    """A new folder for a saved state, under the one that the cluster shares; only a session on one machine may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidewatch-state-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read from there, for a table that several branches of a plan use; lost executors cost no recomputation."""
    path = state_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
