"""The detection engine on streams (ST1-ST11, S3, S5, S9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch.config import DEDUP_SECONDS
from tidewatch.sources.telemetry import RAW_SCHEMA


def read_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON envelopes from a folder, as they arrive."""
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_topic(spark: SparkSession, brokers: str, topic: str, replay: bool = True) -> DataFrame:
    """Messages of a Kafka topic; scorers that need history replay from the start (ST11). Needs the Kafka connector."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    return stream.option("startingOffsets", "earliest" if replay else "latest").load().select(F.col("value").cast("string").alias("value"))


def timed(raw: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Rows with ``ts`` under a watermark; without a readable time they go (P8, ST4)."""
    return raw.withColumn("ts", F.try_to_timestamp("timestamp")).filter("ts is not null").withWatermark("ts", lateness)


class LateRows(StreamingQueryListener):
    """Counts, by query, the rows that came after the watermark had passed their bucket and were left out (ST4).

    Add it with ``spark.streams.addListener``; ``counts`` goes by the query's id.
    """

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.counts[str(p.id)] = self.counts.get(str(p.id), 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def slowest_first(streams: list[DataFrame], lateness: str = "0 seconds") -> DataFrame:
    """One stream for each partition: under the default policy the watermark is that of the slowest (ST2)."""
    out = timed(streams[0], lateness)
    for s in streams[1:]:
        out = out.unionByName(timed(s, lateness))
    return out


def grains(events: DataFrame, width: str = "1 minute") -> DataFrame:
    """Tumbling buckets at three grains (ST1): each event goes to the grains that it has a key for, then one aggregation."""
    entities = F.filter(
        F.array(
            F.struct(F.lit("global").alias("entity_type"), F.lit("global").alias("entity_id")),
            F.struct(F.lit("payer").alias("entity_type"), F.nullif("payer_id", F.lit("")).alias("entity_id")),
            F.struct(F.lit("client_ip").alias("entity_type"), F.nullif("client_ip", F.lit("")).alias("entity_id")),
        ),
        lambda e: e["entity_id"].isNotNull(),
    )
    rows = events.select("ts", "amount", "status", "raw_payload_valid", F.explode(entities).alias("e"))
    return rows.groupBy(F.window("ts", width), "e.entity_type", "e.entity_id").agg(
        F.count("*").alias("event_count"), F.sum(F.abs("amount")).alias("amount_sum"),
        F.count_if(F.col("status").isin("declined", "error", "malformed")).alias("error_count"), F.count_if(~F.coalesce("raw_payload_valid", F.lit(True))).alias("malformed_count"),
    )


def monitor(events: DataFrame, threshold: int, width: str = "5 minutes", every: str = "1 minute") -> DataFrame:
    """Sliding error counts above the threshold (ST3)."""
    errors = events.filter(F.col("status").isin("declined", "error", "malformed"))
    return errors.groupBy(F.window("ts", width, every)).count().filter(F.col("count") > threshold)


ALERT_OUT = T.StructType([T.StructField(n, t) for n, t in (("entity_type", T.StringType()), ("entity_id", T.StringType()), ("alert_type", T.StringType()), ("t", T.LongType()), ("sent", T.BooleanType()), ("suppressed_prior", T.LongType()))])
ALERT_STATE = T.StructType([T.StructField("last", T.LongType()), T.StructField("held", T.LongType())])


def throttle(alerts: DataFrame, seconds: int = DEDUP_SECONDS) -> DataFrame:
    """Alert throttling with state for each kind and entity, which goes after four windows without an alert (W12, ST6, ST7).

    ``alerts`` has entity_type, entity_id, alert_type and ``t`` in epoch seconds.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, held = state.get if state.exists else (None, 0)
        out = []
        for t in sorted(t for b in batches for t in b["t"]):
            sent = last is None or t - last >= seconds
            out.append((*key, t, sent, held if sent else 0))
            last, held = (t, 0) if sent else (last, held + 1)
        state.update((last, held))
        state.setTimeoutDuration(4 * seconds * 1000)
        yield pd.DataFrame(out, columns=ALERT_OUT.names)

    from pyspark.sql.streaming.state import GroupStateTimeout

    keyed = alerts.groupBy("entity_type", "entity_id", "alert_type")
    return keyed.applyInPandasWithState(run, ALERT_OUT, ALERT_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def save_state(states: DataFrame, path: str) -> None:
    """Baselines as a table, so that a new job can start from them."""
    states.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
