"""From JSON messages to the nested document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.telemetry import RAW_SCHEMA


def decode(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Decoded envelopes, and the messages that are no JSON object (P1, ST10)."""
    parsed = messages.withColumn("_j", F.from_json(value, RAW_SCHEMA, {"mode": "PERMISSIVE"})).withColumn("_ok", F.trim(value).startswith("{") & F.expr(f"try_parse_json({value}) IS NOT NULL"))
    return parsed.filter("_ok").select(F.col(value).alias("raw"), "_j.*"), parsed.filter("_ok IS NOT TRUE").select(F.col(value).alias("raw"))


def normalize(flat: DataFrame, now: int, stage: str = "normalized") -> DataFrame:
    """The nested document. A timestamp that can't be read becomes ``now``, which is a parameter."""
    status = F.coalesce(F.col("status"), F.lit("unknown"))
    return flat.select(
        F.coalesce(F.try_to_timestamp("timestamp"), F.timestamp_seconds(F.lit(now)).cast("timestamp")).alias("@timestamp"),
        F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")).alias("event"),
        F.struct(F.coalesce("source", F.lit("generator")).alias("service")).alias("source"),
        F.struct("client_ip").alias("network"),
        F.struct("payer_id", "payee_id", "channel", "amount", "currency", status.alias("status"), "latency_ms").alias("transaction"),
        F.struct(F.coalesce("is_attack", F.lit(False)).alias("is_attack"), "attack_pattern", (~F.coalesce("raw_payload_valid", F.lit(True))).alias("is_malformed")).alias("security"),
        status.isin("declined", "error", "malformed").alias("error"),
        F.when(F.col("log_message").isNotNull(), F.struct(F.col("log_message").alias("message"))).alias("log"),
        F.struct(F.lit(stage).alias("pipeline_stage"), F.timestamp_seconds(F.lit(now)).cast("timestamp").alias("processed_at")).alias("ingest"),
    )


def flatten(docs: DataFrame) -> DataFrame:
    """Documents as the flat columns that scorers read; empty strings are null (P8, P19, P20), the payload is the JSON's length (F32)."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return docs.select(
        F.unix_seconds("@timestamp").alias("t"), F.col("event.id").alias("event_id"), F.col("event.type").alias("event_type"), text("transaction.payer_id").alias("payer_id"),
        text("transaction.payee_id").alias("payee_id"), text("network.client_ip").alias("client_ip"), F.col("transaction.channel").alias("channel"),
        F.when(F.abs("transaction.amount") < float("inf"), F.col("transaction.amount")).alias("amount"), F.col("transaction.status").alias("status"), F.col("error"),
        F.col("security.is_malformed").alias("is_malformed"), F.col("security.is_attack").alias("is_attack"), F.col("security.attack_pattern").alias("attack_pattern"),
        F.col("log.message").alias("log_message"), F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))).alias("payload_bytes"),
    )
