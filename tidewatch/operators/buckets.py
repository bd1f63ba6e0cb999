"""Tumbling buckets at three grains, and their features (A1-A4, ST1)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import bucket, rnd


#: Room for a number of an event and of a repetition in ``arrival``.
EVENTS, REPS = Decimal(10**20), Decimal(10**10)


def arrival():
    """(t, event_id, rep) within ``bucket`` as one number in the same order, nulls first: its minimum is hashed, that of a struct sorts all rows."""
    place = F.coalesce((F.col("t") - F.col("bucket")).cast("decimal(8,0)"), F.lit(Decimal(0)))
    event = F.coalesce(F.col("event_id").cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1)), F.lit(Decimal(0)))
    rep = F.coalesce(F.col("rep").cast("decimal(10,0)") + F.lit(Decimal(2**31 + 1)), F.lit(Decimal(0)))
    return ((place * EVENTS + event) * REPS + rep).cast("decimal(38,0)")


def arrived():
    """The struct of ``t, event_id, rep`` that an ``arrival`` stands for."""
    a = F.col("arrival")
    above = ((a - a % REPS) / REPS).cast("decimal(28,0)")
    number = lambda c, zero, kind: F.when(c > 0, (c - F.lit(Decimal(zero))).cast(kind))
    event, rep = (above % EVENTS).cast("decimal(20,0)"), (a % REPS).cast("decimal(10,0)")
    t = F.col("bucket") + ((above - event) / EVENTS).cast("long")
    return F.struct(t.alias("t"), number(event, 2**63 + 1, "long").alias("event_id"), number(rep, 2**31 + 1, "int").alias("rep"))


#: Bits of a number of an event and of a repetition in ``near``; 17 are left for the seconds of a bucket.
EVENT_BITS, REP_BITS = 43, 3


def arrivals() -> dict:
    """``arrival`` in two columns for ``first_arrival``: ``near``, a long, where the numbers have room in one, ``arrival`` for the rest.

    Decimals of this size are objects; the sums by bucket handle longs several times faster.
    """
    place, event, rep = F.col("t") - F.col("bucket"), F.col("event_id"), F.col("rep")
    fits = place.between(0, (1 << (63 - EVENT_BITS - REP_BITS)) - 1) & event.between(0, (1 << EVENT_BITS) - 1) & rep.between(0, (1 << REP_BITS) - 1)
    near = F.when(fits, (place * (1 << EVENT_BITS) + event) * (1 << REP_BITS) + rep)
    return {"near": near.cast("long"), "arrival": F.when(near.isNull(), arrival())}


def first_arrival():
    """The earlier one of the structs that the least ``near`` and the least ``arrival`` of a bucket stand for."""
    n = F.col("near")
    event, rep = F.shiftright(n, REP_BITS).bitwiseAND(F.lit((1 << EVENT_BITS) - 1)), n.bitwiseAND(F.lit((1 << REP_BITS) - 1))
    t = F.col("bucket") + F.shiftright(n, EVENT_BITS + REP_BITS)
    near = F.struct(t.alias("t"), event.alias("event_id"), rep.cast("int").alias("rep"))
    return F.least(F.when(n.isNotNull(), near), F.when(F.col("arrival").isNotNull(), arrived()))


def grains(tele: DataFrame, seconds: int) -> DataFrame:
    """One pass over the events for (bucket), (bucket, payer) and (bucket, address): one Expand and one shuffle of partial sums.

    An event without payer or address, or with an empty one, counts in the other grains (A1, A2).
    """
    sums = [
        F.count("*").alias("event_count"),
        F.sum("payload_bytes").alias("payload_sum"),
        F.sum(F.abs("amount")).alias("amount_sum"),
        F.count("amount").alias("amount_n"),
        F.count_if("error").alias("error_count"),
        F.count_if("is_malformed").alias("malformed_count"),
        F.min("near").alias("near"),
        F.min("arrival").alias("arrival"),
    ]
    base = tele.withColumns({"bucket": bucket(F.col("t"), seconds), "payer": F.nullif("payer_id", F.lit("")), "ip": F.nullif("client_ip", F.lit(""))})
    base = base.withColumns(arrivals()).select("bucket", "payer", "ip", "payload_bytes", "amount", "error", "is_malformed", "near", "arrival")
    out = base.groupingSets([["bucket"], ["bucket", "payer"], ["bucket", "ip"]], "bucket", "payer", "ip").agg(F.grouping_id().alias("g"), *sums)
    kind = F.when(F.col("g") == 3, "global").when(F.col("g") == 1, "payer").otherwise("client_ip")
    out = out.withColumns({"entity_type": kind, "entity_id": F.when(F.col("g") == 3, "global").when(F.col("g") == 1, F.col("payer")).otherwise(F.col("ip"))})
    out = out.filter("entity_id is not null").withColumn("first", first_arrival())
    return out.select("bucket", "entity_type", "entity_id", "event_count", "payload_sum", "amount_sum", "amount_n", "error_count", "malformed_count", "first")


def features(grain: DataFrame) -> DataFrame:
    """Means and ratios, rounded as the scorers see them (A3)."""
    n = F.col("event_count")
    return grain.withColumns(
        {
            "mean_payload": rnd(F.col("payload_sum") / n, 1),
            "mean_amount": F.when(F.col("amount_n") > 0, rnd(F.col("amount_sum") / F.col("amount_n"), 2)).otherwise(0.0),
            "error_ratio": rnd(F.col("error_count") / n, 4),
        }
    )


def payer_buckets(tele: DataFrame, seconds: int, event_cap: float) -> DataFrame:
    """Count, sum of winsorized amounts and distinct payees of each payer and bucket."""
    base = tele.filter(F.nullif("payer_id", F.lit("")).isNotNull())
    return base.groupBy(bucket(F.col("t"), seconds).alias("bucket"), F.col("payer_id").alias("payer")).agg(
        F.count("*").alias("event_count"),
        F.sum(F.least(F.abs("amount"), F.lit(event_cap))).alias("amount_sum"),
        F.count_distinct("payee_id").alias("distinct_payees"),
    )
