"""Alert throttling, notification texts and the error monitor (W12, ST3, ST7, ST12, F19, F33, U1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEDUP_SECONDS, MONITOR_ERRORS


KEYS = ("entity_type", "entity_id", "alert_type")
#: A saved throttle: when the last alert of a key was sent, and how many were suppressed since.
SAVED = "entity_type string, entity_id string, alert_type string, last long, held long"


def throttle(alerts: DataFrame, seconds: int = DEDUP_SECONDS, initial: DataFrame | None = None) -> DataFrame:
    """``sent`` and ``suppressed_prior`` of every alert: a kind of alert of an entity is sent once in ``seconds``.

    The anchor is the last one sent, so this is a fold per key; keys are independent.  Of alerts at one time the order is
    by source and summary.  A key that is quiet for long keeps its count of suppressed ones.  ``turn`` numbers a key's alerts,
    and ``last`` and ``held`` are the state after each, from which a later run can go on as ``initial`` (S9, ``throttled``).
    """

    def fold(pdf: pd.DataFrame, last: int | None, held: int) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "source", "summary"], kind="stable")
        sent, prior, lasts, helds = [], [], [], []
        for t in pdf["t"]:
            if last is None or t - last >= seconds:
                sent.append(True)
                prior.append(held)
                last, held = t, 0
            else:
                sent.append(False)
                prior.append(0)
                held += 1
            lasts.append(last)
            helds.append(held)
        return pdf.assign(sent=sent, suppressed_prior=prior, turn=range(len(pdf)), last=lasts, held=helds)

    def resumed(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf, *((int(before["last"].iloc[0]), int(before["held"].iloc[0])) if len(before) else (None, 0)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alerts.schema.fields) + ", sent boolean, suppressed_prior long, turn long, last long, held long"
    if initial is None:
        return alerts.groupBy(*KEYS).applyInPandas(lambda pdf: fold(pdf, None, 0), schema)
    return alerts.groupBy(*KEYS).cogroup(initial.groupBy(*KEYS)).applyInPandas(resumed, schema)


def throttled(rows: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Each key's last state of ``throttle``; keys of ``initial`` without a new alert keep theirs."""
    states = rows.select(*KEYS, "turn", "last", "held")
    if initial is not None:
        states = states.unionByName(initial.select(*KEYS, F.lit(-1).cast("long").alias("turn"), "last", "held"))
    return states.groupBy(*KEYS).agg(F.max_by(F.struct("last", "held"), "turn").alias("s")).select(*KEYS, "s.*")


def message(limit: int | None = None):
    """Text of a notification (F19); ``limit`` as a receiver may have it."""
    badge = F.when(F.col("severity") == "high", "[HIGH]").when(F.col("severity") == "medium", "[MEDIUM]").otherwise("[LOW]")
    more = F.when(F.col("suppressed_prior") > 0, F.format_string("(+%d suppressed)", "suppressed_prior"))
    text = F.concat_ws(" ", badge, "alert_type", F.concat(F.col("entity_type"), F.lit(":"), F.col("entity_id")), F.lit("-"), "summary", more)
    return F.substring(text, 1, limit) if limit else text


def monitor(tele: DataFrame, width: int = 300, every: int = 60, threshold: int = MONITOR_ERRORS) -> DataFrame:
    """Sliding windows with more errors than allowed, as alerts (ST3, ST12).

    Errors are summed per step first, so an event is not copied into every window that holds it: only the step's sum is.
    """
    steps = tele.filter("error").groupBy((F.floor(F.col("t") / every) * every).cast("long").alias("step")).count()
    ends = steps.withColumn("t", F.explode(F.sequence(F.col("step") + every, F.col("step") + width, F.lit(every).cast("long"))))
    found = ends.groupBy("t").agg(F.sum("count").alias("errors")).filter(F.col("errors") > threshold)
    return found.select(
        "t", F.lit("error_rate_spike").alias("alert_type"), F.lit("medium").alias("severity"), F.lit("global").alias("entity_type"), F.lit("global").alias("entity_id"),
        F.lit(None).cast("double").alias("score"), F.lit("monitor").alias("source"), F.format_string("%d errors in the last %d s", "errors", F.lit(width)).alias("summary"), F.lit(1).alias("rank"), "errors",
    )
