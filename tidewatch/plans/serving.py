"""Read side: histograms, top lists, feeds, case files, state lookups and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.common import rnd

#: Lookback and histogram step in seconds of each traffic window.
WINDOWS = {"15m": (900, 10), "1h": (3600, 30), "6h": (21600, 180), "24h": (86400, 600)}


def between(df: DataFrame, since: int, until: int) -> DataFrame:
    """Rows of [since, until]; on a table by event day its partitions are pruned too."""
    rows = df.filter(F.col("t").between(since, until))
    if "event_date" in df.columns:
        day = lambda s: F.date_add(F.lit("1970-01-01").cast("date"), s // 86400)
        rows = rows.filter(F.col("event_date").between(day(since), day(until)))
    return rows


def histogram(df: DataFrame, since: int, until: int, step: int, counts: dict[str, Column]) -> DataFrame:
    """Counts by step over the whole span, 0 where nothing happened."""
    spark = df.sparkSession
    first = since // step * step
    spine = spark.range(0, (until - first) // step + 1).select((F.col("id") * step + first).alias("bucket"))
    rows = between(df, since, until).groupBy((F.floor(F.col("t") / step) * step).cast("long").alias("bucket")).agg(*[c.alias(n) for n, c in counts.items()])
    return spine.join(F.broadcast(rows) if (until - first) // step < 100_000 else rows, "bucket", "left").fillna(0)


def traffic(df: DataFrame, window: str, now: int) -> DataFrame:
    """Requests, declines, errors and attacks over a named window before ``now`` (Q7)."""
    if window not in WINDOWS:
        raise ValueError(f"window is one of {', '.join(WINDOWS)}")
    back, step = WINDOWS[window]
    return histogram(df, now - back, now, step, traffic_counts())


def traffic_counts() -> dict[str, Column]:
    return {"total": F.count("*"), "declined": F.count_if(F.col("status") == "declined"), "errors": F.count_if("error"), "attacks": F.count_if("is_attack")}


def whole_buckets(hist: DataFrame) -> DataFrame:
    """Without the last bucket, which may be partial, if there are more than three."""
    last = hist.agg(F.max("bucket").alias("_last"), F.count("*").alias("_n"))
    return hist.join(F.broadcast(last)).filter((F.col("_n") <= 3) | (F.col("bucket") < F.col("_last"))).drop("_last", "_n")


def totals(hist: DataFrame, names: list[str]) -> DataFrame:
    """Sums over all buckets (A10)."""
    return hist.agg(*[F.sum(n).alias(n) for n in names])


def terms(df: DataFrame, key: str, n: int, more: list[Column] | None = None) -> DataFrame:
    """The n most frequent values; nulls aside, ties by value."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("count"), *(more or [])).orderBy(F.desc("count"), "key").limit(n)


def terms_over_time(df: DataFrame, key: str, step: int, n: int) -> DataFrame:
    """Counts by step of its n most frequent values."""
    rows = df.filter(F.col(key).isNotNull()).groupBy((F.floor(F.col("t") / step) * step).cast("long").alias("bucket"), F.col(key).alias("key")).count()
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("count"), "key"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def counters(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row for each named filter."""
    one = df.agg(*[F.count_if(c).alias(f"_{i}") for i, c in enumerate(named.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_{i}").alias("count")) for i, name in enumerate(named)])
    return one.select(F.inline(pairs))


def max_over_time(docs: DataFrame, step: int) -> DataFrame:
    """Largest score by step and kind of entity."""
    return docs.groupBy((F.floor(F.col("t") / step) * step).cast("long").alias("bucket"), "entity_type").agg(F.max("score").alias("max_score"))


def alert_feed(alerts: DataFrame, now: int, limit: int = 30) -> DataFrame:
    """The latest alerts of the last day, with how many there are; the limit is held to 1..100 (T5, Q8)."""
    day = alerts.filter((F.col("t") > now - 86400) & (F.col("t") <= now))
    latest = day.orderBy(F.desc("t"), "entity_type", "entity_id", "alert_type", "source").limit(max(1, min(100, limit)))
    return latest.join(F.broadcast(day.agg(F.count("*").alias("total"))))


def feed_by_summary(alerts: DataFrame, n: int = 15) -> DataFrame:
    """Summaries by when they last came (A15); one of over 512 characters is no key."""
    key = F.when(F.length("summary") <= 512, F.col("summary"))
    return alerts.withColumn("key", key).filter("key is not null").groupBy("key").agg(F.count("*").alias("count"), F.max("t").alias("latest")).orderBy(F.desc("latest"), "key").limit(n)


def entity_events(df: DataFrame, entity_type: str, entity_id: str, limit: int = 20) -> DataFrame:
    """Latest events of a payer or address."""
    columns = {"payer": "payer_id", "client_ip": "client_ip"}
    if entity_type not in columns:
        raise ValueError("entity_type is payer or client_ip")
    rows = df.filter(F.col(columns[entity_type]) == entity_id).orderBy(F.desc("t"), F.desc("event_id"), F.desc("rep")).limit(limit)
    return rows.select("t", "event_id", "rep", "event_type", "channel", "amount", "status", "client_ip", "payer_id")


def entity_case(entities: DataFrame, baselines: DataFrame, drift: DataFrame, events: DataFrame) -> DataFrame:
    """Baseline, drift state and number of events of each asked entity; drift is for payers only.

    ``entities`` and ``baselines`` have entity_type and entity_id, ``drift`` has payer, ``events`` has both keys and a count.
    """
    of_payer = drift.select(F.lit("payer").alias("entity_type"), F.col("payer").alias("entity_id"), "s_volume", "s_amount", "i")
    keys = ["entity_type", "entity_id"]
    return entities.join(baselines, keys, "left").join(of_payer, keys, "left").join(events, keys, "left")


def pulse(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of single values side by side in one (J11, Q10); a part without a row gives nulls."""
    out = None
    for name, part in parts.items():
        one = part.limit(1).agg(F.first(F.struct("*")).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def health(parts: DataFrame) -> DataFrame:
    """State of each service from what it reports (F24). Columns: reachable, loaded, error, warming, lag."""
    state = F.when(~F.col("loaded"), "loading").when(~F.col("reachable"), "offline").when(F.col("error"), "error").when(F.col("warming"), "warming").when(F.col("lag") > 0, "degraded").otherwise("ok")
    return parts.withColumn("state", state)


def history(points: DataFrame, n: int = 120) -> DataFrame:
    """The latest points, with least, largest and last score."""
    kept = points.orderBy(F.desc("tick")).limit(n)
    return kept.agg(F.min("global_score").alias("min"), F.max("global_score").alias("max"), F.max_by("global_score", "tick").alias("latest"), F.count("*").alias("points"))


def worst_drift(latest: DataFrame) -> DataFrame:
    """The payer whose larger chart is largest."""
    return latest.orderBy(F.desc(F.greatest("s_volume", "s_amount")), "payer").limit(1)


def evidence(assessed: DataFrame) -> DataFrame:
    """What drifting payers moved, by payer (dashboard table of cumulative evidence)."""
    rows = assessed.filter("is_anomalous")
    return rows.groupBy("payer").agg(F.count("*").alias("buckets"), F.max("exc_events").alias("events"), rnd(F.max("exc_amount"), 2).alias("amount"), rnd(F.max(F.greatest("s_volume", "s_amount")), 4).alias("peak"))
