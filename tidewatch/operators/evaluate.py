"""Detection quality and load measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.common import rnd


def confusion(truth: DataFrame, flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, precision, recall, F1 and false-positive rate; a key without prediction counts as not flagged.

    ``truth`` has ``attack``; ``flagged`` has ``flagged``.
    """
    rows = truth.join(flagged, keys, "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    out = rows.agg(
        F.count_if(F.col("attack") & F.col("flagged")).alias("tp"), F.count_if(~F.col("attack") & F.col("flagged")).alias("fp"),
        F.count_if(F.col("attack") & ~F.col("flagged")).alias("fn"), F.count_if(~F.col("attack") & ~F.col("flagged")).alias("tn"),
    )
    part = lambda a, b: F.when(b > 0, rnd(a / b, 4)).otherwise(0.0)
    p, r = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return out.withColumns({"precision": part(F.col("tp"), p), "recall": part(F.col("tp"), r), "f1": part(2 * F.col("tp"), p + r), "fp_rate": part(F.col("fp"), F.col("fp") + F.col("tn"))})


def recall_by(truth: DataFrame, flagged: DataFrame, keys: list[str], kinds: str) -> DataFrame:
    """Recall of each kind; a row may have several in the array ``kinds``."""
    rows = truth.join(flagged, keys, "left").select(F.explode(kinds).alias("kind"), F.coalesce("flagged", F.lit(False)).alias("flagged"))
    return rows.groupBy("kind").agg(F.count("*").alias("windows"), F.count_if("flagged").alias("found")).withColumn("recall", rnd(F.col("found") / F.col("windows"), 4))


def class_confusion(rows: DataFrame, classes: int = 3) -> DataFrame:
    """Of each true class how many rows are taken for which, and the share of right ones among all.

    ``rows`` has label and prediction, from 0 on.
    """
    every = Window.partitionBy()  # one row a class
    counts = [F.count_if(F.col("prediction") == k).alias(f"as_{k}") for k in range(classes)]
    cells = rows.groupBy(F.col("label").cast("int").alias("label")).agg(*counts, F.count_if(F.col("prediction") == F.col("label")).alias("right"), F.count("*").alias("n"))
    return cells.withColumn("accuracy", rnd(F.sum("right").over(every) / F.sum("n").over(every), 4)).drop("right", "n")


def amplitude(series: DataFrame, since) -> DataFrame:
    """Shift of each entity's mean from ``since`` on in deviations of what came before (A27). ``series`` has entity, x and at."""
    before = F.col("at") < since
    rows = series.groupBy("entity").agg(
        F.avg(F.when(~before, F.col("x"))).alias("inside"), F.avg(F.when(before, F.col("x"))).alias("mean"), F.stddev_pop(F.when(before, F.col("x"))).alias("sd"), F.count("*").alias("n")
    )
    return rows.withColumn("shift_sigma", F.when(F.col("sd") > 0, (F.col("inside") - F.col("mean")) / F.col("sd")))


def detection_delay(starts: DataFrame, alarms: DataFrame, group: str) -> DataFrame:
    """For each scenario how many were found, and the upper median and largest delay; an alarm from one day before counts.

    ``starts`` has entity, start_day and the scenario; ``alarms`` has entity and alarm_day.
    """
    first = starts.join(alarms, "entity", "left").filter("alarm_day IS NULL OR alarm_day >= start_day - 1").groupBy("entity", "start_day", group).agg(F.min("alarm_day").alias("alarm_day"))
    rows = starts.join(first.select("entity", "alarm_day"), "entity", "left").withColumn("delay", F.col("alarm_day") - F.col("start_day"))
    delays = F.array_sort(F.collect_list("delay"))
    out = rows.groupBy(group).agg(F.count("*").alias("actors"), F.count("delay").alias("found"), delays.alias("d"))
    return out.withColumns({"median_delay": F.try_element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int")), "max_delay": F.array_max("d")}).drop("d")


def observable(actors: DataFrame, activity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actors that have any activity, and entities with activity that are no actors."""
    seen = activity.select("entity").distinct()
    return actors.join(seen, "entity", "left_semi"), seen.join(actors, "entity", "left_anti")


def counter_rates(samples: DataFrame, counter: str, by: list[str]) -> DataFrame:
    """Rates per second between samples; null at the first one and where a counter went back."""
    order = Window.partitionBy(*by).orderBy("t")
    change, time = F.col(counter) - F.lag(counter).over(order), F.col("t") - F.lag("t").over(order)
    return samples.withColumn("rate", F.when((change >= 0) & (time > 0), rnd(change / time, 6)))


def total_rate(rates: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the known rates; null where none is known."""
    return rates.groupBy(*by).agg(rnd(F.sum("rate"), 6).alias("total_rate"))


def throughput(samples: DataFrame, counters: list[str], by: list[str]) -> DataFrame:
    """Growth of each counter over the span, nulls aside."""
    delta = lambda c: (F.max_by(c, F.when(F.col(c).isNotNull(), F.col("t"))) - F.min_by(c, F.when(F.col(c).isNotNull(), F.col("t")))).alias(f"{c}_delta")
    return samples.groupBy(*by).agg((F.max("t") - F.min("t")).alias("span"), *[delta(c) for c in counters])


def streaks(samples: DataFrame, condition, length: int, by: list[str]) -> DataFrame:
    """Samples at which ``condition`` has held ``length`` times in a row or more."""
    order = Window.partitionBy(*by).orderBy("t")
    rows = samples.withColumn("_hold", F.coalesce(condition, F.lit(False)))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_hold"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.count_if("_hold").over(Window.partitionBy(*by, "_island").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", count).filter(F.col("streak") >= length).drop("_hold", "_island")


def growing(counter: str, by: list[str]):
    return F.col(counter) > F.lag(counter).over(Window.partitionBy(*by).orderBy("t"))


def lags(sent: DataFrame, consumed: DataFrame, by: list[str]) -> DataFrame:
    """What was sent since the first sample but not consumed yet, at each sample of ``sent``.

    ``sent`` and ``consumed`` have ``t`` and a counter of their name, sampled at times of their own: of the consumed ones the last
    up to the other's time counts, found in one ordered pass over both.  Null until there is one.
    """
    none = lambda c: F.lit(None).cast("long").alias(c)
    rows = sent.select(*by, "t", F.col("sent").cast("long").alias("sent"), none("consumed")).unionByName(consumed.select(*by, "t", none("sent"), F.col("consumed").cast("long").alias("consumed")))
    order = Window.partitionBy(*by).orderBy("t", F.col("consumed").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    first = lambda c: F.first(c, ignorenulls=True).over(order)
    lag = (F.col("sent") - first("sent")) - (F.last("consumed", ignorenulls=True).over(order) - first("consumed"))
    return rows.withColumn("lag", lag).filter("sent IS NOT NULL").select(*by, "t", "lag")


def drained(lagging: DataFrame, by: list[str], flat: int = 10, times: int = 4, low: int = 100) -> DataFrame:
    """When the backlog first is gone (``low`` or less), or has stayed flat, changing by less than ``flat`` ``times`` in a row."""
    change = F.abs(F.col("lag") - F.lag("lag").over(Window.partitionBy(*by).orderBy("t")))
    still = streaks(lagging, change < flat, times, by).select(*by, "t", F.lit("flat").alias("how"))
    gone = lagging.filter(F.col("lag") <= low).select(*by, "t", F.lit("gone").alias("how"))
    return still.unionByName(gone).groupBy(*by).agg(F.min(F.struct("t", "how")).alias("s")).select(*by, "s.t", "s.how")
