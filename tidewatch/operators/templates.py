"""Log templates by Drain's parse tree of fixed depth (He et al., ICWS 2017) (M5, T4, Q5).

Lines are masked and counted as Spark aggregates first; what is left to mine are distinct masked strings, in the order
in which they first came.  A string's path in the tree is its number of tokens and its leading tokens; a token with a digit,
or one that came when its node had no room for another child, goes under ``<*>``.  Which tokens had room depends on
their first arrival alone, so paths are found by ranks, and the leaves are mined apart from each other, each in its own task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.common import bucket
from tidewatch.operators import buckets

SIMILARITY, DEPTH, CHILDREN = 0.4, 4, 100
WILD = "<*>"
ARRIVAL = ("t", "event_id", "rep")


def _similar(pattern: list[str], parts: list[str]) -> tuple[float, int]:
    """Share of equal tokens, variables aside, and how many variables the pattern has."""
    return sum(a == b for a, b in zip(pattern, parts) if a != WILD) / max(1, len(pattern)), pattern.count(WILD)


def _routed(rows: DataFrame, levels: int, children: int) -> DataFrame:
    """``rows`` with the leaf that each string belongs to: its path of tokens, each of which had room or is ``<*>``."""
    rows = rows.withColumn("path", F.col("n").cast("string"))
    for i in range(levels):
        token = F.try_element_at("tokens", F.lit(i + 1))
        rows = rows.withColumn("token", F.when(token.rlike("[0-9]"), F.lit(WILD)).otherwise(token))
        came = rows.filter(F.col("token").isNotNull() & (F.col("token") != WILD)).groupBy("path", "token").agg(F.min("first").alias("came"))
        order = F.row_number().over(Window.partitionBy("path").orderBy("came", "token"))
        room = came.withColumn("rank", order).filter(F.col("rank") < children).select("path", "token", F.lit(True).alias("room"))
        child = F.when(F.col("token").isNull(), "").when(F.col("room"), F.col("token")).otherwise(WILD)
        rows = rows.join(room, ["path", "token"], "left").withColumn("path", F.concat_ws(" ", "path", child)).drop("token", "room")
    return rows


def mine(lines: DataFrame, template: str = "template", similarity: float = SIMILARITY, depth: int = DEPTH, children: int = CHILDREN, arrival: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """(template, cluster, size): the cluster's pattern has ``<*>`` where its members differ.

    Strings come in the order of ``arrival``, of those columns that ``lines`` has, then of their own text.
    """
    came = [c for c in arrival if c in lines.columns]
    text = F.col(template).alias("template")
    if set(came) == set(ARRIVAL) and all(lines.schema[c].dataType.simpleString() in ("bigint", "int") for c in came):
        # by day first, where arrivals are single numbers whose minimum is hashed; that of structs would sort all lines
        rows = lines.withColumn("bucket", bucket(F.col("t"), 86400)).withColumn("arrival", buckets.arrival())
        lines = rows.groupBy(text, "bucket").agg(F.count("*").alias("count"), F.min("arrival").alias("arrival")).withColumn("first", buckets.arrived())
        lines, text, n = lines.select("template", "count", "first.*"), F.col("template"), F.sum("count")
    else:
        n = F.count("*")
    counted = lines.groupBy(text).agg(n.alias("count"), F.min(F.struct(*came, text.alias("_text"))).alias("first"))
    keyed = _routed(counted.withColumn("tokens", F.split("template", " ")).withColumn("n", F.size("tokens")), depth - 2, children)
    keyed = keyed.withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy("first")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list] = []
        of = []
        for text, count in pdf.sort_values("turn")[["template", "count"]].itertuples(index=False):
            parts, best, at = text.split(" "), (-1.0, -1), -1
            for i, (pattern, _) in enumerate(clusters):
                near = _similar(pattern, parts)
                if near > best:  # of equal ones that with more variables
                    best, at = near, i
            if best[0] < similarity:
                clusters.append([parts, 0])
                at = len(clusters) - 1
            pattern = clusters[at]
            pattern[0] = [a if a == b else WILD for a, b in zip(pattern[0], parts)]
            pattern[1] += int(count)
            of.append((text, at))
        return pd.DataFrame([(t, " ".join(clusters[i][0]), clusters[i][1]) for t, i in of], columns=["template", "cluster", "size"])

    return keyed.select("path", "turn", "template", "count").groupBy("path").applyInPandas(run, "template string, cluster string, size long")


def top(mined: DataFrame, n: int = 100) -> DataFrame:
    """The largest clusters (T4)."""
    return mined.groupBy("cluster").agg(F.max("size").alias("size")).orderBy(F.desc("size"), "cluster").limit(n)
