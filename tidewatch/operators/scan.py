"""Ordered folds over one long sequence, in parallel.

A sequence is cut into chunks.  What a chunk does to any state, its *map*, is found for all chunks at once; maps of many
chunks compose into one, and those again, so that the state before every chunk is known after a few small steps; then
all chunks are folded at once from their own state.  No step holds more than ``width`` rows of a chunk or maps, but for the
last, whose rows are the sequence's length over ``width`` to the power of ``levels``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def states_before(maps: DataFrame, start: tuple, apply: Callable, compose: Callable, state: str, width: int = 1024, levels: int = 2) -> DataFrame:
    """``chunk`` and the state before it.

    ``maps`` has ``chunk`` and what ``apply(state, row)`` needs to make the next state, and ``compose(row, row)`` to make one map of
    two; rows are tuples without the chunk.  ``state`` is the schema of a state.
    """
    schema = "chunk long, " + state

    def run(pdf: pd.DataFrame, held: tuple) -> pd.DataFrame:
        out = []
        for chunk, *row in pdf.sort_values("chunk").itertuples(index=False):
            out.append((chunk, *held))
            held = apply(held, tuple(row))
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    if levels == 1:
        return maps.groupBy(F.lit(0).alias("_top")).applyInPandas(lambda pdf: run(pdf, start), schema)

    def composed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, *row in pdf.sort_values("chunk").itertuples(index=False):
            whole = tuple(row) if whole is None else compose(whole, tuple(row))
        return pd.DataFrame([(key[0], *whole)], columns=pdf.columns)

    above = F.floor(F.col("chunk") / width).cast("long")
    upper = states_before(maps.groupBy(above.alias("_above")).applyInPandas(composed, maps.schema), start, apply, compose, state, width, levels - 1)

    def below(mine: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        return run(mine, next(before.iloc[:, 1:].itertuples(index=False, name=None)))

    return maps.groupBy(above.alias("_above")).cogroup(upper.groupBy(F.col("chunk").alias("_above"))).applyInPandas(below, schema)


def running_last(rows: DataFrame, at: str, columns: list[str], width: int = WIDTH, levels: int = 3) -> DataFrame:
    """``rows`` with each of ``columns`` replaced by its last value so far that isn't null.

    ``at`` numbers the rows from 0 on without a gap.
    """
    rows = rows.withColumn("_chunk", F.floor(F.col(at) / (width if levels > 1 else 1 << 62)).cast("long"))
    order = Window.partitionBy("_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in columns})
    if levels == 1:
        return rows.drop("_chunk")
    ends = rows.groupBy("_chunk").agg(*[F.max_by(c, at).alias(c) for c in columns]).withColumnRenamed("_chunk", "_at")
    before = running_last(ends, "_at", columns, width, levels - 1).select((F.col("_at") + 1).alias("_chunk"), *[F.col(c).alias(f"_before_{c}") for c in columns])
    out = rows.join(before, "_chunk", "left").withColumns({c: F.coalesce(c, f"_before_{c}") for c in columns})
    return out.drop("_chunk", *[f"_before_{c}" for c in columns])


def lagged(rows: DataFrame, at: str, column: str, name: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``column`` of the row before as ``name``; null for the first."""
    rows = rows.withColumn("_chunk", F.floor(F.col(at) / width).cast("long"))
    last = rows.filter(F.col(at) % width == width - 1).select((F.col("_chunk") + 1).alias("_chunk"), F.col(column).alias("_chunk_end"))
    here = F.lag(column).over(Window.partitionBy("_chunk").orderBy(at))
    return rows.withColumn(name, here).join(last, "_chunk", "left").withColumn(name, F.coalesce(name, "_chunk_end")).drop("_chunk", "_chunk_end")


#: No row before.
NONE = -(1 << 62)


def chained(rows: DataFrame, at: str, mark: str, hops: int, jumps: Callable[[pd.DataFrame], list[int]], first: int, width: int = WIDTH) -> DataFrame:
    """The rows that a chain of jumps lands on, from row ``first`` on, with ``_from``, the ``mark`` of the row before on the chain (null for the first).

    ``jumps(pdf)`` says of each of a chunk's rows how many rows further its jump lands, ``hops`` at most, 0 for none any more; it
    also sees the next ``hops`` rows.  ``at`` numbers the rows from 0 on without a gap, and ``first`` is below ``hops``.
    """
    width = max(width, 4 * hops)
    own = F.floor(F.col(at) / width).cast("long")
    near = F.when((F.col(at) % width < hops) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_chunk", F.explode(near))

    def ahead(pdf: pd.DataFrame, chunk: int) -> tuple[pd.DataFrame, list[int]]:
        pdf = pdf.sort_values(at, ignore_index=True)
        mine = int((pdf[at] < (chunk + 1) * width).sum())
        return pdf, [i + j if j else -1 for i, j in enumerate(jumps(pdf)[:mine])]

    def mapped(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each row that the chain may enter by: where it enters the next chunk, and its last row here."""
        pdf, to = ahead(pdf, key[0])
        out, last = [-1] * len(to), pdf[mark].tolist()[: len(to)]
        for i in range(len(to) - 1, -1, -1):
            if 0 <= to[i] < len(to):
                out[i], last[i] = out[to[i]], last[to[i]]
            elif to[i] >= 0:
                out[i] = to[i] - width
        return pd.DataFrame([(key[0], out[:hops], last[:hops])], columns=["chunk", "leaves", "last"])

    def apply(state: tuple, row: tuple) -> tuple:
        enters, _ = state
        return (-1, NONE) if enters < 0 else (int(row[0][enters]), int(row[1][enters]))

    def compose(a: tuple, b: tuple) -> tuple:
        through = [(-1, int(last)) if e < 0 else (int(b[0][e]), int(b[1][e])) for e, last in zip(a[0], a[1])]
        return [e for e, _ in through], [x for _, x in through]

    def follow(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf, to = ahead(pdf, key[0])
        marks = pdf[mark].tolist()
        i, before = (int(state["enters"].iloc[0]), int(state["before"].iloc[0])) if len(state) else (-1, NONE)
        at_rows, since = [], []
        while 0 <= i < len(to):
            at_rows.append(i)
            since.append(None if before == NONE else before)
            before, i = marks[i], to[i]
        return pdf.iloc[at_rows].assign(_from=pd.array(since, dtype="Int64"))[[*names, "_from"]]

    names = rows.columns
    maps = dealt.groupBy("_chunk").applyInPandas(mapped, "chunk long, leaves array<int>, last array<long>")
    entered = states_before(maps, (first, NONE), apply, compose, "enters long, before long")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _from long"
    return dealt.groupBy("_chunk").cogroup(entered.groupBy(F.col("chunk").alias("_chunk"))).applyInPandas(follow, schema)
