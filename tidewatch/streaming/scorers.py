"""The scorers and the fusion as streams with keyed state (ST1, ST4, ST6-ST8, J1, J2, W1-W9).

Each is the batch operator's own fold, fed by what a micro-batch has finished: buckets that the watermark closes come
once and in order, so a key's state after them is all that the next batch needs.  Streams read telemetry as ``normalize``
and the adapter give it, with epoch seconds ``t``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.config import Drift, Fusion, Rate
from tidewatch.functions.common import rnd
from tidewatch.operators import drift, fusion, rate


def keep_state(spark: SparkSession) -> None:
    """The state store that state behind an aggregation needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def clocked(rows: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Rows with ``ts``, the time ``t`` as a timestamp, under a watermark (ST4)."""
    return rows.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", lateness)


# -- scorer 1 -----------------------------------------------------------------------------------------------------------


def features(tele: DataFrame, seconds: int) -> DataFrame:
    """Closed buckets of the grains with a baseline of their own: one row each, when the watermark passes their end (ST1, A1-A3)."""
    payer = F.nullif("payer_id", F.lit(""))
    entities = F.array(F.struct(F.lit("global").alias("entity_type"), F.lit("global").alias("entity_id")), F.struct(F.lit("payer").alias("entity_type"), payer.alias("entity_id")))
    rows = tele.select("ts", "payload_bytes", "error", F.explode(F.filter(entities, lambda e: e["entity_id"].isNotNull())).alias("e"))
    n = F.col("event_count")
    out = rows.groupBy(F.window("ts", f"{seconds} seconds"), "e.entity_type", "e.entity_id").agg(F.count("*").alias("event_count"), F.sum("payload_bytes").alias("payload_sum"), F.count_if("error").alias("error_count"))
    return out.select(
        F.unix_seconds("window.start").alias("bucket"), "entity_type", "entity_id", "event_count",
        rnd(F.col("payload_sum") / n, 1).alias("mean_payload"), rnd(F.col("error_count") / n, 4).alias("error_ratio"),
    )


_KINDS = ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in rate.STATES)
_BUCKET = "bucket long, entity_type string, entity_id string, event_count long, mean_payload double, error_ratio double"


class Baseline(StatefulProcessor):
    """An entity's baseline, folded over its buckets as they close."""

    NAMES = ("bucket", *rate.STATES)

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", f"bucket long, {_KINDS}")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        saved = dict(zip(self.NAMES, self.state.get())) if self.state.exists() else None
        table = pa.Table.from_pandas(pdf[[c.split()[0] for c in _BUCKET.split(", ")]], preserve_index=False)
        last = rate.fold_entity(table, saved, self.alpha, True).to_pylist()[0]
        self.state.update(tuple(last[c] for c in self.NAMES))
        yield rate.fold_entity(table, saved, self.alpha, False).to_pandas()

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        row = initial.iloc[0]
        self.state.update(tuple(int(row[c]) if c in ("bucket", "n") else float(row[c]) for c in self.NAMES))

    def close(self) -> None:
        pass


def z_scores(feats: DataFrame, cfg: Rate = Rate(), initial: DataFrame | None = None) -> DataFrame:
    """Each closed bucket's z against its entity's baseline, which is the key's state.

    ``initial`` has final baselines of a batch run (``rate.baselines``), from which the stream goes on (S9).
    """
    keyed = feats.groupBy("entity_type", "entity_id")
    before = None if initial is None else initial.select("bucket", "entity_type", "entity_id", *rate.STATES).groupBy("entity_type", "entity_id")
    return rate.with_z(keyed.transformWithStateInPandas(Baseline(cfg.alpha), f"{_BUCKET}, {_KINDS}", "Append", "None", before))


# -- scorer 3 -----------------------------------------------------------------------------------------------------------

#: The name under which a bucket itself is counted, for the groups that have no event in it.
EVERY = "\0every"


def payer_buckets(tele: DataFrame, seconds: int, event_cap: float) -> DataFrame:
    """Closed buckets of each payer, and under ``EVERY`` of all attributed events together."""
    rows = tele.filter(F.nullif("payer_id", F.lit("")).isNotNull())
    rows = rows.select("ts", "amount", "payee_id", F.explode(F.array("payer_id", F.lit(EVERY))).alias("payer"))
    payee = F.when(F.col("payer") != EVERY, F.col("payee_id"))
    out = rows.groupBy(F.window("ts", f"{seconds} seconds"), "payer").agg(
        F.count("*").alias("event_count"), F.sum(F.least(F.abs("amount"), F.lit(event_cap))).alias("amount_sum"), F.size(F.collect_set(payee)).cast("long").alias("distinct_payees")
    )
    return out.select(F.unix_seconds("window.start").alias("bucket"), "payer", "event_count", F.coalesce("amount_sum", F.lit(0.0)).alias("amount_sum"), "distinct_payees")


_CELL = ["bucket", "payer", "event_count", "amount_sum", "distinct_payees"]


class Charts(StatefulProcessor):
    """The charts of a group of payers; its state is the last row of each."""

    def __init__(self, cfg: Drift) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("payers", "states binary")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        told = sorted(pdf.loc[pdf["payer"] == EVERY, "bucket"].tolist())
        own = pdf.loc[pdf["payer"] != EVERY, _CELL]
        before = pa.ipc.open_stream(self.state.get()[0]).read_pandas() if self.state.exists() else None
        since = {p: told[0] for p in before["payer"]} if before is not None and told else {}
        for p, b in own.groupby("payer")["bucket"].min().items():
            since.setdefault(p, b)
        cells = pd.DataFrame([(b, p) for p, first in since.items() for b in told if b >= first], columns=["bucket", "payer"])
        if not len(cells):
            return
        cells = cells.merge(own, on=["bucket", "payer"], how="left").fillna({"event_count": 0, "amount_sum": 0.0, "distinct_payees": 0})
        out = drift.fold_payers(cells.astype({"event_count": "int64", "distinct_payees": "int64"}), before, self.cfg)
        table, sink = pa.Table.from_pandas(out.loc[out.groupby("payer")["bucket"].idxmax()], preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))
        yield out

    def close(self) -> None:
        pass


def charts(payers: DataFrame, groups: int, cfg: Drift = Drift()) -> DataFrame:
    """Rows of ``drift.charts`` for every closed bucket, also those in which a payer has no event.

    Payers are dealt into ``groups``, a number that a running stream keeps.  Every closed bucket is told to every group once, so
    a payer that is silent is still folded with zeros.  There is no cap of payers here.
    """
    own = F.when(F.col("payer") == EVERY, F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(F.array(F.pmod(F.xxhash64("payer"), F.lit(groups)).cast("int")))
    dealt = payers.select(*_CELL, F.explode(own).alias("group"))
    return dealt.groupBy("group").transformWithStateInPandas(Charts(cfg), drift.SCHEMA, "Append", "None")


# -- fusion -------------------------------------------------------------------------------------------------------------

ENTITY_TICK = "tick long, entity_type string, entity_id string, base double, active_models long, entity_score double"
#: An entity whose every claim is worth less is forgotten.
PRUNE = 0.01


def entity_ticks(hits: DataFrame, start: int, step: int, halflife: float, cfg: Fusion = Fusion(), prune: float = PRUNE) -> DataFrame:
    """Score of each entity at every tick that the watermark has passed (W4, A18, ST7, ST8).

    ``hits`` is ``fusion.hits`` of a ``clocked`` stream.  An entity's state holds the strongest claim of each model and the
    hits that no tick has seen yet; a timer at its next tick lets the claims decay without any input.  When all are worth less than
    ``prune`` the state goes, and a later hit starts anew (residues are forgotten, as the reference does).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        claims, waiting, tick = json.loads(state.get[0]) if state.exists else ({}, [], None)
        now, out = state.getCurrentWatermarkMs(), []
        fresh = [] if state.hasTimedOut else [tuple(r) for b in batches for r in b[["t", "model", "claim"]].itertuples(index=False)]
        at = lambda t: start + max(0, math.ceil((t - start) / step)) * step  # noqa: E731  the first tick that sees a hit

        def upto(limit_ms: int) -> None:
            nonlocal tick, claims, waiting
            while tick is not None and tick * 1000 < limit_ms:
                for t, model, claim in sorted(h for h in waiting if h[0] <= tick):
                    held = claims.get(model)
                    if held is None or math.log2(claim) + t / halflife > math.log2(held[0]) + held[1] / halflife:
                        claims[model] = [claim, t]
                waiting = [h for h in waiting if h[0] > tick]
                values = {m: c * 2.0 ** ((t - tick) / halflife) for m, (c, t) in claims.items()}
                if all(v < prune for v in values.values()):
                    claims = {}
                    tick = at(min(h[0] for h in waiting)) if waiting else None
                    continue
                base, active = sum(values.values()), sum(v >= cfg.active for v in values.values())
                out.append((tick, *key, base, active, min(1.0, base * (1 + cfg.boost * (active - 1) if active >= 2 else 1.0))))
                tick += step

        upto(now)
        if fresh:
            waiting += [[int(t), m, float(c)] for t, m, c in fresh]
            first = at(min(h[0] for h in waiting))
            tick = first if tick is None or not claims else min(tick, first)
        if tick is None:
            state.remove()
        else:
            state.update((json.dumps([claims, waiting, tick]),))
            state.setTimeoutTimestamp(max(tick * 1000, now + 1))
        yield pd.DataFrame(out, columns=["tick", "entity_type", "entity_id", "base", "active_models", "entity_score"])

    keyed = hits.select("ts", "t", "entity_type", "entity_id", "model", "claim").groupBy("entity_type", "entity_id")
    return keyed.applyInPandasWithState(run, ENTITY_TICK, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def write_levels(spark: SparkSession, path: str, start: int, step: int, cfg: Fusion = Fusion()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for ``entity_ticks``: threat levels under ``path``, one folder a batch.

    All rows of a tick come in one batch.  The level goes on from the last one before; a batch that runs again replaces its own
    folder and nothing else.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            last = batch.agg(F.max("tick")).first()[0]
            if last is None:
                return
            tick, level = _last_level(spark, path, number)
            first = start if tick is None else tick + step
            lv = fusion.levels(spark, fusion.picture(batch, cfg), first, step, last, cfg, initial=level)
            lv.drop("k").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return run


def _last_level(spark: SparkSession, path: str, number: int) -> tuple[int | None, str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None, "normal"
    rows = spark.read.parquet(path).filter(F.col("batch") < number)
    last = rows.agg(F.max_by(F.struct("tick", "level"), "tick").alias("s")).first()["s"]
    return (last["tick"], last["level"]) if last else (None, "normal")
