"""Scorer 1: rate and traffic shape against exponentially weighted baselines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import Rate
from tidewatch.functions.common import iso, rnd, severity
from tidewatch.operators import scan

FLOORS = {"event_count": (1.0, 0.1), "mean_payload": (20.0, 0.1), "error_ratio": (0.05, 0.0)}


def _fold(x: np.ndarray, alpha: float, start: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance before each value and after the last; entry i has seen i values, and those of ``start`` if given.

    Both are first-order recurrences: the mean's over the values, the variance's over the squared steps from the mean before.
    """
    smooth = lambda y: pd.Series(y).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    if start is not None:
        mean = smooth(np.append(start[0], x))
        return mean, smooth(np.append(start[1], (1.0 - alpha) * (x - mean[:-1]) ** 2))
    if not len(x):
        return np.zeros(1), np.zeros(1)
    mean = smooth(x)
    steps = np.append(0.0, (1.0 - alpha) * (x[1:] - mean[:-1]) ** 2)
    return np.append(0.0, mean), np.append(0.0, smooth(steps))


STATES = ("n", *(f"{f}_{s}" for f in FLOORS for s in ("mean", "var")))
ENTITY = ("entity_type", "entity_id")
#: A saved baseline: the entity's last bucket and its state after it.
SAVED = "bucket long, entity_type string, entity_id string, " + ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in STATES)


def fold_entity(table: pa.Table, saved: dict | None, alpha: float, final: bool) -> pa.Table:
    """One entity's buckets with the state before each; with ``final`` its last one with the state after it."""
    table = table.sort_by("bucket")
    n = saved["n"] if saved else 0
    at = slice(-1, None) if final else slice(None, -1)
    more = [n + np.arange(len(table) + 1)[at]]
    for f in FLOORS:
        more += [state[at] for state in _fold(table[f].to_numpy().astype(float), alpha, (saved[f"{f}_mean"], saved[f"{f}_var"]) if n else None)]
    if final and not len(table):  # nothing new: what was saved holds
        kept = {c: [saved["bucket"] if c == "bucket" else saved.get(c)] for c in table.column_names}
        out = pa.table({c: pa.array(v, table.schema.field(c).type) for c, v in kept.items()})
    else:
        out = table.slice(len(table) - 1) if final else table
    for name, values in zip(STATES, more):
        out = out.append_column(name, pa.array(values, type=pa.int64() if name == "n" else pa.float64()))
    return out


#: Entities of more buckets than this are folded one by one, over whole arrays; the shorter ones together, a bucket of each at a time.
LONG = 512


def _step(old: np.ndarray, new: np.ndarray, alpha: float) -> np.ndarray:
    """One more value of an exponentially weighted mean, which an equal value leaves as it is (as in pandas' ``ewm``)."""
    keep = 1.0 - alpha
    return np.where(old != new, (keep * old + alpha * new) / (keep + alpha), old)


def _fold_many(x: np.ndarray, start: np.ndarray, size: np.ndarray, alpha: float, n: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean and variance before each value of many entities, and of each after its last; ``_fold`` for all at once.

    An entity's values stand at ``start``, ``size`` of them; it has seen ``n`` values, with ``mean`` and ``var``.
    """
    means, vars_ = np.zeros(len(x)), np.zeros(len(x))
    mean, var, fresh = mean.copy(), var.copy(), n == 0
    apart = (size > LONG) | (np.bincount(np.repeat(np.arange(len(size)), size), weights=np.isnan(x), minlength=len(size)) > 0)
    for e in np.flatnonzero(apart):
        at = slice(start[e], start[e] + size[e])
        m, v = _fold(x[at], alpha, None if fresh[e] else (mean[e], var[e]))
        means[at], vars_[at], mean[e], var[e] = m[:-1], v[:-1], m[-1], v[-1]
    live = np.flatnonzero(~apart & (size > 0))
    live = live[np.argsort(-size[live], kind="stable")]
    for i in range(size[live[0]] if len(live) else 0):
        live = live[: np.searchsorted(-size[live], -i, side="left")]  # the longest come first
        at, m, v, new = start[live] + i, mean[live], var[live], fresh[live] & (i == 0)
        means[at], vars_[at], value = m, v, x[start[live] + i]
        mean[live] = np.where(new, value, _step(m, value, alpha))
        var[live] = np.where(new, 0.0, _step(v, (1.0 - alpha) * (value - m) ** 2, alpha))
    return means, vars_, mean, var


def fold_entities(table: pa.Table, saved: pa.Table | None, alpha: float, final: bool) -> pa.Table:
    """``fold_entity`` of all entities of ``table``, folded together; ``saved`` has states to go on from."""
    names, known = table.column_names, {(r["entity_type"], r["entity_id"]): r for r in saved.to_pylist()} if saved is not None else {}
    table = table.sort_by([*((c, "ascending") for c in ENTITY), ("bucket", "ascending")])
    keys = [table[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ENTITY] if len(table) else [np.zeros(0, dtype=int)] * 2
    start = np.flatnonzero(np.append(True, (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0))[: len(table)])
    size = np.diff(np.append(start, len(table)))
    firsts = table.select(list(ENTITY)).take(pa.array(start))
    held = [known.pop(tuple(r.values()), None) for r in firsts.to_pylist()]
    before = lambda c: np.array([(h[c] if h else 0) for h in held], dtype=np.int64 if c == "n" else float)
    n = before("n")
    more = [n + size if final else np.repeat(n, size) + np.arange(len(table)) - np.repeat(start, size)]
    for f in FLOORS:
        x = table[f].to_numpy().astype(float)
        means, vars_, mean, var = _fold_many(x, start, size, alpha, n, before(f"{f}_mean"), before(f"{f}_var"))
        more += [mean, var] if final else [means, vars_]
    out = table.take(pa.array(start + size - 1)) if final else table
    for name, values in zip(STATES, more):
        out = out.append_column(name, pa.array(values, type=pa.int64() if name == "n" else pa.float64()))
    if final and known:  # nothing new: what was saved holds
        rest = list(known.values())
        out = pa.concat_tables([out, pa.table({c: pa.array([r.get(c) for r in rest], out.schema.field(c).type) for c in (*names, *STATES)})])
    return out


def _states(rows: DataFrame, cfg: Rate, final: bool, initial: DataFrame | None = None) -> DataFrame:
    """``rows`` with the state before each; with ``final`` each entity's last row only, with the state after it.

    Entities are dealt into groups, and a group's entities are folded together; they never see each other's numbers.
    ``initial`` has saved baselines (S9): the fold of an entity goes on from its own, if there is one.
    """
    kinds = ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in STATES)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(kinds).fields])
    rows = rows.filter("entity_type != 'client_ip'")
    groups = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.pmod(F.xxhash64(*ENTITY), F.lit(groups)).alias("_group")
    if initial is None:
        return rows.groupBy(group).applyInArrow(lambda table: fold_entities(table, None, cfg.alpha, final), schema)

    def run(table: pa.Table, before: pa.Table) -> pa.Table:
        return fold_entities(table, before, cfg.alpha, final)

    before = initial.select(*[F.col(c).alias(c) for c in ("bucket", *ENTITY, *STATES)])  # columns of its own: ``rows`` may come from it too
    return rows.groupBy(group).cogroup(before.groupBy(group)).applyInArrow(run, schema)


def baselines(feats: DataFrame, cfg: Rate = Rate(), final: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """Each bucket's row with the state before it; with ``final`` each entity's last state.

    The fold runs over an entity's buckets in time order; rows are counts per bucket, so even the entity of all traffic has
    one row a minute.  A closed form over windows would overflow after some 120,000 buckets.  A run over later buckets
    goes on from ``initial``, the final baselines of the one before, as if the two were one.
    """
    rows = feats.select("bucket", "entity_type", "entity_id", *FLOORS)
    return _states(rows, cfg, final, initial).select("bucket", "entity_type", "entity_id", *STATES)


def _z(x, mean, var, n, absolute: float, relative: float):
    return F.when(n < 2, 0.0).otherwise((x - mean) / F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(absolute), relative * mean))


def z_scores(feats: DataFrame, cfg: Rate = Rate(), initial: DataFrame | None = None) -> DataFrame:
    """z of rate, payload and error ratio, judged before the bucket is folded in.

    The fold hands every row on with the state before it, so features are computed once and joined with nothing.
    """
    return with_z(_states(feats, cfg, False, initial))


def with_z(rows: DataFrame) -> DataFrame:
    """z of rows that have the state before them."""
    for f, (absolute, relative) in FLOORS.items():
        rows = rows.withColumn(f"{f}_z", _z(F.col(f), F.col(f"{f}_mean"), F.col(f"{f}_var"), F.col("n"), absolute, relative))
    return rows


def _reason(name: str, z, threshold: float):
    return F.format_string(f"{name}=%.1f>{threshold:g}", z)


def score(zs: DataFrame, cfg: Rate = Rate(), multivariate: DataFrame | None = None) -> DataFrame:
    """Score, type, reasons and whether the bucket is anomalous; rows below the floors go.

    ``multivariate`` has (bucket, entity_id, mv_score) of payers (M3).
    """
    rows = zs
    if multivariate is not None:
        rows = rows.join(multivariate.withColumn("entity_type", F.lit("payer")), ["bucket", "entity_type", "entity_id"], "left")
    else:
        rows = rows.withColumn("mv_score", F.lit(0.0))
    mv = F.coalesce("mv_score", F.lit(0.0))
    z = [F.col("event_count_z"), F.col("mean_payload_z"), F.col("error_ratio_z")]
    part = lambda c: F.when(c > cfg.z, F.least(F.lit(1.0), F.abs(c) / (2 * cfg.z)))
    mv_part = F.when(mv >= cfg.multivariate, mv)
    kind = F.when(z[0] > cfg.z, "rate_spike").when(z[1] > cfg.z, "payload_anomaly").when(z[2] > cfg.z, "error_ratio_spike").when(mv_part.isNotNull(), "multivariate_outlier")
    reasons = F.filter(
        F.array(
            F.when(z[0] > cfg.z, _reason("rate_z", z[0], cfg.z)), F.when(z[1] > cfg.z, _reason("payload_z", z[1], cfg.z)),
            F.when(z[2] > cfg.z, _reason("error_ratio_z", z[2], cfg.z)), F.when(mv_part.isNotNull(), F.format_string("multivariate=%.2f", mv)),
        ),
        lambda r: r.isNotNull(),
    )
    rows = rows.withColumns(
        {
            "score": rnd(F.coalesce(F.greatest(*map(part, z), mv_part), F.lit(0.0)), 4),
            "alert_type": kind,
            "reasons": reasons,
            "warming_up": F.col("n") < cfg.warmup,
            "is_anomalous": kind.isNotNull() & (F.col("n") >= cfg.warmup),
        }
    )
    return rows.filter((F.col("entity_type") == "global") | F.col("is_anomalous") | (F.col("event_count") >= cfg.min_events))


def _after(x: np.ndarray, alpha: float) -> np.ndarray:
    """What the values do, one after another, to any (mean, var): ``power, shift, c0, c1, c2``.

    The mean becomes power * mean + shift, the variance power * var + c2 * mean * mean + c1 * mean + c0.  Neighbours are
    composed in pairs, and the pairs again, so n values take log2(n) steps over whole arrays.
    """
    a, b, one = alpha, 1.0 - alpha, np.ones(len(x))
    maps = np.stack([b * one, a * x, b * a * x * x, -2.0 * b * a * x, b * a * one])
    if not len(x):
        return np.array([1.0, 0.0, 0.0, 0.0, 0.0])
    while maps.shape[1] > 1:
        rest = maps[:, -1:] if maps.shape[1] % 2 else maps[:, :0]
        p, s, c0, c1, c2 = maps[:, : maps.shape[1] // 2 * 2 : 2]
        q, t, d0, d1, d2 = maps[:, 1::2]
        pairs = np.stack([q * p, q * s + t, q * c0 + d2 * s * s + d1 * s + d0, q * c1 + 2.0 * d2 * p * s + d1 * p, q * c2 + d2 * p * p])
        maps = np.concatenate([pairs, rest], axis=1)
    return maps[:, 0]


COHORT = "n long, mean double, var double"


def _cohort_apply(state: tuple, row: tuple) -> tuple:
    """What a row of maps (m, power, shift, c0, c1, c2, mean1, var1) makes of (n, mean, var)."""
    n, mean, var = state
    m, power, shift, c0, c1, c2, mean1, var1 = row
    if n == 0:
        return int(m), mean1, var1
    return int(n + m), power * mean + shift, power * var + c2 * mean * mean + c1 * mean + c0


def _cohort_compose(a: tuple, b: tuple) -> tuple:
    m, p, s, c0, c1, c2, mean1, var1 = a
    k, q, t, d0, d1, d2, _, _ = b
    start = _cohort_apply((m, mean1, var1), b)
    return m + k, q * p, q * s + t, q * c0 + d2 * s * s + d1 * s + d0, q * c1 + 2.0 * d2 * p * s + d1 * p, q * c2 + d2 * p * p, start[1], start[2]


def cohort_states(ips: DataFrame, cfg: Rate = Rate(), initial: tuple[int, float, float] = (0, 0.0, 0.0), final: bool = False) -> DataFrame:
    """(bucket, n, mean, var): the state of the one baseline of all addresses before each bucket, or after the last one.

    What counts x_1..x_m do to (mean, var) is affine in mean and quadratic for var, so those of ``part_seconds`` of a bucket
    are reduced to a few numbers, the parts of ``chunk_seconds`` to as few again, and these are composed by ``scan``: no task
    has more than the parts of one chunk in order.  ``initial`` is a state to go on from (S9).
    """

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "part", "first_t", "first_id", "first_rep", "entity_id"])
        at, part, x = (pdf[c].to_numpy() for c in ("bucket", "part", "event_count"))
        start = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(part) != 0)))
        out = []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(x)]):
            one, rest = float(x[s]), _after(x[s + 1 : e].astype(float), cfg.alpha)
            # the first part of all starts from its first value
            mean, var = rest[0] * one + rest[1], rest[4] * one * one + rest[3] * one + rest[2]
            out.append((at[s] // cfg.chunk_seconds, at[s], part[s], e - s, *_after(x[s:e].astype(float), cfg.alpha), mean, var))
        return pd.DataFrame(out, columns=["chunk", "bucket", "part", "m", *form])

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        maps = pdf.sort_values(["bucket", "part"])[["m", *form]].itertuples(index=False, name=None)
        out = next(maps)
        for row in maps:
            out = _cohort_compose(out, row)
        return pd.DataFrame([(key[0], *out)], columns=["chunk", "m", *form])

    def fold(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        state, out, last = next(before[["n", "mean", "var"]].itertuples(index=False, name=None)), [], None
        for bucket, _, *row in pdf.sort_values(["bucket", "part"])[["bucket", "part", "m", *form]].itertuples(index=False):
            if bucket != last:
                out.append((bucket, *state))
                last = bucket
            state = _cohort_apply(state, tuple(row))
        return pd.DataFrame([(last, *state)] if final else out, columns=["bucket", "n", "mean", "var"])

    form = ["power", "shift", "c0", "c1", "c2", "mean1", "var1"]
    numbers = "m long, " + ", ".join(f"{c} double" for c in form)
    first = F.col("first.t")
    span = F.floor((first - F.col("bucket")) / cfg.part_seconds).cast("long")
    rows = ips.select("bucket", span.alias("part"), "entity_id", "event_count", first.alias("first_t"), F.col("first.event_id").alias("first_id"), F.col("first.rep").alias("first_rep"))
    groups = 4 * int(ips.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # of several parts each
    parts = rows.groupBy(F.pmod(F.xxhash64("bucket", "part"), F.lit(groups)).alias("_group")).applyInPandas(reduce, f"chunk long, bucket long, part long, {numbers}")
    before = scan.states_before(parts.groupBy("chunk").applyInPandas(whole, f"chunk long, {numbers}"), initial, _cohort_apply, _cohort_compose, COHORT)
    states = parts.groupBy("chunk").cogroup(before.groupBy("chunk")).applyInPandas(fold, f"bucket long, {COHORT}")
    return states.groupBy().agg(F.max_by(F.struct("*"), "bucket").alias("s")).select("s.*") if final else states


def cohort_scores(feats: DataFrame, cfg: Rate = Rate(), initial: tuple[int, float, float] = (0, 0.0, 0.0)) -> DataFrame:
    """Addresses that tower over the cohort."""
    ips = feats.filter("entity_type = 'client_ip'")
    rows = ips.join(cohort_states(ips, cfg, initial), "bucket")
    z = _z(F.col("event_count"), F.col("mean"), F.col("var"), F.col("n"), 1.0, 0.5)
    rows = rows.withColumn("z", z).filter((F.col("z") > cfg.z) & (F.col("event_count") >= cfg.min_alert_events) & (F.col("n") >= cfg.warmup * 10))
    return rows.withColumns(
        {"score": rnd(F.least(F.lit(1.0), F.abs("z") / (2 * cfg.z)), 4), "alert_type": F.lit("rate_spike"), "reasons": F.array(_reason("cohort_rate_z", F.col("z"), cfg.z)), "is_anomalous": F.lit(True), "warming_up": F.lit(False)}
    )


def documents(scored: DataFrame, cohort: DataFrame, seconds: int) -> DataFrame:
    """Score documents of all three grains in one shape."""
    cols = ["bucket", "entity_type", "entity_id", "event_count", "score", "alert_type", "reasons", "is_anomalous", "warming_up", "first"]
    return scored.select(*cols).unionByName(cohort.select(*cols)).withColumns({"model": F.lit("rate"), "t": F.col("bucket") + seconds})


def alerts(docs: DataFrame, cfg: Rate = Rate()) -> DataFrame:
    """The worst few anomalies of each bucket; ties go by grain and first arrival."""
    kind = F.when(F.col("entity_type") == "global", 0).when(F.col("entity_type") == "payer", 1).otherwise(2)
    rank = Window.partitionBy("bucket").orderBy(F.desc("score"), kind, "first.t", "first.event_id", "first.rep", "entity_id")
    worthy = docs.filter(F.col("is_anomalous") & F.col("alert_type").isNotNull() & (F.col("event_count") >= cfg.min_alert_events))
    kept = worthy.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= cfg.max_alerts)
    summary = F.format_string("%s for %s %s scored %.2f (%d events)", "alert_type", "entity_type", "entity_id", "score", "event_count")
    return kept.select("t", "alert_type", severity(F.col("score")).alias("severity"), "entity_type", "entity_id", "score", F.col("model").alias("source"), summary.alias("summary"), iso(F.col("bucket")).alias("window_start"), "rank")
