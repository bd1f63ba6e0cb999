"""Scorer 3: slow cumulative drift of a payer, by paired CUSUM charts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Drift
from tidewatch.functions.common import rnd, severity

COLUMNS = (
    "bucket", "payer", "i", "event_count", "amount_sum", "distinct_payees", "s_volume", "s_amount", "run_volume", "run_amount", "ewma_volume", "ewma_amount",
    "mean_volume", "mean_amount", "var_volume", "var_amount", "window_start", "exc_events", "exc_amount", "known_volume", "known_amount", "since_volume", "since_amount",
)
SCHEMA = (
    "bucket long, payer string, i long, event_count long, amount_sum double, distinct_payees long, s_volume double, s_amount double, run_volume long, run_amount long, "
    "ewma_volume double, ewma_amount double, mean_volume double, mean_amount double, var_volume double, var_amount double, window_start long, exc_events long, exc_amount double, "
    "known_volume long, known_amount long, since_volume long, since_amount long"
)
#: No chart is open.
NEVER = np.int64(1 << 62)


def _seen(payers: DataFrame) -> DataFrame:
    return payers.groupBy("payer").agg(F.min("bucket").alias("first"))


def _tracked(payers: DataFrame, cfg: Drift) -> DataFrame:
    """(payer, first) of the payers that have a chart: the first ``max_payers`` to appear.  Each task keeps its own first ones."""
    seen = _seen(payers)
    return seen if cfg.max_payers is None else seen.orderBy("first", "payer").limit(cfg.max_payers)


def _resumed(payers: DataFrame, cfg: Drift, initial: DataFrame) -> DataFrame:
    known = initial.select(F.col("payer").alias("payer"), F.lit(-(1 << 62)).alias("first"))
    fresh = _seen(payers).join(known, "payer", "left_anti")
    if cfg.max_payers is not None:
        fresh = fresh.orderBy("first", "payer").limit(max(0, cfg.max_payers - known.count()))
    return known.unionByName(fresh)


def rejected(payers: DataFrame, cfg: Drift = Drift()) -> DataFrame:
    """(payer, first) of the payers beyond the cap, which have no chart."""
    return _seen(payers).join(_tracked(payers, cfg).select("payer"), "payer", "left_anti")


def grid(payers: DataFrame, cfg: Drift = Drift(), initial: DataFrame | None = None) -> DataFrame:
    """Every tracked payer in every bucket from its first one on that has any attributed event; missing ones count 0 (J1, ST7).

    With ``initial``, saved states, the payers that have one are tracked already, from the first of these buckets on (S9).

    Buckets of a payer are made from the sorted list of all buckets, one row of one number a bucket, so there is no range
    join; the payers above the cap of tracked ones, in order of appearance, are left out as the detector rejects them
    (``rejected`` names them).
    """
    first = _tracked(payers, cfg) if initial is None else _resumed(payers, cfg, initial)
    all_buckets = payers.agg(F.array_sort(F.collect_set("bucket")).alias("all"))
    cells = first.join(F.broadcast(all_buckets)).select("payer", F.explode(F.filter("all", lambda b: b >= F.col("first"))).alias("bucket"))
    zero = {"event_count": 0, "amount_sum": 0.0, "distinct_payees": 0}
    return cells.join(payers, ["payer", "bucket"], "left").fillna(zero)


#: What a chart's fold carries on, by the name of a state's columns.
CARRIED = {"known": np.int64, "mean": float, "var": float, "s": float, "run": np.int64, "ewma": float, "since": np.int64}


def _fold(x: np.ndarray, at: np.ndarray, warming: np.ndarray, floor, cfg: Drift, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """One chart of many payers: rows are payers, columns their buckets ``at``.  State after every column.

    ``floor`` gives the least deviation by the means so far, ``start`` the states to go on from.  A payer's row may hold fewer
    buckets than there are columns; what stands in the rest is of no use.
    """
    many, wide = x.shape
    slow, fast = 1.0 - 0.5 ** (1.0 / cfg.halflife), 1.0 - 0.5 ** (1.0 / cfg.ewma_halflife)
    start = start or {k: np.full(many, NEVER if k == "since" else 0, dtype=t) for k, t in CARRIED.items()}
    known, mean, var, total, run, recent, since = (start[k].copy() for k in CARRIED)
    out = {k: np.zeros(x.shape, dtype=t) for k, t in CARRIED.items()}
    for i in range(wide):
        off, warm = x[:, i] - mean, warming[:, i]
        z = np.where(known >= 2, np.clip(off / np.maximum(np.sqrt(np.maximum(var, 0.0)), floor(mean)), -cfg.clip, cfg.clip), 0.0)
        recent = recent + fast * (z - recent)
        total = np.where(warm, 0.0, np.minimum(np.maximum(0.0, total + z - cfg.k), cfg.cap))
        rising = total > 0.0
        run, since = np.where(rising, run + 1, 0), np.where(rising, np.where(since == NEVER, at[:, i], since), NEVER)
        learns = warm | (total < cfg.freeze)
        share = np.where(known + 1 <= cfg.warmup, 1.0 / (known + 1), slow)
        new_mean, new_var = mean + share * off, (1.0 - share) * (var + share * off * off)
        fresh = known == 0
        mean = np.where(learns, np.where(fresh, x[:, i], new_mean), mean)
        var = np.where(learns, np.where(fresh, 0.0, new_var), var)
        known = known + learns
        for k, v in zip(CARRIED, (known, mean, var, total, run, recent, since)):
            out[k][:, i] = v
    return out


def fold_payers(pdf: pd.DataFrame, before: pd.DataFrame | None, cfg: Drift, least: float | None = None) -> pd.DataFrame:
    """State of both charts after every bucket of the payers of ``pdf``, one bucket of each at a time; ``before``: saved states.

    With ``least``, of the rows only those go out in which one of the charts stands there or higher.
    """
    pdf = pdf.sort_values(["payer", "bucket"], ignore_index=True)
    start = np.flatnonzero(pdf["payer"].ne(pdf["payer"].shift()).to_numpy())
    size = np.diff(np.append(start, len(pdf)))
    row = np.repeat(np.arange(len(start)), size)
    col = np.arange(len(pdf)) - start[row]
    filled = lambda c, kind: (x := np.zeros((len(start), size.max()), dtype=kind), x.__setitem__((row, col), pdf[c].to_numpy(dtype=kind)))[0]
    count, amount, at = filled("event_count", np.int64), filled("amount_sum", float), filled("bucket", np.int64)
    saved: dict[str, dict[str, np.ndarray]] = {}
    seen, e, m = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64), np.zeros(len(start))
    if before is not None and len(before):
        held = before.drop_duplicates("payer").set_index("payer").reindex(pdf["payer"].to_numpy()[start])
        kept = lambda c, kind, none=0: held[c].fillna(none).to_numpy().astype(kind)
        seen, e, m = kept("i", np.int64), kept("exc_events", np.int64), kept("exc_amount", float)
        saved = {name: {k: kept(f"{k}_{name}", t, int(NEVER) if k == "since" else 0) for k, t in CARRIED.items() if k != "since"} for name in ("volume", "amount")}
        for name in saved:
            times = held[f"since_{name}"]
            since = np.full(len(start), NEVER)
            since[times.notna().to_numpy()] = times.dropna().astype(np.int64)
            saved[name]["since"] = since
            saved[name] = {k: saved[name][k] for k in CARRIED}
    number = seen[:, None] + np.arange(1, size.max() + 1)
    v = _fold(count.astype(float), at, number < cfg.warmup, lambda x: np.maximum(cfg.count_floor, np.sqrt(np.maximum(x, 0.25))), cfg, saved.get("volume"))
    a = _fold(amount, at, number < cfg.warmup, lambda x: np.maximum(cfg.amount_floor, cfg.amount_relative * x), cfg, saved.get("amount"))
    opened = np.minimum(v["since"], a["since"])
    events, moved, window = np.zeros(count.shape, dtype=np.int64), np.zeros(count.shape), np.where(opened == NEVER, at, opened)
    for i in range(count.shape[1]):
        begin, now = opened[:, i], at[:, i]
        e = np.where(begin == NEVER, 0, np.where(begin == now, count[:, i], e + count[:, i]))
        m = np.where(begin == NEVER, 0.0, np.where(begin == now, amount[:, i], m + amount[:, i]))
        events[:, i], moved[:, i] = e, m
    if least is not None:
        out = np.flatnonzero((np.maximum(v["s"], a["s"]) >= least)[row, col])
        pdf, row, col = pdf.iloc[out], row[out], col[out]
    out = pdf[["bucket", "payer", "event_count", "amount_sum", "distinct_payees"]].assign(i=number[row, col], window_start=window[row, col], exc_events=events[row, col], exc_amount=moved[row, col])
    for name, chart in (("volume", v), ("amount", a)):
        for k in CARRIED:
            out[f"{k}_{name}"] = chart[k][row, col]
        out[f"since_{name}"] = out[f"since_{name}"].astype("Int64").mask(out[f"since_{name}"] == NEVER)
    return out[list(COLUMNS)]


def charts(cells: DataFrame, cfg: Drift = Drift(), initial: DataFrame | None = None, loud: bool = False) -> DataFrame:
    """State of both charts after every bucket of every payer.

    With ``loud``, only the rows that become documents or alerts: ``emitted`` takes none with both charts below all of its levels.

    Payers are dealt into groups, and a group's payers are folded together, one bucket of each at a time; they never see
    each other's numbers.  ``initial`` has each payer's last row of a run before this one, which goes on from there (S9).
    """
    groups = 4 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.pmod(F.xxhash64("payer"), F.lit(groups)).alias("_group")
    least = min(cfg.emit_floor, cfg.h, cfg.h_single) if loud else None
    if initial is None:
        return cells.groupBy(group).applyInPandas(lambda pdf: fold_payers(pdf, None, cfg, least), SCHEMA)

    def run(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        return fold_payers(pdf, before, cfg, least) if len(pdf) else pd.DataFrame(columns=list(COLUMNS))

    before = initial.select(*[F.col(c).alias(c) for c in COLUMNS])  # columns of its own: ``cells`` may come from it too
    return cells.groupBy(group).cogroup(before.groupBy(group)).applyInPandas(run, SCHEMA)


def saved(states: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Each payer's last row of ``charts``, to go on from; those of ``initial`` without a new one stay."""
    rest = [c for c in COLUMNS if c != "payer"]
    rows = states.select(*COLUMNS) if initial is None else states.select(*COLUMNS).unionByName(initial.select(*COLUMNS))
    return rows.groupBy("payer").agg(F.max_by(F.struct(*rest), "bucket").alias("s")).select("payer", "s.*").select(*COLUMNS)


def assess(states: DataFrame, cfg: Drift = Drift()) -> DataFrame:
    """Verdict, score and reasons of every payer and bucket."""
    ok = lambda name, level: (F.col(f"s_{name}") >= level) & (F.col(f"run_{name}") >= cfg.min_buckets) & (F.col(f"ewma_{name}") >= cfg.ewma_floor)
    top = F.greatest("s_volume", "s_amount")
    ratio = F.when((F.col("exc_events") > 0) & (F.col("mean_volume") > 0) & (F.col("mean_amount") > 0), (F.col("exc_amount") / F.col("exc_events")) / (F.col("mean_amount") / F.col("mean_volume"))).otherwise(0.0)
    rows = states.withColumns(
        {
            "warming_up": F.col("i") < cfg.warmup,
            "is_anomalous": (F.col("i") >= cfg.warmup) & ((ok("volume", cfg.h) & ok("amount", cfg.h)) | ok("volume", cfg.h_single)),
            "score": rnd(F.least(F.lit(1.0), top / (2 * cfg.h)), 4),
            "mean_amount_ratio": ratio,
        }
    )
    bad = F.col("is_anomalous")
    chart = lambda name: F.when((F.col(f"s_{name}") >= cfg.emit_floor) | bad, F.concat(F.format_string(f"cusum_{name}=%.1f", rnd(F.col(f"s_{name}"), 1)), F.when(F.col(f"s_{name}") >= cfg.h, f">{cfg.h:g}").otherwise("")))
    reasons = F.array(
        chart("volume"), chart("amount"), F.when(bad & (ratio > 1), F.format_string("cumulative_amount_drift=+%.0f%%", rnd((ratio - 1) * 100, 0))),
        F.when(bad, F.format_string("sustained=%dm", F.greatest("run_volume", "run_amount"))),
    )
    return rows.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))


def emitted(assessed: DataFrame, cfg: Drift = Drift()) -> DataFrame:
    """Rows that become score documents."""
    return assessed.filter(F.col("is_anomalous") | (F.greatest("s_volume", "s_amount") >= cfg.emit_floor))


def documents(assessed: DataFrame, seconds: int) -> DataFrame:
    rows = emitted(assessed)
    return rows.select(
        "bucket", F.lit("payer").alias("entity_type"), F.col("payer").alias("entity_id"), F.lit(None).cast("long").alias("event_count"), "score", F.lit("slow_exfiltration").alias("alert_type"),
        "reasons", "is_anomalous", "warming_up", F.struct(F.col("bucket").alias("t"), F.lit(0).cast("long").alias("event_id"), F.lit(0).alias("rep")).alias("first"),
        F.lit("drift").alias("model"), (F.col("bucket") + seconds).alias("t"),
    )


def alerts(assessed: DataFrame, seconds: int, cfg: Drift = Drift()) -> DataFrame:
    """The worst few drifting payers of each bucket."""
    rank = Window.partitionBy("bucket").orderBy(F.desc("score"), "payer")
    kept = assessed.filter("is_anomalous").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= cfg.max_alerts)
    minutes = F.greatest(F.lit(1), F.floor((F.col("bucket") + seconds - F.col("window_start")) / 60).cast("int"))
    summary = F.format_string("%d events moving %s IDR accumulated over %d min", "exc_events", F.format_number("exc_amount", 0), minutes)
    return kept.select(
        (F.col("bucket") + seconds).alias("t"), F.lit("slow_exfiltration").alias("alert_type"), severity(F.col("score")).alias("severity"), F.lit("payer").alias("entity_type"),
        F.col("payer").alias("entity_id"), "score", F.lit("drift").alias("source"), summary.alias("summary"), "rank",
    )


def latest(assessed: DataFrame) -> DataFrame:
    """Each payer's last state (Q3)."""
    cols = [c for c in assessed.columns if c != "payer"]
    return assessed.groupBy("payer").agg(F.max_by(F.struct(*cols), "bucket").alias("s")).select("payer", "s.*")


def top(assessed: DataFrame, n: int = 10) -> DataFrame:
    """Leaderboard by the larger chart; n is held to 1..100."""
    return latest(assessed).withColumn("s_max", F.greatest("s_volume", "s_amount")).orderBy(F.desc("s_max"), "payer").limit(max(1, min(100, n)))


def tracked(assessed: DataFrame, cfg: Drift = Drift()) -> DataFrame:
    """How many payers have a chart, and how many of these have seen enough buckets."""
    return latest(assessed).agg(F.count("*").alias("tracked"), F.count_if(F.col("i") >= cfg.warmup).alias("warm"))


def first_flagged(assessed: DataFrame) -> DataFrame:
    """The first bucket of each payer that is anomalous, with the buckets seen until then."""
    return assessed.filter("is_anomalous").groupBy("payer").agg(F.min("bucket").alias("first_bucket"), F.min("i").alias("after"), F.count("*").alias("buckets"))
