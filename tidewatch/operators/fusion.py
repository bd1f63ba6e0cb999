"""Fusion of score documents into a decaying, corroborated threat picture."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Fusion
from tidewatch.functions.common import rnd
from tidewatch.operators import scan
from tidewatch.sources import sinks

#: Half-lives after which a hit is worth less than any rounding shows.
HORIZON = 30


def tag():
    """First reason as a short tag."""
    r = F.element_at("reasons", 1)
    return (
        F.when(F.size("reasons") == 0, "anomalous")
        .when(r.startswith("rate_z") | r.startswith("cohort_rate_z"), "rate_spike")
        .when(r.startswith("payload_z"), "payload_anomaly")
        .when(r.startswith("error_ratio"), "error_ratio_spike")
        .when(r.startswith("multivariate"), "multivariate_outlier")
        .when(r.startswith("template="), F.coalesce(F.nullif(F.regexp_extract(r, r"^template=\s*(\S*)", 1), F.lit("")), F.lit("log_classification")))
        .when(r.startswith("cusum") | r.contains("drift"), "slow_exfiltration")
        .otherwise(F.coalesce(F.nullif(F.substring(F.trim(F.substring_index(r, "=", 1)), 1, 32), F.lit("")), F.lit("anomalous")))
    )


def gate(docs: DataFrame, cfg: Fusion = Fusion(), now=None) -> DataFrame:
    """What becomes of each document, in ``disposition``; ``now`` is the document's own time unless given (P11, ST9, U3)."""
    model, value = F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")), F.coalesce("score", F.lit(0.0))
    late = F.lit(False) if now is None else F.lit(now) - F.col("t") > cfg.stale
    what = (
        F.when(model == "fused", "self")
        .when(~F.coalesce("is_anomalous", F.lit(False)) | (value <= 0), "benign")
        .when(late, "stale")
        .when(F.col("event_count") < cfg.min_events, "below_floor")
        .otherwise("folded")
    )
    return docs.withColumn("model", model).withColumn("disposition", what)


HIT = ("entity_type", "entity_id", "model", "t", "weight", "claim", "tag", "level", "held", "held_t")
#: A saved claim: a model's last hit on an entity, with the claim that holds the running maximum.
SAVED = "entity_type string, entity_id string, model string, t long, weight double, claim double, tag string, level double, held double, held_t long"


def hits(gated: DataFrame, cfg: Fusion = Fusion()) -> DataFrame:
    """Folded documents with their weight, weighted claim and tag."""
    weights = F.create_map(*[F.lit(x) for kv in cfg.weights.items() for x in kv])
    rows = gated.filter("disposition = 'folded'").withColumn("weight", F.coalesce(weights[F.col("model")], F.lit(cfg.default_weight)))
    return rows.withColumns({"claim": F.col("weight") * F.least("score", F.lit(1.0)), "tag": tag()})


def contributions(gated: DataFrame, cfg: Fusion = Fusion(), halflife: float | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Each hit with its weighted claim, its tag and when the next hit of its entity and model takes over.

    Decay commutes with the maximum: claim * 2 ^ -((now - t) / halflife) is ordered as log2(claim) + t / halflife, so the
    value that a fold would hold is a running maximum over the entity's hits; ``held`` and ``held_t`` are the claim that
    holds it and its time, as decay is more exact from them than from the logarithm.  ``initial`` has the ``saved`` claims of an
    earlier run, which rule until the first hit of this one (S9).
    """
    half = halflife or cfg.halflife
    rows = hits(gated, cfg)
    rows = rows.select(*HIT[:7], (F.log2("claim") + F.col("t") / half).alias("level"), F.col("claim").alias("held"), F.col("t").alias("held_t"))
    if initial is not None:
        rows = initial.select(*HIT).unionByName(rows)
    order = Window.partitionBy("entity_type", "entity_id", "model").orderBy("t")
    best = F.max(F.struct("level", "held", "held_t")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_b", best).withColumn("next_t", F.lead("t").over(order))
    return rows.select("entity_type", "entity_id", "model", "t", "next_t", "weight", "claim", "tag", "_b.level", "_b.held", "_b.held_t")


def saved(contributed: DataFrame) -> DataFrame:
    """The claims that hold after the last hit, to go on from."""
    return contributed.filter("next_t IS NULL").select(*HIT)


def at_ticks(hits: DataFrame, start: int, step: int, end: int, halflife: float) -> DataFrame:
    """Every contribution's decayed value at each tick for which it is the latest (J3, ST8).

    A hit names the ticks that it rules, at most HORIZON half-lives of them, so as-of evaluation needs no range join.
    """
    first = F.greatest(F.ceil((F.col("t") - start) / step), F.lit(0))
    until = F.least(F.coalesce(F.col("next_t") - 1, F.lit(end)), F.col("t") + int(HORIZON * halflife), F.lit(end))
    last = F.floor((until - start) / step)
    rows = hits.filter(last >= first).withColumn("_k", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("tick", F.col("_k") * step + start).drop("_k")
    return rows.withColumn("value", F.col("held") * F.pow(F.lit(2.0), (F.col("held_t") - F.col("tick")) / halflife))


def entity_states(values: DataFrame, cfg: Fusion = Fusion()) -> DataFrame:
    """Score, active models and strongest claims of each entity at each tick."""
    active = F.col("value") >= cfg.active
    claim = F.struct(F.least(F.lit(1.0), F.col("value") / F.col("weight")).alias("claim"), "model", "tag")
    rows = values.groupBy("tick", "entity_type", "entity_id").agg(
        F.sum("value").alias("base"),
        F.count_if(active).alias("active_models"),
        F.collect_list(F.when(active, claim)).alias("claims"),  # one for each model at most
    )
    boost = F.when(F.col("active_models") >= 2, 1 + cfg.boost * (F.col("active_models") - 1)).otherwise(1.0)
    return rows.withColumn("entity_score", F.least(F.lit(1.0), F.col("base") * boost))


def picture(states: DataFrame, cfg: Fusion = Fusion()) -> DataFrame:
    """Global score, breadth and corroboration of each tick that has a lit entity."""
    lit = states.filter(F.col("entity_score") >= cfg.active)
    return _global(lit.groupBy("tick").agg(F.max("entity_score").alias("peak"), F.count("*").alias("lit_entities"), F.max("active_models").alias("corroboration")), cfg)


def _global(rows: DataFrame, cfg: Fusion) -> DataFrame:
    breadth = cfg.breadth * F.log1p(F.greatest(F.lit(0), F.col("lit_entities") - 1))
    return rows.withColumn("global_score", rnd(F.least(F.lit(1.0), F.col("peak") + breadth), 4))


# -- the picture by intervals, whatever the time between ticks (J3) -----------------------------------------------------

PIECE = "entity_type string, entity_id string, k0 long, k1 long, score double, active_models long"


def _last_at_least(value: np.ndarray, k: np.ndarray, step: float, halflife: float, least: float, until: np.ndarray) -> np.ndarray:
    """The last tick up to ``until`` at which ``value``, decaying from tick ``k`` on, is ``least`` or more; below ``k`` if none."""
    decayed = lambda at: value * 2.0 ** ((k - at) * step / halflife)
    with np.errstate(divide="ignore"):
        last = k + np.floor(np.nan_to_num(np.log2(value / least), neginf=-1.0) * halflife / step)
    last = np.where(decayed(last + 1) >= least, last + 1, np.where(decayed(last) >= least, last, last - 1))
    return np.minimum(last, until).astype(np.int64)


def entity_pieces(rows: pd.DataFrame, start: int, step: int, end: int, halflife: float, cfg: Fusion) -> list[tuple]:
    """(first tick, last tick, score at the first, active models) of the stretches in which nothing but decay changes an entity that is lit."""
    t, following = rows["t"].to_numpy(), rows["next_t"].fillna(end + 1).to_numpy().astype(np.int64)
    first = np.maximum(-((start - t) // step), 0)
    last = (np.minimum(np.minimum(following - 1, t + int(HORIZON * halflife)), end) - start) // step
    use = last >= first
    first, last, held, held_t = first[use], last[use], rows["held"].to_numpy()[use], rows["held_t"].to_numpy()[use]
    if not len(first):
        return []
    values = held * 2.0 ** ((held_t - (start + first * step)) / halflife)
    active = _last_at_least(values, first, step, halflife, cfg.active, last)
    edges = np.unique(np.concatenate([first, last + 1, active + 1]))
    order, at, ruling, out = np.argsort(first, kind="stable"), 0, [], []
    for k, after in zip(edges[:-1].tolist(), edges[1:].tolist()):
        while at < len(order) and first[order[at]] <= k:
            ruling.append(order[at])
            at += 1
        ruling = [i for i in ruling if last[i] >= k]
        if ruling:
            base = sum(float(held[i]) * 2.0 ** ((int(held_t[i]) - (start + k * step)) / halflife) for i in ruling)
            n = sum(1 for i in ruling if active[i] >= k)
            out.append((k, after - 1, base * (1 + cfg.boost * (n - 1) if n >= 2 else 1.0), n))
    if not out:
        return []
    k0, k1, score, n = (np.array(c) for c in zip(*out))
    lit = _last_at_least(score, k0, step, halflife, cfg.active, k1)
    return [(int(a), int(b), float(s), int(m)) for a, b, s, m in zip(k0, lit, score, n) if b >= a]


def pieces(contributed: DataFrame, start: int, step: int, end: int, halflife: float, cfg: Fusion = Fusion()) -> DataFrame:
    """Stretches of ticks in which a lit entity only decays: a few for each hit, however close the ticks are.

    ``score`` is that at tick number ``k0`` before it is held to 1; at tick k it is ``score * 2 ^ ((k0 - k) * step / halflife)``.
    An entity has one hit of a model a bucket at most, so its group is as long as the time.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = entity_pieces(rows, start, step, end, halflife, cfg)
        return pd.DataFrame([(*key, *p) for p in found], columns=["entity_type", "entity_id", "k0", "k1", "score", "active_models"])

    return contributed.select("entity_type", "entity_id", "t", "next_t", "held", "held_t").groupBy("entity_type", "entity_id").applyInPandas(run, PIECE)


def _highest(low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """For each of ``width`` places the last of the intervals [low, high] over it, -1 for none: a tree of spans, filled level by level."""
    tree, rank = np.full(2 * width, -1), np.arange(len(low))
    a, b = low + width, high + width + 1
    while len(a):
        odd = (a & 1).astype(bool)
        np.maximum.at(tree, a[odd], rank[odd])
        odd_b = (b & 1).astype(bool)
        np.maximum.at(tree, b[odd_b] - 1, rank[odd_b])
        a, b = (a + odd) >> 1, (b - odd_b) >> 1
        open_ = a < b
        a, b, rank = a[open_], b[open_], rank[open_]
    at, best = np.arange(width) + width, np.full(width, -1)
    while at[0]:
        best = np.maximum(best, tree[at])
        at = at >> 1
    return best


def swept(found: DataFrame, start: int, step: int, halflife: float, cfg: Fusion = Fusion(), width: int = 1024, parts: int | None = None) -> DataFrame:
    """``picture`` of the ticks with a lit entity, from ``pieces``.

    A piece goes to the chunks of ``width`` ticks that it lies in, and there to one of ``parts`` by its entity.  Of the pieces
    over a tick the one with the largest score decayed to a common time is the largest there too, so a chunk is swept once, by
    a tree of spans; each part then has a row a tick, and these are put together.  ``width`` is a power of two.
    """
    parts = parts or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        zero = key[0] * width
        k0, score, n = pdf["k0"].to_numpy(), pdf["score"].to_numpy(), pdf["active_models"].to_numpy()
        low, high = np.maximum(k0 - zero, 0), np.minimum(pdf["k1"].to_numpy() - zero, width - 1)
        by = np.argsort(np.log2(score) + (k0 - zero) * step / halflife, kind="stable")
        best = _highest(low[by], high[by], width)
        most = _highest(*(x[np.argsort(n, kind="stable")] for x in (low, high)), width)
        lit = np.cumsum(np.bincount(low, minlength=width + 1)[: width + 1] - np.bincount(high + 1, minlength=width + 1)[: width + 1])[:width]
        k = np.flatnonzero(best >= 0)
        top = by[best[k]]
        peak = np.minimum(1.0, score[top] * 2.0 ** ((k0[top] - zero - k) * step / halflife))
        return pd.DataFrame({"k": k + zero, "peak": peak, "lit": lit[k], "n": np.sort(n)[most[k]]})

    chunks = F.sequence(F.floor(F.col("k0") / width).cast("long"), F.floor(F.col("k1") / width).cast("long"))
    dealt = found.select("k0", "k1", "score", "active_models", F.explode(chunks).alias("chunk"), F.pmod(F.xxhash64("entity_type", "entity_id"), F.lit(parts)).alias("part"))
    rows = dealt.groupBy("chunk", "part").applyInPandas(run, "k long, peak double, lit long, n long")
    rows = rows.groupBy((F.col("k") * step + start).alias("tick")).agg(F.max("peak").alias("peak"), F.sum("lit").alias("lit_entities"), F.max("n").alias("corroboration"))
    return _global(rows, cfg)


def contributors(states: DataFrame, cfg: Fusion = Fusion()) -> DataFrame:
    """Each model's strongest claim at each tick, with the tag it carries there."""
    claims = states.filter(F.col("entity_score") >= cfg.active).select("tick", "entity_type", "entity_id", F.explode("claims").alias("c"))
    best = claims.groupBy("tick", "c.model").agg(F.max(F.struct("c.claim", "c.tag")).alias("b"))
    return best.select("tick", "model", rnd(F.col("b.claim"), 4).alias("claim"), F.col("b.tag").alias("tag"))


def top_entities(states: DataFrame, cfg: Fusion = Fusion()) -> DataFrame:
    """The strongest entities of each tick, without the global one."""
    rows = states.filter((F.col("entity_score") >= cfg.active) & (F.col("entity_type") != "global"))
    rank = F.row_number().over(Window.partitionBy("tick").orderBy(F.desc(rnd(F.col("entity_score"), 6)), "entity_type", "entity_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= cfg.top)


def suspects(states: DataFrame, n: int = 6, shown: int = 4, cfg: Fusion = Fusion()) -> DataFrame:
    """The first n of each tick's strongest entities with the first few of their reasons, one for each model."""
    reason = lambda c: F.concat(c["model"], F.lit(":"), F.coalesce(c["tag"], F.lit("")))
    reasons = F.slice(F.array_sort(F.transform("claims", reason)), 1, shown)
    return top_entities(states, cfg).filter(F.col("rank") <= n).withColumn("reasons", reasons)


def spine(spark, start: int, step: int, end: int) -> DataFrame:
    """All ticks (ST8)."""
    return spark.range(0, (end - start) // step + 1).select((F.col("id") * step + start).alias("tick"))


LEVELS = ("normal", "elevated", "critical")


def levels(spark, pic: DataFrame, start: int, step: int, end: int, cfg: Fusion = Fusion(), initial: str = "normal", width: int = scan.WIDTH) -> DataFrame:
    """Threat level at every tick (W9) and the one before it.

    Hysteresis is two independent latches, each set by its upper and reset below its lower threshold, so a latch is the last
    "set" or "reset" so far.  That is found in chunks of ``width`` ticks at once (``scan``), never over all ticks in one place.
    ``initial`` is the level before the first tick (S9); the ``critical`` latch is never set without the other.
    """
    ticks = spine(spark, start, step, end).withColumn("k", ((F.col("tick") - start) / step).cast("long"))
    rows = ticks.join(pic, "tick", "left").select("k", "tick", F.coalesce("global_score", F.lit(0.0)).alias("global_score"), F.coalesce("lit_entities", F.lit(0)).alias("lit_entities"), F.coalesce("corroboration", F.lit(0)).alias("corroboration"))
    g, at = F.col("global_score"), LEVELS.index(initial)
    rows = rows.withColumns({n: F.when(g >= up, True).when(g < down, False) for n, up, down in (("_c", cfg.critical_up, cfg.critical_down), ("_e", cfg.elevated_up, cfg.elevated_down))})
    rows = scan.running_last(sinks.stored(rows), "k", ["_c", "_e"], width)
    level = F.when(F.coalesce("_c", F.lit(at == 2)), "critical").when(F.coalesce("_e", F.lit(at >= 1)), "elevated").otherwise("normal")
    rows = scan.lagged(sinks.stored(rows.withColumn("level", level)), "k", "level", "previous", width)
    return rows.select("tick", "global_score", "lit_entities", "corroboration", "level", F.coalesce("previous", F.lit(initial)).alias("previous"), "k")


def transitions(lv: DataFrame) -> DataFrame:
    """Changes of level, newest first."""
    return lv.filter("level != previous").select(F.col("tick").alias("at"), F.col("previous").alias("from_level"), F.col("level").alias("to_level"), "global_score").orderBy(F.desc("at"))


def emissions(lv: DataFrame, emit_every: float, cfg: Fusion = Fusion(), step: float | None = None, initial: tuple[int, float] | None = None, width: int = scan.WIDTH) -> DataFrame:
    """Ticks at which a document is published, and from when its window runs.

    Which tick comes next after an emission depends on that tick alone, and it comes within ``emit_every``: emissions are a
    chain of bounded jumps, followed in chunks of ticks at once (``scan``).  The first tick only opens the window.  ``step`` is the
    least time between ticks; ticks without a number ``k`` (a table of few rows, by hand) get one and are looked through for it.
    ``initial`` is the last emission of an earlier run and its score (S9).
    """
    if "k" not in lv.columns:
        lv = lv.withColumn("k", F.row_number().over(Window.orderBy("tick")) - 1)
    if step is None:
        step = scan.lagged(lv, "k", "tick", "_before", width).agg(F.min(F.col("tick") - F.col("_before")).alias("d")).first()["d"] or emit_every
    hops = max(1, math.ceil(emit_every / step))
    delta, resumed = cfg.emit_delta, initial is not None

    def jumps(pdf: pd.DataFrame) -> list[int]:
        g, moved, at = (pdf[c].to_numpy() for c in ("global_score", "changed", "tick"))
        was = g.copy()
        if not resumed and len(pdf):
            was[pdf["k"].to_numpy() == 0] = 0.0  # the first tick opens, it tells nothing
        n, out = len(pdf), [0] * len(pdf)
        for d in range(hops, 0, -1):
            if d < n:
                hit = moved[d:] | (at[d:] - at[:-d] >= emit_every) | (abs(g[d:] - was[:-d]) >= delta)
                for i in hit.nonzero()[0].tolist():
                    out[i] = d
        return out

    rows = lv.select("k", "tick", "global_score", "level", (F.col("level") != F.col("previous")).alias("changed"))
    first = 0
    if resumed:
        since, last = initial
        due = F.col("changed") | (F.col("tick") - since >= emit_every) | (F.abs(F.col("global_score") - last) >= delta)
        found = rows.filter(due & (F.col("k") < hops)).agg(F.min("k").alias("k")).first()["k"]
        first = -1 if found is None else found
    chain = scan.chained(rows, "k", "tick", hops, jumps, first, width)
    out = chain.select("tick", F.coalesce("_from", F.lit(initial[0] if resumed else None)).alias("window_start"), "global_score", "level")
    return out if resumed else out.filter("window_start IS NOT NULL")


def documents(emitted: DataFrame) -> DataFrame:
    """Score documents of the fusion itself, one for each emission, in the shape of the scorers' (U2)."""
    none = lambda kind: F.lit(None).cast(kind)
    return emitted.select(
        F.col("window_start").alias("bucket"), F.lit("global").alias("entity_type"), F.lit("global").alias("entity_id"), none("long").alias("event_count"), F.col("global_score").alias("score"), none("string").alias("alert_type"),
        F.array(F.concat(F.lit("threat_level="), F.col("level"))).alias("reasons"), (F.col("level") != "normal").alias("is_anomalous"), F.lit(False).alias("warming_up"),
        F.struct(F.col("tick").alias("t"), F.lit(0).cast("long").alias("event_id"), F.lit(0).alias("rep")).alias("first"), F.lit("fused").alias("model"), F.col("tick").alias("t"),
    )


def level_alerts(lv: DataFrame) -> DataFrame:
    """An alert for each change of level."""
    sev = F.when(F.col("to_level") == "critical", "high").when(F.col("to_level") == "elevated", "medium").otherwise("low")
    summary = F.format_string("Threat level %s -> %s (score %.2f)", "from_level", "to_level", "global_score")
    return transitions(lv).select(
        F.col("at").alias("t"), F.lit("threat_level_change").alias("alert_type"), sev.alias("severity"), F.lit("global").alias("entity_type"), F.lit("global").alias("entity_id"),
        F.col("global_score").alias("score"), F.lit("fused").alias("source"), summary.alias("summary"), F.lit(1).alias("rank"),
    )


def snapshots(lv: DataFrame, states: DataFrame, cfg: Fusion = Fusion()) -> DataFrame:
    """The full picture at every tick (Q1): score, level, since when it holds, breadth, who speaks the loudest, and the strongest entities."""
    since = F.when((F.col("level") != F.col("previous")) | (F.col("k") == 0), F.col("tick"))
    lv = scan.running_last(lv.withColumn("since", since), "k", ["since"])
    claims = contributors(states, cfg).groupBy("tick").agg(F.array_sort(F.collect_list(F.struct((-F.col("claim")).alias("c"), "model", "tag"))).alias("c"))
    best = top_entities(states, cfg).groupBy("tick").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_type", "entity_id"))).alias("e"))
    listed = lambda items, text: F.coalesce(F.array_join(F.transform(items, text), ","), F.lit(""))
    rows = lv.join(claims, "tick", "left").join(best, "tick", "left")
    return rows.select(
        "tick", "global_score", "level", "since", "lit_entities", "corroboration",
        listed("c", lambda x: x["model"]).alias("contributors"), listed("e", lambda x: F.concat(x["entity_type"], F.lit(":"), x["entity_id"])).alias("entities"),
    )
