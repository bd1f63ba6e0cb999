"""Outliers of a payer's traffic shape: exact nearest neighbours and an isolation forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Rate
from tidewatch.sources.sinks import stored

VECTOR = ("log_count", "mean_payload", "error_ratio", "malformed")


def vectors(feats: DataFrame) -> DataFrame:
    """(bucket, entity_id, four numbers) of payers."""
    rows = feats.filter("entity_type = 'payer'")
    return rows.select("bucket", "entity_id", "first", F.log1p("event_count").alias("log_count"), "mean_payload", "error_ratio", F.col("malformed_count").cast("double").alias("malformed"))


def reservoir(vecs: DataFrame, before: int, cfg: Rate = Rate()) -> DataFrame:
    """The latest vectors before a time, ``cfg.reservoir`` at most: the feature's own bound."""
    order = [F.desc("bucket"), F.desc("first.t"), F.desc("first.event_id"), F.desc("first.rep"), "entity_id"]
    return vecs.filter(F.col("bucket") < before).orderBy(*order).limit(cfg.reservoir)


def moments(res: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each number, 1 where it is 0."""
    aggs = [f(c).alias(f"{c}_{n}") for c in VECTOR for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    one = res.agg(*aggs, F.count("*").alias("n"))
    return one.withColumns({f"{c}_std": F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in VECTOR})


def standardized(vecs: DataFrame, res: DataFrame) -> DataFrame:
    """Vectors in units of the reservoir's deviations; the moments are one row."""
    one = F.broadcast(moments(res))
    return vecs.join(one).withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in VECTOR}).drop(*one.columns)


class Forest:
    """Isolation forest (Liu, Ting and Zhou, 2008) in flat arrays."""

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(x))
        self.roots: list[int] = []
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.path: list[float] = []
        for _ in range(trees):
            self.roots.append(self._grow(x[rng.choice(len(x), self.sample, replace=False)], 0, int(np.ceil(np.log2(max(2, self.sample)))), rng))
        self.offset = 0.5  # score_samples is -2 ** (-depth / c); decision = score_samples + offset

    @staticmethod
    def c(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, level: int, limit: int, rng) -> int:
        i = len(self.feature)
        for held, v in ((self.feature, -1), (self.cut, 0.0), (self.child, (0, 0)), (self.path, level + self.c(len(x)))):
            held.append(v)
        spread = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 else []
        if level < limit and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            self.feature[i], self.cut[i] = f, cut
            left = self._grow(x[x[:, f] <= cut], level + 1, limit, rng)
            self.child[i] = (left, self._grow(x[x[:, f] > cut], level + 1, limit, rng))
        return i

    def depth(self, x: np.ndarray) -> np.ndarray:
        feature, cut, child, path = np.array(self.feature), np.array(self.cut), np.array(self.child), np.array(self.path)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (live := feature[node] >= 0).any():
                go = x[rows, np.maximum(feature[node], 0)] > cut[node]
                node = np.where(live, child[node, go.astype(int)], node)
            total += path[node]
        return total / len(self.roots)

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Positive for ordinary points, negative for outliers."""
        return self.offset - 2.0 ** (-self.depth(x) / max(self.c(self.sample), 1e-9))


class Tree:
    """A k-d tree whose leaves hold few points each; a query opens leaves in order of their boxes' distance, until the next is beyond its k-th nearest."""

    def __init__(self, points: np.ndarray, leaf: int = 32) -> None:
        todo, leaves = [np.arange(len(points))], []
        while todo:
            rows = todo.pop()
            spread = np.ptp(points[rows], axis=0)
            if len(rows) <= leaf or not spread.max() > 0:
                leaves += [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
                continue
            by = rows[np.argsort(points[rows, spread.argmax()], kind="stable")]
            todo += [by[: len(by) // 2], by[len(by) // 2 :]]
        self.low = np.stack([points[r].min(axis=0) for r in leaves])
        self.high = np.stack([points[r].max(axis=0) for r in leaves])
        self.members = np.full((len(leaves), leaf, points.shape[1]), np.inf)
        for held, rows in zip(self.members, leaves):
            held[: len(rows)] = points[rows]
        self.opened = 0

    def distances(self, x: np.ndarray, k: int) -> np.ndarray:
        """Those to the k nearest points, the nearest first; infinite where there are fewer."""
        out = [np.zeros((0, k))]
        for i in range(0, len(x), 1024):
            q = x[i : i + 1024]
            off = np.maximum(np.maximum(self.low - q[:, None, :], q[:, None, :] - self.high), 0.0)
            bound = (off**2).sum(axis=2)
            order = np.argsort(bound, axis=1)
            best = np.full((len(q), k), np.inf)
            for rank in range(len(self.low)):
                leaf = order[:, rank]
                live = np.flatnonzero(bound[np.arange(len(q)), leaf] <= best[:, -1])
                if not len(live):
                    break
                self.opened += len(live)
                d = ((self.members[leaf[live]] - q[live, None, :]) ** 2).sum(axis=2)
                best[live] = np.sort(np.concatenate([best[live], d], axis=1), axis=1)[:, :k]
            out.append(np.sqrt(best))
        return np.concatenate(out)


def knn_reference(points: np.ndarray, k: int, tree: Tree | None = None) -> float:
    """99th percentile of each point's mean distance to its k nearest others."""
    means = (tree or Tree(points)).distances(points, k + 1)[:, 1:].mean(axis=1)
    return max(float(np.percentile(means, 99)), 1e-6)


class Model:
    """Scaler, forest and neighbours of a reservoir's points (M1, M2)."""

    def __init__(self, points: np.ndarray, cfg: Rate) -> None:
        self.mean, self.std, self.k = points.mean(axis=0), points.std(axis=0), cfg.neighbours
        self.std[self.std == 0] = 1.0
        self.points = (points - self.mean) / self.std
        self.tree = Tree(self.points)
        self.forest, self.reference = Forest(self.points), knn_reference(self.points, cfg.neighbours, self.tree)

    def score(self, x: np.ndarray) -> pd.DataFrame:
        x = (x - self.mean) / self.std
        iso = np.clip(-self.forest.decision(x) / 0.15, 0, 1)
        ratio = self.tree.distances(x, self.k).mean(axis=1) / self.reference
        return pd.DataFrame({"iso": iso, "knn_ratio": ratio, "mv_score": np.maximum(iso, np.clip((ratio - 1.0) / 2.0, 0, 1))})


SCORES = ("iso", "knn_ratio", "mv_score")


def unscored(vecs: DataFrame) -> DataFrame:
    """Vectors that no model rules score 0."""
    return vecs.withColumns({c: F.lit(0.0) for c in SCORES})


def score(vecs: DataFrame, res: DataFrame, cfg: Rate = Rate()) -> DataFrame:
    """``iso``, ``knn_ratio`` and ``mv_score`` of every vector against a reservoir; 0 while it has too few (M1-M3).

    The reservoir is bounded by its definition, so it and the forest travel with the tasks; vectors stay where they are.
    """
    points = np.array([[r[c] for c in VECTOR] for r in res.select(*VECTOR).collect()], dtype=float).reshape(-1, len(VECTOR))
    if len(points) < cfg.min_fit:
        return unscored(vecs)
    model = Model(points, cfg)

    @F.pandas_udf("iso double, knn_ratio double, mv_score double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            yield model.score(np.stack([c.to_numpy(dtype=float) for c in cols], axis=1))

    return vecs.withColumn("_s", run(*[F.col(c) for c in VECTOR])).select("*", "_s.*").drop("_s")


#: Vectors that one call of a fitted model scores.
CHUNK = 50_000


def refits(vecs: DataFrame, spine: DataFrame, cfg: Rate = Rate()) -> DataFrame:
    """``bucket, before, seen, fit``: vectors before and up to a bucket, and how many had come at the fit that rules it (M4).

    A model is fitted after a bucket once ``cfg.refit`` buckets have passed since the last fit and the reservoir has
    enough, and rules from the next bucket on; ``fit`` is null before the first.  ``spine`` has each finalized bucket
    once, one row of a few numbers, so that its order may be one task's.
    """
    order, every = Window.orderBy("bucket"), Window.partitionBy()
    rows = spine.join(vecs.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    rows = rows.select("bucket", (F.row_number().over(order) - 1).alias("i"), F.sum("n").over(order).alias("seen"), "n")
    rows = rows.withColumn("first_fit", F.min(F.when((F.col("i") >= cfg.refit - 1) & (F.col("seen") >= cfg.min_fit), F.col("i"))).over(every))
    rows = rows.withColumn("fits", (F.col("i") >= F.col("first_fit")) & ((F.col("i") - F.col("first_fit")) % cfg.refit == 0))
    ruling = F.last(F.when(F.col("fits"), F.col("seen")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("bucket", (F.col("seen") - F.col("n")).alias("before"), "seen", ruling.alias("fit"))


def score_by_epochs(vecs: DataFrame, spine: DataFrame, cfg: Rate = Rate()) -> DataFrame:
    """``bucket, entity_id`` and scores of every vector by the model in force when its bucket closed (M3, M4).

    A vector's place in order of arrival says in which block of ``cfg.reservoir`` places it stands; a reservoir lies in two
    blocks at most, so it is gathered by an equi-join.  A group is one reservoir and a chunk of the vectors that its model rules.
    Places and ruling fits are written once, as several branches read them.
    """
    ruled = stored(refits(vecs, spine, cfg))
    arrival = Window.partitionBy("bucket").orderBy("first.t", "first.event_id", "first.rep", "entity_id")
    placed = vecs.withColumn("_r", F.row_number().over(arrival)).join(ruled.select("bucket", "before"), "bucket")
    placed = stored(placed.select(*VECTOR, (F.col("before") + F.col("_r") - 1).alias("place")))
    last = F.floor((F.col("fit") - 1) / cfg.reservoir)
    fits = ruled.filter("fit IS NOT NULL").groupBy("fit").agg(F.sum(F.col("seen") - F.col("before")).alias("n"))
    wanted = fits.select("fit", F.explode(F.array(last, last - 1)).alias("block")).filter("block >= 0")
    held = placed.withColumn("block", F.floor(F.col("place") / cfg.reservoir)).join(wanted, "block")
    held = held.filter((F.col("place") < F.col("fit")) & (F.col("place") >= F.col("fit") - cfg.reservoir)).select("fit", "place", *VECTOR)
    chunks = F.ceil(F.col("n") / CHUNK)
    spread = fits.filter("n > 0").select("fit", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))).alias("chunk"))
    points = held.join(spread, "fit").select(F.col("fit").alias("of"), F.col("chunk").alias("part"), "place", *[F.col(c).alias(f"{c}_held") for c in VECTOR])
    rows = vecs.join(ruled.select("bucket", "fit"), "bucket").select("bucket", "entity_id", *VECTOR, "fit")
    live = rows.filter("fit IS NOT NULL").join(fits, "fit").withColumn("chunk", F.pmod(F.xxhash64("bucket", "entity_id"), chunks).cast("int")).drop("n")

    def run(mine: pd.DataFrame, reservoir: pd.DataFrame) -> pd.DataFrame:
        found = mine[["bucket", "entity_id"]].reset_index(drop=True)
        if not len(mine):
            return found.assign(**{c: 0.0 for c in SCORES})
        model = Model(reservoir.sort_values("place")[[f"{c}_held" for c in VECTOR]].to_numpy(dtype=float), cfg)
        return pd.concat([found, model.score(mine[list(VECTOR)].to_numpy(dtype=float))], axis=1)

    kind = vecs.schema["entity_id"].dataType.simpleString()
    scored = live.groupBy("fit", "chunk").cogroup(points.groupBy("of", "part")).applyInPandas(run, f"bucket long, entity_id {kind}, iso double, knn_ratio double, mv_score double")
    return scored.unionByName(unscored(rows.filter("fit IS NULL").select("bucket", "entity_id")))


def nearest(vecs: DataFrame, res: DataFrame, k: int = 5) -> DataFrame:
    """Mean distance of each vector to its k nearest points of the bounded reservoir (M2), null if that is empty.

    The reservoir travels with the tasks as a k-d tree.  Vectors are small and their search is not, so they are dealt out
    by number: partitions of a few megabytes would put all of them into one task.
    """
    points = np.array([[r[c] for c in VECTOR] for r in res.select(*VECTOR).collect()], dtype=float).reshape(-1, len(VECTOR))
    if not len(points):
        return vecs.withColumn("mean_distance", F.lit(None).cast("double"))
    tree, k = Tree(points), min(k, len(points))

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(tree.distances(np.stack([c.to_numpy(dtype=float) for c in cols], axis=1), k).mean(axis=1))

    dealt = vecs.repartition(int(vecs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "entity_id")
    return dealt.withColumn("mean_distance", run(*[F.col(c) for c in VECTOR]))
