"""The content scorer's model: boosted trees for three classes with a soft maximum, kept as a file.

Labels are the windows' rule levels.  A bounded sample of each class is fitted in one task; the artifact is a line of JSON with
the trees as flat arrays, the names of the inputs and the accuracy on addresses that the fit has not seen.  Scoring runs
over whole arrays in the tasks of the windows, and an artifact of other inputs or too low accuracy is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Content
from tidewatch.operators import content

CLASSES = ("benign", "suspicious", "malicious")
#: Windows of each class that a model is fitted on at most, about.
SAMPLE = 20_000
#: Thresholds of an input that a split is looked for among, at most.
CUTS = 64
#: One address in so many is held out.
PART = 5


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Per input the values between which a split may fall."""
    out = []
    for column in x.T:
        kinds = np.unique(column)
        middle = (kinds[1:] + kinds[:-1]) / 2
        out.append(middle if len(middle) <= CUTS else np.unique(np.quantile(middle, np.linspace(0, 1, CUTS))))
    return out


def _tree(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, step: float, weight: float = 1.0) -> dict:
    """A complete tree of second-order gains; a node without a gain sends all rows left."""
    inner, wide, many = (1 << depth) - 1, CUTS + 1, bins.shape[1]
    feature, threshold = [0] * inner, [np.inf] * inner
    node = np.zeros(len(g), dtype=np.int64)
    for level in range(depth):
        first, count = (1 << level) - 1, 1 << level
        best = np.zeros(count)
        for f in range(many):
            at = (node - first) * wide + bins[:, f]
            gl, hl = (np.bincount(at, v, count * wide).reshape(count, wide).cumsum(axis=1) for v in (g, h))
            gt, ht = gl[:, -1:], hl[:, -1:]
            gain = gl**2 / (hl + weight) + (gt - gl) ** 2 / (ht - hl + weight) - gt**2 / (ht + weight)
            gain[(hl < weight) | (ht - hl < weight)] = 0.0
            gain[:, len(cuts[f]) :] = 0.0
            where = gain.argmax(axis=1)
            for n in range(count):
                if gain[n, where[n]] > best[n] + 1e-9:
                    best[n], feature[first + n], threshold[first + n] = gain[n, where[n]], f, float(cuts[f][where[n]])
        place = np.array([np.searchsorted(cuts[f], t) if np.isfinite(t) else wide for f, t in zip(feature, threshold)])
        node = 2 * node + 1 + (bins[np.arange(len(g)), np.array(feature)[node]] > place[node])
    leaves = node - inner
    gs, hs = (np.bincount(leaves, v, 1 << depth) for v in (g, h))
    return {"feature": feature, "threshold": [t if np.isfinite(t) else None for t in threshold], "leaf": (-step * gs / (hs + weight)).tolist()}


def _walk(tree: dict, x: np.ndarray) -> np.ndarray:
    feature, threshold = np.array(tree["feature"]), np.array([np.inf if t is None else t for t in tree["threshold"]])
    node, inner = np.zeros(len(x), dtype=np.int64), len(feature)
    while len(node) and node[0] < inner:
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
    return np.array(tree["leaf"])[node - inner]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, step: float = 0.3) -> list[list[dict]]:
    """``rounds`` of one tree for each class on the gradients of the soft maximum."""
    cuts = _cuts(x)
    bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, x.shape[1]), dtype=np.int64)
    margin, trees, truth = np.zeros((len(x), len(CLASSES))), [], np.eye(len(CLASSES))[y.astype(int)]
    for _ in range(rounds):
        p = softmax(margin)
        trees.append([_tree(bins, cuts, p[:, k] - truth[:, k], p[:, k] * (1 - p[:, k]), depth, step) for k in range(len(CLASSES))])
        margin += np.stack([_walk(t, x) for t in trees[-1]], axis=1)
    return trees


def probabilities(trees: list[list[dict]], x: np.ndarray) -> np.ndarray:
    return softmax(sum((np.stack([_walk(t, x) for t in r], axis=1) for r in trees), np.zeros((len(x), len(CLASSES)))))


def labelled(win: DataFrame) -> DataFrame:
    return win.withColumn("label", content.rule_level(Content().storm))


def _held() -> object:
    return F.crc32(F.coalesce("client_ip", F.lit("")).cast("binary")) % PART == 0


def train(win: DataFrame, rows: int = SAMPLE, rounds: int = 40, depth: int = 3, step: float = 0.3) -> dict:
    """An artifact fitted on about ``rows`` windows of each class, or all of fewer, and measured on every held-out address."""
    seen = labelled(win).filter(~_held())
    many = {r["label"]: r["count"] for r in seen.groupBy("label").count().collect()}
    share = F.create_map(*[F.lit(v) for k, n in many.items() for v in (k, min(1.0, rows / n))]) if many else F.lit(None).cast("map<int,double>")
    mix = F.pmod(F.xxhash64("client_ip", "bucket"), F.lit(1 << 30)) / float(1 << 30)
    sample = seen.filter(mix < share[F.col("label")]).select("label", *[F.col(c).cast("double") for c in content.FEATURES])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(pdf.columns))  # the same trees however the rows come
        trees = fit(pdf[list(content.FEATURES)].to_numpy(), pdf["label"].to_numpy(), rounds, depth, step)
        return pd.DataFrame([(json.dumps(trees), len(pdf))], columns=["trees", "n"])

    found = sample.groupBy(F.lit(0).alias("one")).applyInPandas(run, "trees string, n long").first()
    if found is None:
        raise ValueError("there is no window to fit a model on")
    artifact = {"features": list(content.FEATURES), "classes": list(CLASSES), "trees": json.loads(found["trees"]), "rows": found["n"], "accuracy": None}
    right = F.avg((_winner() == F.col("label")).cast("double"))
    artifact["accuracy"] = predict(labelled(win).filter(_held()), artifact).agg(right.alias("a")).first()["a"]
    return artifact


def _winner():
    """The likeliest class; of equal ones the smaller."""
    top = F.greatest("p_benign", "p_suspicious", "p_malicious")
    return F.when(F.col("p_benign") == top, 0).when(F.col("p_suspicious") == top, 1).otherwise(2)


def check(artifact: dict, least: float = 0.97) -> dict:
    """The artifact, if its inputs are the windows' and its accuracy on held-out addresses will do (M7)."""
    content.check_contract(artifact["features"], artifact["accuracy"] if artifact["accuracy"] is not None else 0.0, least)
    if tuple(artifact["classes"]) != CLASSES:
        raise ValueError("the model's classes are not the rule levels")
    return artifact


def save(spark: SparkSession, artifact: dict, path: str, least: float = 0.97) -> None:
    """Write a model that passes ``check``; any other is refused before it can replace one that did."""
    spark.createDataFrame([(json.dumps(check(artifact, least)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, least: float = 0.97) -> dict:
    return check(json.loads(spark.read.text(path).first()["value"]), least)


def predict(win: DataFrame, artifact: dict) -> DataFrame:
    """``win`` with ``p_benign``, ``p_suspicious`` and ``p_malicious``, which ``content.score`` takes."""
    trees, names = artifact["trees"], artifact["features"]

    @F.pandas_udf("p_benign double, p_suspicious double, p_malicious double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = probabilities(trees, np.stack([c.to_numpy(dtype=float) for c in batch], axis=1))
            yield pd.DataFrame(p, columns=["p_benign", "p_suspicious", "p_malicious"])

    return win.withColumn("_p", run(*[F.col(c).cast("double") for c in names])).select(*win.columns, "_p.*")


def holdout(win: DataFrame, artifact: dict) -> DataFrame:
    """``label, prediction`` of every window of the addresses that no fit sees."""
    return predict(labelled(win).filter(_held()), artifact).select("label", _winner().cast("double").alias("prediction"))
