"""Exact k-means over integer vectors with Shallot's bounds and dynamically shrinking neighbour search.

Every vector remembers its nearest and its second-nearest centroid, an upper bound on its distance to the former and a
lower bound on that to any other.  After the centroids have moved, both bounds are widened by how far they moved; while
the upper one stays below the lower one, or below half the distance from the centroid to its closest neighbour, nothing
is computed.  Otherwise the search starts from the closer of the two remembered centroids and goes through that
centroid's neighbours in order of distance.  By the triangle inequality, none further away than the distance to the
start plus that to the second-nearest centroid so far can matter, so this ball shrinks as better ones are found.
Bounds are floats with a margin; candidates that survive them are compared as integers, so assignments are exact.

A round is one pass: each task reads its rows with their bounds, assigns them, and writes them back together with its
sums for each centroid.  Nothing is shuffled but those sums, so copies of one vector cost no task more than its share,
and the rows' table, written to the shared folder each round, is all that a lost executor needs.

Cases.  Rows whose vector is null, has another number of components, or holds a null or non-finite one are left out.
Repeated rows are each a vector of their own; equal distances go to the smaller centroid number.  With fewer vectors than centroids
there are as many centroids as vectors; an empty table gives no row.  A null id is clustered too, but its vector starts
a centroid only after all others.  Integers beyond +-2**53 are held at that bound, and a distance or
inertia beyond 64 bits is reported as 2**63 - 1; assignments stay exact between such vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common

#: Integers are held within this.
LIMIT = 1 << 53
#: Below this, a squared distance over 64 components fits 64 bits.
SMALL = 1 << 27
LONG = (1 << 63) - 1
#: Bounds are floats of exact integers and of moves; so much they may be off.
MARGIN = 1e-9


def to_integers(values: np.ndarray, factor: float) -> np.ndarray:
    """``floor(factor * x)``, held within ``LIMIT``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * factor), -LIMIT, LIMIT).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows: 64-bit integers where they fit, Python's else."""
    if a.size and max(np.abs(a).max(), np.abs(b).max()) >= SMALL // max(1, a.shape[-1] // 64):
        d = a.astype(object) - b.astype(object)
        return (d * d).sum(axis=-1)
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


class Centroids:
    """A round's centroids with what the search needs: distances, neighbours in order, and how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None) -> None:
        self.at, self.k = at, len(at)
        self.apart = root(squared(at[:, None, :], at[None, :, :])) if self.k else np.zeros((0, 0))
        self.order = np.argsort(self.apart + np.where(np.eye(self.k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")
        self.half = np.sort(self.apart, axis=1)[:, 1] / 2 if self.k > 1 else np.full(self.k, np.inf)
        self.moved = root(squared(at, before)) if before is not None and self.k else np.zeros(self.k)
        self.compared = 0  # squared distances that were computed

    def _to(self, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.compared += len(x)
        return squared(x, self.at[j])

    def assign(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """New (nearest, second-nearest, upper bound, lower bound) of rows ``x`` from the bounds under the centroids before."""
        a, b = a.copy(), b.copy()
        upper = (upper + self.moved[a]) * (1 + MARGIN)
        largest, runner = (*np.sort(self.moved)[[-1, -2]],) if self.k > 1 else (0.0, 0.0)
        lower = lower - np.where(self.moved[a] == largest, runner if (self.moved == largest).sum() == 1 else largest, largest)
        if self.k == 1:
            return a, b, root(self._to(x, a)), np.full(len(x), np.inf)
        safe = np.maximum(lower, self.half[a]) * (1 - MARGIN)
        rows = np.flatnonzero(~(upper < safe))
        to_a = self._to(x[rows], a[rows])
        upper[rows] = root(to_a)
        still = ~(upper[rows] * (1 + MARGIN) < safe[rows])
        rows, to_a = rows[still], to_a[still]
        if len(rows):
            a[rows], b[rows], to_best, to_second = self._search(x[rows], a[rows], b[rows], to_a)
            upper[rows], lower[rows] = root(to_best), root(to_second)
        return a, b, upper, lower

    def _search(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, to_a: np.ndarray) -> tuple[np.ndarray, ...]:
        to_b = self._to(x, b)
        swap = (to_b < to_a) | ((to_b == to_a) & (b < a))
        best, second = np.where(swap, b, a), np.where(swap, a, b)
        d_best, d_second = np.where(swap, to_b, to_a), np.where(swap, to_a, to_b)
        start, known = best.copy(), second.copy()
        d_start = root(d_best)
        live = np.arange(len(x))
        for place in range(1, self.k):
            j = self.order[start[live], place]
            near = self.apart[start[live], j] <= (d_start[live] + root(d_second[live])) * (1 + MARGIN)
            live, j = live[near], j[near]  # neighbours come by distance and the ball only shrinks: who is out stays out
            if not len(live):
                break
            new = j != known[live]
            r, j = live[new], j[new]
            d = self._to(x[r], j)
            first = (d < d_best[r]) | ((d == d_best[r]) & (j < best[r]))
            then = ~first & ((d < d_second[r]) | ((d == d_second[r]) & (j < second[r])))
            f, t = r[first], r[then]
            second[f], d_second[f] = best[f], d_best[f]
            best[f], d_best[f] = j[first], d[first]
            second[t], d_second[t] = j[then], d[then]
        return best, second, d_best, d_second


_ROW = "vec_id long, v array<long>, a int, b int, upper double, lower double, distance long"
#: Rows with ``part`` filled are a task's sums: of centroid ``a``, one row each.
_STATE = f"{_ROW}, part array<decimal(38,0)>"
_ARROW = pa.schema(
    [("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("a", pa.int32()), ("b", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()), ("part", pa.list_(pa.decimal128(38, 0)))]
)


def matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return np.asarray(column.flatten()).astype(dtype, copy=False).reshape(-1, width)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))


def _round(centroids: Centroids, width: int):
    """A task's pass over its rows: assigned rows, then for each centroid [count, sum of distances, sums of components]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            x = matrix(batch["v"], width, np.int64)
            if not len(x):
                continue
            a, b, upper, lower = centroids.assign(x, *(batch[c].to_numpy() for c in ("a", "b", "upper", "lower")))
            d = squared(x, centroids.at[a])
            by = np.argsort(a, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(a[by])) + 1):
                held = sums.setdefault(int(a[rows[0]]), [0] * (width + 2))
                wide = x[rows].astype(object) if int(np.abs(x[rows]).max()) * len(rows) > LONG else x[rows]
                for i, s in enumerate([len(rows), sum(map(int, d[rows])), *wide.sum(axis=0)]):
                    held[i] += int(s)
            out = np.minimum(d, LONG).astype(np.int64)
            rows = [batch["vec_id"], batch["v"], pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(upper), pa.array(lower), pa.array(out), pa.nulls(len(x), _ARROW.field("part").type)]
            yield pa.RecordBatch.from_arrays(rows, schema=_ARROW)
        if sums:
            keys = sorted(sums)
            none = {f.name: pa.nulls(len(keys), f.type) for f in _ARROW}
            none |= {"a": pa.array(keys, pa.int32()), "part": pa.array([sums[k] for k in keys], _ARROW.field("part").type)}
            yield pa.RecordBatch.from_arrays([none[f.name] for f in _ARROW], schema=_ARROW)

    return run


def totals(state: DataFrame) -> dict[int, list[int]]:
    """[count, inertia, sums of components] of each centroid: k rows of fixed width, added up by Spark."""
    each = state.filter("part IS NOT NULL").select("a", F.posexplode("part").alias("i", "s")).groupBy("a", "i").agg(F.sum("s").alias("s"))
    out: dict[int, list[int]] = {}
    for r in each.orderBy("a", "i").collect():
        out.setdefault(r["a"], []).append(int(r["s"]))
    return out


def usable(column, dims: int):
    """True for vectors of ``dims`` components, none null or non-finite."""
    x = F.col(column)
    fit = F.size(x) == dims if dims else F.size(x) > 0
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return F.coalesce(x.isNotNull() & fit & ~F.coalesce(bad, F.lit(True)), F.lit(False))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, factor: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", seed: str = "1") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``, ``second``, ``centroid``.

    ``k`` centroids start as the vectors with the smallest SHA-256 of ``seed:id``; each of ``rounds`` rounds assigns all vectors
    and replaces every non-empty centroid by the floor of its vectors' mean; then they are assigned once more.
    """
    spark, folder = vectors.sparkSession, common.shared_dir(vectors.sparkSession)

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = to_integers(matrix(batch["x"], dims, np.float64), factor)
            n = len(x)
            if n:
                zero = pa.array(np.zeros(n, np.int32))
                rows = [batch["vec_id"], lists(x), zero, pa.array(np.ones(n, np.int32)), pa.array(np.full(n, np.inf)), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64)), pa.nulls(n, _ARROW.field("part").type)]
                yield pa.RecordBatch.from_arrays(rows, schema=_ARROW)

    kept = vectors.filter(usable(vector_col, dims)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    state = common.cut_lineage(kept.mapInArrow(integers, _STATE), folder, "0")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.select("vec_id", "v", rank.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    at = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dims)
    before = None
    if not len(at):
        rounds = -1
    for i in range(rounds + 1):
        state = common.cut_lineage(state.filter("part IS NULL").mapInArrow(_round(Centroids(at, before), dims), _STATE), folder, str(i + 1))
        common.drop(spark, folder, str(i))
        found = totals(state)
        if i < rounds:
            before, at = at, at.copy()
            for c, (n, _, *s) in found.items():
                at[c] = [t // n for t in s]
    found = totals(state) if rounds >= 0 else {}
    whole = min(LONG, sum(v[1] for v in found.values()))
    about = [(c, min(LONG, v[1]), whole, hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest(), at[c].tolist()) for c, v in found.items()]
    each = spark.createDataFrame(about, "a int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    rows = state.filter("part IS NULL").join(F.broadcast(each), "a")  # k rows
    return rows.select("vec_id", F.col("a").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256", F.when(F.col("b") < len(at), F.col("b")).alias("second"), "centroid")
