"""The k nearest neighbours of a set of query vectors by cosine, as a product of blocks.

Queries and candidates are dealt into blocks, and a cell of the grid (a block of queries, a block of candidates) is
one unit of work: its queries are held as int8 codes, its candidates stream by.  A product of codes, exact in integers,
lies within a known distance of the true cosine: the lengths of both quantisation errors bound it.  Pairs whose upper
bound stays below the k-th best so far, or below the k-th best lower bound of the tile, are settled by that; the others
are computed again from the original vectors in double precision, and a heap for each query keeps the best.  The heaps of
all cells of a query are merged by rank.  So the result is the exact one.

Equal candidate vectors are one, which carries its k + 1 smallest ids: no query can want more of them.  Cells take as many
rows whatever these hold, and rows are sorted by cell so that a task holds one block of queries and one tile at a time.

Cases.  Vectors that are null, empty, zero, or hold a null or non-finite component take no part, neither as query nor as
candidate.  Only vectors of one length are compared.  A query with fewer candidates has them all; one without any has no row.
Ties go to the smaller id, a null id last.  Repeated rows are candidates each, also those equal to the query's row, and
each repeated query row gets its own list.  A null id is no query.  An empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.centroid_clustering import matrix, usable

#: Queries of a block, which a task holds, and candidates of a block, which it streams.
QUERIES, CANDIDATES = 1 << 15, 1 << 20
#: Rows and columns of a tile.
TILE = 1024
#: Rounding of the float bounds themselves.
SLACK = 1e-6
LAST = (1 << 63) - 1


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; their digits stay."""
    top = np.abs(x).max(axis=1)
    return np.ldexp(x, -np.frexp(top)[1][:, None])


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, component after component: the same two vectors give the same number wherever they stand."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


class Block:
    """Vectors with their int8 codes; ``error`` is the length of what the codes miss of the unit vector, ``size`` that of what they say."""

    def __init__(self, raw: np.ndarray) -> None:
        self.raw = scaled(raw)
        self.norm = np.sqrt(dots(self.raw, self.raw))
        unit = self.raw / self.norm[:, None]
        self.step = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.step[:, None]).astype(np.int8)
        told = self.codes * self.step[:, None]
        self.error, self.size = np.sqrt(((unit - told) ** 2).sum(axis=1)), np.sqrt((told**2).sum(axis=1))

    def __len__(self) -> int:
        return len(self.raw)

    def cosine(self, rows: np.ndarray, other: Block, columns: np.ndarray) -> np.ndarray:
        return dots(self.raw[rows], other.raw[columns]) / (self.norm[rows] * other.norm[columns])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of int8 codes.  float32 holds sums below 2 ** 24 exactly, so up to 1,040 components at a time."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return out


class Best:
    """A heap for each query of a block, with the worst kept (smallest cosine, then largest id) on top."""

    def __init__(self, queries: Block, k: int) -> None:
        self.queries, self.k, self.recomputed = queries, k, 0
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(queries))]
        self.floor = np.full(len(queries), -np.inf)

    def offer(self, other: Block, ids: list[list[int]], own: dict[int, dict[int, int]]) -> None:
        """A block of candidates with their ids; ``own``: for a query, the candidate of the same vector and which of its ids is the query's."""
        for at in range(0, len(self.queries), TILE):
            q = slice(at, min(at + TILE, len(self.queries)))
            for left in range(0, len(other), TILE):
                c = slice(left, min(left + TILE, len(other)))
                self._tile(q, c, other, ids, own)

    def _tile(self, q: slice, c: slice, other: Block, ids: list[list[int]], own: dict[int, dict[int, int]]) -> None:
        mine = self.queries
        near = product(mine.codes[q], other.codes[c]) * mine.step[q, None] * other.step[None, c]
        off = mine.error[q, None] + mine.size[q, None] * other.error[None, c] + SLACK
        floor = self.floor[q]
        if near.shape[1] > self.k:  # the query's own row may be among the best, so one more
            floor = np.maximum(floor, -np.partition(off - near, self.k, axis=1)[:, self.k])
        rows, columns = np.nonzero(near + off >= floor[:, None])
        rows, columns = rows + q.start, columns + c.start
        self.recomputed += len(rows)
        for some in range(0, len(rows), 1 << 16):
            r, s = rows[some : some + (1 << 16)], columns[some : some + (1 << 16)]
            for i, j, score in zip(r.tolist(), s.tolist(), mine.cosine(r, other, s).tolist()):
                self._push(i, score, ids[j], own.get(i, {}).get(j))
        self.floor[q] = [h[0][0] if len(h) == self.k else -np.inf for h in self.heaps[q]]

    def _push(self, i: int, score: float, ids: list[int], without: int | None) -> None:
        heap = self.heaps[i]
        for x in ids:
            if without is not None and x == without:
                without = None  # the query's own row, once
                continue
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -x))
            elif heap[0] < (score, -x):
                heapq.heapreplace(heap, (score, -x))
            else:
                break  # further ids are larger


_FOUND = "query long, h1 long, h2 long, vec_id long, score double"


def _cells(k: int):
    """Rows sorted by cell, length and kind: a block's queries come first, then its candidates in tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, best = None, [], None

        def finish() -> Iterator[pa.RecordBatch]:
            if best is not None:
                rows = [(*asked[i], None if x == -LAST else -x, s) for i, heap in enumerate(best.heaps) for s, x in heap]
                for at in range(0, len(rows), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + (1 << 16)]), types)], names=["query", "h1", "h2", "vec_id", "score"])

        types = [pa.int64()] * 4 + [pa.float64()]
        held: list[tuple[np.ndarray, list]] = []
        for batch in batches:
            cell, dims, kind = (batch[c].to_numpy() for c in ("cell", "dims", "kind"))
            code = np.stack([cell, dims, kind], axis=1)
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1).tolist(), len(code)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                here = (int(cell[a]), int(dims[a]))
                if here != key:
                    yield from finish()
                    key, asked, best, held = here, [], None, []
                x = matrix(part["x"], here[1], np.float64)
                names = list(zip(*(part[c].to_pylist() for c in ("query", "h1", "h2"))))
                if kind[a] == 0:
                    held.append((x, names))
                    continue
                if best is None and held:
                    asked = [n for _, more in held for n in more]
                    best, held = Best(Block(np.concatenate([m for m, _ in held])), k), []
                    where: dict[tuple[int, int], list[int]] = {}
                    for i, (_, h1, h2) in enumerate(asked):
                        where.setdefault((h1, h2), []).append(i)
                if best is not None:
                    own: dict[int, dict[int, int]] = {}
                    for j, (_, h1, h2) in enumerate(names):
                        for i in where.get((h1, h2), ()):
                            own.setdefault(i, {})[j] = asked[i][0]
                    best.offer(Block(x), [[LAST if v is None else v for v in ids] for ids in part["ids"].to_pylist()], own)
        yield from finish()

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` rows nearest to each row for which ``is_query`` holds."""
    spark, folder = vectors.sparkSession, common.shared_dir(vectors.sparkSession)
    x = F.col(f"`{vector_col}`")
    real = vectors.filter(usable(vector_col, 0) & F.coalesce(F.exists(x, lambda e: e != 0), F.lit(False)))
    plain = real.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(is_query & F.col(f"`{id_col}`").isNotNull(), F.lit(False)).alias("asks"), F.transform(x.cast("array<double>"), lambda e: e + 0.0).alias("x"))
    plain = plain.select("id", "asks", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit("second"), "x").alias("h2"))
    # a vector's k + 1 smallest ids; rows of one vector are cut to so many before they meet
    smallest = F.row_number().over(W.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last()))
    distinct = plain.select("id", "x", "h1", "h2").withColumn("r", smallest).filter(F.col("r") <= k + 1).groupBy("h1", "h2")
    held = common.cut_lineage(distinct.agg(F.first("x").alias("x"), F.sort_array(F.collect_list(F.coalesce("id", F.lit(LAST)))).alias("ids")), folder, "distinct")
    asked = common.cut_lineage(plain.filter("asks").groupBy(F.col("id").alias("query"), "h1", "h2").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("times")), folder, "asked")
    n_queries, n_held = asked.count(), held.count()
    columns = max(1, -(-n_queries // queries))
    lines = max(1, -(-n_held // candidates), -(-common.width(spark) // columns))
    block = lambda n: F.pmod(F.col("h2"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select("query", "h1", "h2", "x", F.lit(None).cast("array<long>").alias("ids"), F.lit(0).alias("kind"), F.pmod(F.xxhash64("query", "h1"), F.lit(columns)).cast("int").alias("c"), every(lines).alias("l"))
    c = held.select(F.lit(None).cast("long").alias("query"), "h1", "h2", "x", "ids", F.lit(1).alias("kind"), every(columns).alias("c"), block(lines).alias("l"))
    cells = q.unionByName(c).withColumn("cell", F.col("l") * columns + F.col("c")).withColumn("dims", F.size("x"))
    dealt = cells.select("cell", "dims", "kind", "query", "h1", "h2", "ids", "x").repartition(min(lines * columns, 8 * common.width(spark)), "cell").sortWithinPartitions("cell", "dims", "kind")
    found = dealt.mapInArrow(_cells(k), _FOUND)
    best = F.row_number().over(W.partitionBy("query", "h1", "h2").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    ranked = found.withColumn("rank", best).filter(F.col("rank") <= k)
    often = asked.filter("times > 1").select("query", "h1", "h2", "times")
    ranked = ranked.join(often, ["query", "h1", "h2"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
