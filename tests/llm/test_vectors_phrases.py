"""Clustering, nearest neighbours and collocations against brute force, and their edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import centroid_clustering as clustering
from tidewatch.llm import collocations as phrases
from tidewatch.llm import nearest_neighbours as neighbours

SCHEMA = "vec_id long, embedding array<float>, cluster string, x double, a int"


def vectors(dims: int = 64) -> list[tuple]:
    """Blobs, copies, null and broken vectors, a repeated row, a null id; the other columns have names that the operators use."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, dims))
    rows = [(i, (middle[i % 6] + rng.normal(size=dims) * 0.4).astype(np.float32).tolist()) for i in range(230)]
    rows += [(300 + i, rows[50][1]) for i in range(60)] + [rows[7], rows[7], (None, rows[9][1]), (50, rows[3][1])]
    rows += [(400, None), (401, []), (402, [1.0] * (dims - 1)), (403, [float("nan")] + [0.5] * (dims - 1)), (404, [float("inf")] + [0.5] * (dims - 1)), (405, [None] + [0.5] * (dims - 1)), (450, [0.0] * dims)]
    rows += [(500 + i, [(-1.0) ** i * 3.0, 1.0 * i, 2.0]) for i in range(4)] + [(550, [3.0, 1.0, 2.0])]
    return [(i, v, "clash", 1.5, 9) for i, v in rows]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3)


def real(v, dims):
    return v is not None and (len(v) == dims if dims else len(v) > 0) and all(e is not None and math.isfinite(e) for e in v)


# -- 11 -----------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims=64):
    kept = [(i, [math.floor(64 * e) for e in v]) for i, v, *_ in rows if real(v, dims)]
    order = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)
    at = [v for *_, v in order[:k]]
    assign = lambda: [min((sum((p - q) ** 2 for p, q in zip(v, c)), j) for j, c in enumerate(at)) for _, v in kept]
    for _ in range(rounds):
        found, groups = assign(), defaultdict(list)
        for (_, v), (_, j) in zip(kept, found):
            groups[j].append(v)
        for j, g in groups.items():
            at[j] = [sum(c) // len(g) for c in zip(*g)]
    found = assign()
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, found)), key=repr)


def clusters(df, **how):
    return sorted((tuple(r) for r in clustering.cluster(df, **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (1, 2), (2, 1), (400, 2)])
def test_clusters_equal_brute_force(table, k, rounds):
    assert clusters(table, k=k, rounds=rounds) == plain_clusters(vectors(), k, rounds)


def test_clusters_of_few_and_of_no_rows(spark):
    rows = [(1, [0.5] * 64, "", 0.0, 0), (2, [-0.51] * 64, "", 0.0, 0), (3, [0.5] * 64, "", 0.0, 0)]
    assert clusters(spark.createDataFrame(rows, SCHEMA)) == plain_clusters(rows, 16, 3)
    assert clusters(spark.createDataFrame([], SCHEMA)) == []
    assert clusters(spark.createDataFrame([(1, None, "", 0.0, 0)], SCHEMA)) == []


def test_huge_components_are_held_and_still_assigned(spark):
    rows = [(i, [s * 1e30] + [float(i)] * 63, "", 0.0, 0) for i, s in enumerate([1, -1, 1, -1])]
    found = clustering.cluster(spark.createDataFrame(rows, SCHEMA), k=2, rounds=2).collect()
    assert len(found) == 4 and all(0 <= r["distance"] <= 2**63 - 1 for r in found)
    assert clustering.to_integers(np.array([[1e300, -1e300, 0.5, -0.01]]), 64.0).tolist() == [[1 << 53, -(1 << 53), 32, -1]]


def test_bounds_save_comparisons_and_lose_nothing():
    rng = np.random.default_rng(0)
    middle = rng.integers(-900, 900, (40, 16))
    x = (middle[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 16))).astype(np.int64)
    x[:500] = x[0]
    at, before = x[500 + rng.choice(3500, 40, replace=False)], None
    state = np.zeros(4000, np.int64), np.ones(4000, np.int64), np.full(4000, np.inf), np.zeros(4000)
    for i in range(6):
        c = clustering.Centroids(at, before)
        state = c.assign(x, *state)
        d = ((x[:, None] - at[None]) ** 2).sum(-1)
        assert (state[0] == d.argmin(1)).all()
        rest = np.sqrt(np.where(np.arange(40) == state[0][:, None], 1 << 60, d).min(1))
        assert (state[3] <= rest * (1 + 1e-6)).all() and (state[2] * (1 + 1e-6) >= np.sqrt(d.min(1))).all()
        if i:
            assert c.compared < 0.35 * d.size
        before, at = at, np.array([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else at[j] for j in range(40)])


def test_ties_go_to_the_smaller_centroid():
    at = np.array([[4, 0], [0, 0], [0, 0], [2, 0]])
    c = clustering.Centroids(at)
    x = np.array([[0, 0], [1, 0], [3, 0], [9, 9]])
    for start in range(4):
        a, *_ = c.assign(x, np.full(4, start), np.full(4, (start + 1) % 4), np.full(4, np.inf), np.zeros(4))
        assert a.tolist() == [1, 1, 0, 0]


# -- 12 -----------------------------------------------------------------------------------------------------------------


def plain_neighbours(rows, k):
    kept = [(i, np.array(v, dtype=np.float64)) for i, v, *_ in rows if real(v, 0) and any(v)]
    norm = [math.sqrt(sum(float(e) * float(e) for e in v)) for _, v in kept]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is None or i % 50:
            continue
        near = []
        for b, (j, w) in enumerate(kept):
            if a != b and len(v) == len(w):
                s = 0.0
                for p, q in zip(v.tolist(), w.tolist()):
                    s += p * q
                near.append((-round(s / (norm[a] * norm[b]), 13), j is None, j))
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(sorted(near)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [{}, {"queries": 3, "candidates": 7}])
def test_neighbours_equal_brute_force(table, blocks):
    found = neighbours.search(table, F.col("vec_id") % 50 == 0, k=5, **blocks).collect()
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 13)) for r in found), key=repr) == plain_neighbours(vectors(), 5)


def test_few_or_no_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "", 0.0, 0), (1, [1.0, 1.0], "", 0.0, 0), (50, [2.0], "", 0.0, 0), (7, [0.0, -2.0], "", 0.0, 0)], SCHEMA)
    found = neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 1), (0, 2, 7)] and found[1]["score"] == 0.0
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_extreme_vectors_neither_overflow_nor_vanish(spark):
    rows = [(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [2e200, -1e200]), (3, [-1e-300, -2e-300])]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 2, 3] and [round(r["score"], 12) for r in found] == [1.0, 0.0, -1.0]


def test_error_bounds_hold_and_settle_most_pairs():
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(50, 64))
    x = middle[rng.integers(0, 50, 6000)] + rng.normal(size=(6000, 64)) * 0.3
    q, c = neighbours.Block(x[:40]), neighbours.Block(x[40:])
    true = (q.raw / q.norm[:, None]) @ (c.raw / c.norm[:, None]).T
    near = neighbours.product(q.codes, c.codes) * q.step[:, None] * c.step
    assert (np.abs(true - near) <= q.error[:, None] + q.size[:, None] * c.error + 1e-9).all()
    assert q.codes.dtype == np.int8 and (neighbours.product(q.codes, c.codes) == q.codes.astype(np.int64) @ c.codes.astype(np.int64).T).all()
    best = neighbours.Best(q, 5)
    best.offer(c, [[i] for i in range(len(c))], {})
    assert [sorted(-i for _, i in h) for h in best.heaps] == [sorted(r) for r in np.argsort(-true, axis=1, kind="stable")[:, :5].tolist()]
    assert best.recomputed < 0.05 * true.size


# -- 13 -----------------------------------------------------------------------------------------------------------------

LINES = ["New York City is big", "in new york city, the new york times", "on the other hand; on the one hand", "kick the bucket", "e.g. new york", "x\tnew  york city", "on the other hand"]


def texts() -> list[tuple]:
    rng = np.random.default_rng(9)
    filler = ["the", "of", "and", "Ünï", "x", "!", "\x00b", "ﬁ", "on", "new"]
    rows = []
    for i in range(160):
        parts = [LINES[j] for j in rng.integers(0, len(LINES), 4)] + [" ".join(rng.choice(filler, 9))]
        rows.append(("\n".join(parts) if i % 2 else ". ".join(parts) + "\r", ["en", "fr", None, "und"][i % 4]))
    return rows + [(None, "en"), ("", "de"), (" \t ", "de"), (".,;:!?", None), ("new york " * 4000, "en"), ("new york city\n" * 50, "en"), ("lonely", "xx")]


def plain_collocations(rows, least, top):
    out, counts, n = [], defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, low = lang or "und", (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, f in counts.items():
        long = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in long.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            held = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in long.items())
            if not held:
                rows_.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p, -a, left, right, n[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


@pytest.mark.parametrize("how", [{"least": 3, "top": 40}, {"least": 12, "top": 2000}, {"least": 3, "top": 40, "hot": 20}])
def test_collocations_equal_brute_force(spark, how):
    df = spark.createDataFrame([(t, g, "p", 1, 2) for t, g in texts()], "text string, lang string, phrase string, a int, n int").repartition(5)
    found = sorted(tuple(r) for r in phrases.collocations(df, **how).collect())
    assert found == plain_collocations(texts(), how["least"], how["top"]) and len(found) > 20


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(9 * 10**18, 9 * 10**18, 9 * 10**18), (9 * 10**18 - 1, 9 * 10**18, 9 * 10**18 + 5), (30, 31, 10**18), (7, 7, 7), (123456789012345678, 223456789012345679, 323456789012345671)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", phrases.score_of("a", "l", "r").alias("s"))
    assert all(r["s"] == 2000000 * r["a"] // (r["l"] + r["r"]) for r in df.collect())


def test_quicksort_counts_every_prefix():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 6, (3000, 4))
    keys[:1000] = [1, 2, 3, 4]
    keys[rng.random(3000) < 0.3, 2:] = -1
    keys[rng.random(3000) < 0.3, 3] = -1
    weight = rng.integers(1, 5, 3000)
    for least in (1, 40):
        want = Counter()
        for row, c in zip(keys.tolist(), weight.tolist()):
            for d in range(1, 5):
                if -1 not in row[:d]:
                    want[tuple(row[:d])] += c
        got = {tuple(keys[i, :d].tolist()): int(t) for d, p, ts in phrases.quicksort(keys, weight, least, 2) for i, t in zip(p, ts)}
        assert got == {p: c for p, c in want.items() if len(p) >= 2 and c >= least}
    assert list(phrases.quicksort(np.zeros((0, 4), np.int64), np.zeros(0, np.int64), 1, 1)) == []


def test_long_texts_are_cut_at_pieces_only():
    text = "one two three, four five. " * 900 + "w " * 4000 + ";" + "z" * 3000
    parts = list(phrases.parts(text, 500))
    assert "".join(parts) == text and len(parts) > 20 and all(p[-1] in ".,;:!?\n" for p in parts[:-1])
    assert list(phrases.parts("a b " * 5000, 500)) == ["a b " * 5000]
