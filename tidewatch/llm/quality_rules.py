"""Quality rules: exact counts over whole documents, and gradient-boosted trees that judge what passes the base rules.

The trees are fitted on a bounded sample of labelled documents and flattened into numpy node arrays, which score whole
batches.  More symbols, repeated lines or repeated words can only lower a document's score (monotonic constraints).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common, gbt

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punctuation_share", "other_share",
    "line_words", "distinct_share", "pipe_share", "longest_word", "common_share", "sentence_words", "bracket_share",
)
#: Features in which the score may only fall.
FALLING = ("symbol_share", "dup_line_share", "repeat_share")
#: Labelled documents that the trees are fitted on, at most.
TRAIN_ROWS = 8000
#: Share of the good training documents that the trees' threshold keeps.
KEEP_GOOD = 0.995
WINDOW = 5
SYMBOLS = b"#*$%&|<>"


def _byte_classes() -> np.ndarray:
    kind = np.zeros(256, dtype=np.uint8)
    for c in range(256):
        s = chr(c)
        kind[c] = 0 if c >= 128 else 1 if s.isupper() else 2 if s.islower() else 3 if s.isdigit() else 4 if s.isspace() else 5
    return kind


CLASS = _byte_classes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that a window of ``window`` words covers which the sequence holds twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    code = ids[:n].astype(np.int64)
    for k in range(1, window):  # exact: each step ranks the windows one word longer
        pair = code * (int(ids.max()) + 1) + ids[k : k + n]
        _, code = np.unique(pair, return_inverse=True)
    twice = np.bincount(code)[code] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The exact counts and the features of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(raw.count(bytes([c])) for c in SYMBOLS), 0, 0), [0.0] * len(FEATURES)
    data = np.frombuffer(raw, dtype=np.uint8)
    by_byte = np.bincount(data, minlength=256)
    points = len(raw) - int(by_byte[0x80:0xC0].sum())
    chars = points - int(by_byte[9:14].sum() + by_byte[32])
    symbols = int(sum(by_byte[c] for c in SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()] if by_byte[10] else [raw]
    dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    repeat = repeated_words(ids)
    kinds = np.bincount(CLASS, by_byte, minlength=6)
    solid = max(1.0, kinds.sum() - kinds[4])
    top = np.sort(np.bincount(ids))[::-1]
    ends = int(by_byte[46] + by_byte[33] + by_byte[63])
    features = [
        np.log1p(n), chars / n, symbols / solid, dup / len(lines), repeat / n, kinds[1] / solid, kinds[3] / solid, kinds[5] / solid, kinds[0] / solid,
        n / len(lines), len(number) / n, int(by_byte[124]) / n, max(map(len, words)), float(top[:10].sum()) / n, n / (ends + 1), int(by_byte[123] + by_byte[125] + by_byte[91] + by_byte[93]) / n,
    ]
    return (n, chars, symbols, dup, repeat), [float(f) for f in features]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


class Verdict:
    """The fitted trees and the score from which a document stays."""

    def __init__(self, trees: gbt.Trees, threshold: float) -> None:
        self.trees, self.threshold = trees, threshold


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Verdict:
    """Trees fitted on at most ``rows`` labelled documents, those of the smallest hash of the id.

    Documents that the base rules refuse are left out.  Of several labels of one document the largest counts.  Without labels
    of both kinds everything is kept.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
    picked = (
        common.thinned(known, F.col("id").cast("string"), rows)  # so that no task holds or sends more than its share
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64(F.col("id").cast("string")), "id")
        .limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")  # bounded by rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(y, *measure(t)) for y, t in zip(batch["y"], batch["text"])]
            yield pd.DataFrame([(y, f) for y, c, f in found if not base_failed(c[0], c[4])], columns=["y", "f"])

    sample = texts.select("y", "text").mapInPandas(run, "y double, f array<double>").collect()
    y = np.array([r["y"] > 0 for r in sample], dtype=float)
    x = np.array([r["f"] for r in sample]).reshape(len(sample), len(FEATURES))
    if not len(y) or y.min() == y.max():
        return Verdict(gbt.constant(1.0), 0.0)
    trees = gbt.fit(x, y, trees=60, depth=3, rate=0.15, min_leaf=8, monotone={FEATURES.index(f): -1 for f in FALLING})
    good = np.sort(trees.probability(x[y == 1]))
    return Verdict(trees, min(0.5, float(good[int((1 - KEEP_GOOD) * len(good))])))


def judge(docs: DataFrame, verdict: Verdict, text_col: str = "text") -> DataFrame:
    """The counts, ``base_failed``, ``quality_score`` and ``kept`` beside the columns of ``docs``, of which those names are replaced.

    A null or empty text has no words and fails the base rules.  Whole texts are read, however long.  Rows are
    independent, so repeated rows get equal values and an empty table stays empty.
    """
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality_score double, kept boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [measure(t) for t in batch]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(len(found), len(COUNTS))
            out = pd.DataFrame(counts, columns=COUNTS)
            out["base_failed"] = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            out["quality_score"] = verdict.trees.probability(np.array([f for _, f in found]).reshape(len(found), len(FEATURES)))
            out["kept"] = ~out["base_failed"] & (out["quality_score"] >= verdict.threshold)
            yield out

    own = [*COUNTS, "base_failed", "quality_score", "kept"]
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in own]
    found = docs.select(*kept, score(F.col(text_col).cast("string")).alias("__found"))
    return found.select(*kept, *[f"__found.{c}" for c in own])
