"""Removal of repeated word sequences by relative Lempel-Ziv parsing.

The reference is the corpus itself in document order, indexed by anchors (see ``windows``) and cut into blocks, one for
each shuffle partition of the index.  A document is factored against every block that holds one of its anchors: at a
position whose next ``window`` words the block's index knows from earlier in the reference, the factor goes on greedily
for as long as its words are those after the source.  The next factor starts at the first window that the last one does
not hold, so every window at a factor boundary is checked.  Factors of at least ``window`` words, also across anchors,
are the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common, windows

ANCHOR_WORDS = 6


def word_split(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = windows.words(raw)
    values = windows.word_values(raw, starts, ends)
    return values, values


class Block:
    """A block of the reference: the words of its stretches in order, and where each sequence of ``window`` words first starts."""

    def __init__(self, stretches: list[np.ndarray], window: int) -> None:
        self.window = window
        size = np.array([len(s) for s in stretches], dtype=np.int64)
        self.ends = np.cumsum(size)
        self.words = np.concatenate([*stretches, np.zeros(0, dtype=np.uint64)])
        _, rank = np.unique(self.words, return_inverse=True)
        rank, wide = rank.astype(np.int64), 1
        while 2 * wide <= window:  # ranks of twice as many words are pairs of ranks
            rank, wide = self._pairs(rank, wide), 2 * wide
        if wide < window:
            rank = self._pairs(rank, window - wide)
        whole = np.arange(len(rank)) + window <= np.repeat(self.ends, size)[: len(rank)]
        starts = np.flatnonzero(whole)
        self.source = np.arange(len(self.words))
        _, first, kind = np.unique(rank[starts], return_index=True, return_inverse=True)
        self.source[starts] = starts[first[kind]]
        self.known = np.flatnonzero(self.source < np.arange(len(self.words)))

    @staticmethod
    def _pairs(rank: np.ndarray, apart: int) -> np.ndarray:
        n = len(rank) - apart
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.unique(rank[:n] * (int(rank.max()) + 1) + rank[apart:], return_inverse=True)[1].astype(np.int64)

    def _extent(self, a: int, b: int, most: int) -> int:
        """Equal words from ``a`` and ``b`` on, ``most`` at most."""
        n, step = 0, 64
        while n < most:
            k = min(step, most - n)
            other = np.flatnonzero(self.words[a + n : a + n + k] != self.words[b + n : b + n + k])
            if len(other):
                return n + int(other[0])
            n, step = n + k, 4 * step
        return n

    def factors(self) -> list[list[tuple[int, int]]]:
        """Of each stretch its factors (first word, words) against all that stands before."""
        out, at = [], 0
        ends = self.ends.tolist()
        for end in ends:
            found, i = [], int(np.searchsorted(self.known, at))
            here = self.known[i : int(np.searchsorted(self.known, end))].tolist()
            i = 0
            while i < len(here):
                start = here[i]
                source = int(self.source[start])
                limit = ends[int(np.searchsorted(self.ends, source, "right"))]
                n = self._extent(source, start, min(end - start, limit - source))
                found.append((start - at, n))
                after = start + n - self.window + 1  # the first window that this factor does not hold
                i += int(np.searchsorted(here[i:], after))
            out.append(found)
            at = end
        return out


def repeated_spans(docs: DataFrame, window: int, folder: str, id_col: str, text_col: str) -> DataFrame:
    """(key, key2, p, n): windows p to p + n - 1 of that document stand earlier in the corpus too."""
    parts = common.width(docs.sparkSession)
    keyed = windows.keyed(docs, id_col, text_col, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("rank"))
    found = common.cut_lineage(windows.exchange(keyed.select(*windows.KEY, "rank", "text"), word_split, window, min(ANCHOR_WORDS, window), True, parts), folder, "ranges")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, key2, text, spans in zip(batch["key"], batch["key2"], batch["text"], batch["spans"]):
                values = word_split(text)[0]
                rows += [(key, key2, s["rank"], s["p"], s["f"], values[s["p"] : s["p"] + s["n"] + window - 1].tobytes()) for s in spans]
            yield pd.DataFrame(rows, columns=["key", "key2", "rank", "p", "f", "piece"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([b for b in batches] or [pd.DataFrame(columns=["key", "key2", "rank", "p", "f", "piece"])])
        held = held.drop_duplicates(["key", "key2", "rank", "p"]).sort_values(["rank", "key", "key2", "p"], kind="stable")
        block = Block([np.frombuffer(x, dtype=np.uint64) for x in held["piece"]], window)
        rows = [(key, key2, p + s, n - window + 1) for key, key2, p, runs in zip(held["key"], held["key2"], held["p"], block.factors()) for s, n in runs]
        yield pd.DataFrame(rows, columns=["key", "key2", "p", "n"]).astype({"key": "int64", "key2": "int64", "p": "int64", "n": "int32"})

    asked = windows.gathered(found.filter("todo is not null"))
    texts = keyed.select(*windows.KEY, "text").join(asked.hint("shuffle_hash"), windows.KEY)
    stretches = texts.mapInPandas(pieces, "key long, key2 long, rank long, p long, f long, piece binary")
    parsed = common.cut_lineage(stretches.repartition(parts, "f").mapInPandas(parse, windows.SETTLED), folder, "parsed")
    return found.filter("todo is null").select(*windows.KEY, "p", "n").unionByName(parsed)


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256, text`` of every row of ``docs``.

    Words are runs of anything but ASCII white space.  Every word goes that a window of ``window`` words covers whose
    sequence also starts earlier: in a document of a smaller id (an integer; null comes first), or before in the same
    document; nothing is judged on what is left.  ``text`` joins the kept words with single spaces.  A null or
    empty text has no words.  Rows that repeat id and text are one document and get equal values; different texts
    under one id are ordered by a hash.  Other columns are not read.
    """
    folder = folder or common.shared_dir(docs.sparkSession)
    spans = windows.gathered(repeated_spans(docs, window, folder, id_col, text_col))

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string, text string")
    def cut(texts: pd.Series, found_spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, found_spans):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            gone = windows.covered(found, len(words), window)
            kept = b" ".join([w for w, g in zip(words, gone) if not g] if gone.any() else words)
            rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "text"])

    out = windows.keyed(docs, id_col, text_col).join(spans.hint("shuffle_hash"), windows.KEY, "left").withColumn("_cut", cut("text", "spans"))
    return out.select(F.col("id").alias(id_col), "_cut.*")
