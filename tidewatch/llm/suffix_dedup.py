"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Anchors (see ``windows``) say which stretches of text can repeat at all.  Those stretches are dealt out by anchor, and
every task keeps a family of suffix arrays over what it has seen: each new batch of stretches gets its own suffix array,
sorted letter by letter, is merge-scanned against all levels for matches of full length, and joins the family as its
smallest level; levels of equal size merge, so a task with n suffixes has at most log2(n) arrays.  Suffixes are compared
by their bytes, so matches are exact; the order needs no more than their first ``length`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common, windows

ANCHOR_BYTES = 32
#: Bytes of a batch of the family.
BATCH = 1 << 20


def byte_split(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return raw, windows.byte_values()[raw]


def _ranked(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks, from 1 on, and the number of kinds."""
    kinds, rank = np.unique(x, return_inverse=True)
    return rank + 1, len(kinds)


class Level:
    """A suffix array: one suffix of each kind in order, whether that kind repeats, and which kind each suffix is of."""

    def __init__(self, text: np.ndarray, order: np.ndarray, marked: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> None:
        self.text, self.order, self.marked, self.ids, self.kind = text, order, marked, ids, kind

    def words(self) -> np.ndarray:
        """The eight bytes from each place on as one number, without a copy."""
        return np.ndarray((len(self.text) - 7,), dtype=">u8", buffer=self.text.data, strides=(1,))

    @classmethod
    def sort(cls, text: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int) -> Level:
        """Prefix doubling: ranks of 2 h bytes are pairs of ranks of h bytes."""
        level = cls(text, starts, np.zeros(0, dtype=bool), ids, np.zeros(0, dtype=np.int64))
        size = 1
        while size * 2 <= min(8, length):
            size *= 2
        if size == 8:
            rank, kinds = _ranked(level.words().astype(np.uint64))
        else:
            rank, kinds = text.astype(np.int64) + 1, 256
            for h in (1, 2)[: size.bit_length() - 1]:
                rank, kinds = _ranked(rank * (kinds + 1) + np.concatenate([rank[h:], np.zeros(h, dtype=np.int64)]))
        while 2 * size <= length:
            rank, kinds = _ranked(rank * (kinds + 1) + np.concatenate([rank[size:], np.zeros(min(size, len(rank)), dtype=np.int64)]))
            size *= 2
        last = rank[starts] * (kinds + 1) + rank[starts + length - size]  # both ends of the first ``length`` bytes
        _, first, level.kind, count = np.unique(last, return_index=True, return_inverse=True, return_counts=True)
        level.order, level.marked = starts[first], count > 1
        return level

    def find(self, other: Level, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each kind of ``other`` the place of the first one here that isn't smaller, and whether the two are equal."""
        mine, theirs, n = self.words(), other.words(), len(self.order)
        steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])] if length >= 8 else []

        def compare(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """-1, 0 or 1: how suffixes here compare with those of ``other``."""
            out, live = np.zeros(len(at), dtype=np.int8), np.arange(len(at))
            a, b = self.order[at], other.order[rows]
            if not steps:
                for d in range(length):
                    x, y = self.text[a[live] + d].astype(np.int16), other.text[b[live] + d].astype(np.int16)
                    out[live] = np.sign(x - y)
                    live = live[x == y]
                return out
            for d in steps:
                x, y = mine[a[live] + d].astype(np.uint64), theirs[b[live] + d].astype(np.uint64)
                same = x == y
                out[live[~same]] = np.where(x[~same] < y[~same], -1, 1)
                live = live[same]
                if not len(live):
                    break
            return out

        rows = np.arange(len(other.order))
        if steps:
            heads, wanted = mine[self.order].astype(np.uint64), theirs[other.order].astype(np.uint64)
            low, high = np.searchsorted(heads, wanted, "left"), np.searchsorted(heads, wanted, "right")
        else:
            low, high = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), n)
        live = rows[low < high]
        while len(live):
            middle = (low[live] + high[live]) >> 1
            smaller = compare(middle, live) < 0
            low[live[smaller]] = middle[smaller] + 1
            high[live[~smaller]] = middle[~smaller]
            live = live[low[live] < high[live]]
        equal = low < n
        inside = rows[equal]
        equal[inside] = compare(low[inside], inside) == 0
        return low, equal

    def merge(self, other: Level, length: int) -> Level:
        """One array of both: kinds that both have become one."""
        low, equal = self.find(other, length)
        fresh = np.flatnonzero(~equal)
        shift = np.cumsum(np.bincount(low[fresh], minlength=len(self.order) + 1))
        here = np.arange(len(self.order)) + shift[:-1]  # new ones that aren't greater stand before
        there = np.empty(len(low), dtype=np.int64)
        there[fresh] = low[fresh] + np.arange(len(fresh))
        there[equal] = here[low[equal]]
        order, marked = np.empty(len(here) + len(fresh), dtype=np.int64), np.zeros(len(here) + len(fresh), dtype=bool)
        order[there], order[here] = other.order + len(self.text), self.order
        marked[here] = self.marked
        marked[there] |= other.marked
        marked[there[equal]] = True
        return Level(np.concatenate([self.text, other.text]), order, marked, np.concatenate([self.ids, other.ids]), np.concatenate([here[self.kind], there[other.kind]]))


class Family:
    """Suffix arrays whose sizes differ by a factor of two or more."""

    def __init__(self, length: int) -> None:
        self.length, self.levels, self.count = length, [], 0

    def add(self, pieces: list[bytes]) -> None:
        """Take in a batch of stretches; their suffixes of ``length`` bytes or more are numbered on."""
        text = np.frombuffer(b"".join([*pieces, bytes(8)]), dtype=np.uint8)
        many = np.array([max(0, len(p) - self.length + 1) for p in pieces], dtype=np.int64)
        if not many.sum():
            return
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        starts = np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(many.sum())
        new = Level.sort(text, starts, self.count + np.arange(len(starts)), self.length)
        self.count += len(starts)
        for level in self.levels:  # merge scan
            place, equal = level.find(new, self.length)
            level.marked[place[equal]] = True
            new.marked[equal] = True
        self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1].order) > len(self.levels[-2].order):
            small, large = self.levels.pop(), self.levels.pop()
            self.levels.append(large.merge(small, self.length))

    def marks(self) -> np.ndarray:
        """For each suffix whether its first ``length`` bytes start another one too."""
        out = np.zeros(self.count, dtype=bool)
        for level in self.levels:
            out[level.ids] = level.marked[level.kind]
        return out


def repeated_spans(docs: DataFrame, length: int, folder: str, id_col: str, text_col: str) -> DataFrame:
    """(key, key2, p, n): windows p to p + n - 1 of that document start with a string that starts elsewhere too."""
    spark, parts = docs.sparkSession, common.width(docs.sparkSession)
    keyed = windows.keyed(docs, id_col, text_col)
    base = keyed.select(*windows.KEY, F.lit(0).cast("long").alias("rank"), "text")
    found = common.cut_lineage(windows.exchange(base, byte_split, length, min(ANCHOR_BYTES, length), False, parts), folder, "ranges")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, key2, text, spans in zip(batch["key"], batch["key2"], batch["text"], batch["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(key, key2, s["p"], s["f"], s["todo"], raw[s["p"] : s["p"] + s["n"] - 1 + length]) for s in spans]
            yield pd.DataFrame(rows, columns=["key", "key2", "p", "f", "todo", "piece"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, asked = Family(length), []
        waiting: list[bytes] = []
        size = at = 0
        for batch in batches:
            for key, key2, p, todo, piece in zip(batch["key"], batch["key2"], batch["p"], batch["todo"], batch["piece"]):
                n = len(piece) - length + 1
                if todo:
                    asked.append((key, key2, p, at, n))
                waiting.append(piece)
                at, size = at + n, size + len(piece)
                if size >= BATCH:
                    family.add(waiting)
                    waiting, size = [], 0
        family.add(waiting)
        rows, marks = [], family.marks()
        for key, key2, p, at, n in asked:
            edge = np.flatnonzero(np.diff(marks[at : at + n], prepend=False, append=False))
            rows += [(key, key2, p + s, e - s) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())]
        yield pd.DataFrame(rows, columns=["key", "key2", "p", "n"]).astype({"key": "int64", "key2": "int64", "p": "int64", "n": "int32"})

    asked = windows.gathered(found.filter("todo is not null"))
    texts = keyed.select(*windows.KEY, "text").join(asked.hint("shuffle_hash"), windows.KEY)
    stretches = texts.mapInPandas(pieces, "key long, key2 long, p long, f long, todo int, piece binary")
    compared = common.cut_lineage(stretches.repartition(parts, "f").mapInPandas(compare, windows.SETTLED), folder, "compared")
    return found.filter("todo is null").select(*windows.KEY, "p", "n").unionByName(compared)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, text`` of every row of ``docs``, and the columns that ``keep`` names.

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else, in this document or
    another; nothing is judged on what is left.  ``text`` is what is left, without the rest of a character that removal
    cuts; ``kept_sha256`` is that of the bytes themselves.  A null text counts as empty, and null is left.  Rows with
    equal texts are copies of each other, also where their ids are equal or null.  Whole texts are read, however long; an
    empty table gives an empty one.  Other columns are not read; those of ``keep`` may have any name but the ones above.
    """
    folder = folder or common.shared_dir(docs.sparkSession)
    spans = windows.gathered(repeated_spans(docs, length, folder, id_col, text_col))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    def cut(texts: pd.Series, found_spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, found_spans):
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
            gone = windows.covered(found, len(raw), length)
            kept = raw[~gone].tobytes()
            runs = int(np.diff(gone.astype(np.int8), prepend=np.int8(0)).clip(0).sum())
            rows.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), None if text is None else kept.decode("utf-8", "ignore")))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    more = [F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep or [])]
    out = windows.keyed(docs, id_col, text_col, *more).join(spans.hint("shuffle_hash"), windows.KEY, "left")
    out = out.withColumn("_cut", cut("text", "spans"))
    return out.select(F.col("id").alias(id_col), "_cut.*", *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep or [])])
