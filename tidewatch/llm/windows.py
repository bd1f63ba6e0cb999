"""Repeated windows of a sequence, found through few content-chosen anchors instead of every position.

Of the k-grams in a window the one with the smallest hash is its anchor, so equal windows have equal anchors at equal
places, and consecutive windows share one: a sequence falls into *ranges* of windows with a common anchor, about one
range for every half window.  Where a sequence repeats itself within a window, as in a run of one letter, the anchor may
move on without changing, and such windows are still one range, which has to be compared with itself.  Windows can only be equal if their anchors are, and copies of a whole range, known by a
cryptographic digest of 128 bits, are equal in every window.  So anchors are shuffled, not windows, and the operators
compare only ranges whose anchor repeats while their content does not.  Fingerprints of anchors only route; two
different anchors with one fingerprint cost a comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(0xFFFFFFFF00000000)
#: Windows that are handled at once; longer documents go in such parts.
PART = 1 << 19
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i below n or more."""
    if len(_tables.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    if "bytes" not in _tables:
        _tables["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    return _tables["bytes"]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``grams`` and ``spans`` read polynomial fingerprints."""
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all k-grams."""
    n = len(h) - k
    return mix((h[k:] - h[:n]) * _tables["down"][:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def tuples(values: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all k consecutive values: each is mixed with its place, so that no arrangement of values collides by construction."""
    m = max(0, len(values) - k + 1)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        out += mix(values[j : j + m] + np.uint64((2 * j + 1) * _BASE % (1 << 64)))
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size :][: len(x) - width + 1]) if size < width else out


def is_space() -> np.ndarray:
    if "space" not in _tables:
        t = np.zeros(256, dtype=bool)
        t[[9, 10, 11, 12, 13, 32]] = True
        _tables["space"] = t
    return _tables["space"]


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in bytes of UTF-8."""
    edge = np.flatnonzero(np.diff(~is_space()[raw], prepend=False, append=False))
    return edge[::2], edge[1::2]


#: Bytes of a word that the table tells apart by their place; longer words have a digest.
_PLACES = 64


def word_values(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of every word: random numbers for each byte at each place, added up and mixed."""
    if "places" not in _tables:
        _tables["places"] = np.random.default_rng(20240301).integers(0, 1 << 64, (_PLACES, 256), dtype=np.uint64).reshape(-1)
    out, step = np.empty(len(starts), dtype=np.uint64), 1 << 15
    for i in range(0, len(starts), step):  # bounded memory for very long texts
        s, e = starts[i : i + step], ends[i : i + step]
        size, base = e - s, int(s[0])
        word = np.zeros(int(e[-1]) - base + 1, dtype=np.int64)
        word[s - base] = np.diff(s - base, prepend=0)
        place = np.minimum(np.arange(len(word) - 1) - np.cumsum(word)[:-1], _PLACES - 1)
        part = raw[base : e[-1]]
        total = np.zeros(len(word), dtype=np.uint64)
        np.cumsum(_tables["places"][place * 256 + part], out=total[1:])
        out[i : i + step] = mix(total[e - base] - total[s - base] + size.astype(np.uint64))
        for k in np.flatnonzero(size > _PLACES):
            out[i + k] = int.from_bytes(hashlib.blake2b(raw[s[k] : e[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def ranges(values: np.ndarray, content: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """First window, number of windows, anchor, whether it moves, and content digest of each range; ``content`` are the elements themselves."""
    found, digests = [], []
    raw, size = memoryview(np.ascontiguousarray(content)).cast("B"), content.itemsize
    for at in range(0, max(0, len(values) - window + 1), PART):
        part = values[at : at + PART + window - 1]
        h, m = prefix(part), len(part) - window + 1
        kh = grams(h, k)
        order = (kh & _HIGH) | np.arange(len(kh), dtype=np.uint64)
        anchor = (sliding_min(order, window - k + 1) & _LOW).astype(np.int64)
        gram = kh[anchor]
        cut = np.flatnonzero(gram[1:] != gram[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [m]])
        found.append((first + at, last - first, gram[first], anchor[first] != anchor[last - 1]))
        digests += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(((first + at) * size).tolist(), ((last + at + window - 1) * size).tolist())]
    if not found:
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, zero.astype(np.uint64), zero.astype(bool), b""
    return *(np.concatenate(x) for x in zip(*found)), b"".join(digests)


#: A range on its way: anchor, content, row key, rank of the document, first window, windows, copies (2: two or more), whether the anchor moves.
RANGE = np.dtype([("f", "<u8"), ("r1", "<u8"), ("r2", "<u8"), ("key", "<i8"), ("key2", "<i8"), ("rank", "<i8"), ("p", "<i8"), ("n", "<i4"), ("c", "<i2"), ("moves", "<i2")])
KEY = ["key", "key2"]
SETTLED = "key long, key2 long, p long, n int"


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """True where a run of equal rows begins in sorted columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def settle(r: np.ndarray, keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ranges; which are the first of their anchor and content; which are known to repeat in every window.

    ``keep_first``: the first in document order doesn't count as a repetition; else all of two or more do.
    """
    r = r[np.lexsort((r["p"], r["key2"], r["key"], r["rank"], r["r2"], r["r1"], r["f"]))]
    first = starts_of(r["f"], r["r1"], r["r2"])
    group = np.cumsum(first) - 1
    copies = np.bincount(group, r["c"]).astype(np.int64) if len(r) else np.zeros(0, dtype=np.int64)
    if keep_first:
        head = r[first][group] if len(r) else r
        return r, first, (r["p"] != head["p"]) | (r["key"] != head["key"]) | (r["key2"] != head["key2"]) | (r["rank"] != head["rank"])
    return r, first, copies[group] >= 2


def exchange(docs: DataFrame, split, window: int, k: int, keep_first: bool, parts: int) -> DataFrame:
    """Ranges that repeat as a whole (``todo`` null) and those to compare window by window.

    ``docs`` has ``key``, ``key2``, ``rank`` and ``text``; ``split`` makes a text's elements and their values.  Each task first
    settles what it can among its own ranges, so of a passage in a third of all documents one range a batch is shuffled.
    ``todo``: 1 if it has to be answered, 0 if others need it only; one range stands for all of the same content.
    """
    buckets = 4 * parts

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[np.ndarray] = []
            for key, key2, rank, text in zip(batch["key"], batch["key2"], batch["rank"], batch["text"]):
                content, values = split(text or "")
                p, n, f, moves, digest = ranges(values, content, window, k)
                one = np.empty(len(p), dtype=RANGE)
                both = np.frombuffer(digest, dtype="<u8").reshape(-1, 2)
                one["f"], one["r1"], one["r2"], one["key"], one["key2"], one["rank"], one["p"], one["n"], one["c"], one["moves"] = f, both[:, 0], both[:, 1], key, key2, rank, p, n, 1, moves
                held.append(one)
            if not held:
                continue
            r, first, known = settle(np.concatenate(held), keep_first)
            sent = r[first].copy()
            sent["c"] = np.where(known[first], 2, 1)
            bucket = (sent["f"] >> np.uint64(33)).astype(np.int64) % buckets
            by = np.argsort(bucket, kind="stable")
            b, at = np.unique(bucket[by], return_index=True)
            rows = [(int(x), part.tobytes()) for x, part in zip(b, np.split(sent[by], at[1:]))]
            done = r[known & ~first]
            if len(done):
                rows.append((int(done["key"][0]) % buckets, b"=" + done.tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "data"])

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(x: np.ndarray, todo) -> pd.DataFrame:
            return pd.DataFrame({"key": x["key"], "key2": x["key2"], "rank": x["rank"], "p": x["p"], "n": x["n"], "f": x["f"].view(np.int64), "todo": pd.array(todo, dtype="Int32")})

        held: list[np.ndarray] = []
        for batch in batches:
            for data in batch["data"]:
                if data[:1] == b"=" and len(data) % RANGE.itemsize == 1:
                    done = np.frombuffer(data, dtype=RANGE, offset=1)
                    yield out(done, [None] * len(done))
                else:
                    held.append(np.frombuffer(data, dtype=RANGE))
        if not held:
            return
        r, first, known = settle(np.concatenate(held), keep_first)
        yield out(r[known], [None] * int(known.sum()))
        reps = r[first]
        kinds = np.bincount(np.cumsum(starts_of(reps["f"])) - 1)[np.cumsum(starts_of(reps["f"])) - 1]
        open_ = (kinds > 1) | ((reps["moves"] > 0) & ~known[first])
        yield out(reps[open_], np.where(known[first][open_], 0, 1))

    return docs.mapInPandas(local, "bucket int, data binary").repartition(parts, "bucket").mapInPandas(settled, "key long, key2 long, rank long, p long, n int, f long, todo int")


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    from tidewatch.llm import common

    key, key2 = common.row_keys(id_col, text_col)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), key.alias("key"), key2.alias("key2"), *more)


def gathered(spans_df: DataFrame) -> DataFrame:
    """One row for each document: its ranges in one array, which the document's own length bounds."""
    return spans_df.groupBy(*KEY).agg(F.collect_list(F.struct("p", "n", *[c for c in ("f", "todo", "rank") if c in spans_df.columns])).alias("spans"))


def covered(spans_list, length: int, window: int) -> np.ndarray:
    """True for every element that one of the windows covers."""
    edge = np.zeros(length + 1, dtype=np.int64)
    if spans_list is not None:
        for s in spans_list:
            edge[s["p"]] += 1
            edge[s["p"] + s["n"] - 1 + window] -= 1
    return np.cumsum(edge[:-1]) > 0
