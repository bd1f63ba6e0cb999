"""Harmonic packing of tokenized documents into fixed-length training sequences.

A piece of a document of length l belongs to class k when k pieces of that length fit a sequence but k + 1 do not, and a
sequence of class k always takes exactly k pieces.  Classes never wait for each other and neither do workers: every task
packs the documents of its own partition, so the plan is one pass over the scan without any shuffle, and a lost
executor costs its own partitions only.

Documents may be cut, so a rest that fills its class badly gives off a piece as long as the next smaller class holds,
and what remains goes on in the same way.  When a task ends, pieces of sequences that are not complete are laid end to
end and cut anew; the last of these is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sequence of whole pieces of one class may leave so many tokens unused before a piece is cut.
SLACK = 12


class Encoder:
    """Token ids of texts by a ``tokenizers`` file.

    The vocabulary's own merge ranks drive the faster byte-level encoder, which yields the same ids (tests hold the two
    against each other); texts with a special token's string go through ``tokenizers`` itself, and so do those that the
    faster one's pattern gives up on, such as a run of a million spaces.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> None:
        self.path, self.fast, self.slow, self.special = tokenizer_path, None, None, ["<|endoftext|>"]
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError as e:  # its stack for backtracking is full
                if "backtracking" not in str(e):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cuts(n: int, capacity: int, slack: int = SLACK) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of ``n`` tokens."""
    out, start = [], 0
    while n - start >= capacity:
        out.append((start, capacity, 1))
        start += capacity
    while (rest := n - start) > 0:
        k = capacity // rest
        if capacity - k * rest <= slack:
            out.append((start, rest, k))
            break
        piece = capacity // (k + 1)
        out.append((start, piece, k + 1))
        start += piece
    return out


class Packer:
    """Open sequences of one task, one for each class."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id, self.open = capacity, first_id, {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        for start, length, k in cuts(len(ids), self.capacity):
            held = self.open.setdefault(k, [])
            held.append((doc, start, ids[start : start + length], len(ids)))
            if len(held) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total, self.open = sum(len(p[2]) for p in left), {}
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length(), -1, -1) if total % self.capacity >> b & 1]
        at = 0
        for size in sizes:
            held = []
            while size:
                doc, start, ids, n = left[at]
                held.append((doc, start, ids[:size], n))
                size -= len(held[-1][2])
                if len(held[-1][2]) == len(ids):
                    at += 1
                else:
                    left[at] = (doc, start + len(held[-1][2]), ids[len(held[-1][2]) :], n)
            yield from self._close(held)


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    capacity: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of each document: where it starts, its length and checksum, its sequence and offset there.

    A document is its text's ids and then ``end_id``, so a null or empty text is that one id.  Every id lies in exactly
    one piece, and every sequence is gapless from offset 0.  Repeated rows are packed once each.  Other columns are not
    read.  An empty table gives no row.  A very long text is cut into full sequences like any other.  Memory is that of one batch of texts and fewer than 2 * sqrt(capacity) open
    sequences.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(tokenizer_path, ranks_path, pattern)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["id"], batch["text"]):
                ids = np.concatenate([encode(text), end]) if text else end
                rows.extend(packer.add(doc, ids))
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(list(packer.finish()), columns=names)

    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"doc string, {SCHEMA}")
    return out.withColumn("doc", F.col("doc").cast(docs.schema[id_col].dataType)).withColumnRenamed("doc", id_col)
