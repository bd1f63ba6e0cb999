"""Encoding and decoding with the pieces of a SentencePiece model by streaming Viterbi search.

The best segmentation is the one with the largest sum of piece scores.  The search reads texts from left to right in
blocks.  All pieces that match in a block are found first, and every boundary gets its best score and a backpointer.  A
piece still to come can start at one of the last boundaries only, as many as the longest piece has characters; what the
backpointers of all of these have in common is final: its ids are committed, and only what follows is carried into the
next block.  A boundary that no match goes across is one on which all paths converge; between two such ones the search
takes one character of every open stretch at a time, over whole arrays, and a stretch without one for longer than
``DENSE`` characters goes through ``Stream``, which walks its backpointers as it goes.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters of a block, and of a stretch between convergence points that whole arrays search.
BLOCK, DENSE = 1 << 15, 64
#: Letters whose pairs have a table of their own.
FREQUENT = 256
#: Below the worst piece by so much scores a character that has no piece; it is written as bytes.
UNKNOWN = 10.0


class Vocabulary:
    """Pieces, scores and ids of a model file."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=model_path)
        self.size = m.get_piece_size()
        self.pieces: dict[str, tuple[float, int]] = {}
        self.byte_ids, self.bytes_of = [m.unk_id()] * 256, [b""] * self.size
        for i in range(self.size):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not m.is_control(i) and not m.is_unknown(i) and not m.is_unused(i):
                self.pieces[piece] = (m.get_score(i), i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.pieces), default=1)
        worst = min((s for s, _ in self.pieces.values() if s > -1e8), default=0.0)
        self.unknown = worst - UNKNOWN
        for p, (s, i) in self.pieces.items():
            if s <= -1e8:  # no learned score, as runs of spaces have it: just below all that have one
                self.pieces[p] = (worst - 1, i)
        self._arrays()

    def _arrays(self) -> None:
        """The trie of all pieces as arrays: classes of code points, a hash table of edges, and the piece that ends at a node."""
        letters = [c for c, _ in Counter(c for p in self.pieces for c in p).most_common()]
        self.classes = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.classes[ord(" ")] = self.classes[ord(SPACE)]
        self.width = len(letters) + 1
        edges: dict[int, int] = {}
        ends: dict[int, tuple[float, int]] = {}
        number = {c: i for i, c in enumerate(letters, 1)}
        for p, hit in self.pieces.items():
            node = 0
            for c in p:
                node = edges.setdefault(node * self.width + number[c], len(edges) + 1)
            ends[node] = hit
        self.score = np.full(len(edges) + 1, -np.inf, dtype=np.float32)
        self.piece = np.full(len(edges) + 1, -1, dtype=np.int32)
        for node, (score, i) in ends.items():
            self.score[node], self.piece[node] = score, i
        self.bits = max(8, (4 * len(edges)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.target = np.zeros(1 << self.bits, dtype=np.int32)
        key, to = np.array(list(edges), dtype=np.int64), np.array(list(edges.values()), dtype=np.int32)
        self.first = np.zeros(self.width, dtype=np.int64)  # nodes after one letter, and after two of the most frequent ones
        self.pair = np.zeros((FREQUENT, FREQUENT), dtype=np.int64)
        letter_of = {node: k for k, node in edges.items() if k < self.width}
        self.first[list(letter_of.values())] = list(letter_of)
        for k, node in edges.items():
            a, b = divmod(k, self.width)
            if b < FREQUENT and (c := letter_of.get(a, FREQUENT)) < FREQUENT:
                self.pair[c, b] = node
        at = self._slot(key)
        while len(key):
            free = self.slots[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slots[at[won]], self.target[at[won]] = key[won], to[won]
            left = np.ones(len(key), dtype=bool)
            left[won] = False
            key, to, at = key[left], to[left], at[left] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def follow(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that a letter leads to; 0 for none."""
        key = node * self.width + letter
        at = self._slot(key)
        found = self.slots[at]
        out = np.where(found == key, self.target[at], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            found = self.slots[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.target[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Stream:
    """Viterbi search over characters that come one by one; ``committed`` grows as paths converge.

    Convergence is looked for whenever the window has grown by the longest piece, and after each failure only when it has
    doubled, so the search takes time in proportion to the text even where no two paths ever meet.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.committed: list[tuple[int, int]] = []  # start and id of each piece; id -1: bytes
        self.done = 0  # characters before the last committed boundary
        self.recent = ""  # the last characters, as many as the longest piece has
        self.best = [0.0]  # of every boundary since the last committed one
        self.back: list[tuple[int, int]] = [(-1, -1)]  # start of the last piece and its id; id -1: bytes
        self.widest = 0  # positions that the stream ever held
        self.next = 2 * vocabulary.longest

    def push(self, char: str) -> None:
        v, best = self.v, self.best
        n = len(best)
        self.recent = recent = (self.recent + char)[-min(v.longest, n) :]
        top, how = best[n - 1] + v.unknown, (n - 1, -1)
        for i in range(len(recent)):
            hit = v.pieces.get(recent[i:])
            start = n - len(recent) + i
            if hit is not None and (score := best[start] + hit[0]) > top:  # of equal sums the longest last piece
                top, how = score, (start, hit[1])
        best.append(top)
        self.back.append(how)
        self.widest = max(self.widest, n)
        if n >= self.next:
            self.converge()

    def converge(self, lowest: int | None = None) -> None:
        """Commit what all paths have in common; a piece still to come starts at boundary ``lowest`` of the text or later, at one of the last by itself."""
        n = len(self.best) - 1
        first = n - self.v.longest + 1 if lowest is None else lowest - self.done
        at = converged(range(max(0, first), n + 1), lambda i: self.back[i][0])
        if at > 0:
            self._commit(at)
        left = len(self.best) - 1
        self.next = max(left + self.v.longest, 2 * self.v.longest) if at > 0 else 2 * n

    def _commit(self, at: int) -> None:
        found: list[tuple[int, int]] = []
        end = at
        while end > 0:
            start, piece = self.back[end]
            found.append((self.done + start, piece))
            end = start
        self.committed.extend(reversed(found))
        self.done += at
        base = self.best[at]
        self.best = [b - base for b in self.best[at:]]
        self.back = [(s - at, p) for s, p in self.back[at:]]
        self.recent = self.recent[-(len(self.best) - 1) :] if len(self.best) > 1 else ""

    def finish(self) -> list[tuple[int, int]]:
        if len(self.best) > 1:
            self._commit(len(self.best) - 1)
        return self.committed


def converged(boundaries, before) -> int:
    """The last boundary that the best paths to all of ``boundaries`` have in common; ``before`` gives the one before on a path."""
    paths = [-b for b in set(boundaries)]
    heapq.heapify(paths)
    while len(paths) > 1:
        last = before(-heapq.heappop(paths))
        if -last not in paths:
            heapq.heappush(paths, -last)
    return -paths[0]


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary

    def _search(self, letters: np.ndarray, text: np.ndarray, last: bool) -> tuple[np.ndarray, int]:
        """Piece ids by the place where each starts (-1: bytes, -2: none starts here) and the boundary up to which they are final.

        ``letters`` are the classes of ``text``; class -1 stands between texts.  Unless it is the ``last`` block, a piece could
        start at any of the last ``longest`` boundaries and go on beyond the end; final is what the best paths to all of these
        have in common, also where matches of other paths go across.
        """
        v, n, w = self.v, len(text), self.v.longest
        padded = np.concatenate([letters, np.full(w, -1, dtype=letters.dtype)]).astype(np.int64)
        at = np.flatnonzero(letters > 0)
        node = np.zeros(len(at), dtype=np.int64)
        reach, single = np.arange(1, n + 1), np.zeros(n, dtype=bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # starts of the matches of each length, and their nodes
        for depth in range(w):
            letter = padded[at + depth]
            if depth == 0:
                node = v.first[letter]
            elif depth == 1:
                before = padded[at]
                often = (before < FREQUENT) & (letter < FREQUENT)
                near = v.pair[np.where(often, before, 0), np.where(often, letter, 0)]
                rare = np.flatnonzero(~often)
                near[rare] = v.follow(node[rare], letter[rare])
                node = near
            else:
                node = v.follow(node, letter)
            use = (node > 0) & (letter > 0)
            at, node = at[use], node[use]
            if not len(at):
                break
            ends = v.piece[node] >= 0
            found.append((at[ends], node[ends]))
            reach[at[ends]] = at[ends] + depth + 1
            if depth == 0:
                single[at[ends]] = True
        far = np.maximum.accumulate(reach) if n else reach
        meet = np.concatenate([[0], np.flatnonzero(far == np.arange(1, n + 1)) + 1])  # boundaries that no match goes across
        start, end = meet[:-1], meet[1:]
        size, out = end - start, np.full(n, -2, dtype=np.int32)
        # matches by the number of characters before their end in the stretch, the longest first, so that it wins equal sums
        alone = np.flatnonzero(~single)
        begin = np.concatenate([*[s for s, _ in found], alone])
        node = np.concatenate([*[x for _, x in found], np.zeros(len(alone), dtype=np.int64)])
        length = np.repeat(np.array([*range(1, len(found) + 1), 1]), [*[len(s) for s, _ in found], len(alone)])
        stretch = np.repeat(np.arange(len(size)), size)
        if len(stretch) < n or size.max(initial=0) > DENSE:
            whole = np.zeros(n, dtype=bool)
            whole[: len(stretch)] = size[stretch] <= DENSE
            use = whole[begin]
            begin, node, length = begin[use], node[use], length[use]
        of = stretch[begin]
        step = (begin - start[of] + length).astype(np.uint16)
        key = step * np.uint16(w) + (w - length).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        key, node, length = key[order], node[order], length[order]
        low = begin[order] + of[order]  # a slot for each boundary inside a stretch and for both its ends
        high = low + length
        score = np.where(node > 0, v.score[node], v.unknown)
        best, choice = np.full(n + len(size) + 1, -np.inf), np.zeros(n + len(size) + 1, dtype=np.int64)
        slot = start + np.arange(len(size))
        best[slot] = 0.0
        cuts = np.flatnonzero(np.diff(key)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            ends = high[i:j]
            total = best[low[i:j]] + score[i:j]
            better = np.flatnonzero(total > best[ends])
            ends = ends[better]
            best[ends], choice[ends] = total[better], better + i
        done, stops = n, end.copy()
        if not last and n:
            # no match of the block goes across a boundary of ``meet``: all paths to later ones lead through this stretch's end
            open_ = int(np.searchsorted(end, max(0, n - w), "right"))
            lowest = max(int(start[open_]), n - w + 1)
            if size[open_] <= DENSE:
                done = converged(range(lowest, int(end[open_]) + 1), lambda i: int(low[choice[i + open_]]) - open_ if i > start[open_] else i)
                stops[open_] = done
            else:
                dense, more = self._streamed(text[start[open_] : end[open_]], lowest - int(start[open_]))
                done = int(start[open_]) + more
                out[start[open_] : done] = dense
                stops[open_] = start[open_]
            stops[open_ + 1 :] = start[open_ + 1 :]
        short = np.flatnonzero((size <= DENSE) & (stops > start))
        first, slot = slot[short], stops[short] + short
        piece = np.where(node > 0, v.piece[node], -1)
        while len(slot):
            m = choice[slot]
            slot = low[m]
            out[slot - short] = piece[m]
            use = slot > first
            slot, first, short = slot[use], first[use], short[use]
        for i in np.flatnonzero((size > DENSE) & (stops > start)):
            out[start[i] : end[i]] = self._streamed(text[start[i] : end[i]], enough=len(text))[0]
        return out, done

    def _ids(self, out: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Ids in order, characters without a piece as those of their bytes."""
        found = out[out > -2]
        plain = found >= 0
        if plain.all():
            return found
        where = np.flatnonzero(out == -1)
        raw = [np.array([self.v.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")], dtype=np.int32) for c in text[where].tolist()]
        spread = np.ones(len(found), dtype=np.int64)
        spread[~plain] = [len(r) for r in raw]
        ids = np.repeat(found, spread)
        ids[np.repeat(~plain, spread)] = np.concatenate(raw)
        return ids

    def _lone(self, codes: np.ndarray) -> np.ndarray:
        """A text beyond a block: each block starts at the boundary up to which the one before is final."""
        parts, at = [], 0
        while at < len(codes):
            block = codes[at : at + BLOCK]
            out, done = self._search(self.v.classes[block], block, at + len(block) == len(codes))
            if not done:  # no convergence in a whole block
                out, done = self._streamed(codes[at:])
            parts.append(self._ids(out[:done], codes[at : at + done]))
            at += done
        return np.concatenate(parts)

    def _streamed(self, codes: np.ndarray, lowest: int | None = None, enough: int = BLOCK // 2) -> tuple[np.ndarray, int]:
        """As ``_search``, one character at a time, up to the first convergence after ``enough`` characters or to the end.

        ``lowest``: the text goes on, with pieces that start at this boundary or later.
        """
        stream = Stream(self.v)
        for i in range(0, len(codes), BLOCK):
            for c in codes[i : i + BLOCK].tolist():
                stream.push(SPACE if c == 32 else chr(c))
            if stream.done > enough and i + BLOCK < len(codes):
                break
        else:
            if lowest is None:
                stream.finish()
            else:
                stream.converge(lowest)
        out = np.full(stream.done, -2, dtype=np.int32)
        for start, piece in stream.committed:
            out[start] = piece
        return out, stream.done

    def many(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Ids of texts in turn; short ones share a block."""
        held: list[np.ndarray] = []
        waiting: list[int | None] = []  # None: a null text, else its place among the held ones
        chars = 0

        def flush() -> Iterator[np.ndarray | None]:
            found: list[np.ndarray] = []
            if held:
                text = np.concatenate([x for h in held for x in (h, _GAP)])
                letters = self.v.classes[text]
                ends = np.cumsum([len(h) + 1 for h in held]) - 1
                letters[ends] = -1
                out, _ = self._search(letters, text, True)
                out[ends] = -2
                ids = self._ids(out, text)
                count = (out > -2).astype(np.int64)
                if (out == -1).any():
                    where = np.flatnonzero(out == -1)
                    count[where] = [len(chr(c).encode("utf-8", "surrogatepass")) for c in text[where].tolist()]
                found = np.split(ids, np.cumsum(np.add.reduceat(count, np.concatenate([[0], ends[:-1] + 1])))[:-1])
            for i in waiting:
                yield None if i is None else found[i]
            held.clear()
            waiting.clear()

        for t in texts:
            if t is None or not t:
                waiting.append(None if t is None else len(held))
                if t is not None:
                    held.append(np.zeros(0, dtype=np.uint32))
                continue
            codes = np.frombuffer((" " + t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            if len(codes) > BLOCK:
                yield from flush()
                chars = 0
                yield self._lone(codes)
                continue
            if chars + len(codes) > BLOCK:
                yield from flush()
                chars = 0
            waiting.append(len(held))
            held.append(codes)
            chars += len(codes) + 1
        yield from flush()

    def __call__(self, text: str | None) -> list[int] | None:
        found = next(self.many([text]))
        return None if found is None else found.tolist()


_GAP = np.zeros(1, dtype=np.uint32)


def joined(ids: list[int], table: list[bytes]) -> str:
    raw = b"".join([table[i] for i in ids if 0 <= i < len(table)])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts in ``ids_col``: the segmentation with the largest sum of scores.

    A space stands before the first character, as the model's own encoder has it, and of equal sums the one with the
    longer last piece is taken.  Characters without a piece become the ids of their bytes.  A null text has null ids and
    an empty one none.  Whole texts are encoded, however long, in blocks; rows are independent of each other, so repeated
    rows get equal ids, and an empty table stays empty.  A column that has the name of ``ids_col`` is replaced.
    """

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(Vocabulary(model_path))
        for batch in batches:
            yield pd.Series(list(encoder.many(list(batch))), dtype=object)

    return docs.withColumn(ids_col, run(F.col(f"`{text_col}`").cast("string")))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col``: pieces and bytes joined, without the space that ``encode`` puts in front.

    Null ids give null; ids outside the vocabulary and control ids give nothing; bytes that are no UTF-8 give the
    replacement character.  A column that has the name of ``text_col`` is replaced.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = Vocabulary(model_path).bytes_of
        for batch in batches:
            yield pd.Series([None if ids is None else joined(ids.tolist(), table) for ids in batch], dtype=object)

    return df.withColumn(text_col, run(F.col(f"`{ids_col}`")))


def digest(docs: DataFrame, model_path: str, text_col: str = "text", into: str = "digest") -> DataFrame:
    """``docs`` with a struct of each text's number of ids, their CRC-32 (little-endian, four bytes each), and the SHA-256 of
    what they decode to and whether that is the text; all null for a null text, and no id for an empty one.  Ids and decoded
    texts stay in the task.  An empty table stays empty; a column that has the name of ``into`` is replaced.
    """

    @F.pandas_udf("n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(model_path)
        encoder = Encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for text, ids in zip(batch, encoder.many(list(batch))):
                if ids is None:
                    rows.append((None, None, None, None))
                    continue
                back = joined(ids.tolist(), vocabulary.bytes_of)
                sha = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), sha, back == text))
            yield pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "decoded_sha256", "round_trip"]).astype({"n_ids": "Int64", "ids_crc32": "Int64", "round_trip": "boolean"})

    return docs.withColumn(into, run(F.col(f"`{text_col}`").cast("string")))
