"""Progressive JPEG as a media column: lossless storage in coefficients, and decoding to full-resolution RGB.

The decoder reads progressive files (SOF2, 8 bits, Huffman codes, one or three components, any subsampling, restart
intervals): every scan adds its band of the spectrum or its next bit to arrays of coefficients; these are dequantized,
inverse-transformed in numpy, chroma is upsampled, and the result is an RGB tensor.  All entropy-coded segments of a
scan are decoded in step, one symbol of each at a time, so the work is done by whole arrays.

The writer stores 64 numbers from -128 to 127 in the 64 coefficients of a block, in zigzag order, which the format keeps
exactly.  A picture has luma and two chroma components of half its width and height; the payload's blocks fill luma row
by row, then Cb, then Cr.  Each scan sends a band of one component, or the DC of all three: first the upper bits, then
the lowest.  Each block, or each group of blocks in a scan of three components, is its own restart interval.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: position in a block of the k-th coefficient in zigzag order.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
#: Component (-1: all three), first and last coefficient, previous and current lowest bit of the writer's scans.
SCANS = (
    (-1, 0, 0, 0, 1), (0, 1, 20, 0, 1), (0, 21, 63, 0, 1), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1),
    (-1, 0, 0, 1, 0), (0, 1, 20, 1, 0), (0, 21, 63, 1, 0), (1, 1, 63, 1, 0), (2, 1, 63, 1, 0),
)
#: Groups of 4 luma and 2 chroma blocks in a row of a stored picture, and rows of groups that the format allows.
ROW, TALLEST = 32, 4095
#: Segments that are coded at once, and bytes of payload or media that a task handles at once.
STEP, BATCH = 1 << 11, 1 << 18


def _code_table() -> tuple[list[int], list[int]]:
    """Numbers of codes by length and the symbols, for every (run, size) that the writer may use: short codes for run 0."""
    common = [0x05, 0x06, 0x04, 0x03, 0x07, 0x02, 0x01]
    rest = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 9) if (r << 4 | s) not in common]
    counts = [0] * 16
    counts[2], counts[3] = 5, 2  # lengths 3 and 4; what is left of the code space holds the rest in 9 bits
    counts[8] = len(rest)
    return counts, common + rest


AC_COUNTS, AC_SYMBOLS = _code_table()
DC_COUNTS, DC_SYMBOLS = [0, 0, 0, 12] + [0] * 12, list(range(12))


def code_words(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """Code length times 256 plus symbol by the next 16 bits; 0 where no code fits."""
    out = np.zeros(1 << 16, dtype=np.int64)
    for s, (code, length) in code_words(counts, symbols).items():
        low = code << (16 - length)
        out[low : low + (1 << (16 - length))] = length << 8 | s
    return out


_WORDS = code_words(AC_COUNTS, AC_SYMBOLS)
_CODE, _LENGTH = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
for _s, (_w, _k) in _WORDS.items():
    _CODE[_s], _LENGTH[_s] = _w, _k
#: Size category and extra bits of numbers from -256 to 255.
_SIZE = np.array([abs(v).bit_length() for v in range(-256, 256)], dtype=np.int64)
_EXTRA = np.array([v + (1 << abs(v).bit_length()) - 1 if v < 0 else v for v in range(-256, 256)], dtype=np.int64)
_HALF = np.array([0] + [1 << (n - 1) for n in range(1, 16)], dtype=np.int64)
_FULL = np.array([(1 << n) - 1 for n in range(16)], dtype=np.int64)
#: Bits of an AC coefficient of a first pass that follows another one directly, by the byte that it is taken from.
_NEXT = np.array([(-(-v >> 1) if v < 0 else v >> 1) for v in range(-128, 128)], dtype=np.int64)
_NEXT_BITS = _CODE[_SIZE[_NEXT + 256]] << _SIZE[_NEXT + 256] | _EXTRA[_NEXT + 256]
_NEXT_LENGTH = np.where(_NEXT == 0, 0, _LENGTH[_SIZE[_NEXT + 256]] + _SIZE[_NEXT + 256])
_NEXT_BITS[_NEXT == 0] = 0


def _stream(bits: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments one after another, each filled up with ones, with stuffing and a restart marker before it; and where they start and end.

    ``bits`` and ``length`` hold the codes of a segment in a row, at most 32 bits in each; ``place`` is a segment's number in its scan.
    """
    n = len(length)
    pad = -length.sum(axis=1) & 7
    size = length.sum(axis=1) + pad >> 3
    most = int(length.max(initial=7))
    join = 3 if most <= 11 else 2 if most <= 16 else 1  # neighbours that are laid together first: 33 bits at most
    empty = np.zeros((n, -(length.shape[1] + 1) % join), dtype=np.int64)
    length, bits = np.concatenate([length, pad[:, None], empty], axis=1), np.concatenate([bits, _FULL[pad][:, None], empty], axis=1)
    flat, codes = length.reshape(-1, join), bits.reshape(-1, join)
    bits, length = codes[:, 0], flat[:, 0]
    for k in range(1, join):
        bits, length = bits << flat[:, k] | codes[:, k], length + flat[:, k]
    flat, bits = np.ascontiguousarray(length), np.ascontiguousarray(bits).view(np.uint64)
    to = np.cumsum(flat)
    at = to - flat
    total = int(to[-1])
    wide = bits << ((64 - (at & 31) - flat) & 63).view(np.uint64)  # nothing has length 0 but zeros
    word, words = at >> 5, (total >> 5) + 2
    out = np.bincount(word, wide >> np.uint64(32), words)  # bits never meet, so sums are exact
    out[1:] += np.bincount(word, wide & np.uint64(0xFFFFFFFF), words)[:-1]
    plain = out.astype(np.uint64).astype(">u4").view(np.uint8)[: total >> 3]
    ff = plain == 0xFF
    stuffed = np.cumsum(ff)
    begin = np.cumsum(size) - size
    row = np.arange(n)
    where = np.arange(len(plain)) + (stuffed - ff) + 2 * (np.repeat(row, size) + 1)
    grown = np.zeros(len(plain) + int(stuffed[-1]) + 2 * n, dtype=np.uint8)
    grown[where] = plain
    mark = begin + np.where(begin > 0, stuffed[begin - 1], 0) + 2 * row
    grown[mark], grown[mark + 1] = 0xFF, 0xD0 + (place - 1) % 8
    return grown, np.append(mark, len(grown))


def _dc(c: np.ndarray, refine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the DC of groups of six blocks: four of luma, of which each is told by its difference from the last, Cb, Cr."""
    v = c.astype(np.int64) >> (0 if refine else 1)
    if refine:
        return v & 1, np.ones(v.shape, dtype=np.int64)
    v[:, 1:4] -= v[:, :3].copy()
    size = _SIZE[v + 256]
    return size << size | _EXTRA[v + 256], 4 + size  # the code of category s is s in four bits


def _ac_first(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a band of blocks without its lowest bit, and of the end of the block."""
    index = c.astype(np.int64) + 128
    bits, length = _NEXT_BITS[index], _NEXT_LENGTH[index]
    zero = length == 0
    n, wide = c.shape
    end = np.zeros(n, dtype=bool)
    if zero.any():
        k = np.arange(wide)
        last = np.maximum.accumulate(np.where(zero, -1, k), axis=1)
        end = last[:, -1] < wide - 1
        run = k - 1
        run = np.concatenate([np.full((n, 1), 0), run[1:] - last[:, :-1]], axis=1)
        row, col = np.nonzero(~zero & (run > 0))
        value, r = _NEXT[index[row, col]], run[row, col]
        size = _SIZE[value + 256]
        symbol = (r & 15) << 4 | size
        bits[row, col], length[row, col] = _CODE[symbol] << size | _EXTRA[value + 256], _LENGTH[symbol] + size
        far = r > 15
        if far.any():  # 16, 32 or 48 zeros have a code each time, in a column before
            before, size = np.zeros((2, n, wide), dtype=np.int64)
            for more in (16, 32, 48):
                rows, cols = row[r >= more], col[r >= more]
                before[rows, cols] = before[rows, cols] << _LENGTH[0xF0] | _CODE[0xF0]
                size[rows, cols] += _LENGTH[0xF0]
            bits, length = np.stack([before, bits], axis=2).reshape(n, -1), np.stack([size, length], axis=2).reshape(n, -1)
    return np.concatenate([bits, np.where(end, _CODE[0], 0)[:, None]], axis=1), np.concatenate([length, np.where(end, _LENGTH[0], 0)[:, None]], axis=1)


def _refined(row: list[int]) -> tuple[list[int], list[int]]:
    """Codes of the lowest bits of one block's band, as the format has it: bits of known coefficients wait for the next symbol."""
    bits, length, wait, run = [], [], [], 0
    final = max((k for k, v in enumerate(row) if abs(v) == 1), default=-1)

    def put(symbol: int, sign: int | None = None) -> None:
        bits.append(int(_CODE[symbol]) if sign is None else int(_CODE[symbol]) << 1 | sign)
        length.append(int(_LENGTH[symbol]) + (sign is not None))
        bits.extend(wait)
        length.extend([1] * len(wait))
        wait.clear()

    for k, v in enumerate(row):
        if v == 0:
            run += 1
            continue
        while run > 15 and k <= final:
            put(0xF0)
            run -= 16
        if abs(v) > 1:
            wait.append(abs(v) & 1)
        else:
            put(run << 4 | 1, int(v > 0))
            run = 0
    if run or wait:
        put(0)
    return bits, length


def _ac_refine(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the lowest bit of a band of blocks."""
    value = np.abs(c.astype(np.int16)).astype(np.uint8)
    n, wide = c.shape
    low, known = value & 1, value > 1
    if known.all():  # the end of the block, then one bit of each: eight to a code
        packed = np.packbits(low, axis=1).astype(np.int64)
        length = np.full(packed.shape[1], 8)
        if wide % 8:
            packed[:, -1] >>= 8 - wide % 8
            length[-1] = wide % 8
        return np.concatenate([np.full((n, 1), _CODE[0]), packed], axis=1), np.tile(np.concatenate([[_LENGTH[0]], length]), (n, 1))
    bits, length = np.zeros((n, 2 * wide + 8), dtype=np.int64), np.zeros((n, 2 * wide + 8), dtype=np.int64)
    bits[:, 0], length[:, 0] = _CODE[0], _LENGTH[0]
    bits[:, 1 : wide + 1], length[:, 1 : wide + 1] = low * known, known
    for i in np.flatnonzero((value == 1).any(axis=1)):
        b, k = _refined(c[i].tolist())
        bits[i], length[i] = 0, 0
        bits[i, : len(b)], length[i, : len(k)] = b, k
    return bits, length


def _encode(c: np.ndarray, first: int, last: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of segments; rows of blocks that refinement can tell alike are coded together."""
    if first == 0:
        return _dc(c, bool(high))
    return _ac_refine(c) if high else _ac_first(c)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _tables() -> bytes:
    dqt = _segment(0xDB, b"\0" + bytes([1]) * 64)
    dc = _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]))
    return dqt + dc + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS]))


def _shape(blocks: int) -> tuple[int, int]:
    """Rows and columns of groups of six blocks."""
    groups = -(-blocks // 6)
    rows = min(TALLEST, -(-groups // ROW))
    return rows, -(-groups // rows)


def _groups(rows: int, cols: int) -> np.ndarray:
    """The blocks of each group of a picture, four of luma and two of chroma, by their place in the payload's order."""
    y = np.arange(4 * rows * cols).reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    rest = np.arange(rows * cols)
    return np.concatenate([y, 4 * len(rest) + rest[:, None], 5 * len(rest) + rest[:, None]], axis=1)


def write(payloads: list[bytes]) -> list[bytes]:
    """Progressive files of payloads whose lengths are multiples of 64 and not 0; equal payloads give equal files."""
    shapes = [_shape(len(p) // 64) for p in payloads]
    count = np.array([r * c for r, c in shapes])
    blocks = np.frombuffer(b"".join(x for p, n in zip(payloads, count.tolist()) for x in (p, bytes(384 * n - len(p)))), dtype=np.int8).reshape(-1, 64)
    base = 6 * (np.cumsum(count) - count)
    out = []
    for p, (rows, cols) in zip(payloads, shapes):
        size = (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big")
        frame = _segment(0xC2, bytes([8]) + size + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append([_HEAD, frame, b"\xff\xdd\0\4\0\1", _segment(0xFE, (len(p) // 64).to_bytes(8, "big"))])
    for of, first, last, high, low in SCANS:
        body = bytes([3, 1, 0, 2, 0, 3, 0]) if of < 0 else bytes([1, of + 1, 0])
        head = _segment(0xDA, body + bytes([first, last, high << 4 | low]))
        # the segments of all files, in turn
        segments = count * (4 if of == 0 else 1)
        ends = np.cumsum(segments)
        place = np.arange(ends[-1]) - np.repeat(ends - segments, segments)
        if of < 0:
            where = np.concatenate([_groups(*s) + b for s, b in zip(shapes, base.tolist())])
            values = blocks[:, 0][where]
        else:
            offset = base + (0, 4, 5)[of] * count
            values = blocks[np.repeat(offset, segments) + place, first : last + 1]
        parts, marks, at = [], [], 0
        for i in range(0, len(values), STEP):
            data, mark = _stream(*_encode(values[i : i + STEP], first, last, high), place[i : i + STEP])
            parts.append(data.tobytes())
            marks.append(mark[:-1] + at)
            at += len(data)
        stream, mark = b"".join(parts), np.append(np.concatenate(marks), at)
        for o, a, b in zip(out, mark[ends - segments].tolist(), mark[ends].tolist()):
            o += (head, stream[a + 2 : b])
    return [b"".join(x) + b"\xff\xd9" for x in out]


_HEAD = b"\xff\xd8" + _tables()


class Reader:
    """Entropy-coded segments laid end to end, without stuffing, each with a bit position of its own."""

    def __init__(self, raw: np.ndarray) -> None:
        self.raw = np.concatenate([raw, np.full(16, 0xFF, dtype=np.uint8)])
        self.wide = np.zeros(len(self.raw), dtype=np.uint64)  # the 40 bits from each byte on
        for k in range(5):
            self.wide[: len(self.raw) - k] |= self.raw[k:].astype(np.uint64) << np.uint64(32 - 8 * k)
        self.near = (self.wide >> np.uint64(16)).astype(np.int64)  # the next 24
        self.at = np.zeros(0, dtype=np.int64)

    def seek(self, starts: np.ndarray) -> None:
        self.at = starts * 8

    def take(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n bits, at most 16, of each row."""
        at = self.at[rows]
        v = self.wide[at >> 3] >> (40 - (at & 7) - n).astype(np.uint64) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))
        self.at[rows] += n
        return v.astype(np.int64)

    def symbol(self, rows: np.ndarray, table: np.ndarray, mask: int = 15) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each row, and the extra bits whose number stands in its low bits."""
        at = self.at[rows]
        word, used = self.wide[at >> 3], at & 7
        found = table[(word >> (24 - used).astype(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)]
        if not found.all():
            raise ValueError("a code that no table has")
        size = found & mask
        total = (found >> 8) + size
        extra = (word >> (40 - used - total).astype(np.uint64)).astype(np.int64) & _FULL[size]
        self.at[rows] = at + total
        return found & 255, extra


def _extend(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < _HALF[size], v - _FULL[size], v)


def _dc_scan(reader: Reader, units: list[np.ndarray], coefficients: np.ndarray, table, high: int, low: int, kinds: list[np.ndarray]) -> None:
    """``units[u]`` and ``kinds[u]``: block and component of the u-th data unit of each segment, -1 where it has none."""
    guess = np.zeros((len(reader.at), 4), dtype=np.int64)
    for block, kind in zip(units, kinds):
        rows = np.flatnonzero(block >= 0)
        if high:
            coefficients[block[rows], 0] |= reader.take(rows, np.ones(len(rows), dtype=np.int64)) << low
            continue
        for c in np.unique(kind[rows]):
            of = rows[kind[rows] == c]
            size, extra = reader.symbol(of, table[int(c)])
            guess[of, c] += _extend(extra, size)
        coefficients[block[rows], 0] = guess[rows, kind[rows]] << low


def direct(table: np.ndarray) -> np.ndarray:
    """Value, run and total length of a coefficient by the next 16 bits, where its code and extra bits fit in them; else 0."""
    bits = np.arange(1 << 16)
    length, run, size = table >> 8, table >> 4 & 15, table & 15
    total = length + size
    fits = (table > 0) & (total <= 16) & ((size > 0) | (run == 15))
    value = _extend(bits >> np.where(fits, 16 - total, 0) & _FULL[size], size)
    return np.where(fits, value << 16 | run << 8 | total, 0)


def _ac_first_scan(reader: Reader, rows: np.ndarray, block: np.ndarray, c: np.ndarray, table, quick: np.ndarray, bands: np.ndarray, first: int, last: int, low: int) -> None:
    """A band of one block of each of ``rows``, but for its lowest bits."""
    flat, at, k = c.reshape(-1), reader.at[rows], np.full(len(rows), first)
    base = block[rows] * 64
    while len(rows):
        found = quick[reader.near[at >> 3] >> (8 - (at & 7)) & 0xFFFF]
        if not found.all():  # an end of the block, or a code that is long
            slow = np.flatnonzero(found == 0)
            reader.at[rows[slow]] = at[slow]
            s, extra = reader.symbol(rows[slow], table)
            run, size = s >> 4, s & 15
            end = (size == 0) & (run < 15)
            gone = slow[end]
            if len(gone):
                bands[rows[gone]] = (np.int64(1) << run[end]) - 1 + reader.take(rows[gone], run[end])
            at[slow] = reader.at[rows[slow]]
            found[slow] = _extend(extra, size) << 16 | run << 8
            if len(gone):
                use = np.ones(len(rows), dtype=bool)
                use[gone] = False
                rows, at, k, base, found = rows[use], at[use], k[use], base[use], found[use]
        k += found >> 8 & 255
        if len(k) and k.max() > last:
            raise ValueError("a run beyond the end of a band")
        flat[base + k] = found >> 16 << low
        at += found & 255
        k += 1
        live = k <= last
        if not live.all():
            done = ~live
            reader.at[rows[done]] = at[done]
            rows, at, k, base = rows[live], at[live], k[live], base[live]


def _ac_scan(reader: Reader, units: list[np.ndarray], c: np.ndarray, table, quick: np.ndarray, first: int, last: int, high: int, low: int) -> None:
    bands = np.zeros(len(reader.at), dtype=np.int64)  # blocks still to come without a symbol
    one = np.int64(1) << low
    for block in units:
        live = np.flatnonzero(block >= 0)
        k = np.full(len(block), first)
        idle = bands[live] > 0
        if idle.any():
            rows = live[idle]
            bands[rows] -= 1
            if high:
                _refine_rest(reader, rows, block, c, k, last, one)
        todo = live[~idle]
        if not high:
            _ac_first_scan(reader, todo, block, c, table, quick, bands, first, last, low)
            continue
        while len(todo):
            s, extra = reader.symbol(todo, table)
            run, size = s >> 4, s & 15
            end = (size == 0) & (run < 15)
            if end.any():
                rows = todo[end]
                bands[rows] = (np.int64(1) << run[end]) - 1 + reader.take(rows, run[end])
                _refine_rest(reader, rows, block, c, k, last, one)
                todo, run, size, extra = todo[~end], run[~end], size[~end], extra[~end]
            if not len(todo):
                break
            got = size > 0
            rows = todo[got]
            value = np.zeros(len(block), dtype=np.int64)
            value[rows] = np.where(extra[got] > 0, one, -one)
            skip = np.zeros(len(block), dtype=np.int64)
            skip[todo] = run
            _refine_run(reader, todo, block, c, k, last, skip, one)
            rows = rows[k[rows] <= last]
            c[block[rows], k[rows]] = value[rows]
            k[todo] += 1
            todo = todo[k[todo] <= last]


def _refine_rest(reader: Reader, rows: np.ndarray, block: np.ndarray, c: np.ndarray, k: np.ndarray, last: int, one: np.int64) -> None:
    """One more bit of every known coefficient from ``k`` to the end of the band; their bits follow each other."""
    first = int(k[rows].min())
    v = c[block[rows], first : last + 1]
    known = (v != 0) & (np.arange(first, last + 1) >= k[rows][:, None])
    at = reader.at[rows][:, None] + np.cumsum(known, axis=1) - known
    bit = reader.raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
    grow = known & (bit > 0) & (np.abs(v) & one == 0)
    c[block[rows], first : last + 1] = np.where(grow, v + np.sign(v) * one, v)
    reader.at[rows] += known.sum(axis=1)


def _refine_run(reader: Reader, rows: np.ndarray, block: np.ndarray, c: np.ndarray, k: np.ndarray, last: int, skip: np.ndarray, one: np.int64) -> None:
    """Pass ``skip`` zeros from ``k`` on and read one more bit of every coefficient on the way; ends at the next zero."""
    while len(rows := rows[k[rows] <= last]):
        at = c[block[rows], k[rows]]
        known = at != 0
        stop = ~known & (skip[rows] == 0)
        skip[rows[~known]] -= 1
        more = rows[known]
        if len(more):
            v = at[known]
            grow = (reader.take(more, np.ones(len(more), dtype=np.int64)) > 0) & (np.abs(v) & one == 0)
            c[block[more], k[more]] = np.where(grow, v + np.sign(v) * one, v)
        rows = rows[~stop]
        k[rows] += 1


class Frame:
    """Header fields and coefficient arrays of one file."""

    def __init__(self) -> None:
        self.height = self.width = self.restart = self.blocks = self.base = 0
        self.components: list[dict] = []
        self.quant: dict[int, np.ndarray] = {}
        self.comment = b""


class _Files:
    """The bytes of many files, end to end, where the bytes FF stand in them, and the same without stuffing and restart markers."""

    def __init__(self, files: list[bytes]) -> None:
        self.raw = np.frombuffer(b"".join(files), dtype=np.uint8)
        ff = np.flatnonzero(self.raw[:-1] == 0xFF)
        after = self.raw[ff + 1]
        restart, stuffed = (after >= 0xD0) & (after <= 0xD7), after == 0
        self.stops = ff[~restart & ~stuffed]
        use = np.ones(len(self.raw), dtype=bool)
        use[ff[restart | stuffed] + 1] = False
        use[ff[restart]] = False
        self.plain = self.raw[use]
        self.left_out = ff[restart | stuffed]
        self.gone = np.concatenate([[0], np.cumsum(np.where(restart, 2, 1)[restart | stuffed])])
        self.restarts = ff[restart]
        self.starts = self.place(self.restarts + 2)

    def place(self, at: np.ndarray) -> np.ndarray:
        """Where a byte of ``raw`` stands in ``plain``."""
        return at - self.gone[np.searchsorted(self.left_out, at)]


_orders: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
_codes: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _kept(memory: dict, key: tuple, make):
    """What ``make`` gives, from a small memory that starts anew when full."""
    if key not in memory:
        if len(memory) >= 500:
            memory.clear()
        memory[key] = make()
    return memory[key]


def read(files: list[bytes]) -> tuple[list[Frame], np.ndarray]:
    """Frames of progressive files and the blocks of all of them; scans that files have alike are decoded together."""
    whole, frames, plans, begin = _Files(files), [], [], 0
    stops = whole.stops.tolist()
    stop = 0
    for data in files:
        frame, huff, scans, at = Frame(), {}, [], 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker in (0xD9, 0xFF):
                at += 1
                if marker == 0xD9:
                    break
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    frame.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], dtype=">u2" if wide == 2 else np.uint8).astype(np.float64)
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff = {**huff, body[0]: body[1 : 17 + n]}
                    body = body[17 + n :]
            elif marker == 0xC2:
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.components = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
                h, v = max(c["h"] for c in frame.components), max(c["v"] for c in frame.components)
                frame.mcus = (-(-frame.height // (8 * v)), -(-frame.width // (8 * h)))
                at_block = 0
                for c in frame.components:
                    c["rows"], c["cols"] = -(-(-(-frame.height * c["v"] // v)) // 8), -(-(-(-frame.width * c["h"] // h)) // 8)
                    c["shape"] = (frame.mcus[0] * c["v"], frame.mcus[1] * c["h"])
                    c["base"] = at_block
                    at_block += c["shape"][0] * c["shape"][1]
                frame.blocks = at_block
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive Huffman file")
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                frame.comment = body
            elif marker == 0xDA:
                n = body[0]
                of = tuple(next(j for j, c in enumerate(frame.components) if c["id"] == body[1 + 2 * i]) for i in range(n))
                band = (body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15)
                tables = tuple(huff.get(body[2 + 2 * i] >> 4 if band[0] == 0 else 0x10 | body[2 + 2 * i] & 15) for i in range(n))
                while stop < len(stops) and stops[stop] < begin + at:
                    stop += 1
                end = stops[stop] if stop < len(stops) else len(whole.raw)
                scans.append((band, of, tables, begin + at, end, frame.restart))
                at = end - begin
        frames.append(frame)
        plans.append(scans)
        begin += len(data)
    total = 0
    for f in frames:
        f.base = total
        total += f.blocks
    coefficients = np.zeros((total, 64), dtype=np.int32)
    bounds = np.array([(s[3], s[4]) for scans in plans for s in scans], dtype=np.int64).reshape(-1, 2)
    heads, cuts = whole.place(bounds[:, 0]), np.searchsorted(whole.restarts, bounds).tolist()
    number = np.cumsum([0, *map(len, plans)]).tolist()
    reader = Reader(whole.plain)
    for step in range(max(map(len, plans), default=0)):
        alike: dict[tuple, list[int]] = {}
        for i, scans in enumerate(plans):
            if step < len(scans):
                band, of, tables = scans[step][:3]
                alike.setdefault((band, tables, of if band[0] == 0 else ()), []).append(i)
        for (band, tables, of), members in alike.items():
            starts, units, kinds = [], [], []
            for i in members:
                restart, scan = plans[i][step][5], number[i] + step
                order, kind = _block_order(frames[i], plans[i][step][1], restart)
                count, (a, b) = len(order), cuts[scan]
                if b - a + 1 < count:
                    raise ValueError("a scan ends too early")
                starts += (heads[scan : scan + 1], whole.starts[a : a + count - 1])
                units.append(np.where(order >= 0, order + frames[i].base, -1) if restart != 1 else order + frames[i].base)
                kinds.append(kind)
            most = max(u.shape[1] for u in units)
            pad = lambda x, fill: np.concatenate([np.pad(u, ((0, 0), (0, most - u.shape[1])), constant_values=fill) if u.shape[1] < most else u for u in x]).T
            all_units, first = pad(units, -1), np.concatenate(starts)
            if band[0] == 0:
                all_kinds = pad(kinds, 0)
                codes = {c: _kept(_codes, (t,), lambda t=t: (lookup(list(t[:16]), list(t[16:])), None))[0] for c, t in zip(of, tables) if t}
            else:
                t = tables[0]
                codes, quick = _kept(_codes, (t, "AC"), lambda t=t: (x := lookup(list(t[:16]), list(t[16:])), direct(x)))
            for a in range(0, len(first), STEP):
                by_unit = list(all_units[:, a : a + STEP])
                reader.seek(first[a : a + STEP])
                if band[0] == 0:
                    _dc_scan(reader, by_unit, coefficients, codes, band[2], band[3], list(all_kinds[:, a : a + STEP]))
                else:
                    _ac_scan(reader, by_unit, coefficients, codes, quick, *band)
    return frames, coefficients


def _block_order(frame: Frame, of: tuple[int, ...], restart: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and components of each segment's units, -1 beyond the end: by MCU where a scan has several components, else by the component's own rows."""

    def make() -> tuple[np.ndarray, np.ndarray]:
        parts, kinds = [], []
        for i in of:
            c = frame.components[i]
            if len(of) == 1:
                at = (c["base"] + np.arange(c["rows"])[:, None] * c["shape"][1] + np.arange(c["cols"])).reshape(-1, 1)
            else:
                at = c["base"] + np.arange(c["shape"][0] * c["shape"][1]).reshape(frame.mcus[0], c["v"], frame.mcus[1], c["h"])
                at = at.transpose(0, 2, 1, 3).reshape(-1, c["v"] * c["h"])
            parts.append(at)
            kinds.append(np.full(at.shape, i))
        order, kind = np.concatenate(parts, axis=1), np.concatenate(kinds, axis=1)
        per = (restart or len(order)) * order.shape[1]
        spare = -order.size % per
        return np.pad(order.reshape(-1), (0, spare), constant_values=-1).reshape(-1, per), np.pad(kind.reshape(-1), (0, spare)).reshape(-1, per)

    return _kept(_orders, (frame.height, frame.width, restart, of, *((c["h"], c["v"]) for c in frame.components)), make)


def _basis() -> np.ndarray:
    """64 x 64: what a coefficient in zigzag order adds to each pixel, in units of 2 ** -14, so that sums are exact in any order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.rint(np.kron(one, one)[ZIGZAG] * (1 << 14))


BASIS = _basis()


def _pixels(coefficients: np.ndarray) -> np.ndarray:
    """Inverse transform of dequantized blocks: 64 pixels of each, from 0 to 255."""
    out = np.empty(coefficients.shape, dtype=np.int16)
    for i in range(0, len(out), STEP):
        x = (coefficients[i : i + STEP].astype(np.float64) @ BASIS).astype(np.int64)
        x += (1 << 13) + (128 << 14)
        x >>= 14
        np.minimum(np.maximum(x, 0, out=x), 255, out=out[i : i + STEP], casting="unsafe")
    return out


def rgb(frames: list[Frame], coefficients: np.ndarray) -> Iterator[np.ndarray]:
    """The height x width x 3 tensors of decoded files, in turn."""
    if any((q != 1).any() for f in frames for q in f.quant.values()):
        coefficients = coefficients.copy()
        for f in frames:
            for c in f.components:
                at = f.base + c["base"]
                coefficients[at : at + c["shape"][0] * c["shape"][1]] *= f.quant[c["q"]].astype(np.int32)
    pixels = _pixels(coefficients)
    for frame in frames:
        h, v = max(c["h"] for c in frame.components), max(c["v"] for c in frame.components)
        planes = []
        for c in frame.components:
            (rows, cols), at = c["shape"], frame.base + c["base"]
            planes.append(pixels[at : at + rows * cols].reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols))
        out = np.empty((8 * v * frame.mcus[0], 8 * h * frame.mcus[1], 3), dtype=np.uint8)
        if len(planes) == 1:
            out[:] = planes[0][..., None]
        else:  # the usual factors, in units of 2 ** -16; what chroma adds is computed before it is upsampled
            grow = [(v // c["v"], h // c["h"]) for c in frame.components]
            if len(set(grow[1:])) > 1 or grow[0] != (1, 1):
                planes = [p.repeat(a, axis=0).repeat(b, axis=1) for p, (a, b) in zip(planes, grow)]
                grow = [(1, 1)] * 3
            a, b = grow[1]
            cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
            y = planes[0].reshape(len(cb), a, -1, b)
            wide, half = out.reshape(len(cb), a, -1, b, 3), 1 << 15
            for k, more in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
                x = y + (more + half >> 16).astype(np.int16)[:, None, :, None]
                np.minimum(np.maximum(x, 0, out=x), 255, out=wide[..., k], casting="unsafe")
        yield out[: frame.height, : frame.width]


def payload(frame: Frame, coefficients: np.ndarray) -> bytes:
    """The bytes that ``write`` stored."""
    n = int.from_bytes(frame.comment, "big")
    return coefficients[frame.base : frame.base + n].astype(np.int8).tobytes()


def _batched(items: list, size) -> Iterator[list[int]]:
    """Places of items by groups of about ``BATCH`` bytes."""
    group, held = [], 0
    for i, x in enumerate(items):
        group.append(i)
        held += size(x)
        if held >= BATCH:
            yield group
            group, held = [], 0
    if group:
        yield group


def _filled(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or 64 * (not data))


#: What a stored picture is told with.
STORED = "media binary, height int, width int, rgb binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def _told(files: list[bytes]) -> list[tuple]:
    """Height, width, RGB bytes, and what payload and picture are, all read from the files."""
    out = []
    frames, coefficients = read(files)
    for frame, tensor in zip(frames, rgb(frames, coefficients)):
        data = payload(frame, coefficients)
        feature = f"{tensor.shape[0]}x{tensor.shape[1]} mean {tensor.mean():.3f} std {tensor.std():.3f}"
        out.append((tensor.shape[0], tensor.shape[1], tensor.tobytes(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), feature))
    return out


def store(df: DataFrame, bytes_col: str, into: str = "stored") -> DataFrame:
    """``df`` with a struct of ``STORED`` in ``into``: the bytes of ``bytes_col`` (a string counts as UTF-8) as a progressive JPEG file, and what that file holds.

    Zero bytes fill the payload up to a positive multiple of 64, so a null or empty value is one empty block.  The file is
    decoded again: ``rgb`` are the rows of its full-resolution tensor, ``payload_bytes``, ``payload_sha256`` and
    ``tail_crc32`` (last 64 bytes) are those of the payload read back, ``feature`` is the picture's size, mean and standard deviation.
    Equal values give equal structs, whatever rows stand beside them; an empty table stays empty; a column that has the name of
    ``into`` is replaced.  Long values are coded in steps of bounded size; a value's file and picture are held whole.
    """

    @F.pandas_udf(STORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [b"" if x is None else bytes(x) for x in batch]
            for group in _batched(raw, len):
                files = write([_filled(raw[i]) for i in group])
                yield pd.DataFrame([(f, *t) for f, t in zip(files, _told(files))], columns=[c.split()[0] for c in STORED.split(", ")])

    return df.withColumn(into, run(F.coalesce(F.col(f"`{bytes_col}`").cast("binary"), F.lit(b""))))


def tensors(df: DataFrame, media_col: str = "media", into: str = "tensor") -> DataFrame:
    """``df`` with the decoded picture of any progressive file: height, width and the RGB bytes in row order.

    Null for a null file or one that is no such JPEG; a column that has the name of ``into`` is replaced.
    """

    @F.pandas_udf("height int, width int, rgb binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch:
                try:
                    t = None if data is None else next(rgb(*read([bytes(data)])))
                except (ValueError, IndexError, StopIteration, KeyError, TypeError, AttributeError):
                    t = None
                out.append((None, None, None) if t is None else (t.shape[0], t.shape[1], t.tobytes()))
            yield pd.DataFrame(out, columns=["height", "width", "rgb"]).astype({"height": "Int32", "width": "Int32"})

    return df.withColumn(into, run(F.col(f"`{media_col}`")))
