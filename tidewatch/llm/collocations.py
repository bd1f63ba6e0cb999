"""Phrases that collocate: exact counts of word sequences by three-way quicksort of suffix pointers.

Every place in a text is a pointer to the words that follow it, ``DEPTH`` at most.  Pointers are partitioned by the word
at one depth into less, equal and greater; the equal part goes on at the next depth, the others at the same one.  The
size of an equal part is the count of the phrase that its pointers share, and a part below the least count is
abandoned, as no phrase in it can reach that.  All parts of a level are partitioned at once by whole arrays.

Pointers are routed by their two leading words, so that all of a phrase meet.  Two passes before say which pointers can
matter: words, then pairs of such words, are counted over the whole corpus, and a pointer ends before the first pair
that is rarer than the least count.  Those counts reach the tasks as bitmaps of a fixed size: a clash of hashes lets a
pointer through that is abandoned later, never the other way round.  Equal pointers of a batch travel once, with their
number.  A pair with ``HOT`` places or more is routed by all words of its pointers; phrases that begin with it are then
counted in parts, which are added up at the end.

Cases.  A null or empty text has no words; a null ``lang`` is ``und``.  Repeated rows count each.  Ties of the score go
by count, then by the phrase's bytes.  Words are compared by their bytes, whatever they hold; very long texts are split
between batches at pieces only.  An empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.windows import mix

DEPTH = 4
#: Places from which on a leading pair is routed by all words; about, as counts of 32 bits of a hash and 16 of a batch say it.
HOT = 1 << 16
#: Bits of a filter: 16 MB whatever the corpus holds, in pieces of 4 KB.
BITS, PIECE = 27, 15
#: Bytes of text that are tokenized at once.
BATCH = 1 << 22

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens:
    """Words of some texts: ``ids`` into ``names``, the piece of each word, and its language as an index of ``langs``."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = _LOWER[np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, dtype=np.uint8)
        ends_of_texts = offsets[1:] - offsets[0]
        gap = _GAP[raw]
        edge = np.flatnonzero(np.diff(~gap, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        # a word never spans two texts: the places where one ends are cut
        cut = ends_of_texts[:-1][(ends_of_texts[:-1] > 0) & (ends_of_texts[:-1] < len(raw))]
        cut = np.unique(cut)
        cut = cut[~gap[cut] & ~gap[cut - 1]] if len(cut) else cut
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        text = np.searchsorted(ends_of_texts, starts, side="right")
        breaks = np.searchsorted(np.flatnonzero(_BREAK[raw]), starts)
        self.piece = np.cumsum(np.concatenate([[True], (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])])) if len(starts) else starts
        keep = raw[~gap]
        word_offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(word_offsets), pa.py_buffer(keep)).dictionary_encode()
        self.ids, self.names = words.indices.to_numpy().astype(np.int64), words.dictionary
        coded = langs.fill_null("und").dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy()[text].astype(np.int64)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return hashed(self.names), hashed(self.langs)


def hashed(names: pa.Array) -> np.ndarray:
    return mix(pd.util.hash_array(np.asarray(names.to_pylist(), dtype=object), categorize=False)) if len(names) else np.zeros(0, dtype=np.uint64)


def named(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Hash of a word in a language."""
    return mix(word ^ mix(lang + np.uint64(7)))


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two words that stand beside each other."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    """Texts by about ``BATCH`` bytes; longer ones by pieces."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for at in range(0, len(batch), 256):  # few texts at a time as Python objects
            some = batch.slice(at, 256)
            for text, lang in zip(some["text"].to_pylist(), some["lang"].to_pylist()):
                for part in parts(text or ""):
                    texts.append(part)
                    langs.append(lang)
                    size += len(part)
                    if size >= BATCH:
                        yield Tokens(pa.array(texts, pa.string()), pa.array(langs, pa.string()))
                        texts, langs, size = [], [], 0
    if texts:
        yield Tokens(pa.array(texts, pa.string()), pa.array(langs, pa.string()))


def parts(text: str, size: int = BATCH) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end where a piece does."""
    while len(text) > 2 * size:
        cut = min((i for i in (text.find(c, size) for c in ".,;:!?\n\x0b\x0c\r") if i >= 0), default=len(text) - 1) + 1
        yield text[:cut]
        text = text[cut:]
    if text:
        yield text


# -- bitmaps of frequent hashes ---------------------------------------------------------------------------------------

_HASHES = "bucket int, data binary"
#: Of a hash, the 32 bits after those of the bucket, and its count in a batch: a count beyond 16 bits says no more than a full one.
_HASH = np.dtype([("h", "<u4"), ("c", "<u2")])
_TOP = 64 - BITS + PIECE


def dealt(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Hashes with their counts, by the piece of the bitmap that they fall into."""
    one, at = np.unique(h >> np.uint64(_TOP - 32), return_inverse=True)
    rows = np.empty(len(one), dtype=_HASH)
    rows["h"], rows["c"] = one & np.uint64(0xFFFFFFFF), np.minimum(np.bincount(at, c, len(one)), 0xFFFF)
    bucket = (one >> np.uint64(32)).astype(np.int32)
    b, cuts = np.unique(bucket, return_index=True)
    if len(b):
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array([x.tobytes() for x in np.split(rows, cuts[1:])], pa.binary())], names=["bucket", "data"])


def _bits(levels: list[int]):
    """Buckets come sorted; of each, the bits of the hashes that reach each level."""

    def bits(held: list[bytes]) -> list[bytes]:
        rows = np.frombuffer(b"".join(held), dtype=_HASH)
        one, at = np.unique(rows["h"], return_inverse=True)
        counts, out = np.bincount(at, rows["c"], len(one)), []
        for least in levels:
            place = one[counts >= least] >> np.uint32(32 - PIECE)
            flags = np.zeros(1 << PIECE, dtype=bool)
            flags[place] = True
            out.append(np.packbits(flags).tobytes() if len(place) else b"")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        done: list[tuple] = []
        for batch in batches:
            for b, data in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist()):
                if b != key and held:
                    done.append((key, bits(held)))
                    held = []
                key = b
                held.append(data)
        if held:
            done.append((key, bits(held)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int32()), pa.array([x for _, x in done], pa.list_(pa.binary()))], names=["bucket", "bits"])

    return run


class Filter:
    """A bitmap of ``2 ** BITS`` bits for each level, broadcast: its size is fixed, whatever the corpus holds."""

    def __init__(self, hashes: DataFrame, levels: list[int]) -> None:
        spark, width = hashes.sparkSession, common.width(hashes.sparkSession)
        pieces = hashes.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_bits(levels), "bucket int, bits array<binary>")
        maps = [np.zeros(1 << (BITS - 3), dtype=np.uint8) for _ in levels]
        size = 1 << (PIECE - 3)
        for r in pieces.collect():  # 2 ** (BITS - PIECE) rows of 4 KB at most
            for m, b in zip(maps, r["bits"]):
                if b:
                    m[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(bytes(b), dtype=np.uint8)
        self.sent = spark.sparkContext.broadcast(maps)

    def holds(self, h: np.ndarray, level: int = 0) -> np.ndarray:
        place = h >> np.uint64(64 - BITS)
        return (self.sent.value[level][(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1


# -- suffix pointers ----------------------------------------------------------------------------------------------------


def quicksort(keys: np.ndarray, weight: np.ndarray, least: int, shown: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a pointer each, count each) of the prefixes of ``shown`` keys or more that are counted ``least`` times or more.

    ``keys``: a row for each pointer, -1 where it has ended.  Multikey three-way quicksort, all parts of one round at a time.
    """
    width = keys.shape[1]
    flat = np.ascontiguousarray(keys).reshape(-1)
    pointer = np.arange(len(keys))
    size, depth = np.array([len(keys)] if len(keys) else [], dtype=np.int64), np.zeros(1 if len(keys) else 0, dtype=np.int64)
    while len(size):
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size)
        key = flat[pointer * width + depth[part]]
        low, mid, high = key[start], key[start + size // 2], key[start + size - 1]
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))[part]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        place, counts, base = np.empty(len(key), dtype=np.int64), [], start
        for s in range(3):
            mask = side == s
            count = np.add.reduceat(mask, start, dtype=np.int64)
            seen = np.cumsum(mask)
            before = seen[start] - mask[start]
            place[mask] = (base[part] + seen - before[part] - 1)[mask]
            counts.append(count)
            base = base + count
        moved = np.empty_like(pointer)
        moved[place] = pointer
        sizes = np.stack(counts, axis=1).reshape(-1)
        depths = np.stack([depth, depth + 1, depth], axis=1).reshape(-1)
        some = sizes > 0
        sizes, depths, equal = sizes[some], depths[some], np.tile([False, True, False], len(size))[some]
        start = np.cumsum(sizes) - sizes
        total = np.add.reduceat(weight[moved], start)
        first = moved[start]
        ended = equal & (flat[first * width + depths - 1] < 0)
        going = (total >= least) & ~ended
        told = equal & going & (depths >= shown)
        for d in np.unique(depths[told]):
            these = told & (depths == d)
            yield int(d), first[these], total[these]
        going &= depths < width
        pointer = moved[np.repeat(going, sizes)]
        size, depth = sizes[going], depths[going]


def count_words(docs: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` and ``f`` of every word; a null phrase has the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tokenized(batches):
            code, count = np.unique(t.lang * max(1, len(t.names)) + t.ids, return_counts=True)
            lang, word = np.divmod(code, max(1, len(t.names)))
            every = np.bincount(t.lang, minlength=len(t.langs))
            names = pa.concat_arrays([t.names.take(pa.array(word)).cast(pa.string()), pa.nulls(len(every), pa.string())])
            langs = t.langs.take(pa.array(np.concatenate([lang, np.arange(len(every))])))
            yield pa.RecordBatch.from_arrays([langs, names, pa.array(np.concatenate([count, every]))], names=["lang", "phrase", "f"])

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from dealt(named(hashed(batch["phrase"]), hashed(batch["lang"])), batch["f"].to_numpy())


def _pairs(t: Tokens, words: Filter) -> tuple[np.ndarray, np.ndarray]:
    """First places of the pairs of frequent words in one piece, and their hashes."""
    of_word, of_lang = t.hashes()
    h = named(of_word[t.ids], of_lang[t.lang])
    fit = words.holds(h)
    at = np.flatnonzero(fit[:-1] & fit[1:] & (t.piece[1:] == t.piece[:-1]))
    return at, paired(h[at], h[at + 1])


def pair_hashes(docs: DataFrame, words: Filter) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tokenized(batches):
            _, h = _pairs(t, words)
            yield from dealt(h, np.ones(len(h)))

    return docs.mapInArrow(run, _HASHES)


_POINTERS = "bucket int, hot boolean, lang string, phrase string, c long"


def pointers(docs: DataFrame, words: Filter, pairs: Filter, buckets: int) -> DataFrame:
    """The words after every place that a frequent pair begins at, each once a batch with its number, and the bucket it is routed to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tokenized(batches):
            at, h = _pairs(t, words)
            fit = pairs.holds(h)
            at, h = at[fit], h[fit]
            if not len(at):
                continue
            goes = np.zeros(len(t.ids) + DEPTH, dtype=bool)
            goes[at] = True
            ids = np.concatenate([t.ids, np.full(DEPTH, -1)])
            keys = np.full((len(at), DEPTH), -1, dtype=np.int64)
            keys[:, 0], keys[:, 1], on = ids[at], ids[at + 1], np.ones(len(at), dtype=bool)
            for d in range(2, DEPTH):
                on = on & goes[at + d - 1]
                keys[:, d] = np.where(on, ids[at + d], -1)
            # equal pointers once: codes of the first two and the last words, then of both
            n, code = len(t.names) + 1, t.lang[at]
            for d in range(DEPTH):
                _, code = np.unique(code * n + keys[:, d] + 1, return_inverse=True)
            _, first, count = np.unique(code, return_index=True, return_counts=True)
            keys, h, lang = keys[first], h[first], t.lang[at[first]]
            hot = pairs.holds(h, 1)
            of_word, rest = t.hashes()[0], np.zeros(len(h), dtype=np.uint64)
            for d in range(2, DEPTH):
                rest = mix(rest + np.where(keys[:, d] < 0, np.uint64(0), of_word[keys[:, d]]))
            bucket = (np.where(hot, mix(h ^ rest), h) % np.uint64(buckets)).astype(np.int32)
            columns = [t.names.take(pa.array(np.where(keys[:, d] < 0, 0, keys[:, d]), mask=keys[:, d] < 0)) for d in range(DEPTH)]
            phrase = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()), null_handling="skip").cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(hot), t.langs.take(pa.array(lang)), phrase, pa.array(count)], names=["bucket", "hot", "lang", "phrase", "c"])

    return docs.mapInArrow(run, _POINTERS)


def _counted(least: int):
    """Buckets come sorted, one after the other; phrases of a hot pair are told whatever their number, as others have parts too."""

    def sort(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang = rows["lang"].dictionary_encode()
        lists = pc.split_pattern(rows["phrase"], " ")
        flat = lists.flatten().dictionary_encode()
        sizes = pc.list_value_length(lists).to_numpy()
        keys = np.full((len(rows), DEPTH + 1), -1, dtype=np.int64)
        keys[:, 0] = lang.indices.to_numpy()
        row = np.repeat(np.arange(len(rows)), sizes)
        keys[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.indices.to_numpy()
        hot, c = rows["hot"].to_numpy(zero_copy_only=False), rows["c"].to_numpy()
        for some, few in ((~hot, least), (hot, 1)):
            here = np.flatnonzero(some)
            for depth, pointer, total in quicksort(keys[here], c[here], few, 3):
                at = here[pointer]
                columns = [flat.dictionary.take(pa.array(keys[at, d])) for d in range(1, depth)]
                yield pa.RecordBatch.from_arrays([rows["lang"].take(pa.array(at)), pc.binary_join_element_wise(*columns, " "), pa.array(total)], names=["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[0]["bucket"][0].as_py() != bucket[a]:
                    yield from sort(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from sort(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def count_phrases(docs: DataFrame, least: int, folder: str, hot: int = HOT) -> DataFrame:
    """``lang``, ``phrase``, ``f`` of the phrases of 1 to ``DEPTH`` words with ``f`` of ``least`` or more, and each language's number of words under a null phrase."""
    docs = docs.select("text", "lang")
    words = common.cut_lineage(count_words(docs).filter(F.col("phrase").isNull() | (F.col("f") >= least)), folder, "words")
    frequent = Filter(words.filter("phrase IS NOT NULL").mapInArrow(_word_hashes, _HASHES), [least])
    pairs = Filter(pair_hashes(docs, frequent), [least, hot])
    width = common.width(docs.sparkSession)
    routed = pointers(docs, frequent, pairs, 64 * width).repartition(width, "bucket").sortWithinPartitions("bucket")
    found = routed.mapInArrow(_counted(least), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return common.cut_lineage(words.unionByName(found), folder, "phrases")


def score_of(a: str, l: str, r: str) -> Column:  # noqa: E741
    """``floor(2000000 * a / (l + r))``, exact whatever fits 64 bits."""
    return F.expr(f"2000000BD * cast({a} AS decimal(20,0)) div (cast({l} AS decimal(20,0)) + cast({r} AS decimal(20,0)))").cast("long")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: tuple[int, int] = (80, 100), text_col: str = "text", lang_col: str = "lang", hot: int = HOT) -> DataFrame:
    """The best ``top`` phrases of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase stands for no more than a longer one that holds it if that occurs at least ``inside[0] / inside[1]`` as often.
    """
    folder = common.shared_dir(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    counts = count_phrases(rows, least, folder, hot)
    f, w = counts.filter("phrase IS NOT NULL"), F.split("phrase", " ", -1)
    n = counts.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    long = f.withColumn("w", w).filter(F.size("w") > 1).select("lang", "phrase", "w", F.col("f").alias("a"))
    join = lambda a: F.array_join(a, " ")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.slice("w", 1, F.col("k"))).alias("first"), join(F.slice("w", F.col("k") + 1, F.size("w"))).alias("rest"))
    part = lambda name, alias: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(alias))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("score", score_of("a", "l", "r"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.a", "s.l", "s.r", "s.score")
    sizes = F.explode(F.sequence(F.lit(2), F.size("w") - 1))
    subs = long.filter(F.size("w") > 2).withColumn("m", sizes).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)))
    around = subs.groupBy("lang", join(F.slice("w", F.col("i"), F.col("m"))).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (inside[1] * wide("longer") < inside[0] * wide("a")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

