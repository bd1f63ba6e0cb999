"""Exact Jaccard join of documents on word n-grams by universe partitioning and the pigeonhole principle.

A document is the set of its n-grams.  The size of a set selects its *band*; within a band all n-grams are hashed to
the same number of segments, so a set falls apart into segment subsets.  A set is indexed in its own band and, if it is
small enough to link with sets of the next smaller band, there too.  Two sets that link differ in at most H elements,
hence in at most H segments: if a document's non-empty segments, weighted by how many differences each can prove,
exceed H by q, then every partner must agree on segments of weight q at least.

Every segment subset is indexed; each ``DELETE_EVERY``-th is also indexed with one element left out, which finds
partners that differ by one element there and so lets such a segment prove two differences.  Allocation is by cost: a
document is probed with its rarest keys only, and of the most frequent ones it leaves out as much weight as q - 1
allows.  A document whose shared keys weigh less than q can have no partner and leaves the join at once.

Candidates whose parity sketches already differ in too many bits are none; the others are verified on the full sets.
Only connections matter for components, so a key with many documents first yields a star or a few around its most
central ones, those that share most keys with others: of near copies of one text, that is the text itself, for every
key.  Each document joins the stars of a few of its keys only, whatever their number.  Then, across the components so far, come a few pairs for each document, different ones for each key.  After
each step components are contracted.  What is left are *open* sets: those with a key whose sets still lie in different
components.  A link between two components joins open sets, and these are few or, like the many versions of one
template, alike without linking: all their pairs would be quadratic.  So their elements are put in order, the rarest
first.  Of two sets that link, the smaller has its first common element so early that the rest can hold the overlap that
a link needs; so only elements that early meet, across components only, and what linked sets cannot lack there decides
which pairs are verified.  Nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import common, windows

#: Sets of fewer elements have a segment for every element: with hashed segments they would have so few that the weight a
#: link needs falls to 0 for some sets.  The scheme, weights and verification are the same.
SMALL = 48
#: A band reaches from a size to twice that size; its smallest sets have so many segments for each element.
SPREAD = 1.1
DELETE_EVERY = 32
#: Elements of sets that are indexed at once; copies in one batch are indexed once all the same.
PART = 1 << 19
_SEGMENT = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted fingerprints of the distinct n-grams of the words, A-Z lower-cased; of fewer than n words the whole sequence."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    starts, ends = windows.words(raw)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    values = windows.word_values(raw, starts, ends)
    if len(starts) < n:
        return windows.mix(windows.tuples(values, len(starts)) + np.uint64(len(starts)))
    found = np.sort(windows.tuples(values, n))
    return found[windows.starts_of(found)]


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set; 0 for the empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) or 1 if len(s) else 0


def sketch(s: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the elements that fall on it.

    An element in only one of two sets turns one bit, so sketches differ in no more bits than their sets in elements: a
    pair whose sketches differ in more bits than linked sets may is none, for certain.
    """
    odd = np.bincount((windows.mix(s + np.uint64(7)) >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view("<u8")


class Bands:
    """Sizes, segments and distances for a similarity of ``num`` / ``den`` or more."""

    def __init__(self, num: int, den: int) -> None:
        if 2 * num < den:
            raise ValueError("a similarity of at least one half is asked for")
        self.num, self.den = num, den
        self.lower = [1, *(SMALL << i for i in range(26))]

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.lower, n, "right")) - 1

    def largest(self, n: np.ndarray) -> np.ndarray:
        """Size of the largest set that can link with one of size n."""
        return n * self.den // self.num

    def apart(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Bound on the differences of linked sets of sizes up to n and t: their intersection is num / (num + den) of the sizes' sum."""
        return (n + t) * (self.den - self.num) // (self.den + self.num)

    def distance(self, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Most differences with a partner: in its own band of any size, in the next smaller one a smaller one."""
        return np.where(own, self.apart(n, self.largest(n)), self.apart(n, n))

    def segments(self, band: int) -> int:
        return 1 << 62 if band == 0 else int(self.lower[band] * (1.5 if band == 1 else SPREAD))

    def schemes(self, n: int) -> list[tuple[int, bool]]:
        """Bands in which a set of size n is indexed; true for its own."""
        band = self.of(n)
        return [(band, True)] + [(band - 1, False)] * (band > 0 and self.largest(self.lower[band] - 1) >= n)


def signatures(s: np.ndarray, band: int, bands: Bands, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the band's segments of a set and their kinds: 0 whole, weight 1; 1 whole, weight 2; 2 one element left out."""
    salt = np.uint64((band + 1 + 64 * seed) * 0x9E3779B97F4A7C15 % (1 << 64))
    if band == 0:
        return windows.mix(s + salt), np.zeros(len(s), dtype=np.uint8)
    spread = windows.mix(s ^ salt)
    segment = (spread >> np.uint64(20)) % np.uint64(bands.segments(band))
    order = np.argsort(segment)
    segment, spread = segment[order], windows.mix(spread[order])
    first = windows.starts_of(segment)
    cut = np.flatnonzero(first)
    total = np.add.reduceat(spread, cut) + segment[cut] * _SEGMENT + salt
    two = (segment[cut] % np.uint64(DELETE_EVERY) == 0) & (np.diff(np.append(cut, len(s))) > 1)  # a lone element's key goes with it
    inside = np.repeat(two, np.diff(np.append(cut, len(s))))
    less = (np.repeat(total, np.diff(np.append(cut, len(s)))) - spread)[inside]
    return windows.mix(np.concatenate([total, less])), np.concatenate([two.astype(np.uint8), np.full(len(less), 2, dtype=np.uint8)])


#: A set in a row of keys: name, size, weight of all its segments there, sets that share its keys (each counted for every key),
#: its component, and its keys in this row.
DOC = np.dtype([("sid", "<i8"), ("n", "<i4"), ("cap", "<i4"), ("mass", "<i8"), ("comp", "<i8"), ("own", "?"), ("keys", "<i4")])
#: The same with its sketch, as pairs are made from it.
SKETCHED = np.dtype([*DOC.descr, ("sketch", "<u8", (8,))])
FORM = "bucket int, docs binary, keys binary, kinds binary, freq binary"
#: What is told of each row beside its keys.
INFO = "key long, key2 long, id string, size long, sid long"
#: Bits of a key that are kept: enough to tell keys of one shuffle partition apart; a clash costs a verification.
_BITS = np.uint64(0xFFFFFFFFFFFF)


def _pack(doc: np.ndarray, table: np.ndarray, key: np.ndarray, kind: np.ndarray, freq: np.ndarray | None, bucket: np.ndarray) -> pd.DataFrame:
    """Rows by bucket; ``doc`` has each key's place in ``table``. Keys take six bytes and stand by set, so each set is told once a row."""
    order = np.lexsort((doc, bucket))
    doc, key, kind, bucket = doc[order], key[order], kind[order], bucket[order]
    freq = None if freq is None else freq[order]
    at, to = _runs(bucket)
    run, end = _runs(bucket, doc)
    head = table[doc[run]].copy()
    head["keys"] = end - run
    six = np.ascontiguousarray((key & _BITS).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    begin, stop = np.searchsorted(run, at), np.searchsorted(run, to)
    rows = [(int(bucket[a]), head[b:e].tobytes(), six[a:z].tobytes(), kind[a:z].tobytes(), b"" if freq is None else freq[a:z].tobytes()) for a, z, b, e in zip(at, to, begin, stop)]
    return pd.DataFrame(rows, columns=["bucket", "docs", "keys", "kinds", "freq"])


def _unpack(batches: Iterator[pd.DataFrame], form: np.dtype = DOC) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place in the table, table, keys, kinds, frequencies of all rows of a partition."""
    parts: dict[str, list[bytes]] = {"docs": [], "keys": [], "kinds": [], "freq": []}
    for b in batches:
        for name, held in parts.items():
            held += list(b[name])
    table = np.frombuffer(b"".join(parts["docs"]), dtype=form)
    six = np.frombuffer(b"".join(parts["keys"]), dtype=np.uint8).reshape(-1, 6)
    key = np.zeros((len(six), 8), dtype=np.uint8)
    key[:, :6] = six
    freq = np.frombuffer(b"".join(parts["freq"]), dtype="<u4")
    return np.repeat(np.arange(len(table)), table["keys"]), table, key.reshape(-1).view("<u8"), np.frombuffer(b"".join(parts["kinds"]), dtype=np.uint8), freq


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(windows.starts_of(*columns))
    return at, np.append(at[1:], len(columns[0])) if len(at) else at


def _bucket(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return labels[((windows.mix(x.astype(np.uint64)) >> np.uint64(33)) % np.uint64(len(labels))).astype(np.int64)]


class Clash(Exception):
    """Too many elements of one set share their segments, so that it could miss a partner."""


def index(sets: Iterator[tuple[int, np.ndarray]], bands: Bands, labels: np.ndarray, seed: int = 0) -> pd.DataFrame:
    """Packed keys of a batch of (name, set)."""
    table, keys, kinds = [], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint8)]
    for sid, s in sets:
        for band, own in bands.schemes(len(s)):
            key, kind = signatures(s, band, bands, seed)
            cap = len(kind) + int((kind == 1).sum()) - int((kind == 2).sum())
            n = np.int64(len(s))
            if cap <= bands.distance(n, np.bool_(own)):
                raise Clash  # beyond ten standard deviations
            table.append((sid, len(s), cap, 0, sid, own, 0))
            keys.append(key)
            kinds.append(kind)
    doc = np.repeat(np.arange(len(table)), [len(k) for k in keys[1:]])
    key = np.concatenate(keys)
    return _pack(doc, np.array(table, dtype=DOC), key, np.concatenate(kinds), None, _bucket(key & _BITS, labels))


def shared(labels: np.ndarray):
    """Of a partition of keys those that two sets or more have, one of them in its own band; back to the sets. What is told of rows passes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            told = batch["docs"].map(len) == 0
            yield batch[told].assign(bucket=-1)
            held.append(batch[~told])
        doc, table, key, kind, _ = _unpack(held)
        order = np.argsort(key)
        sorted_key = key[order]
        twice = np.zeros(len(key), dtype=bool)
        twice[1:] = sorted_key[1:] == sorted_key[:-1]
        twice[:-1] |= twice[1:]
        order = order[twice]  # most keys are alone and go here
        order = order[np.lexsort((kind[order], table["sid"][doc[order]], key[order]))]
        d, k, what = doc[order], key[order], kind[order]
        sid, own = table["sid"][d], table["own"][d]
        new = windows.starts_of(k, sid, what)  # copies have one name
        d, k, what, sid, own = d[new], k[new], what[new], sid[new], own[new]
        start, end = _runs(k)
        group = np.repeat(np.arange(len(start)), end - start)
        size = np.bincount(group, windows.starts_of(k, sid)) if len(k) else np.zeros(0)
        keep = ((np.bincount(group, own) > 0) & (np.bincount(group, what < 2) > 0) & (size > 1))[group] if len(k) else np.zeros(0, dtype=bool)
        d, k, what = d[keep], k[keep], what[keep]
        freq = size[group][keep].astype("<u4") if len(group) else np.zeros(0, dtype="<u4")
        yield _pack(d, table, k, what, freq, _bucket(sid[keep], labels)).assign(key=0, key2=0, id="", size=0, sid=0)

    return run


def allocate(bands: Bands, labels: np.ndarray):
    """All shared keys of each set: it stays if they weigh enough, is probed with the rarest (bit 0 of ``freq``) and joins the stars of a few (bit 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, table, key, kind, freq = _unpack(batches)
        sid, own = table["sid"][doc], table["own"][doc]
        order = np.lexsort((freq, own, sid))
        doc, key, kind, freq, sid, own = doc[order], key[order], kind[order], freq[order], sid[order], own[order]
        start, end = _runs(sid, own)
        if not len(start):
            return
        group = np.repeat(np.arange(len(start)), end - start)
        head = table[doc[start]]
        q = head["cap"] - bands.distance(head["n"].astype(np.int64), head["own"])
        weight = np.where(kind == 1, 2, 1)
        total = np.add.reduceat(weight, start)
        upto = np.cumsum(weight)
        before = upto - weight - (upto[start] - weight[start])[group]  # within the set, rarest first
        stays = (total >= q)[group]
        runs, to = _runs(sid)
        table = table.copy()
        table["mass"][doc] = np.repeat(np.add.reduceat(freq.astype(np.int64), runs), to - runs)
        probe = own & (total[group] - before > (q - 1)[group])  # what is left out weighs q - 1 at most
        star = np.zeros(len(doc), dtype=bool)
        for k in range(CHOSEN):  # from its rarest to its most frequent key, evenly
            star[start + k * (end - start - 1) // (CHOSEN - 1)] = True
        yield _pack(doc[stays], table, key[stays], kind[stays], (probe + 2 * star)[stays].astype("<u4"), _bucket(sid[stays], labels))

    return run


def by_key(labels: np.ndarray):
    """Of a partition of sets the keys again, each set with its component and sketch.

    These come as rows of ``SKETCHED`` without keys, in ``kinds``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, told = [], [b""]
        for batch in batches:
            extra = batch["docs"].map(len) == 0
            told += list(batch.loc[extra, "kinds"])
            held.append(batch[~extra])
        doc, table, key, kind, freq = _unpack(held)
        names = np.frombuffer(b"".join(told), dtype=SKETCHED)
        names = names[np.argsort(names["sid"])]
        full = np.zeros(len(table), dtype=SKETCHED)
        for f in DOC.names:
            full[f] = table[f]
        if len(names):
            at = np.minimum(np.searchsorted(names["sid"], table["sid"]), len(names) - 1)
            full["comp"], full["sketch"] = names["comp"][at], names["sketch"][at]
        yield _pack(doc, full, key, kind, freq, _bucket(key, labels))

    return run


#: Stars that a key yields, each among the sets that the one before did not reach, and keys of a set in whose stars it is.
STARS, CHOSEN = 3, 5
#: Of a key's sets in an order that the key itself mixes, those so many places apart are tried in the second step.
NEAR = (1, 2)
#: How candidates are found, one way after the other.
STEPS = ("star", "near", "rest")
PAIR = "a long, b long, x long, y long"


def pairs(bands: Bands, step: str):
    """Candidates a, b of a partition of keys and their components x, y: stars; or sets that a mixed order puts near each other, across components only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, table, key, kind, probe = _unpack(batches, SKETCHED)
        sid, n = table["sid"][doc], table["n"][doc].astype(np.int64)
        order = np.lexsort((sid, -table["mass"][doc] if step == "star" else n, key))
        doc, key, kind, probe, sid, n = doc[order], key[order], kind[order], probe[order], sid[order], n[order]
        probe, star = probe & 1 > 0, probe & 2 > 0
        comp, most, found = table["comp"][doc], bands.largest(n), set()
        sketches = table["sketch"]

        def may_link(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.bitwise_count(sketches[doc[i]] ^ sketches[doc[j]]).sum(axis=-1) <= bands.apart(n[i], n[j])

        def put(i: np.ndarray, j: np.ndarray) -> None:
            turn = sid[i] > sid[j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            found.update(zip(sid[i].tolist(), sid[j].tolist(), comp[i].tolist(), comp[j].tolist()))

        for s, e in zip(*_runs(key)):
            if e - s < 2 or not (star if step == "star" else probe)[s:e].any():
                continue
            if step == "star":
                left = np.arange(s, e)
                for _ in range(STARS):
                    hub, left = left[0], left[1:]
                    left = left[sid[left] != sid[hub]]
                    if not len(left):
                        break
                    near = (np.maximum(n[left], n[hub]) <= np.minimum(most[left], most[hub])) & may_link(np.full(len(left), hub), left)
                    reached = left[near & star[left]]
                    put(np.full(len(reached), hub), reached)
                    left = left[~near]
                    if len(left) < 2:
                        break
            elif comp[s:e].min() == comp[s:e].max():
                continue
            else:
                mixed = s + np.argsort(windows.mix(sid[s:e].view(np.uint64) ^ key[s]))
                for far in NEAR:
                    i, j = np.minimum(mixed[:-far], mixed[far:]), np.maximum(mixed[:-far], mixed[far:])
                    use = (comp[i] != comp[j]) & (n[j] <= most[i]) & ((kind[i] < 2) | (kind[j] < 2))
                    i, j = i[use], j[use]
                    use = may_link(i, j)
                    put(i[use], j[use])
            if len(found) > 200_000:
                yield pd.DataFrame(list(found), columns=["a", "b", "x", "y"])
                found = set()
        yield pd.DataFrame(list(found), columns=["a", "b", "x", "y"])

    return run


def open_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition of keys the sets, with their components, of each key that is probed and whose sets lie in different components."""
    doc, table, key, _, probe = _unpack(batches, SKETCHED)
    order = np.argsort(key, kind="stable")
    doc, key, probe = doc[order], key[order], probe[order] & 1 > 0
    comp, wanted = table["comp"][doc], np.zeros(len(table), dtype=bool)
    at, to = _runs(key)
    if len(at):
        mixed = (np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at)) & np.logical_or.reduceat(probe, at)
        wanted[doc[np.repeat(mixed, to - at)]] = True
    _, first = np.unique(table["sid"][wanted], return_index=True)
    yield pd.DataFrame({"sid": table["sid"][wanted][first], "comp": table["comp"][wanted][first]})


def early_pairs(opened: DataFrame, sets: DataFrame, num: int, den: int, folder: str) -> DataFrame:
    """Candidates a, b and their components x, y among open sets (sid, comp).

    ``at`` is an element's place in its set when the rarest come first, the same order for all sets.  Of sets of n and
    m >= n elements that link, num / (num + den) of n + m are common; so their first common element stands early enough in both for
    so many to follow it.  Of an element's sets those of its largest component meet the others only, never each other.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["data"].map(len).to_numpy() // 8
            cut = np.flatnonzero(np.diff(np.cumsum(size) // (1 << 18), prepend=0))  # bounded memory for long texts
            for rows in np.split(np.arange(len(batch)), cut):
                part, n = batch.iloc[rows], size[rows]
                told = {c: np.repeat(x, n) for c, x in (("sid", part["sid"].to_numpy()), ("comp", part["comp"].to_numpy()), ("n", n))}
                yield pd.DataFrame({**told, "token": np.frombuffer(b"".join(part["data"]), dtype="<i8")})

    def up(a: Column, b: int) -> Column:
        return F.floor((a + b - 1) / b)

    elements = sets.select("sid", "data").join(opened, "sid").mapInPandas(spread, "sid long, comp long, n long, token long")
    elements = common.cut_lineage(elements, folder, "elements")
    often = elements.groupBy("token").agg(F.count("*").alias("f"))
    order = Window.partitionBy("sid").orderBy("f", "token")
    early = elements.join(often, "token").withColumn("at", F.row_number().over(order) - 1)
    early = early.filter((F.col("f") > 1) & (F.col("at") <= F.col("n") - up(F.col("n") * num, den)))
    early = early.withColumn("first", F.col("at") <= F.col("n") - up(2 * num * F.col("n"), num + den)).drop("f")
    early = common.cut_lineage(early, folder, "early")
    by_comp = early.groupBy("token", "comp").agg(F.count("*").alias("sets"), F.count_if("first").alias("firsts"))
    largest = by_comp.groupBy("token").agg(F.max(F.struct("sets", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("firsts").alias("firsts"))
    largest = largest.filter((F.col("comps") > 1) & (F.col("firsts") > 0)).select("token", F.col("top.comp").alias("top"))
    early = early.join(largest, "token").withColumn("main", F.col("comp") == F.col("top")).drop("top")
    one = early.filter("first").select("token", F.col("sid").alias("s"), F.col("n").alias("ns"), F.col("at").alias("i"), F.col("comp").alias("x"), F.explode(F.expr("if(main, array(false), array(false, true))")).alias("main"))
    other = early.select("token", F.col("sid").alias("t"), F.col("n").alias("nt"), F.col("at").alias("j"), F.col("comp").alias("y"), "main")
    needed = up(num * (F.col("ns") + F.col("nt")), num + den)
    smaller = (F.col("ns") < F.col("nt")) | ((F.col("ns") == F.col("nt")) & (F.col("s") < F.col("t")))
    met = one.join(other, ["token", "main"]).filter(smaller & (F.col("x") != F.col("y")) & (F.least(F.col("ns") - F.col("i"), F.col("nt") - F.col("j")) >= needed))
    turn = F.col("s") > F.col("t")
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    return met.select(pick("s", "t").alias("a"), pick("t", "s").alias("b"), pick("x", "y").alias("x"), pick("y", "x").alias("y")).distinct()


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(sid, comp) of every name in the links a, b: the smallest one that it is connected with.

    Labels move along links to their minimum and then to their label's label, until none changes.
    """
    links = links.select("a", "b").filter("a != b")
    both = common.cut_lineage(links.union(links.select("b", "a")).distinct(), folder, f"{name}-links")
    labels, step = common.cut_lineage(both.groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("m")).select("sid", F.least("sid", "m").alias("comp")), folder, f"{name}-0"), 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("sid", "b"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("comp").alias("m"))
        low = labels.join(near, "sid").select("sid", "comp", F.least("comp", "m").alias("new"))
        far = labels.select(F.col("sid").alias("new"), F.col("comp").alias("jump"))
        moved = common.cut_lineage(low.join(far, "new").select("sid", F.least("new", "jump").alias("comp"), (F.least("new", "jump") != F.col("comp")).alias("moved")), folder, f"{name}-{step}")
        labels = moved.select("sid", "comp")
        common.drop(links.sparkSession, folder, f"{name}-{step - 1}")
        if not moved.filter("moved").limit(1).count():
            common.drop(links.sparkSession, folder, f"{name}-links")
            return labels


def verified(found: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of candidate pairs those that link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["one"], batch["other"]):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                both = np.sort(np.concatenate([x, y]))
                common_ = int((both[1:] == both[:-1]).sum())
                keep.append(den * common_ >= num * (len(both) - common_))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b", "x", "y"]]

    with_one = found.join(sets.select(F.col("sid").alias("a"), F.col("data").alias("one")), "a")
    both = with_one.join(sets.select(F.col("sid").alias("b"), F.col("data").alias("other")), "b")
    return both.select("a", "b", "x", "y", "one", "other").mapInPandas(run, PAIR)


def members(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, seed: int = 0) -> DataFrame:
    """``key, key2, id, n_shingles, comp`` of every row: its ``common.row_keys`` and the name of its component, null for an empty set."""
    spark = docs.sparkSession
    folder, parts, bands = folder or common.shared_dir(spark), common.width(spark), Bands(num, den)
    labels = np.array(common.even_labels(spark, parts), dtype=np.int64)
    keyed = windows.keyed(docs, id_col, text_col)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = {}
            info = []
            for key, key2, i, text in zip(batch["key"], batch["key2"], batch["id"], batch["text"]):
                s = shingles(text, n)
                name = set_id(s)
                info.append((key, key2, i, len(s), name))
                if name:
                    held[name] = s
            part, size, clash = [], 0, False
            for item in [*held.items(), None]:
                if item is not None:
                    part.append(item)
                    size += len(item[1])
                if size >= PART or item is None:
                    try:
                        yield index(part, bands, labels, seed).assign(key=0, key2=0, id="", size=0, sid=0)
                    except Clash:
                        clash = True
                    part, size = [], 0
            if clash:
                info.append((0, 0, None, -1, 0))
            rows = pd.DataFrame(info, columns=["key", "key2", "id", "size", "sid"])
            yield rows.assign(bucket=labels[rows["key"] % parts], docs=b"", keys=b"", kinds=b"", freq=b"")

    first = keyed.select("key", "key2", F.col("id").cast("string").alias("id"), "text").mapInPandas(named, f"{INFO}, {FORM}")
    rows = common.cut_lineage(first.repartition(parts, "bucket").mapInPandas(shared(labels), f"{INFO}, {FORM}"), folder, "shared")
    if rows.filter("size < 0").limit(1).count():  # segments are dealt anew, by other hashes, for all
        return members(docs, n, num, den, id_col, text_col, f"{folder}/again", seed + 1)
    info = rows.filter("bucket < 0").select("key", "key2", F.col("id").cast("long").alias("id"), F.col("size").alias("n_shingles"), "sid")
    fields = [x.split()[0] for x in FORM.split(", ")]
    packed = rows.filter("bucket >= 0").select(*fields)
    kept = common.cut_lineage(packed.repartition(parts, "bucket").mapInPandas(allocate(bands, labels), FORM), folder, "kept")

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"sid": np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(np.frombuffer(x, dtype=DOC)["sid"] for x in batch["docs"])]))})

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, n) for t in batch["text"]]
            yield pd.DataFrame({"sid": batch["sid"], "data": [s.tobytes() for s in found], "sketch": [sketch(s).tobytes() for s in found]})

    wanted = kept.select("docs").mapInPandas(names, "sid long").distinct()
    one = info.groupBy("sid").agg(F.min(F.struct("key", "key2")).alias("row")).join(wanted, "sid", "left_semi").select("row.*", "sid")  # copies meet before they are dealt out
    sets = keyed.select("key", "key2", "text").join(one.hint("shuffle_hash"), windows.KEY).select("sid", "text").mapInPandas(full, "sid long, data binary, sketch binary")
    sets = common.cut_lineage(sets, folder, "sets")

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            table = np.zeros(len(batch), dtype=SKETCHED)
            table["sid"], table["comp"] = batch["sid"], batch["comp"]
            if len(batch):
                table["sketch"] = np.frombuffer(b"".join(batch["sketch"]), dtype="<u8").reshape(-1, 8)
            where = _bucket(table["sid"], labels)
            yield pd.DataFrame([(int(b), b"", b"", table[where == b].tobytes(), b"") for b in np.unique(where)], columns=fields)

    tried = comp = None
    for step in STEPS:
        named_sets = sets.select("sid", "sketch").withColumn("comp", F.col("sid")) if comp is None else sets.select("sid", "sketch").join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        keys = kept.unionByName(named_sets.select("sid", "comp", "sketch").mapInPandas(labelled, FORM))
        by_keys = keys.repartition(parts, "bucket").mapInPandas(by_key(labels), FORM).repartition(parts, "bucket")
        if step == "rest":
            opened = common.cut_lineage(by_keys.mapInPandas(open_sets, "sid long, comp long").distinct(), folder, "open")
            found = early_pairs(opened, sets, num, den, folder)
        else:
            found = by_keys.mapInPandas(pairs(bands, step), PAIR).distinct()
        found = common.cut_lineage(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), folder, step)
        good = common.cut_lineage(verified(found, sets, num, den).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), folder, f"{step}-links")
        tried = found.select("a", "b") if tried is None else tried.unionByName(found.select("a", "b"))
        merged = components(good, folder, f"{step}-components")  # of components, not of sets: what is merged already is one
        if comp is None:
            comp = merged
            continue
        moved = named_sets.select("sid", "comp").join(merged.select(F.col("sid").alias("comp"), F.col("comp").alias("new")), "comp", "left")
        comp = common.cut_lineage(moved.select("sid", F.coalesce("new", "comp").alias("comp")), folder, f"{step}-labels")

    common.drop(spark, folder, "kept", "sets", "open", "elements", "early", f"{STEPS[1]}-labels", *(f"{step}{part}" for step in STEPS for part in ("", "-links")))
    return info.join(comp, "sid", "left").select("key", "key2", "id", "n_shingles", F.when(F.col("sid") != 0, F.coalesce("comp", "sid")).alias("comp"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, key2`` of one document of each component: that of the smallest id, null last, and then of the smallest keys. Empty sets have none."""
    whole = members(docs, id_col=id_col, text_col=text_col).filter("comp is not null")
    return whole.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "key2")).alias("least")).select("least.key", "least.key2")


def join(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row: rows whose sets have a Jaccard similarity of ``num / den`` or more link.

    ``component_id`` is the smallest id (an integer) that a row reaches by links, itself included; rows with a null id
    link too, and a component of such rows only has null.  A null or empty text and one without words have an empty set,
    which links with nothing.  Repeated rows and rows with equal sets are linked.  Other columns are not read.
    """
    folder = folder or common.shared_dir(docs.sparkSession)
    whole = members(docs, n, num, den, id_col, text_col, folder)
    # written, so that a component in a large share of all rows is split in the join
    least = common.cut_lineage(whole.filter("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id")), folder, "least")
    out = whole.join(least, "comp", "left").select("id", "n_shingles", F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.col("component_id").cast(kind).alias("component_id"))
