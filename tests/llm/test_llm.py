"""The ten operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import html
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import (
    gbt, html_extract, language_id, media_jpeg, ngram_join, packing, quality_rules, queries, sentencepiece_viterbi, substring_dedup, suffix_dedup, url_filters, windows,
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and odd texts, a null id and a repeated row."""
    base, passage = prose(1, 160), prose(2, 90)
    near = base.split()
    near[80] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(3, 40) + " " + passage + " " + prose(4, 30)), (5, prose(5, 200) + "\n" + passage), (6, None), (7, ""), (8, " \t\n"), (9, "one two three"), (10, "One two THREE"),
        (11, "one two four"), (12, "ab" * 500), (13, "é" * 450 + " " + prose(6, 5)), (14, prose(7, 3000)), (15, "x" + prose(7, 3000)[:9000]), (16, "word " * 60), (None, base), (17, prose(8, 5)), (17, prose(8, 5)),
    ]
    for i in range(12):  # a chain of near copies, each a little further from the first
        near[3 + 11 * i] = f"edit{i}"
        rows.append((30 + i, " ".join(near)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", n) for n, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, key long").repartition(3)  # clashing names beside


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, quality int")


# -- 1 ------------------------------------------------------------------------------------------------------------------


def shingle_sets(rows):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t in rows:
        w = (t or "").encode().translate(low).split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows):
    sets = shingle_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids and sets[i] else rows[i][0]) for i in group]
    return Counter(out)


def test_join_matches_brute_force(docs):
    assert Counter(tuple(r) for r in ngram_join.join(docs).collect()) == brute_components(corpus())


def test_join_of_the_test_table_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op1_ngram_join(spark, sf).collect()) == brute_components(rows)


def template_group(k, linked):
    """k texts of one template, 0.71 similar to each other, and ``linked`` that are 0.9 similar to one of them."""
    rng = np.random.default_rng(k)
    words = [f"t{i}" for i in range(300)]
    rows = []
    for d in range(k):
        own = list(words)
        own[d % 7 : d % 7 + 40] = [f"d{d}x{i}" for i in range(40)]  # 44 shingles of 296 are its own
        at = 60 + int(rng.integers(0, 200))
        own[at : at + 6] = [f"e{d}x{i}" for i in range(6)]
        rows.append((d, " ".join(own)))
        if d < linked:
            rows.append((1000 + d, " ".join(own[:-8] + [f"z{d}"])))
    return rows


def test_join_of_a_template_group_makes_few_pairs(spark, tmp_path, monkeypatch):
    """Sets that share their rarest keys without linking are not paired; those among them that do link are."""
    made, early = [], ngram_join.early_pairs

    def counted(*args):
        found = early(*args)
        made.append((args[0].count(), found.count()))
        return found

    monkeypatch.setattr(ngram_join, "early_pairs", counted)
    for k in (60, 120, 240):
        rows = template_group(k, 10)
        got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), folder=str(tmp_path / str(k)))
        assert Counter(tuple(r) for r in got.collect()) == brute_components(rows)
        assert len({r.component_id for r in got.collect()}) == k
    assert [opened >= k for (opened, _), k in zip(made, (60, 120, 240))] == [True] * 3
    assert all(pairs <= opened for opened, pairs in made), made


def test_first_common_elements_meet(spark, tmp_path):
    """Without any other step, every link between open sets comes out of their early elements."""
    rng, held = np.random.default_rng(3), []
    for base in range(12):
        s = rng.integers(1, 1 << 62, int(rng.integers(1, 90)), dtype=np.uint64)
        for _ in range(8):
            keep = s[rng.random(len(s)) < rng.choice([0.8, 0.9, 1.0])]
            held.append(np.unique(np.concatenate([keep, rng.integers(1, 1 << 62, int(rng.integers(0, 1 + len(s) // 6)), dtype=np.uint64)])))
    held = [s for s in held if len(s)]
    sets = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(held)], "sid long, data binary")
    opened = spark.createDataFrame([(i, i // 3 * 3) for i in range(len(held))], "sid long, comp long")
    found = {(r.a, r.b) for r in ngram_join.early_pairs(opened, sets, 3, 4, str(tmp_path)).collect()}
    links = set()
    for j, b in enumerate(held):
        for i, a in enumerate(held[:j]):
            common = len(np.intersect1d(a, b))
            if i // 3 != j // 3 and 4 * common >= 3 * (len(a) + len(b) - common):
                links.add((i, j))
    assert links and links <= found


def test_join_of_nothing(spark):
    assert ngram_join.join(empty(spark)).collect() == []


def test_pigeonhole_holds_for_every_size():
    """Linked sets share segments of the weight that the allocation counts on; sketches never differ in more bits than sets."""
    bands, rng = ngram_join.Bands(3, 4), np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 7, 12, 30, 47, 48, 60, 63, 95, 96, 130, 191, 192, 500, 1500):
        s = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(n - np.ceil(0.75 * n))
        other = np.sort(np.concatenate([s[drop:]]))
        for a, b in ((s, s), (other, s), (np.sort(np.concatenate([s[n // 7 :], rng.integers(0, 1 << 63, n // 7, dtype=np.uint64)])), s)):
            common = len(np.intersect1d(a, b))
            if not len(a) or 4 * common < 3 * (len(a) + len(b) - common):
                continue
            assert np.bitwise_count(ngram_join.sketch(a) ^ ngram_join.sketch(b)).sum() <= len(a) + len(b) - 2 * common <= bands.apart(len(a), len(b))
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            band = bands.of(len(small))
            assert band in [x for x, _ in bands.schemes(len(large))]
            k1, t1 = ngram_join.signatures(small, band, bands)
            k2, t2 = ngram_join.signatures(large, band, bands)
            cap = len(t1) + int((t1 == 1).sum()) - int((t1 == 2).sum())
            q = cap - int(bands.distance(np.int64(len(small)), np.bool_(True)))
            weight = sum(2 if t == 1 else 1 for k, t in zip(k1, t1) if k in set(k2.tolist()))
            assert 0 < q <= weight


# -- 2 ------------------------------------------------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_is_whole_and_tight(spark, docs):
    got = queries.tokens_packed(docs).collect()
    t = tokenizer()
    want = Counter()
    for i, text in corpus():
        want[i, tuple(t.encode(text or "", add_special_tokens=False).ids + [0])] += 1
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for seq in sequences.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    for (i, ids), n in want.items():
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i and r.doc_tokens == len(ids))
        for start, length, crc in set(pieces):
            if (i, len(ids)) in {(j, len(x)) for (j, x) in want if (j, x) != (i, ids)}:
                continue
            assert zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes()) == crc
    used = sum(r.length for r in got)
    padding = sum(1024 - n for s in sequences.values() if (n := sum(r.length for r in s)) & (n - 1))
    assert padding < 0.03 * used


@pytest.mark.parametrize("n", [1, 2, 13, 16, 17, 63, 64, 100, 511, 512, 513, 700, 1000, 1023, 1024, 1025, 5000])
def test_cuts_cover_a_document(n):
    at = 0
    for start, length, k in packing.cuts(n, 1024):
        assert start == at and length * k <= 1024 and 1024 - length * k <= max(packing.SLACK, k)
        at += length
    assert at == n


def test_both_encoders_agree_and_special_text_takes_the_slow_one():
    e, t = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), tokenizer()
    for text in ("Hello  world\n\n x", "naïve €5 日本語 👍🏽", "a" * 300, "<|endoftext|> z", "don't   \t\r\n 123 --"):
        assert e(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_of_a_million_spaces(spark):
    df = spark.createDataFrame([(1, " " * 1_000_001), (2, "\n" * 1_000_001 + "x"), (3, "a" * 300_000)], "doc_id long, text string")
    r = queries.tokens_packed(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert len(r) == 3 and all(x.n == x.d for x in r)


def test_packing_of_nothing(spark):
    assert queries.tokens_packed(empty(spark)).count() == 0


# -- 3 and 6 ------------------------------------------------------------------------------------------------------------


def brute_bytes(rows, length=400):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in raws for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raws):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def brute_words(rows, window=20):
    seen, out, last = set(), [], None
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if (i, t) == last:  # a repeated row is the same document
            out.append(out[-1])
            continue
        last = (i, t)
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(k)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


def test_suffix_dedup_matches_brute_force(docs):
    got = suffix_dedup.remove_repeats(docs, keep=["key", "id"])
    assert got.columns[-2:] == ["key", "id"]
    assert Counter(tuple(r)[:5] for r in got.collect()) == brute_bytes(corpus())


def test_substring_dedup_matches_brute_force(docs):
    assert Counter(tuple(r) for r in substring_dedup.remove_repeats(docs).drop("text").collect()) == brute_words(corpus())


def test_dedup_of_the_test_table_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(tuple(r)[:5] for r in queries.op3_suffix_dedup(spark, sf).collect()) == brute_bytes(rows)
    assert Counter(tuple(r) for r in queries.op6_substring_dedup(spark, sf).collect()) == brute_words(rows)


def test_runs_are_few_ranges_and_still_compared(spark):
    """One letter or word over and over is one range a part; windows that repeat in it are found though no other text has them."""
    raw, values = suffix_dedup.byte_split("a" * 100_000)
    assert len(windows.ranges(values, raw, 400, 32)[0]) == 1
    values, _ = substring_dedup.word_split("w " * 50_000)
    assert len(windows.ranges(values, values, 20, 6)[0]) == 1
    rows = [(1, "a" * 100_000), (2, "xy" * 700 + "z" + "b" * 399), (3, "c" * 400), (4, "c" * 401), (5, "w " * 50_000), (6, prose(8, 90) + " w" * 21), (7, "p q r " * 40), (8, "d" * 450 + prose(5, 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()) == sorted((i, *cut_bytes(rows, i)) for i, _ in rows)
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()}
    assert kept == {i: cut_words(rows, i) for i, _ in rows}


def cut_bytes(rows, doc):
    """Bytes and runs that go, by counting every string of 400 bytes."""
    seen = Counter(t[p : p + 400] for _, t in rows for p in range(len(t) - 399))
    text = dict(rows)[doc]
    gone = np.zeros(len(text) + 1, dtype=bool)
    for p in range(len(text) - 399):
        if seen[text[p : p + 400]] > 1:
            gone[p : p + 400] = True
    return int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum())


def cut_words(rows, doc):
    seen = set()
    for i, t in rows:
        w = t.split()
        gone = np.zeros(len(w), dtype=bool)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = True
            seen.add(key)
        if i == doc:
            return len(w), int(gone.sum())


def test_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).collect() == [] and substring_dedup.remove_repeats(empty(spark)).collect() == []


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 11, 16, 30, 40])
def test_family_marks_what_any_two_stretches_share(length):
    rng, family, pieces = np.random.default_rng(length), suffix_dedup.Family(length), []
    for _ in range(12):
        batch = [bytes(rng.integers(0, 2, int(rng.integers(0, 90)), dtype=np.uint8)) for _ in range(int(rng.integers(1, 6)))]
        if pieces:
            batch.append(pieces[int(rng.integers(len(pieces)))][3:] + b"\0\0\0")
        family.add(batch)
        pieces += batch
        sizes = [len(x.order) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        for x in family.levels:
            suffixes = [bytes(x.text[p : p + length]) for p in x.order]
            assert suffixes == sorted(set(suffixes))
    whole = [p[k : k + length] for p in pieces for k in range(len(p) - length + 1)]
    counts = Counter(whole)
    assert family.marks().tolist() == [counts[x] > 1 for x in whole]


@pytest.mark.parametrize("window", [1, 3, 4, 7, 20])
def test_factors_cover_what_stands_before(window):
    rng = np.random.default_rng(window)
    stretches = [rng.integers(0, 2, int(rng.integers(0, 60)), dtype=np.uint64) for _ in range(20)]
    stretches.append(np.concatenate([stretches[3], stretches[5], stretches[3]]))
    seen = set()
    for s, found in zip(stretches, substring_dedup.Block(stretches, window).factors()):
        want = []
        for p in range(len(s) - window + 1):
            k = s[p : p + window].tobytes()
            want.append(k in seen)
            seen.add(k)
        got = np.zeros(len(want), dtype=bool)
        for start, n in found:
            assert n >= window
            got[start : start + n - window + 1] = True
        assert got.tolist() == want


def thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_that_fool_polynomials_differ(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{a} " + prose(50, 30)), (2, f"{b} " + prose(50, 30)), (3, a), (4, b), (5, a)]
    values = substring_dedup.word_split(f"{a} {b} {a}")[0]
    assert values[0] == values[2] != values[1]
    two = "x " * 40 + " ".join("xy"[i.bit_count() & 1] for i in range(64))
    rows += [(6, two), (7, two.translate(str.maketrans("xy", "yx")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in ngram_join.join(docs).collect()) == brute_components(rows)
    assert Counter(tuple(r) for r in substring_dedup.remove_repeats(docs).drop("text").collect()) == brute_words(rows)
    assert Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs).collect()) == brute_bytes(rows)


@pytest.mark.parametrize("part", [64, 1 << 19])
def test_ranges_cover_every_window_once(part, monkeypatch):
    monkeypatch.setattr(windows, "PART", part)
    values = windows.mix(np.random.default_rng(1).integers(0, 4, 700, dtype=np.uint64))
    p, n, _, _, digest = windows.ranges(values, values, 20, 6)
    assert p[0] == 0 and (p[1:] == (p + n)[:-1]).all() and p[-1] + n[-1] == 700 - 19 and len(digest) == 16 * len(p)


# -- 4, 7, 9 ------------------------------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    r = queries.op4_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    good = r.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert good > 0.98 and r.filter("score < 0 OR score > 1").count() == 0


def test_language_edges(spark, docs):
    labelled = spark.createDataFrame([(1, "the and of to", "en"), (2, "der die das und", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 !?", "c"), (None, "the of", "d"), (5, "𝔘𝔫 漢字 ß", None)], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd, language_id.train(labelled)).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[None] == "en" and got[5] in ("en", "de")
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(empty(spark))).collect()} == {"und"}


def test_a_text_without_letters_has_no_language(spark):
    labelled = spark.createDataFrame([(1, "the and of to", "en"), (2, "der die das und", "de")], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "\U0001f600\U0001f600"), (2, "\U0001d7ce\U0001d7d8 12"), (3, "\U0001d518\U0001d52b"), (4, "the \U0001f600"), (None, "of the")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(odd, language_id.train(labelled)).withColumn("held_out", queries.held_out()).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0 and got[3].lang_pred != "und" and got[4].lang_pred == "en"
    assert got[None].held_out is False


def test_prototypes_are_those_of_brute_force(spark):
    """Cosines of trigram vectors built letter by letter."""
    rows = [(i, prose(60 + i, 12) if i % 2 else " ".join(f"w{i}{j}x" for j in range(9)), "en" if i % 2 else "de") for i in range(8)]
    v, size = language_id.letter_vectors().astype(int), language_id.DIM
    number = {chr(c): 1 + c - 97 for c in range(97, 123)}

    def vector(text):
        t, out = re.sub(r"[^a-z]+", " ", f" {text.lower()} "), np.zeros(size)
        for a, b, c in zip(t, t[1:], t[2:]):
            out += np.roll(v[number.get(a, 0)], 2) * np.roll(v[number.get(b, 0)], 1) * v[number.get(c, 0)]
        return out / np.linalg.norm(out)

    sums = {lang: sum(vector(t) for _, t, k in rows if k == lang) for lang in ("de", "en")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in language_id.identify(docs, language_id.train(docs)).collect():
        cosines = {k: float(vector(r.text) @ s / np.linalg.norm(s)) for k, s in sums.items()}
        assert r.lang_pred == max(cosines, key=cosines.get) and abs(r.score - cosines[r.lang_pred]) < 1e-3


def test_training_samples_are_thinned_alike_however_rows_are_dealt(spark):
    from tidewatch.llm import common

    rows = spark.range(20_000).withColumn("k", F.col("id").cast("string"))
    a, b = ({r.id for r in common.thinned(x, F.col("k"), 500).collect()} for x in (rows, rows.repartition(7, F.lit(1))))
    assert a == b and 500 < len(a) < 720 and common.thinned(rows.limit(0), F.col("k"), 5).count() == 0


def brute_quality(text):
    raw = (text or "").encode()
    w = raw.split()
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in raw.split(b"\n") if x.split()]
    return len(w), sum(len(x.decode()) for x in w), sum(raw.count(c.encode()) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_match_brute_force(spark, sf):
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [t for _, t in corpus()] + ["a\n\na\n b\nb\x0b", "#x", "\n"]
    for t in rows:
        assert quality_rules.measure(t)[0] == brute_quality(t)


def test_quality_verdict_learns_the_labels(spark):
    d = "/root/testdata/sf0.01"
    r = queries.op7_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("NOT base_failed")
    assert r.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.98
    assert r.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.2


def test_quality_verdicts_match_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    verdict = quality_rules.train(docs, labels)
    t = verdict.trees
    for r in quality_rules.judge(docs, verdict).collect():
        counts = brute_quality(r.text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        total, features = t.base, quality_rules.measure(r.text)[1]
        for node in t.roots.tolist():
            while t.feature[node] >= 0:
                node = int(t.left[node] if features[t.feature[node]] <= t.threshold[node] else t.right[node])
            total += t.value[node]
        score = 1 / (1 + np.exp(-total))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*counts, failed)
        assert abs(r.quality_score - score) < 1e-9 and r.kept == (not failed and r.quality_score >= verdict.threshold)


def test_quality_and_urls_of_nothing(spark):
    assert quality_rules.judge(empty(spark), quality_rules.train(empty(spark), empty(spark))).count() == 0
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string, host int")).count() == 0


def test_url_verdicts_of_the_test_table_match_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    d, seen = "/root/testdata/sf0.01", Counter()
    pages = spark.read.parquet(f"{d}/pages.parquet")
    extra = [(-1, None), (-2, ""), (-3, "x"), (-4, "http://A.ORG/x?y#z"), (-5, "a://b.com/fr/" + "q" * 30_000), (-6, "://example.org/en/1"), (-7, "ftp://com/de/"), (-8, "http://ORG/")]
    both = pages.select("page_id", "url").unionByName(spark.createDataFrame(extra, "page_id long, url string"))
    for r in url_filters.filter_urls(both).collect():
        host = path = ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
            host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), re.split("[?#]", rest[k:])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        if fits:
            assert (r.rule, r.verdict) == max(fits)[1:]
        else:
            assert r.rule is None and r.verdict == ("allow" if r.score >= 0.5 else "block")
        seen[bool(fits)] += 1
    assert seen[True] and seen[False]


def test_quality_without_labels_keeps_what_the_base_rules_keep(spark, docs):
    v = quality_rules.train(docs, empty(spark))
    assert quality_rules.judge(docs, v).filter("kept = base_failed").count() == 0


def test_trees_obey_their_constraints_in_both_forms(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=600) > 0).astype(float)
    m = gbt.fit(x, y, trees=15, depth=3, monotone={0: -1, 1: 1})
    for j, sign in ((0, -1), (1, 1)):
        low, high = x.copy(), x.copy()
        high[:, j] += 1.5
        assert (sign * (m.margin(high) - m.margin(low)) >= -1e-12).all()
    df = spark.createDataFrame(x[:50].tolist(), "a double, b double, c double")
    got = [r[0] for r in df.select(m.to_column([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert np.allclose(got, m.probability(x[:50]))


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        ("https://A.Example.ORG/es/1?x=/en/", "a.example.org", "/es/1", "example.org/es/"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"), ("http://x.org", "x.org", "", None), ("http://x.org/", "x.org", "/", "org/"),
        ("http://a.com/fr/", "a.com", "/fr/", "com/fr/"), ("http://a.com/de/?q", "a.com", "/de/", "com/de/"), ("http://notorg/", "notorg", "/", None), ("nothing", "", "", None), (None, "", "", None), ("x://y?z://w", "y", "", None), ("http://badexample.org/es/", "badexample.org", "/es/", "org/"),
    ],
)
def test_url_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url, "mine")], "page_id long, url string, verdict string")
    r = url_filters.filter_urls(df).first()
    assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
    if rule:
        assert r.verdict == ("allow" if rule in ("org/", "com/fr/") else "block")


def test_url_plan_is_native(spark, sf):
    plan = queries.op9_url_filters(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# -- 5, 8, 10 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trees():
    return html_extract.train()


@pytest.mark.parametrize("mix, least", [(0.0, 0.95), (0.4, 0.9)])
def test_extraction_of_generated_pages(trees, mix, least):
    maker, hit, miss, extra = html_extract.Maker(12345, mix), 0, 0, 0
    for _ in range(60):
        page, main = maker.page()
        got = html_extract.extract([page], trees)[0]
        found = sum(len(t) for t in main if t in got)
        hit, miss, extra = hit + found, miss + sum(map(len, main)) - found, extra + max(0, len(got) - found - len(main))
    assert hit / (hit + miss) > least and hit / (hit + extra) > least


def test_extraction_edges(trees):
    body = "This is a long enough paragraph, with several words and a full stop. " * 3
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>A&nbsp;title &amp; more</h1><p>{body}<p>a<b>b</b>c<br>d &lt;x&gt; &#233;</p><script>var x='<p>no</p>'</script><div class='comments'><p>first!</p></div></article><footer>(c)</footer>"
    got = html_extract.extract([page, None, "", "<!-- only", "<p", "<script>never closed", "<div>" * 3000 + "x"], trees)
    assert "abc d <x> é" in got[0] and "no" not in got[0].split() and "Home" not in got[0] and "(c)" not in got[0] and "A title & more" in got[0]
    assert got[1:4] == ["", "", ""] and got[5] == ""


@pytest.mark.parametrize("tag", ["div", "article", "main", "section"])
@pytest.mark.parametrize(
    "name",
    [
        "content", "promo-free content", "post more-text", "entry top-story", "side-by-side article", "main-content share-enabled", "ad-free story", "article header-large",
        "related-article body", "content-with-sidebar",
    ],
)
def test_no_class_token_decides_alone(trees, tag, name):
    texts = ["A title", "This is the first paragraph of a text that goes on for a while, with commas, and more words to follow it. " * 3]
    texts.append("The second one says other things; it is as long as the first, and it ends with a full stop. " * 3)
    inside = f"<h1>{texts[0]}</h1><p>{texts[1]}</p><p>{texts[2]}</p>"
    page = f"<html><body><nav><a href='/'>Home</a> <a href='/x'>News</a></nav><{tag} class='{name}'>{inside}</{tag}><footer>(c) 2024 Us</footer></body></html>"
    assert html_extract.extract([page], trees) == [" ".join(t.strip() for t in texts)]


@pytest.mark.parametrize("around", ["<form>{}</form>", '<form id="aspnetForm" class="form">{}</form>', '<div id="page"><form method="post"><div>{}</div></form></div>'])
def test_a_form_around_the_page_is_no_form(trees, around):
    """Its article stays, and the form that stands in it goes."""
    first = "The river rose in the night, and by morning the lower fields were under water. People came out to look at it. " * 3
    second = "Nobody had seen it so high before; the oldest of them spoke of another spring, long ago, when the bridge went. " * 3
    inner = f"""<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav><div class="content"><h1>High water</h1><p>{first}</p><p>{second}</p></div>
<form class="newsletter"><p>Subscribe to our letter</p><input name="m"><button>Send</button></form><footer><p>Copyright, all rights reserved</p></footer>"""
    got = html_extract.extract(["<html><body>" + around.format(inner) + "</body></html>"], trees)[0]
    assert got == " ".join(["High water", first.strip(), second.strip()])



@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_extraction_of_the_test_table_is_its_articles(spark, d):
    """Against the article element itself, found by name and stripped of tags; white space aside."""
    folder = f"/root/testdata/{d}"
    got = {r.page_id: r for r in queries.op5_html_extraction(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = re.sub(r"<[^>]+>", " ", re.search(r"<article[^>]*>(.*?)</article>", p.html, re.S)[1])
        assert "".join(html.unescape(inside).split()) == "".join(got[p.page_id].text.split()) and got[p.page_id].n_chars == len(got[p.page_id].text)
        assert got[p.page_id].text == " ".join(got[p.page_id].text.split())


def test_extraction_of_nothing_and_of_clashing_columns(spark, trees):
    nothing = spark.createDataFrame([], "page_id long, html string, text string, n_chars int")
    assert html_extract.extract_text(nothing, trees=trees).collect() == []
    odd = spark.createDataFrame([(1, "<article><p>Some words, and more of them here.</p></article>", "mine", 7), (2, None, None, None), (3, "no element at all", "x", 1)], nothing.schema)
    got = {r.page_id: r for r in html_extract.extract_text(odd, trees=trees).collect()}
    assert got[1].text == "Some words, and more of them here." and got[2].text == "" and got[2].n_chars == 0 and got[3].text is not None


def payloads() -> list[bytes]:
    rng = np.random.default_rng(0)
    cases = [bytes(rng.integers(0, 256, 64 * k, dtype=np.uint8)) for k in (1, 3, 129, 300)] + [bytes(64), b"\xff" * 64, bytes(62) + b"\1\xff"]
    return cases + [bytes((rng.random(64 * 30) < p).astype(np.uint8) * rng.integers(1, 4, 64 * 30, dtype=np.uint8)) for p in (0.02, 0.2, 0.6)]


def test_jpeg_round_trip_of_any_bytes():
    cases = payloads()
    files = media_jpeg.write(cases)
    frames, blocks = media_jpeg.read(files)
    assert [media_jpeg.payload(f, blocks) for f in frames] == cases
    assert [media_jpeg.write([c])[0] for c in cases] == files  # alone or beside others
    together = list(media_jpeg.rgb(frames, blocks))
    assert all((next(media_jpeg.rgb(*media_jpeg.read([f]))) == t).all() for f, t in zip(files, together))


def plain_decode(data: bytes) -> tuple[list[list[list[int]]], int, int]:
    """Coefficients of each component's blocks of a file with subsampled chroma, by the letter of the format: one bit at a time."""
    at, tables, comps, blocks, restart, height, width = 2, {}, [], [], 0, 0, 0
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            code, k, words = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    words[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = words
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4) for i in range(body[5])]
            blocks = [[[0] * 64 for _ in range(height // 16 * (width // 16) * h * h)] for _, h in comps]
        elif marker == 0xDA:
            n = body[0]
            of, (first, last, bits) = [[c for c, _ in comps].index(body[1 + 2 * i]) for i in range(n)], body[1 + 2 * n :]
            high, low, end = bits >> 4, bits & 15, at
            while data[end] != 0xFF or data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 1
            pieces, piece, k = [], bytearray(), at
            while k < end:
                if data[k] == 0xFF and data[k + 1]:
                    pieces.append(bytes(piece))
                    piece, k = bytearray(), k + 2
                    continue
                piece.append(data[k])
                k += 2 if data[k] == 0xFF else 1
            pieces.append(bytes(piece))
            at, cols = end, width // 16
            if n == 1:
                units = [[(of[0], b)] for b in range(len(blocks[of[0]]))]
            else:
                units = [[(0, (2 * (m // cols) + y) * 2 * cols + 2 * (m % cols) + x) for y in (0, 1) for x in (0, 1)] + [(1, m), (2, m)] for m in range(len(blocks[1]))]
            assert restart == 1 and len(pieces) == len(units)
            for piece, group in zip(pieces, units):
                stream = iter("".join(f"{x:08b}" for x in piece))
                take = lambda k, stream=stream: int("".join(next(stream) for _ in range(k)) or "0", 2)

                def symbol(words, take=take):
                    code = 0
                    for length in range(1, 17):
                        code = code << 1 | take(1)
                        if (length, code) in words:
                            return words[length, code]
                    raise AssertionError("no code")

                signed = lambda size, take=take: v if (v := take(size)) >> (size - 1) else v - (1 << size) + 1
                before = [0, 0, 0]
                for c, b in group:
                    block = blocks[c][b]
                    if first == 0:
                        if high:
                            block[0] |= take(1) << low
                        else:
                            size = symbol(tables[0])
                            before[c] += signed(size) if size else 0
                            block[0] = before[c] << low
                        continue
                    k, words = first, tables[0x10]
                    while k <= last:
                        s = symbol(words)
                        run, size = s >> 4, s & 15
                        if not high:
                            if not size and run < 15:
                                break
                            k += run
                            if size:
                                block[k] = signed(size) * (1 << low)
                            k += 1
                            continue
                        fresh = (1 if take(1) else -1) << low if size else 0
                        ended = not size and run < 15
                        while k <= last:
                            if block[k]:
                                if take(1):
                                    block[k] += (1 if block[k] > 0 else -1) << low
                            elif not ended:
                                if not run:
                                    block[k] = fresh
                                    k += 1
                                    break
                                run -= 1
                            k += 1
    return blocks, height, width


def test_jpeg_decoder_agrees_with_a_plain_one():
    for case in payloads()[:3] + payloads()[4:]:
        data = media_jpeg.write([case])[0]
        blocks, height, width = plain_decode(data)
        (frame,), found = media_jpeg.read([data])
        assert found.tolist() == [b for c in blocks for b in c] and bytes(x & 255 for c in blocks for b in c for x in b)[: len(case)] == case
        basis = np.zeros((64, 8, 8))
        one = [[(np.sqrt(1 / 8) if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)]
        for z, place in enumerate(media_jpeg.ZIGZAG):
            basis[z] = np.outer(one[place // 8], one[place % 8])
        planes = []
        for c, up in zip(blocks, (1, 2, 2)):
            rows = height // 8 // up
            pixels = np.clip(np.rint(np.tensordot(np.array(c, dtype=float), basis, 1)) + 128, 0, 255).reshape(rows, -1, 8, 8)
            planes.append(pixels.transpose(0, 2, 1, 3).reshape(8 * rows, -1).repeat(up, axis=0).repeat(up, axis=1))
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1), 0, 255)
        assert np.abs(next(media_jpeg.rgb([frame], found)) - want).max() <= 3  # rounding


def test_jpeg_decodes_colour_with_upsampled_chroma():
    """A file made by hand: three components, luma sampled twice as finely, DC only."""
    head = b"\xff\xd8" + media_jpeg._tables() + media_jpeg._segment(0xC2, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    bits = ""
    for v in (80, 0, 0, 0, 40, -24):  # differences of DC in 4 luma blocks, Cb, Cr
        size = abs(v).bit_length()
        bits += f"{size:04b}" + (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    picture = head + media_jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])) + data + b"\xff\xd9"
    t = next(media_jpeg.rgb(*media_jpeg.read([picture])))
    y, cb, cr = 128 + 80 / 8, 40 / 8, -24 / 8
    assert t.shape == (16, 16, 3) and (t == np.rint([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb])).all()


def test_media_query(spark, docs):
    r = media_jpeg.store(docs.withColumn("stored", F.lit(1)), "text").select("text", "stored.*").collect()
    for x in r:
        raw = (x.text or "").encode()
        raw += bytes(-len(raw) % 64 or 64 * (not raw))
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert x.height * x.width * 3 == len(x.rgb)
    t = media_jpeg.tensors(spark.createDataFrame([(b"junk",), (None,), (bytes(r[0].media),)], "media binary")).select("tensor.*").collect()
    assert t[0].height is None and t[1].rgb is None and t[2].rgb == r[0].rgb
    assert media_jpeg.store(empty(spark), "text").count() == 0


def test_viterbi_is_optimal_and_reversible(spark, sf):
    model = public_tokenizers.path("piece_bpe_32k.model")
    v = sentencepiece_viterbi.Vocabulary(model)
    encoder = sentencepiece_viterbi.Encoder(v)

    def best(text):
        t = "▁" + text.replace(" ", "▁")
        score, back = [0.0], [None]
        for k in range(1, len(t) + 1):
            options = [(score[k - 1] + v.unknown, k - 1, -1)] + [(score[s] + v.pieces[t[s:k]][0], s, v.pieces[t[s:k]][1]) for s in range(max(0, k - v.longest), k) if t[s:k] in v.pieces]
            score.append(max(o[0] for o in options))
            back.append(next(o for o in options[1:] + options[:1] if o[0] == score[k]))
        ids, k = [], len(t)
        while k:
            _, s, p = back[k]
            ids = ([p] if p >= 0 else [v.byte_ids[b] for b in t[s:k].encode()]) + ids
            k = s
        return ids

    texts = ["hello world", "  two  spaces ", "tab\tand\nline", "日本語 and ẞ é 👍", "unbroken" * 40, "a" * 500, " ", "x"]
    texts += [r.text[:600] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(10).collect()]
    for t in texts:
        assert encoder(t) == best(t)
        assert sentencepiece_viterbi.joined(encoder(t), v.bytes_of) == t
    s = sentencepiece_viterbi.Stream(v)
    for c in "somelongword" * 500:
        s.push(c)
    assert s.widest <= 4 * v.longest and len(s.committed) > 100


@pytest.mark.parametrize("block", [40, 1 << 15])
def test_blocks_do_not_change_ids(spark, sf, block, monkeypatch):
    """Long texts, runs without a convergence point, empty and null texts, whatever block they are cut into."""
    encoder = sentencepiece_viterbi.Encoder(sentencepiece_viterbi.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    texts = [None, "", "a" * 700, "=" * 300 + " end", "日本語 and ẞ é 👍" * 20, "▁x▁", "\0 \0", prose(9, 20_000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect()]
    whole = [encoder(t) for t in texts]
    monkeypatch.setattr(sentencepiece_viterbi, "BLOCK", block)
    assert [None if x is None else x.tolist() for x in encoder.many(texts)] == whole


def test_search_commits_where_backpointers_converge():
    """Also inside a stretch whose every boundary some match goes across, and so that the window stays small."""
    v = sentencepiece_viterbi.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    encoder, inside, kept = sentencepiece_viterbi.Encoder(v), 0, []
    for seed in range(200):
        text = "▁" + prose(seed, 60).replace(" ", "") + "tion" * (seed % 4)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)[: 60 + seed]
        out, done = encoder._search(v.classes[codes], codes, False)
        whole, _ = encoder._search(v.classes[codes], codes, True)
        stream = sentencepiece_viterbi.Stream(v)
        for c in codes.tolist():
            stream.push(chr(c))
        stream.converge()
        assert done == stream.done  # the character-by-character walk comes to the same boundary
        assert [(i, int(p)) for i, p in enumerate(out[:done]) if p > -2] == stream.committed == [(i, int(p)) for i, p in enumerate(whole[:done]) if p > -2]
        crossed = any(text[a:b] in v.pieces for a in range(max(0, done - v.longest), done) for b in range(done + 1, min(len(codes), a + v.longest) + 1))
        inside += crossed and done > 0
        kept.append(len(codes) - done)
    assert inside > 20 and np.median(kept) <= 2 * v.longest


@pytest.mark.parametrize("text", ["=" * 200_000, " " * 200_000, "a" * 200_000, "ab" * 100_000, "\n" * 200_000])
def test_sentencepiece_of_long_runs_takes_linear_time(text):
    v = sentencepiece_viterbi.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    began = time.process_time()
    ids = sentencepiece_viterbi.Encoder(v)(text)
    assert sentencepiece_viterbi.joined(ids, v.bytes_of) == text and time.process_time() - began < 30


def test_sentencepiece_of_nothing(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    nothing = spark.createDataFrame([], "doc_id long, text string, digest string, ids string")
    assert sentencepiece_viterbi.digest(nothing, model).count() == 0 and sentencepiece_viterbi.encode(nothing, model).count() == 0


def test_encode_and_decode_columns(spark, docs):
    model = public_tokenizers.path("piece_bpe_32k.model")
    r = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(docs, model), model).collect()
    assert all(x.decoded == x.text for x in r) and all((x.ids is None) == (x.text is None) for x in r)
    assert queries.op10_sentencepiece.__doc__ and sentencepiece_viterbi.digest(docs, model).filter("digest.round_trip = false").count() == 0


# -- pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = (before, docs.collect())
    before, after = kept["n-gram Jaccard join"]
    rows = [(r.doc_id, r.text) for r in before]
    assert {r.doc_id for r in after} == {i for i, _, c in brute_components(rows) if i == c}
    before, after = kept["suffix-array dedup"]
    want = {k[0]: k[4] for k in brute_bytes([(r.doc_id, r.text) for r in before], corpus_pipeline.PASSAGE_BYTES)}
    assert sum(k[2] > 0 for k in brute_bytes([(r.doc_id, r.text) for r in before], corpus_pipeline.PASSAGE_BYTES)) > 0
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] or not r.text.isascii() for r in after) and all(r.n_chars == len(r.text) for r in after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in after}


def test_stages_of_nothing(spark, sf):
    nothing = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


def test_run_is_the_stages_together(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_near_duplicates_keep_one_row_of_each_group(spark):
    same, other, lone, named = prose(101, 200), prose(102, 200), prose(103, 200), prose(104, 200)
    near = " ".join(same.split()[:-1] + ["changed"])
    assert min(map(len, (same, other, lone, named))) > 400
    rows = [
        (1, same, "b"), (1, same, "a"), (1, same, "a"), (2, near, "a"), (None, same, "a"),  # repeated rows, a near copy and a null id
        (None, other, "a"), (None, other, "a"), (None, lone, "a"),  # null ids only
        (3, named, "a"), (4, prose(105, 200), "a"), (4, named, "a"),  # a namesake of a survivor is a copy
        (5, "", "a"), (5, "", "a"), (None, None, "a"), (6, " \t\n", "a"),  # without words
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stay = corpus_pipeline.near_duplicates(spark, docs, "")
    want = [(1, same, "a"), (None, other, "a"), (None, lone, "a"), (3, named, "a"), (4, rows[9][1], "a"), *rows[11:]]
    assert stay.columns == docs.columns and Counter(tuple(r) for r in stay.select("doc_id", "text", "source").collect()) == Counter(want)
    rest = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(stay.collect(), docs.schema), "")
    assert Counter(tuple(r) for r in rest.select("doc_id", "text", "source").collect()) == Counter(want)
