"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A trigram's vector is the product of its letters' vectors, each
rolled by its place, a document's is the sum over its trigrams, and a language's prototype is the sum over its training
documents, each scaled to length one.  A document gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions of the vectors.
DIM = 512
#: Letters share so many symbols besides the space; those beyond a-z are dealt out by code point.
SYMBOLS = 47
#: Training documents of each language, at most.
TRAIN_PER_LANGUAGE = 1500
#: Of a training document; prediction reads whole texts.
SEED = 20240229


def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (SYMBOLS + 1, DIM), dtype=np.int8) * 2 - 1


def trigram_vectors() -> np.ndarray:
    """The bound vectors of all trigrams of symbols."""
    v = letter_vectors()
    pair = np.roll(v, 2, axis=1)[:, None, :] * np.roll(v, 1, axis=1)[None, :, :]
    return (pair.reshape(-1, 1, DIM) * v[None, :, :]).reshape(-1, DIM)


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of every code point: 0 for all that is no letter."""
    table = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            table[c] = 1 + (ord(s) - 97 if "a" <= s <= "z" else 26 + c % (SYMBOLS - 26))
    return table


class Profiler:
    """Turns texts into document vectors."""

    def __init__(self) -> None:
        self.symbols, self.vectors, self.size = symbol_table(), trigram_vectors(), SYMBOLS + 1

    def __call__(self, text: str | None) -> np.ndarray | None:
        """The bundled vector scaled to length one; None without a letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        s = self.symbols[codes]
        if not s.any():
            return None
        keep = np.ones(len(s), dtype=bool)  # one space between words
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s = np.concatenate([[0], s[keep], [0]])
        grams = (s[:-2] * self.size + s[1:-1]) * self.size + s[2:]
        if len(grams) < 4000:
            kinds, counts = np.unique(grams, return_counts=True)
        else:
            counts = np.bincount(grams, minlength=self.size**3)
            kinds = np.flatnonzero(counts)
            counts = counts[kinds]
        v = counts.astype(np.float32) @ self.vectors[kinds].astype(np.float32)
        norm = float(np.sqrt(v @ v))
        return v / norm if norm > 0 else v


@dataclass
class Prototypes:
    languages: list[str]
    vectors: np.ndarray

    def nearest(self, v: np.ndarray) -> tuple[str, float]:
        if not self.languages:
            return "und", 0.0
        cosines = self.vectors @ v
        best = int(cosines.argmax())
        return self.languages[best], float(min(1.0, max(0.0, cosines[best])))


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = TRAIN_PER_LANGUAGE) -> Prototypes:
    """Prototypes from at most ``per_language`` documents of each language, those of the smallest hash of the id.

    They are ranked among those that a threshold on the hash leaves of each language, so a language in most rows is no large
    group.  Tasks bundle their own documents; the driver gets one vector for each language and task that had any.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and id is not null")
    count = {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()}  # one row for each language
    if not count:
        return Prototypes([], np.zeros((0, DIM), dtype=np.float32))
    share = F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, int(min(1.0, 1.2 * per_language / n) * (1 << 53)))])
    picked = picked.filter(F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 11) <= share[F.col("lang")])
    rank = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    ids = picked.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= per_language).select("id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    few = texts.join(F.broadcast(ids), "id", "left_semi")  # bounded: per_language ids of each language

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profile, sums = Profiler(), {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if (v := profile(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + v
        yield pd.DataFrame([(k, v.astype("<f4").tobytes()) for k, v in sorted(sums.items())], columns=["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for row in few.select("lang", "text").mapInPandas(bundle, "lang string, v binary").collect():
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["v"], dtype="<f4").astype(float)
    names = sorted(total)
    vectors = np.array([total[k] / (np.linalg.norm(total[k]) or 1) for k in names], dtype=np.float32).reshape(len(names), DIM)
    return Prototypes(names, vectors)


def identify(docs: DataFrame, prototypes: Prototypes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` (the cosine, 0 to 1) beside the columns of ``docs``, of which those names are replaced.

    A text that is null, empty or has no letter gets ``und`` and 0.  Of equal cosines the alphabetically first language
    wins.  Rows are independent of each other, so repeated rows get equal values and an empty table stays empty.
    """
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        profile = Profiler()
        for batch in batches:
            found = [("und", 0.0) if (v := profile(t)) is None else prototypes.nearest(v) for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    found = docs.select(*kept, predict(F.col(text_col).cast("string")).alias("__found"))
    return found.select(*kept, "__found.lang_pred", "__found.score")
