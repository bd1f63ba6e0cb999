"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, ngram_join, quality_rules, suffix_dedup
from tidewatch.llm import queries as llm

#: No stage can be written in SQL as a whole; tests hold ``run`` against brute force.
ORACLE_SQL = None
#: Documents below this cosine with their nearest language are rejected, as are those without a letter.
LEAST_COSINE = 0.15
#: Bytes from which on a string that stands elsewhere too is a repeated passage: some 30 to 35 words, so that a passage of 50
#: short words is one too.  (The operator's own query asks for 400.)
PASSAGE_BYTES = 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that resemble no known language."""
    found = llm.languages(docs)
    return found.filter((found["lang_pred"] != "und") & (found["score"] >= LEAST_COSINE)).select(*docs.columns)


def quality_rule(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the base rules or the trees refuse."""
    verdict = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, verdict).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of the smallest id, null last, then of the smallest key and columns.

    Rows without a word are in no group and all stay.  Rows with equal id and text fall together before any is dealt out.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    row = F.struct(*[F.col(c) for c in docs.columns if c != "text"], F.col("text"))
    key, key2 = common.row_keys()
    distinct = docs.filter(worded).groupBy(key.alias("key"), key2.alias("key2")).agg(F.min(row).alias("row"))
    stay = distinct.join(ngram_join.survivors(docs.select("doc_id", "text")), ["key", "key2"], "left_semi").select("row.*").select(*docs.columns)
    return stay.unionByName(docs.filter(~worded))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that stand elsewhere in the corpus too; ``n_chars`` counts what is left."""
    rest = suffix_dedup.remove_repeats(docs, PASSAGE_BYTES, keep=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    return llm.tokens_packed(docs)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rule),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.cut_lineage(stage(spark, docs, sf_dir), folder, str(i))
    return STAGES[-1][1](spark, docs, sf_dir)
