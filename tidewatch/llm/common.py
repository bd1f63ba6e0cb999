"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder, for tables that outlive the executors which wrote them.

    The cluster names that folder in ``spark.checkpoint.dir``; only a session on one machine (tests) may leave it unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidewatch-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more."""
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them for the size of its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """128 bits in two columns that name a document: rows with equal id and equal text are the same one, all others are distinct."""
    parts = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`")
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def thinned(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """A sample of about 1.2 times ``rows`` rows of ``df`` by the hash of ``key``, or all of fewer: what a training set is picked from.

    Which rows stay does not depend on how they are dealt out, and no task keeps more than its share.
    """
    share = min(1.0, 1.2 * rows / max(1, df.count()))
    return df.filter(F.shiftrightunsigned(F.xxhash64(key), 11) <= int(share * (1 << 53)))


def even_labels(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of ``parts`` partitions that ``repartition(parts, column)`` sends there: one bucket each, none empty."""
    tried = spark.range(0, 40 * parts + 400, 1, 1).select(F.col("id").cast("int").alias("x"))
    found = dict(tried.groupBy(F.expr(f"pmod(hash(x), {parts})").alias("p")).agg(F.min("x")).collect())
    return [found.get(p, p) for p in range(parts)]
