"""Written intermediate tables and small helpers the operators here have in common."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.prefix import attach
from gleaner.session import work_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: computed once, safe against lost executors."""
    short_batches(df.sparkSession)
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def of_each_label(rows: DataFrame, label: str, key: Column, n: int, order: list[str], distinct: bool = False) -> DataFrame:
    """At most `n` rows of every label, those whose key has the smallest hashes (ties by `order`); of equal rows one, if asked.

    The labels are counted first, over all rows, so that a label is never too rare to be seen. A share of each label's hashes,
    about eight times what is wanted and in any case its smallest, is let through where the rows are read; only that is ranked.
    """
    hashed = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64(key), 2))
    counted = hashed.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_least"))
    share = F.least(F.lit(8.0 * n) / F.col("_n"), F.lit(1.0)) * float(1 << 62)
    limits = written(counted.select(label, F.greatest(F.col("_least"), share.cast("long")).alias("_limit")), "label-limits")
    near = attach(hashed, limits, [label]).filter(F.col("_h") <= F.col("_limit")).drop("_limit")
    if distinct:
        near = near.distinct()
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", *order))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= n).select(*rows.columns)


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Lets Spark send texts to Python a thousand rows at a time; with its default of 10,000 a batch of long texts is large on
    both sides. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices: texts as Python objects take several times their size, so a task holds few at a time. What is free
    at the end goes back to the system, for Spark keeps the process for later tasks."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only
    if trim:
        trim(0)
