"""Tables kept in folders by a hash of their key: a change rewrites the folders it falls in and leaves the others' files alone.

The rows of the touched folders are read (Spark prunes the others), merged, and replace the old ones by Spark's dynamic partition
overwrite, which stages all new files beside the table and takes the old ones away after the last of them is written. Each folder
written holds one row with a null key, which readers leave out, so that a folder that loses its last row is replaced too. One
writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gleaner.operators.sync import upsert
from gleaner.operators.vectors import Embedder, build_index, embedded, index_rows, reusable_rows
from gleaner.streaming.sync import read_or_empty

PART, OWN = "part", "_own"
WRITERS = 64     # tasks the folders of a write are dealt to at least, if the session has as many


def part_of(key: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def read_folders(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """The table's rows with their folder number; none while nothing was written."""
    kept = StructType([*[StructField(f.name, f.dataType) for f in schema if f.name != PART], StructField(PART, IntegerType())])
    return read_or_empty(spark, path, kept).filter(F.col(key).isNotNull())


def dealt(rows: DataFrame, key: str, parts: int, touched: int) -> DataFrame:
    """Rows whose key is not null in tasks that write the folders, with the columns `part` and `own` the tasks go by. `touched` folders
    are `WRITERS` tasks at least: where they are few, their rows may be many."""
    own = F.pmod(F.hash(key), F.lit(-(-WRITERS // touched)))
    placed = rows.filter(F.col(key).isNotNull()).withColumn(PART, part_of(key, parts)).withColumn(OWN, own)
    # neither is null; said here, for an inner join on them says it too, and Spark then sees that it has dealt these rows before
    return placed.filter(F.col(PART).isNotNull() & F.col(OWN).isNotNull()).repartition(PART, OWN)


def replace_folders(rows: DataFrame, path: str, touched: list[int]) -> None:
    """Replaces the touched folders by the rows, which may come from them. They have the column `part` and lie in the tasks that write them."""
    marks = rows.sparkSession.createDataFrame([(p,) for p in touched], f"{PART} int").coalesce(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != PART], PART)
    rows.unionByName(marks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def write_folders(rows: DataFrame, path: str, key: str, parts: int, touched: list[int] | None = None) -> None:
    """Replaces the touched folders (default: all) by the rows, which have to lie in them; rows with a null key are left out."""
    touched = list(range(parts)) if touched is None else touched
    if touched:
        replace_folders(dealt(rows, key, parts, len(touched)).drop(OWN), path, touched)


def touched_parts(keys: DataFrame, key: str, parts: int) -> list[int]:
    """Folders that hold the keys: at most `parts` numbers."""
    return sorted(r[0] for r in keys.filter(F.col(key).isNotNull()).select(part_of(key, parts)).distinct().collect())


def merge_folders(changes: DataFrame, path: str, schema: StructType, key: str, parts: int,
                  merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Writes `merge(current rows, changes)` of the folders the changes fall in; returns their numbers."""
    spark = changes.sparkSession
    touched = touched_parts(changes, key, parts)
    current = read_folders(spark, path, schema, key).filter(F.col(PART).isin(touched)).drop(PART)
    write_folders(merge(current, changes), path, key, parts, touched)
    return touched


def upsert_records(changes: DataFrame, path: str, schema: StructType, order: str | None = None, *, key: str = "id", parts: int = 256) -> list[int]:
    """Keyed upsert into a table of `schema`: the last change of a key wins, columns the changes lack stay as they are."""
    return merge_folders(changes.filter(F.col(key).isNotNull()), path, schema, key, parts, lambda current, new: upsert(current, new, key, order))


SHOWN = ["title", "url", "kind", "text", "timestamp"]


def update_index(records: DataFrame, embed: Embedder, path: str, parts: int = 256) -> list[int]:
    """Brings a stored index up to date with the records: new, changed and dropped ones; returns the folders rewritten.

    A folder is rewritten if any of its rows differs in place, document hash or what is shown; vectors of rows that are still right
    are kept, so only the rest are embedded.
    """
    spark = records.sparkSession
    here = part_of("id", parts)
    narrow = lambda rows: rows.select("record_id", "row_pos", "doc_hash", F.xxhash64(*SHOWN).alias("shown"))
    empty = build_index(records.limit(0), embed).schema
    stored = read_folders(spark, path, empty, "record_id")
    wanted, had = narrow(index_rows(records)).withColumn("side", F.lit(1)), narrow(stored).withColumn("side", F.lit(-1))
    # equal rows of both sides cancel out
    differing = wanted.unionByName(had).groupBy("record_id", "row_pos", "doc_hash", "shown").agg(F.sum("side").alias("n")).filter("n <> 0")
    touched = touched_parts(differing, "record_id", parts)
    if touched:
        # records and stored rows are dealt to the folders' writers first, by the same columns; what follows needs no other exchange
        with _part_of_the_keys(spark):
            old = dealt(stored.filter(F.col(PART).isin(touched)), "record_id", parts, len(touched))
            rows = reusable_rows(dealt(records.filter(here.isin(touched)), "id", parts, len(touched)), old, (PART, OWN))
            replace_folders(embedded(rows, embed).drop(OWN), path, touched)
    return touched


@contextmanager
def _part_of_the_keys(spark: SparkSession) -> Iterator[None]:
    """Spark joins sides that are dealt alike by some of the keys as they lie, else only those dealt by all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_index(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_folders(spark, path, schema, "record_id").drop(PART)
