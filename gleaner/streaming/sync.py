"""Incremental jobs over landed files: ingest, dead letters, ledgers, attempts, progress.

Every stream runs `availableNow` with a checkpoint and writes through `foreachBatch`. What was
already taken is looked up in the pool tables; the last attempts and the newest stage are kept in
Spark's state store. Replaying a batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from gleaner.operators.attempts import is_live, newest_stage
from gleaner.operators.joins import first_occurrence
from gleaner.operators.ranking import latest_attempt


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A parquet table, or no rows while nothing has been written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    query = (stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
             .trigger(availableNow=True).foreachBatch(each).start())
    query.awaitTermination()
    return query


# --- ingest with dead letters ------------------------------------------------
DEAD = "source string, id string"
POOL_PARTS = 16


def pool_part(c: str = "id") -> Column:
    """Folder of the pool an id is kept in."""
    return F.pmod(F.xxhash64(c), F.lit(POOL_PARTS)).cast("int")


def sync_stream(items: DataFrame, pool: str, dead: str, checkpoint: str,
                landed: Callable[[DataFrame], DataFrame] | None = None,
                order: list[str] | None = None) -> StreamingQuery:
    """Takes new items of a stream(source, id, …) into the pool folder, failures into the dead-letter folder.

    `landed` returns the items that could be ingested (default: all). An item is new when its id is neither
    pooled nor dead-lettered for its source; the first occurrence in a batch counts. The pool is kept in
    folders by `part`, a hash of the id; a batch reads the ids of the folders it touches.
    """
    spark = items.sparkSession
    order = order or [c for c in items.columns if c != "id"]
    kept = StructType([*items.schema.fields, StructField("part", IntegerType())])

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.withColumn("part", pool_part()).persist()
        fresh = None
        try:
            touched = [r.part for r in batch.select("part").distinct().collect()]     # at most POOL_PARTS numbers
            have = read_or_empty(spark, pool, kept).filter(F.col("part").isin(touched)).select("part", "id")
            gone = read_or_empty(spark, dead, DEAD)
            fresh = first_occurrence(
                batch.join(have, ["part", "id"], "left_anti").join(gone, ["source", "id"], "left_anti"), ["id"], order).persist()
            took = fresh if landed is None else landed(fresh)
            failed = fresh.join(took.select("id"), "id", "left_anti").select("source", "id")
            took.select(*items.columns, "part").repartition("part").write.mode("append").partitionBy("part").parquet(pool)
            if landed is not None:
                failed.write.mode("append").parquet(dead)
        finally:
            batch.unpersist()
            if fresh is not None:
                fresh.unpersist()

    return run_available(items, checkpoint, each)


def retry_dead(spark: SparkSession, dead: str, cleared: str, sources: list[str] | None = None) -> str:
    """Writes the dead letters without the retried sources (all by default) to `cleared`; returns that path."""
    kept = read_or_empty(spark, dead, DEAD)
    kept = kept.filter(~F.col("source").isin(sources)) if sources else kept.filter(F.lit(False))
    kept.write.mode("errorifexists").parquet(cleared)
    return cleared


# --- tables kept by batches ---------------------------------------------------
# A batch writes what it changed to a folder of its own, named by stream and batch: a replayed batch writes the same folder again,
# and a stream with a new checkpoint adds to what others wrote. Readers merge the rows by an order the rows carry, so the order
# of the batches does not matter. `compacted` writes the merged rows to a new root.
def query_of(spark: SparkSession) -> str:
    """Id of the stream whose batch is being written."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def write_batch(changed: DataFrame, root: str, batch: int) -> None:
    changed.write.mode("overwrite").parquet(f"{root}/changes/stream={query_of(changed.sparkSession)}/batch={batch}")


def changes(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows that batches wrote under a root."""
    rows = read_or_empty(spark, f"{root}/changes", schema)
    return rows.drop("stream", "batch")


def compacted(merged: DataFrame, root: str) -> str:
    """Writes the merged rows of a table as the first batch of a new root; streams go on there. Returns the root."""
    merged.write.mode("errorifexists").parquet(f"{root}/changes/stream=merged/batch=0")
    return root


LEDGER = ("name string, last_run string, runs bigint, last_current bigint, last_new bigint, last_ingested bigint, "
          "error string")
RUNS = ("source string, run_date string, current bigint, new bigint, ingested bigint, error string, rate_limited boolean, "
        "arrived timestamp")


def source_ledger_stream(results: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keeps the runs of every source from a stream of run results; `ledger` reads them.

    results(source, run_date, current, new, ingested, error, rate_limited); the newest of a source in a batch is its run.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        last = first_occurrence(batch, ["source"], [F.desc("run_date")]).withColumn("arrived", F.current_timestamp())
        names = [c.split()[0] for c in RUNS.split(", ")]
        write_batch(last.select(*names), root, batch_id)

    return run_available(results, checkpoint, each)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The per-source ledger: number of runs, the newest arrival's date and error, the counts of the newest that was not rate-limited."""
    counts, newest = F.struct("current", "new", "ingested"), F.struct("arrived", "run_date")
    polled = F.when(~F.coalesce("rate_limited", F.lit(False)), newest)
    per = changes(spark, root, RUNS).groupBy(F.col("source").alias("name")).agg(
        F.max_by("run_date", newest).alias("last_run"), F.count(F.lit(1)).alias("runs"), F.max_by(counts, polled).alias("_c"),
        F.max_by(F.coalesce("error", F.lit("")), newest).alias("error"))
    value = lambda c: F.coalesce(F.col("_c")[c], F.lit(0)).alias(f"last_{c}")
    return per.select("name", "last_run", "runs", value("current"), value("new"), value("ingested"), "error")


ATTEMPTS = "arm string, record_id string, at timestamp, seq bigint, ok boolean, seconds double"


def attempt_stats_stream(attempts: DataFrame, root: str, checkpoint: str, schema: str = ATTEMPTS) -> StreamingQuery:
    """Keeps the last attempt per (arm, record) of an append-only log in Spark's state store; `last_attempts` reads what changed."""
    kept = StructType.fromDDL(schema)
    last = latest_attempt(attempts.select(*[F.col(f.name).cast(f.dataType) for f in kept]))
    return run_available(last, checkpoint, lambda batch, n: write_batch(batch, root, n), "update")


def last_attempts(spark: SparkSession, root: str, schema: str = ATTEMPTS) -> DataFrame:
    """The last attempt per (arm, record) of what `attempt_stats_stream` keeps."""
    return latest_attempt(changes(spark, root, schema))


PROGRESS = "log_time timestamp, stage string, done bigint, total bigint"
NEWEST = ["log_time", "done"]


def progress_stream(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Newest stage of a growing log, in Spark's state store. events(log_time, stage, done, total)."""
    return run_available(newest_stage(events, NEWEST), checkpoint, lambda batch, n: write_batch(batch, root, n), "update")


def progress(spark: SparkSession, root: str, now: Column) -> DataFrame:
    """The newest stage, and whether its line is young enough for the run to be alive."""
    return newest_stage(changes(spark, root, PROGRESS), NEWEST).withColumn("live", is_live(F.col("log_time"), now))
