"""Runnable checks of the incremental jobs: a stream is run to its end, then its tables are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import attempts as A
from gleaner.plans import stage
from gleaner.plans.queries_facets import ORACLE_AG11
from gleaner.plans.queries_io import LOG, log_lines_of
from gleaner.plans.registry import query
from gleaner.session import work_folder
from gleaner.streaming import sync as S


def in_parts(spark, sf, name, key, root, run):
    """A driver table that lands in four parts by `key` modulo 4: three are read by one stream as they arrive, the last one by
    a stream with a new checkpoint over the same tables. `run(stream, checkpoint)` is called for each."""
    table = stage.table(spark, sf, name)
    for k in range(4):
        folder, checkpoint = (f"{root}/land/first", f"{root}/ck-first") if k < 3 else (f"{root}/land/later", f"{root}/ck-later")
        table.filter(F.pmod(key, F.lit(4)) == k).write.mode("append").parquet(folder)
        run(spark.readStream.schema(table.schema).parquet(folder), checkpoint)


# events arrive in stretches of this many ids, dealt to the four parts in turn
SPAN = 50


@query("ss1_sync_stream", """
WITH i AS (SELECT 's' || length(CAST(user_id AS VARCHAR)) AS source, CAST(user_id AS VARCHAR) AS id, event_id AS pos,
                  event_id // 50 % 4 AS part FROM events)
SELECT 'pool' AS list, source, id, min(struct_pack(part := part, pos := pos)).pos AS pos FROM i WHERE id NOT LIKE '%7' GROUP BY ALL
UNION ALL SELECT DISTINCT 'dead', source, id, NULL FROM i WHERE id LIKE '%7'""", filled=["pos"])
def ss1(spark, sf):
    """First event of a user is its item; ids ending in 7 never land. A last run is offered everything again and takes nothing."""
    root = work_folder(spark, "sync")
    uid = F.col("user_id").cast("string")
    land = lambda df: df.filter("id NOT LIKE '%7'")

    def run(stream, checkpoint):
        items = stream.select(F.concat(F.lit("s"), F.length(uid).cast("string")).alias("source"), uid.alias("id"),
                              F.col("event_id").alias("pos"))
        S.sync_stream(items, f"{root}/pool", f"{root}/dead", checkpoint, land, ["pos"])

    in_parts(spark, sf, "events", F.floor(F.col("event_id") / SPAN), root, run)
    run(spark.readStream.schema(stage.table(spark, sf, "events").schema).parquet(f"{root}/land/first"), f"{root}/ck-again")
    pool = spark.read.parquet(f"{root}/pool").select(F.lit("pool").alias("list"), "source", "id", "pos")
    dead = S.read_or_empty(spark, f"{root}/dead", S.DEAD).select(
        F.lit("dead").alias("list"), "source", "id", F.lit(None).cast("bigint").alias("pos"))
    return pool.unionByName(dead)


@query("ss2_dead_letters", """
SELECT DISTINCT 's' || user_id % 3 AS source, CAST(user_id AS VARCHAR) AS id FROM events
WHERE CAST(user_id AS VARCHAR) LIKE '%7' AND user_id % 3 <> 1""")
def ss2(spark, sf):
    """Dead letters left after one source was cleared for a retry; a user fails once, however often it is offered."""
    root = work_folder(spark, "dead")

    def run(stream, checkpoint):
        items = stream.select(F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("pos"))
        S.sync_stream(items, f"{root}/pool", f"{root}/dead", checkpoint, lambda df: df.filter("id NOT LIKE '%7'"), ["pos"])

    in_parts(spark, sf, "events", F.floor(F.col("event_id") / SPAN), root, run)
    return S.read_or_empty(spark, S.retry_dead(spark, f"{root}/dead", f"{root}/dead-2", ["s1"]), S.DEAD)


@query("ss3_source_ledger_stream", """
WITH o AS (SELECT *, o_orderkey % 4 AS part FROM orders),
last AS (SELECT o_orderpriority AS name, max(part) AS part, count(DISTINCT part) AS runs FROM o GROUP BY 1)
SELECT name, strftime(max(o_orderdate), '%Y-%m-%d') AS last_run, runs, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS last_current
FROM last JOIN o ON o.o_orderpriority = name AND o.part = last.part GROUP BY name, runs""")
def ss3(spark, sf):
    """Orders as run results in four arrivals: the newest of a source in an arrival is its run."""
    root = work_folder(spark, "ledger")

    def run(stream, checkpoint):
        S.source_ledger_stream(stream.select(
            F.col("o_orderpriority").alias("source"),
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("run_date"),
            F.col("o_orderkey").alias("current"), F.lit(0).alias("new"), F.lit(0).alias("ingested"), F.lit("").alias("error"),
            F.lit(False).alias("rate_limited")), root, checkpoint)

    in_parts(spark, sf, "orders", F.col("o_orderkey"), root, run)
    out = S.ledger(spark, root)
    return out.select("name", F.substring("last_run", 1, 10).alias("last_run"), "runs", "last_current")


@query("ss4_progress_stream", f"""WITH {LOG}, newest AS (SELECT max(log_time) AS t FROM log)
SELECT strftime(log_time, '%Y-%m-%d %H:%M:%S') AS at, stage, done, total,
       date_trunc('minute', t) + INTERVAL 70 SECOND - log_time < INTERVAL 60 SECOND AS live FROM log, newest WHERE stage IS NOT NULL
ORDER BY log_time DESC, done DESC NULLS LAST LIMIT 1""", filled=["done", "total"])
def ss4(spark, sf):
    """Log lines in four arrivals; alive as seen 70 seconds after the minute of the last line."""
    root = work_folder(spark, "progress")
    in_parts(spark, sf, "events", F.col("event_id"), root, lambda stream, checkpoint: S.progress_stream(
        A.stage_events(log_lines_of(stream)), root, checkpoint))
    last = stage.table(spark, sf, "events").agg(F.date_trunc("minute", F.max("ts")).cast("timestamp").alias("t"))
    out = S.progress(spark, root, last.scalar() + F.expr("INTERVAL 70 SECONDS"))
    return out.select(F.date_format("log_time", "yyyy-MM-dd HH:mm:ss").alias("at"), "stage", "done", "total", "live")


@query("ss5_attempt_stats_stream", ORACLE_AG11)
def ss5(spark, sf):
    root = work_folder(spark, "attempts")
    schema = "arm string, record_id string, at timestamp_ntz, seq bigint, ok boolean, seconds decimal(18,2)"

    def run(stream, checkpoint):
        S.attempt_stats_stream(stream.select(
            F.col("event_type").alias("arm"), F.col("user_id").cast("string").alias("record_id"), F.col("ts").alias("at"),
            F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"),
            F.col("value").cast("decimal(18,2)").alias("seconds")), root, checkpoint, schema)

    in_parts(spark, sf, "events", F.col("event_id"), root, run)
    return A.attempt_stats(S.last_attempts(spark, root, schema))
