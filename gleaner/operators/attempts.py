"""Run logs and run reports: attempts, stages, sources, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.text import present
from gleaner.operators.ranking import latest_attempt


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """Per arm: ok, failed and mean seconds over the last attempt at each record."""
    last = latest_attempt(attempts)
    return last.groupBy("arm").agg(
        F.count_if("ok").alias("ok"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"),
        (F.coalesce(F.sum("seconds"), F.lit(0)).cast("double") / F.count(F.lit(1))).alias("avg_seconds"))


def attempt_notes(stats: DataFrame, scored: DataFrame, sample_size: int | Column) -> DataFrame:
    """stats plus a note: abandoned arms (nothing ok, never scored) and arms stopped early."""
    size = F.lit(sample_size) if isinstance(sample_size, int) else sample_size
    tried = F.col("ok") + F.col("failed")
    marked = stats.join(scored.select("arm", F.lit(True).alias("_scored")), "arm", "left")
    note = (F.when(F.col("_scored").isNull() & (F.col("ok") == 0), "abandoned")
            .when(tried < size, F.concat(F.lit("stopped at "), tried.cast("string"), F.lit("/"), size.cast("string")))
            .otherwise(""))
    return marked.select(*stats.columns, tried.alias("attempted"), note.alias("note"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """stage outcomes(record_id, stage, status) -> total, with_errors, clean records."""
    per = outcomes.groupBy("record_id").agg(F.bool_or(F.col("status") == "error").alias("bad"))
    return per.agg(F.count(F.lit(1)).alias("total"), F.count_if("bad").alias("with_errors"),
                   F.count_if(~F.col("bad")).alias("clean"))


def stage_tallies(outcomes: DataFrame, statuses: tuple[str, ...] = ("ok", "skip", "error")) -> DataFrame:
    """stage × status counts."""
    return (outcomes.groupBy("stage").pivot("status", list(statuses)).agg(F.count(F.lit(1)))
            .select("stage", *[F.coalesce(s, F.lit(0)).alias(s) for s in statuses]))


def source_outcomes(state: DataFrame) -> DataFrame:
    """Per source and overall (`level` 1) from state(name, last_current, last_new, last_ingested, failed, error)."""
    return (state.rollup("name").agg(
        F.grouping_id().alias("level"), F.sum("last_current").alias("current"), F.sum("last_new").alias("new"),
        F.sum("last_ingested").alias("ingested"), F.sum("failed").alias("failed"),
        F.count_if(present("error")).alias("errors")))


def discover_summary(found: DataFrame, store: DataFrame, min_score: float = K.MIN_CANDIDATE_SCORE) -> DataFrame:
    """One row: found and kept of this run's scored candidates, pending of the store after it.

    found(id, score), store(id, state) already holds the kept ones.
    """
    run = found.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("score") >= min_score).alias("kept"))
    pending = store.agg(F.count_if(F.col("state") == "new").alias("pending"))
    return run.withColumn("pending", pending.scalar())


def coverage_report(runs: DataFrame, elapsed_seconds: Column) -> DataFrame:
    """runs(status, duration): transcribed, silent, failed, and audio seconds per elapsed second.

    Only records that did not fail count as audio; elapsed time below a second counts as one.
    """
    audio = F.coalesce(F.sum(F.when(F.col("status") != "failed", F.col("duration"))), F.lit(0)).cast("double")
    return runs.agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "silent").alias("silent"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        (audio / F.greatest(elapsed_seconds, F.lit(1.0))).alias("realtime"))


def stage_events(lines: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Log lines -> (log_time, stage, done, total); lines without a stage are dropped.

    Lines start with an ISO-like time; `[stage] … (i/n)` or `collection … page …` name the stage.
    """
    v = F.col(value)
    tagged = F.regexp_extract(v, K.LOG_STAGE, 1)
    listing = F.contains(v, F.lit("collection ")) & F.contains(v, F.lit(" page "))
    stage = F.when(tagged != "", tagged).when(listing, "enumerate")
    count = lambda g: F.when(tagged != "", F.regexp_extract(v, K.LOG_COUNT, g).try_cast("bigint"))
    return (lines.select(
        *(keep or []), F.try_to_timestamp(F.substring(v, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("log_time"),
        stage.alias("stage"), count(1).alias("done"), count(2).alias("total"))
        .filter("stage IS NOT NULL"))


def newest_stage(events: DataFrame, order: list[str]) -> DataFrame:
    """The newest stage with its progress, as one partial aggregate."""
    return events.agg(F.max_by(F.struct("log_time", "stage", "done", "total"), F.struct(*order)).alias("e")) \
        .select("e.*").filter("stage IS NOT NULL")


def is_live(written: Column, now: Column) -> Column:
    return now - written < F.make_dt_interval(secs=F.lit(K.LIVE_SECONDS))
